"""docloom: a PySpark-native engine for document-reconstruction analytics."""
