"""Column functions: geometry, text and quality predicates."""
