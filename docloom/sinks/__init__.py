"""Writers: JSON documents, trace lines, slide packages, layer manifests."""
