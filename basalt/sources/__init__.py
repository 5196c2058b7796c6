"""Sources: files, tables and manifests."""
