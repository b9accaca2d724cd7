"""Planning over files: only the bytes near the aims are read."""
