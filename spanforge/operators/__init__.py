"""DataFrame operators over sources, ranges and records."""
