"""Record-aligned byte-range planning and processing on Spark DataFrames."""

__version__ = "0.1.0"


def capabilities() -> frozenset[str]:
    """What this package plans and reads."""
    return frozenset({"delimited", "pattern", "fixed", "partition", "multi_source", "cursor", "record_ranges", "json_documents"})
