"""Spark data sources and text forms of plans."""

from pyspark.sql import SparkSession

from .record_documents import RecordDocuments, read_documents
from .record_ranges import RecordRanges
from .tsv import parse_ranges, parse_worker_ranges, ranges_tsv, read_ranges, worker_ranges_tsv

__all__ = ["RecordDocuments", "RecordRanges", "parse_ranges", "parse_worker_ranges", "ranges_tsv", "read_documents", "read_ranges", "register", "worker_ranges_tsv"]


def register(spark: SparkSession) -> None:
    """Makes the formats record_ranges and record_documents known to the session."""
    spark.dataSource.register(RecordRanges)
    spark.dataSource.register(RecordDocuments)
