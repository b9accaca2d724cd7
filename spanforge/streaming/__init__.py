"""Ranges and records one at a time, in bounded memory, without a plan of the whole file."""

from .cursor import RangeCursor, checksum, read_range, read_records

__all__ = ["RangeCursor", "checksum", "read_range", "read_records"]
