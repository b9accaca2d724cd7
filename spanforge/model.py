"""Ranges, plans, schemas and the checks on arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import types as T

NEWLINE = 0x0A


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


RANGE_SCHEMA = T.StructType(_longs("index", "start", "end_exclusive", "length"))
SOURCE_RANGE_SCHEMA = T.StructType(_longs("source_index", "index", "start", "end_exclusive", "length"))
WORKER_RANGE_SCHEMA = T.StructType(_longs("worker_index", "source_index", "start", "end_exclusive", "length"))
RECORD_SCHEMA = T.StructType([*_longs("source_index", "range_index", "local_line", "offset"), T.StructField("record", T.BinaryType(), False)])


class PlanError(RuntimeError):
    """A plan does not hold for its source."""


@dataclass(frozen=True)
class Range:
    """The half-open byte range [start, end) of a source."""

    index: int
    start: int
    end: int

    def __post_init__(self) -> None:
        if self.index < 0 or self.start < 0 or self.end < self.start:
            raise ValueError(f"not a range: index {self.index}, [{self.start}, {self.end})")

    @property
    def length(self) -> int:
        return self.end - self.start

    def row(self) -> tuple[int, int, int, int]:
        return self.index, self.start, self.end, self.length


@dataclass(frozen=True)
class Plan:
    """Contiguous ranges that cover one source."""

    path: str
    file_size: int
    requested_parts: int
    delimiter: int
    ranges: tuple[Range, ...]

    @property
    def actual_partitions(self) -> int:
        return len(self.ranges)

    def range_for_part(self, part: int) -> Range | None:
        """The part's range; None for a part that collapsed or never was."""
        return self.ranges[part] if 0 <= part < len(self.ranges) else None

    def to_df(self, spark):
        return spark.createDataFrame([r.row() for r in self.ranges], RANGE_SCHEMA)


@dataclass(frozen=True)
class WorkerRange:
    worker_index: int
    source_index: int
    start: int
    end: int

    def row(self) -> tuple[int, int, int, int, int]:
        return self.worker_index, self.source_index, self.start, self.end, self.end - self.start


def as_parts(parts) -> int:
    if isinstance(parts, bool) or not isinstance(parts, int):
        raise TypeError(f"parts must be an integer, not {type(parts).__name__}")
    if parts <= 0:
        raise ValueError("parts must be positive")
    return parts


def as_byte(delimiter) -> int:
    """One byte, from an integer 0 to 255 or a bytes of length 1."""
    if isinstance(delimiter, (bytes, bytearray)):
        if len(delimiter) != 1:
            raise ValueError("delimiter must be one byte")
        return delimiter[0]
    if isinstance(delimiter, bool):
        raise ValueError("delimiter must be an integer from 0 to 255 or one byte")
    if not isinstance(delimiter, int):
        raise TypeError(f"delimiter must be an integer or bytes, not {type(delimiter).__name__}")
    if not 0 <= delimiter <= 255:
        raise ValueError("delimiter must lie in 0 to 255")
    return delimiter


def as_pattern(pattern) -> bytes:
    """A delimiter of one or more bytes."""
    if isinstance(pattern, int) and not isinstance(pattern, bool):
        return bytes([as_byte(pattern)])
    if not isinstance(pattern, (bytes, bytearray)):
        raise TypeError(f"pattern must be bytes, not {type(pattern).__name__}")
    if not pattern:
        raise ValueError("pattern must not be empty")
    return bytes(pattern)


def as_path(path) -> str:
    """A resolved absolute local path; a URI of another file system stays as it is."""
    if not isinstance(path, (str, bytes, os.PathLike)):
        raise TypeError(f"path must be str, bytes or PathLike, not {type(path).__name__}")
    text = os.fsdecode(path)
    if "\0" in text:
        raise ValueError("path holds a NUL")
    if text.startswith("file:"):
        text = text[5:] if not text.startswith("file://") else text[7:]
    return text if "://" in text else os.path.realpath(text)
