"""Plans as tab-separated numbers without a header."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RANGE_SCHEMA, Range, WorkerRange


def ranges_tsv(ranges: Iterable[Range]) -> str:
    """index, start, end, length."""
    return "".join("\t".join(map(str, r.row())) + "\n" for r in ranges)


def worker_ranges_tsv(rows: Iterable[WorkerRange]) -> str:
    """worker, source, start, end, length."""
    return "".join("\t".join(map(str, r.row())) + "\n" for r in rows)


def _numbers(text: bytes | str, columns: int) -> Iterable[list[int]]:
    lines = (text if isinstance(text, str) else text.decode("ascii")).splitlines()
    for n, line in enumerate(lines, 1):
        fields = line.split("\t")
        if len(fields) != columns or not all(f.isascii() and f.isdigit() for f in fields):
            raise ValueError(f"line {n}: expected {columns} numbers")
        yield [int(f) for f in fields]


def parse_ranges(text: bytes | str) -> list[Range]:
    out = []
    for index, start, end, length in _numbers(text, 4):
        if length != end - start:
            raise AssertionError(f"range {index}: length {length} is not {end} - {start}")
        out.append(Range(index, start, end))
    return out


def parse_worker_ranges(text: bytes | str) -> list[WorkerRange]:
    return [WorkerRange(w, s, a, b) for w, s, a, b, _ in _numbers(text, 5)]


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A range file as a DataFrame; a malformed line or a wrong length fails the query."""
    rows = spark.read.schema(RANGE_SCHEMA).csv(path, sep="\t", mode="FAILFAST")
    wrong = F.col("length") != F.col("end_exclusive") - F.col("start")
    return rows.withColumn("length", F.when(wrong, F.raise_error(F.lit("length is not end - start"))).otherwise(F.col("length")).cast("long"))
