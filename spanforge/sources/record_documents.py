"""The data source "record_documents": JSON lines of large files as documents, one Spark partition for each planned range.

    read_documents(spark, "/data/big.jsonl", parts=64)

plans the files, counts the records of every range in one pass on the cluster (a row a range comes back), and loads

    spark.read.format("record_documents").option("parts", 64).option("bases", ...).load(path)

so that every document knows its line number in its file and nothing is shuffled. Without the option `bases` the planner counts by
itself, which suits small files.

Options: path, parts, worker as for record_ranges, delimiter is a newline; world_size (must equal parts) and rank (reads that
range only); text_key, id_key, default_metadata (a JSON object), add_file_path (true or false), skip and limit (per range), keep_empty;
adapter ("module:function", called with a record's object, the file's name and the line number; it returns an object with text, id, media, metadata).

Lines that are not UTF-8 or not JSON objects are left out, but keep their line number.
"""

from __future__ import annotations

import base64
import binascii
import importlib
import json
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..model import Plan, as_path
from .record_ranges import RangePartition, RecordReader

DOCUMENT_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("source_index", "range_index", "line_index")]
    + [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("media", T.ArrayType(T.BinaryType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
ARROW_SCHEMA = pa.schema([*[pa.field(n, pa.int64(), False) for n in ("source_index", "range_index", "line_index")], ("id", pa.string()), ("text", pa.string()), ("media", pa.list_(pa.binary())), ("metadata", pa.map_(pa.string(), pa.string()))])


def _as_string(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _media(items) -> list[bytes | None]:
    """The bytes of each medium; base64 may hold signs of no meaning."""
    out = []
    for item in items or []:
        coded = item.get("media_bytes") if isinstance(item, dict) else None
        try:
            out.append(None if coded is None else coded if isinstance(coded, bytes) else base64.b64decode(coded))
        except (binascii.Error, ValueError):
            out.append(None)
    return out


class DocumentReader(RecordReader):
    def __init__(self, options: dict):
        super().__init__(options)
        if "world_size" in options and int(options["world_size"]) != self.parts:
            raise ValueError(f"world_size {options['world_size']} is not the plan's number of parts, {self.parts}")
        if "rank" in options:
            self.worker = int(options["rank"])
            if not 0 <= self.worker < self.parts:
                raise ValueError(f"rank {self.worker} must lie in 0 to {self.parts - 1}")
        self.text_key, self.id_key = options.get("text_key", "text"), options.get("id_key", "id")
        self.default_metadata = json.loads(options.get("default_metadata", "{}"))
        self.add_file_path, self.keep_empty = (options.get(k, "false").lower() == "true" for k in ("add_file_path", "keep_empty"))
        self.skip, self.limit = int(options.get("skip", "0")), int(options.get("limit", "-1"))
        self.bases = {(s, r): n for s, r, n in json.loads(options["bases"])} if "bases" in options else None
        self.adapter = options.get("adapter")

    def partitions(self) -> list[RangePartition]:
        """The planned ranges, each with the number of its first record."""
        worker, self.worker = self.worker, None
        planned = super().partitions()
        self.worker = worker
        bases, at = self.bases, {}
        if bases is None:
            bases = {}
            for index, source, path, start, end, size in (r for p in planned for r in p.ranges):
                bases[source, index] = at.get(source, 0)
                at[source] = bases[source, index] + sum(len(ends) for _, ends, _ in self.blocks(index, source, path, start, end, size))
        out = [RangePartition(tuple((*r, bases[r[1], r[0]]) for r in p.ranges)) for p in planned]
        return [p for i, p in enumerate(out) if worker in (None, i)]

    def _adapted(self) -> Callable[[dict, str, int], dict]:
        if self.adapter:
            module, _, name = self.adapter.partition(":")
            return getattr(importlib.import_module(module), name)

        def plain(record: dict, name: str, line: int) -> dict:
            rest = {k: v for k, v in record.items() if k not in (self.text_key, self.id_key, "media", "metadata")}
            inner = record.get("metadata")
            return {"text": record.get(self.text_key), "id": record.get(self.id_key), "media": record.get("media"), "metadata": (inner if isinstance(inner, dict) else {}) | rest}

        return plain

    def _documents(self, index: int, path: str, base: int, blocks) -> Iterator[tuple]:
        """(line, id, text, media, metadata) of the records that are documents."""
        adapt, name, line = self._adapted(), os.path.basename(path), base
        for _, ends, data in blocks:
            begin = 0
            for end in ends.tolist():
                raw, at, begin, line = data[begin:end], line, end, line + 1
                try:
                    record = json.loads(raw.decode())
                except (UnicodeDecodeError, json.JSONDecodeError):
                    continue
                if not isinstance(record, dict):
                    continue
                try:
                    doc = adapt(record, name, at)
                except Exception as error:
                    raise RuntimeError(f"worker {index}, {path}, line {at}: {type(error).__name__}: {error}") from error
                text, media = _as_string(doc.get("text")) or "", _media(doc.get("media"))
                if not (text or media or self.keep_empty):
                    continue
                metadata = self.default_metadata | (doc.get("metadata") or {})
                if self.add_file_path:
                    metadata["file_path"] = path
                own = doc.get("id")
                yield at, f"{name}/{at}" if own is None else _as_string(own), text, media, [(k, _as_string(v)) for k, v in metadata.items()]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        for index, source, path, start, end, size, base in partition.ranges:
            rows: list[tuple] = []
            held, seen = 0, 0
            for row in self._documents(index, path, base, self.blocks(index, source, path, start, end, size)):
                seen += 1
                if seen <= self.skip:
                    continue
                if 0 <= self.limit <= seen - 1 - self.skip:
                    break
                rows.append(row)
                held += len(row[2])
                if len(rows) >= 4096 or held > 4 << 20:
                    yield self._batch(source, index, rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(source, index, rows)

    @staticmethod
    def _batch(source: int, index: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[source] * len(rows), [index] * len(rows), *map(list, zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_SCHEMA, strict=True)], schema=ARROW_SCHEMA)


class RecordDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_documents"

    def schema(self):
        return DOCUMENT_SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def range_bases(spark: SparkSession, path: str, parts: int) -> list[tuple[int, int, int]]:
    """(source_index, range_index, number of the first record) of every range: one pass of counting, a row a range."""
    records = spark.read.format("record_ranges").option("parts", parts).load(path).select("source_index", "range_index")
    counts = sorted(records.groupBy("source_index", "range_index").agg(F.count("*")).collect())
    out, at = [], {}
    for source, index, n in counts:
        out.append((source, index, at.get(source, 0)))
        at[source] = at.get(source, 0) + n
    return out


def read_documents(spark: SparkSession, paths, parts: int, plan: Plan | None = None, upstream: DataFrame | None = None, **options) -> DataFrame:
    """The documents of one file or an ordered list of files, read in `parts` ranges (options as for the data source).

    plan: a plan made for the file before; ValueError if it is another file's or asks for other parts. upstream: rows that come with
    the reader's. A range that collapsed gives no rows.
    """
    from . import register

    names = [as_path(p) for p in paths] if isinstance(paths, Sequence) and not isinstance(paths, (str, bytes)) else [as_path(paths)]
    if plan is not None:
        if names != [plan.path]:
            raise ValueError(f"the plan is one of {plan.path}, not of {', '.join(names)}")
        if plan.requested_parts != parts:
            raise ValueError(f"the plan asks for {plan.requested_parts} parts, not {parts}")
    DocumentReader({"path": json.dumps(names), "parts": str(parts), **{k: _as_option(v) for k, v in options.items()}})  # complains here, not in a task
    register(spark)
    path = json.dumps(names)
    options["bases"] = json.dumps(range_bases(spark, path, parts))
    out = spark.read.format("record_documents").option("parts", parts).options(**{k: _as_option(v) for k, v in options.items()}).load(path)
    return out if upstream is None else upstream.unionByName(out, allowMissingColumns=True)


def _as_option(value) -> str:
    return json.dumps(value) if isinstance(value, dict) else str(value).lower() if isinstance(value, bool) else str(value)
