"""The data source "record_ranges": the records of one or more large files, one Spark partition for each planned range.

    register(spark)
    spark.read.format("record_ranges").option("parts", 64).load("/data/big.jsonl")

Options: path (a file, or a JSON list of files), parts (per plan), delimiter (a byte as a number; default 10), worker (read that
range only). The plan is made once, on the driver, by seeking. The files must be reachable under the same path
from all executors; each reads its range in blocks, and fails if a file is not as long as planned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import RECORD_SCHEMA, as_byte, as_parts, as_path
from ..plans.files import open_source, plan_file, plan_files, source_size

BLOCK = 4 << 20
ARROW_SCHEMA = pa.schema([pa.field(n, pa.int64(), False) for n in ("source_index", "range_index", "local_line", "offset")] + [pa.field("record", pa.binary(), False)])


@dataclass
class RangePartition(InputPartition):
    """The ranges that one task reads: (range_index, source_index, path, start, end, size of the file)."""

    ranges: tuple


def _blocks(path: str, start: int, end: int, size: int, delimiter: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(offset, ends of the records in it, bytes): whole records in blocks of about BLOCK bytes."""
    if source_size(path) != size:
        raise OSError(f"{path} has changed since it was planned")
    with open_source(path) as f:
        f.seek(start)
        at, held = start, [b""]
        while at < end:
            data = f.read(min(BLOCK, end - at))
            if not data:
                raise OSError(f"short read: [{start}, {end}) of {path} stopped at {at}")
            at += len(data)
            last = data.rfind(delimiter.to_bytes(1, "big"))
            if last < 0 and at < end:
                held.append(data)
                continue
            cut = last + 1 if at < end else len(data)
            whole = b"".join([*held, data[:cut]])
            held = [data[cut:]]
            if len(whole) >= 1 << 31:
                raise OSError(f"a record of {path} near {at} has 2 GiB or more")
            ends = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == delimiter) + 1
            if not len(ends) or ends[-1] != len(whole):
                if at < size:
                    raise OSError(f"range [{start}, {end}) of {path} splits a record")
                ends = np.append(ends, len(whole))
            yield at - len(held[0]) - len(whole), ends, whole


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path") or ""
        self.paths = [as_path(p) for p in (json.loads(path) if path.startswith("[") else [path])]
        if not path:
            raise ValueError("record_ranges needs a path")
        self.parts = as_parts(int(options.get("parts", "1")))
        self.delimiter = as_byte(int(options.get("delimiter", "10")))
        self.worker = int(options["worker"]) if "worker" in options else None
        if self.worker is not None and not 0 <= self.worker < self.parts:
            raise ValueError("worker must be less than parts")

    def partitions(self) -> list[RangePartition]:
        """One partition for each requested part; parts that collapsed have no ranges."""
        out: list[list] = [[] for _ in range(self.parts)]
        if len(self.paths) == 1:
            plan = plan_file(self.paths[0], self.parts, self.delimiter)
            for r in plan.ranges:
                out[r.index].append((r.index, 0, plan.path, r.start, r.end, plan.file_size))
        else:
            sizes = {p: source_size(p) for p in self.paths}
            for w in plan_files(self.paths, self.parts, self.delimiter):
                p = self.paths[w.source_index]
                out[w.worker_index].append((w.worker_index, w.source_index, p, w.start, w.end, sizes[p]))
        return [RangePartition(tuple(r)) for i, r in enumerate(out) if self.worker in (None, i)]

    def blocks(self, index: int, source: int, path: str, start: int, end: int, size: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """_blocks(), whose failures name worker, source and range."""
        try:
            yield from _blocks(path, start, end, size, self.delimiter)
        except OSError as error:
            raise OSError(f"worker {index}, source {source} ({path}), range [{start}, {end}): {error}") from error

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        for index, source, path, start, end, size in partition.ranges:
            line = 0
            for offset, ends, data in self.blocks(index, source, path, start, end, size):
                n = len(ends)
                begins = np.concatenate(([0], ends[:-1]))
                record = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])
                same = lambda x, k=n: pa.array(np.full(k, x, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([same(source), same(index), pa.array(np.arange(line, line + n)), pa.array(begins + offset), record], schema=ARROW_SCHEMA)
                line += n


class RecordRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_ranges"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


