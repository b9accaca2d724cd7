"""Plans over a DataFrame whose rows are sources: one BINARY column each, and a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytescan as B
from ..model import WORKER_RANGE_SCHEMA, as_byte, as_parts

SOURCES_PER_RUN = 10_000
#: Up to so many parts the aims, one row a part, are sent to the sources; more parts meet them by key.
BROADCAST_PARTS = 200_000


def explode_ranges(sources: DataFrame, ranges: Column, *keep: str) -> DataFrame:
    """One row a range: the kept columns, index, start, end_exclusive, length. Sources without ranges give none."""
    rows = sources.select(*keep, F.posexplode(ranges).alias("index", "r"))
    return rows.select(*keep, F.col("index").cast("long").alias("index"), "r.start", "r.end_exclusive", (F.col("r.end_exclusive") - F.col("r.start")).alias("length"))


def delimited(sources: DataFrame, data: str, chunk_size: int, pattern=b"\n", *keep: str) -> DataFrame:
    return explode_ranges(sources, B.delimited_ranges(F.col(data), chunk_size, pattern), *keep)


def fixed(sources: DataFrame, data: str, chunk_size: int, *keep: str) -> DataFrame:
    return explode_ranges(sources, B.fixed_ranges(F.col(data), chunk_size), *keep)


def partitioned(sources: DataFrame, data: str, parts: int, delimiter=0x0A, *keep: str) -> DataFrame:
    return explode_ranges(sources, B.partition_ranges(F.col(data), parts, delimiter), *keep)


def worker(ranges: DataFrame, index: int, parts: int) -> DataFrame:
    """The ranges with that index: none where parts collapsed. An index outside the request fails."""
    if not 0 <= index < as_parts(parts):
        raise ValueError("worker must be less than parts")
    return ranges.where(F.col("index") == index)


def running_start(rows: DataFrame, order: str, value: str, name: str, per_run: int = SOURCES_PER_RUN) -> DataFrame:
    """rows with the sum of value over all rows before it by the integer column order: within runs of per_run numbers, then over the runs."""
    run = F.expr(f"{order} div {per_run}")
    numbered = rows.withColumn("__run", run)
    sums = numbered.groupBy("__run").agg(F.sum(value).alias("__sum"))
    base = sums.select("__run", (F.sum("__sum").over(Window.orderBy("__run")) - F.col("__sum")).alias("__base"))  # a row for per_run sources
    inner = Window.partitionBy("__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.join(base, "__run").withColumn(name, F.col("__base") + F.sum(value).over(inner) - F.col(value)).drop("__run", "__base")


def multi_source(sources: DataFrame, data: str, parts: int, delimiter=0x0A, order: str = "source_index") -> DataFrame:
    """WORKER_RANGE_SCHEMA rows: the sources, in order of their index, shared out to at most parts workers.

    The aims are equal cuts of the total length. An aim at a source's start stays; any other moves to the end of the record
    that holds it, where a source's end ends a record too. Aims at or before the last cut are passed over. Each source finds the
    aims that fall into it by arithmetic and reads no other source; only the cuts, one a part at most, are folded on the driver.
    """
    spark, parts, byte = sources.sparkSession, as_parts(parts), as_byte(delimiter)
    sized = sources.select(F.col(order).cast("long").alias("source_index"), F.col(data).alias("data"), B.byte_length(F.col(data)).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], WORKER_RANGE_SCHEMA)
    n = min(parts, total)
    placed = running_start(sized.select("source_index", "size"), "source_index", "size", "prefix")
    lo, hi = f"greatest(ceil(cast(prefix as decimal(38,0)) * {n} / {total}) - 1, 1)", f"least(ceil(cast(prefix + size as decimal(38,0)) * {n} / {total}), {n - 1})"  # one more on each side, as quotients are rounded
    aims = placed.where("size > 0").select("*", F.expr(lo).cast("long").alias("lo"), F.expr(hi).cast("long").alias("hi")).where("lo <= hi")
    aims = aims.select("source_index", "prefix", "size", F.explode(F.expr("sequence(lo, hi)")).alias("i"))
    aims = aims.withColumn("aim", F.expr(f"cast(floor(cast(i as decimal(38,0)) * {total} / {n}) as bigint)"))
    # decimal quotients are rounded: put the aim right by one where the product says so
    aims = aims.withColumn("aim", F.expr(f"aim + CASE WHEN cast(aim + 1 as decimal(38,0)) * {n} <= cast(i as decimal(38,0)) * {total} THEN 1 WHEN cast(aim as decimal(38,0)) * {n} > cast(i as decimal(38,0)) * {total} THEN -1 ELSE 0 END"))
    aims = aims.where("aim >= prefix AND aim < prefix + size")
    # a row a part at most; only sources with an aim in them are looked into, where they lie
    small = F.broadcast(aims) if n <= BROADCAST_PARTS else aims
    found = sized.select(F.col("source_index").alias("__s"), "data").join(small, F.col("source_index") == F.col("__s"))
    behind = B.find_from(F.col("data"), byte, F.col("aim") - F.col("prefix"))
    end = F.when(F.col("aim") == F.col("prefix"), F.col("aim")).when(behind > 0, F.col("prefix") + behind).otherwise(F.col("prefix") + F.col("size"))
    cuts, last = [], 0
    for aim, moved in found.select("aim", end.alias("moved")).orderBy("aim").toLocalIterator():
        if aim <= last or moved <= last:
            continue
        if moved == total:
            break
        cuts.append(moved)
        last = moved
    edges = [0, *cuts, total]
    width = -(-total // n)  # sources and workers meet in stretches of so many bytes: a row for each stretch that they reach into
    spans = spark.createDataFrame([(w, s, e) for w, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "worker_index long, s long, e long")
    spans = spans.select("*", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")).alias("at"))
    reach = placed.where("size > 0").select("source_index", "prefix", "size", F.explode(F.expr(f"sequence(prefix div {width}, (prefix + size - 1) div {width})")).alias("__at"))
    met = reach.join(F.broadcast(spans) if n <= BROADCAST_PARTS else spans, F.expr(f"__at = at AND s < prefix + size AND prefix < e AND at = greatest(s, prefix) div {width}"))
    out = met.select("worker_index", "source_index", F.expr("greatest(s, prefix) - prefix").alias("start"), F.expr("least(e, prefix + size) - prefix").alias("end_exclusive"))
    return out.select("worker_index", "source_index", "start", "end_exclusive", (F.col("end_exclusive") - F.col("start")).alias("length"))


def framed(sources: DataFrame, data: str, delimiter=0x0A, *keep: str) -> DataFrame:
    """One row a record, without its delimiter: kept columns, line_index, offset, record.

    Arrow batches: the records are slices of the source's bytes, their offsets a running sum in its task, so nothing is shuffled.
    """
    byte = as_byte(delimiter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _frames(batch, byte)
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)

    out = T.StructType([*sources.select(*keep).schema.fields, T.StructField("line_index", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("record", T.BinaryType())])
    return sources.select(*keep, data).mapInArrow(run, out)


def _frames(batch: pa.RecordBatch, byte: int) -> pa.RecordBatch:
    """The records of all values in the last column at once, with the other columns of their rows."""
    data = batch.column(batch.num_columns - 1).cast(pa.binary())
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.empty(0, dtype=np.uint8)
    at -= at[0]
    marks = np.flatnonzero(raw == byte)
    open_ = np.flatnonzero(at[1:] > at[:-1])
    open_ = open_[raw[at[open_ + 1] - 1] != byte]  # rows whose last record has no delimiter
    row = np.concatenate((open_, np.searchsorted(at, marks, side="right") - 1))
    end = np.concatenate((at[open_ + 1], marks))
    order = np.argsort(end, kind="stable")  # a row's end comes before a delimiter at the next one's start
    row, end = row[order], end[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    begin = at[row]
    begin[~first] = end[np.flatnonzero(~first) - 1] + 1
    inside = np.ones(len(raw), dtype=bool)
    inside[marks] = False
    sizes = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    record = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(sizes), pa.py_buffer(raw[inside])])
    starts = np.flatnonzero(first)
    line = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    take = pa.array(row)
    kept = [c.take(take) for c in batch.columns[:-1]]
    return pa.RecordBatch.from_arrays([*kept, pa.array(line), pa.array(begin - at[row]), record], names=[*batch.schema.names[:-1], "line_index", "offset", "record"])


def framed_by_range(sources: DataFrame, data: str, parts: int, delimiter=0x0A, *keep: str) -> DataFrame:
    """framed(), and range_index: the range of a plan of each source in `parts` that the record lies in."""
    planned = sources.select(*keep, B.partition_ranges(F.col(data), parts, delimiter).alias("__ranges"), data)
    rows = framed(planned, data, delimiter, *keep, "__ranges")
    number = F.size(F.filter("__ranges", lambda r: r["start"] <= F.col("offset"))) - 1
    return rows.withColumn("range_index", number.cast("long")).drop("__ranges")


def payloads(ranges: DataFrame, data: str) -> DataFrame:
    """ranges (with the source's data column) and the bytes of each."""
    return ranges.withColumn("payload", B.payload(F.col(data), F.col("start"), F.col("length")))


def record_offsets(sources: DataFrame, data: str, parts: int, key: str, delimiter=0x0A) -> DataFrame:
    """(key, index, record_offset): the number of the first record of each range of a plan among the source's records. One fold over the ranges
    of a source, in its row."""
    mark = bytes([as_byte(delimiter)])
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("n"), F.array().cast("array<bigint>").alias("out"), F.col(data).alias("data"))

    def step(state: Column, r: Column) -> Column:
        inside = B.count_of(B.payload(state["data"], r["start"], r["end_exclusive"] - r["start"]), mark)
        return F.struct((state["n"] + inside).alias("n"), F.array_append(state["out"], state["n"]).alias("out"), state["data"].alias("data"))

    firsts = F.aggregate(B.partition_ranges(F.col(data), parts, delimiter), begin, step, lambda s: s["out"])
    return sources.select(key, F.posexplode(firsts).alias("index", "record_offset")).select(key, F.col("index").cast("long").alias("index"), "record_offset")


def worker_rows(plan: DataFrame) -> DataFrame:
    """The rows of each worker together: worker_index, rows (in source order)."""
    return plan.groupBy("worker_index").agg(F.array_sort(F.collect_list(F.struct("source_index", "start", "end_exclusive", "length"))).alias("rows"))


def worker_stats(plan: DataFrame) -> DataFrame:
    """One row: workers, ranges, bytes, the least and most bytes of a worker, and most / mean."""
    each = plan.groupBy("worker_index").agg(F.count("*").alias("ranges"), F.sum("length").alias("bytes"))
    return each.agg(
        F.count("*").alias("workers"), F.sum("ranges").alias("ranges"), F.sum("bytes").alias("bytes"),
        F.min("bytes").alias("least_bytes"), F.max("bytes").alias("most_bytes"), (F.max("bytes") / F.avg("bytes")).alias("imbalance"),
    )
