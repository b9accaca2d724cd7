"""Checks of plans and of what was read by them, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytescan as B
from ..model import as_byte


def coverage(ranges: DataFrame, sources: DataFrame, data: str, key: str) -> DataFrame:
    """(key, covered, size, whole): whether the ranges' lengths add up to the source's."""
    held = ranges.groupBy(key).agg(F.sum("length").alias("covered"))
    sized = sources.select(key, B.byte_length(F.col(data)).alias("size"))
    out = sized.join(held, key, "left").select(key, F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), "size")
    return out.withColumn("whole", F.col("covered") == F.col("size"))


def contiguity(ranges: DataFrame, key: str) -> DataFrame:
    """(key, index, contiguous): each range is not empty and begins where the one before ended, the first at 0."""
    before = F.lag("end_exclusive", 1, 0).over(Window.partitionBy(key).orderBy("index"))
    return ranges.select(key, "index", ((F.col("start") == before) & (F.col("length") > 0)).alias("contiguous"))


def alignment(ranges: DataFrame, data: str, key: str, delimiter=0x0A) -> DataFrame:
    """(key, index, aligned): the byte before a range other than the first, and the last byte of one other than the last, are the delimiter."""
    mark = F.lit(bytearray([as_byte(delimiter)]))
    final = F.col("end_exclusive") == B.byte_length(F.col(data))
    head = (F.col("start") == 0) | (F.substring(data, F.col("start").cast("int"), F.lit(1)) == mark)
    tail = final | (F.substring(data, F.col("end_exclusive").cast("int"), F.lit(1)) == mark)
    return ranges.select(key, "index", (head & tail).alias("aligned"))


def workers_in_order(plan: DataFrame) -> DataFrame:
    """(source_index, in_order): a source's ranges follow on each other from 0, with rising workers, which are numbered without gaps."""
    order = Window.partitionBy("source_index").orderBy("start")
    each = plan.select("source_index", (F.lag("end_exclusive", 1, 0).over(order) == F.col("start")).alias("on"), (F.col("worker_index") > F.lag("worker_index", 1, -1).over(order)).alias("up"))
    numbers = plan.agg((F.max("worker_index") + 1 == F.count_distinct("worker_index")).alias("dense"))
    return each.groupBy("source_index").agg((F.bool_and("on") & F.bool_and("up")).alias("fine")).crossJoin(F.broadcast(numbers)).select("source_index", (F.col("fine") & F.col("dense")).alias("in_order"))


def worker_plan_faults(plan: DataFrame, sources: DataFrame, data: str, key: str = "source_index", delimiter=0x0A) -> DataFrame:
    """(fault, source_index, worker_index, start) of a plan over several sources: empty if it holds.

    Looked at: known sources, bounds, lengths, no empty ranges, record edges; in each source no gap or overlap, whole cover and workers that don't
    fall; workers numbered from 0 without gaps, each behind the one before in source and place; bytes of all workers against bytes of all sources.
    """
    mark = F.lit(bytearray([as_byte(delimiter)]))
    at = lambda c: F.substring(F.col("__data"), F.col(c).cast("int"), F.lit(1))
    size = B.byte_length(F.col("__data"))
    held = sources.select(F.col(key).cast("long").alias("__key"), F.col(data).alias("__data"))
    rows = plan.join(held, F.col("source_index") == F.col("__key"), "full_outer")
    order = Window.partitionBy("__source").orderBy("start")
    rows = rows.withColumn("__source", F.coalesce("source_index", "__key"))
    # the bytes stay behind: windows see numbers only
    rows = rows.select(
        "__source", "worker_index", "start", "end_exclusive", "length", size.alias("size"),
        F.col("__key").isNull().alias("unknown"),
        ((F.col("start") > 0) & (F.col("start") < size) & (at("start") != mark)).alias("head"),
        ((F.col("end_exclusive") > 0) & (F.col("end_exclusive") < size) & (at("end_exclusive") != mark)).alias("tail"),
    )
    before, last = F.lag("end_exclusive", 1, 0).over(order), F.lead("start").over(order).isNull()
    rows = rows.select("*", before.alias("before"), last.alias("last"), F.lag("worker_index").over(order).alias("worker_before"))
    checks = {
        "unknown source": F.col("unknown") | (F.col("__source") < 0), "worker below 0": F.col("worker_index") < 0,
        "out of bounds": (F.col("start") < 0) | (F.col("start") > F.col("end_exclusive")) | (F.col("end_exclusive") > F.col("size")),
        "length": F.col("end_exclusive") - F.col("start") != F.col("length"), "empty range": F.col("length") <= 0,
        "start splits a record": F.col("head"), "end splits a record": F.col("tail"),
        "gap or overlap": F.col("start") != F.col("before"), "worker falls": F.col("worker_index") < F.col("worker_before"),
        "source not covered": F.when(F.col("start").isNull(), F.col("size") > 0).otherwise(F.col("last") & (F.col("end_exclusive") != F.col("size"))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    each = rows.select(F.explode(found).alias("fault"), F.col("__source").alias("source_index"), "worker_index", "start")
    # a row a worker from here on
    place = F.struct("source_index", "start")
    workers = plan.groupBy("worker_index").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    line = Window.orderBy("worker_index")
    workers = workers.select("*", F.lag("worker_index", 1, -1).over(line).alias("prior"), F.lag("hi").over(line).alias("prior_hi"))
    gaps = {"workers not compact": F.col("worker_index") != F.col("prior") + 1, "workers out of order": F.col("lo") <= F.col("prior_hi")}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in gaps.items()]), lambda x: x.isNotNull())
    return each.unionByName(workers.select(F.explode(found).alias("fault"), F.col("lo.source_index").alias("source_index"), "worker_index", F.col("lo.start").alias("start")))


def exactly_once(seen: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """Keys that were not read as often as expected: (*key, seen, expected). Empty if all is well."""
    counted = [df.groupBy(*key).agg(F.count("*").alias(n)) for df, n in ((seen, "seen"), (expected, "expected"))]
    both = counted[0].join(counted[1], list(key), "full_outer").na.fill(0, ["seen", "expected"])
    return both.where("seen <> expected")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two runs has and the other has not."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def order_free_checksum(rows: DataFrame, *key: Column | str, buckets: int = 1024) -> DataFrame:
    """(checksum): SHA-256 over the sorted lines key:key:count of the distinct keys, first within buckets of equal leading hash, then over the buckets."""
    counted = rows.groupBy(*key).count()
    line = F.concat_ws(":", *[c if isinstance(c, Column) else F.col(c) for c in key], F.col("count"))
    held = counted.select(line.alias("line")).groupBy(F.pmod(F.crc32(F.col("line").cast("binary")), F.lit(buckets)).alias("b"))
    parts = held.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("checksum"))


def additive_checksum(rows: DataFrame, *key: str) -> DataFrame:
    """(n, high, low): how many rows, and the sums of both halves of the MD5 of "key:...": equal for equal rows in any order, and additive
    over parts of them. Every task adds up its own rows; nothing is collected."""
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]).cast("binary"))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), half(1).alias("high"), half(16).alias("low"))


def sorted_checksum(rows: DataFrame, *key: str) -> DataFrame:
    """(checksum): SHA-256 over the sorted lines "key:...:count\\n" of the distinct keys, in one piece: for as many keys as one task can hold."""
    counted = rows.groupBy(*key).count()
    line = F.concat_ws(":", *key, "count")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*key, line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    return counted.agg(F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("checksum"))
