"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from itertools import filterfalse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Append columns, taking the place of columns of the same name (in any letter case)."""
    names = {n.lower() for n in new}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[c.alias(n) for n, c in new.items()])


BATCH_ROWS, BATCH_MB = 2000, 4


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: few rows and megabytes each, or both sides of the pipe hold tens of megabytes a task. A
    session that asks for less keeps its own."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_MB << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shrink_heaps(spark: SparkSession) -> None:
    """Before a stage whose memory lies in Python workers: the executors collect their heaps and give back what earlier stages made them grow
    by. A few short tasks for each core, so that every executor has some."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns under the names c0, c1, ...: names with dots or signs don't reach what resolves names."""
    return df.select(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)])


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these names, in order of its columns."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])


def one_of_each(rows: DataFrame, keys: list[Column], columns: list[str]) -> DataFrame:
    """One row for each value of keys, of the least digest of columns; tasks choose among their own rows before any meet."""
    own = [F.col(f"`{c}`") for c in columns]
    names = [f"__key{i}" for i in range(len(keys))]
    digest = F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])))
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])
    least = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], row.alias("__row"), digest.alias("__digest")).groupBy(*names).agg(F.min_by("__row", "__digest").alias("__row"))
    return least.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(columns)])


def bucket_count(rows: int, per_bucket: int, most: int = 1 << 20) -> int:
    return max(1, min(most, -(-rows // per_bucket)))


_kept: dict = {}


def worker_keeps(key, make: Callable):
    """make(), kept in a Python worker for its later tasks with that key. Only one thing is kept: tasks of another
    operator in the same worker give its memory back."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class Bounded(dict):
    """A table that is emptied by make_room() when its keys and values have passed `most` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def put(self, key, value, size: int) -> None:
        """size: bytes of key and value; what Python adds to them is counted here."""
        self[key] = value
        self.held += size + 200

    def make_room(self) -> None:
        if self.held > self.most:
            self.empty()

    def empty(self) -> None:
        self.clear()
        self.held = 0


class Recent(Bounded):
    """A table of at most `most` bytes in two halves: when the newer one is full it becomes the older, whose keys come back as they are met."""

    def __init__(self, most: int):
        super().__init__(most // 2)
        self.older, self.each = {}, 0.0

    def missing(self, keys: set) -> list:
        """Those of keys that neither half has; those of the older half come into the newer."""
        out = []
        for key in filterfalse(self.__contains__, keys):  # set.difference() would go through all of a table that is no plain dict
            got = self.older.pop(key, None)
            if got is None:
                out.append(key)
            else:
                self[key] = got
                self.held += self.each
        return out

    def make_room(self) -> None:
        if self.held > self.most:
            self.older, self.each = dict(self), self.held / len(self)
            self.empty()


def worker_keeps_nothing() -> None:
    _kept.clear()


def give_memory_back(keep=None) -> None:
    """At a task's end: what a Python worker has freed goes back to the system, as the worker stays for other tasks; so does what
    worker_keeps() made for another key than `keep`."""
    import ctypes
    import gc

    import pyarrow as pa

    for key in [k for k in _kept if k != keep]:
        del _kept[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return
