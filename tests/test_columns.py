"""Column expressions against golden vectors and the plain planners."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import bytescan as B
from spanforge.operators import ranges as R
from spanforge.operators import verify as V

from . import semantics as S


def frame(spark, values):
    return spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "k long, data binary")


def got(df, expression):
    rows = df.select("k", expression.alias("r")).orderBy("k").collect()
    return [[(x["start"], x["end_exclusive"]) for x in r["r"]] for r in rows]


DELIMITED = [
    (b"", 1024, b"\n", []),
    (b"first\nother\n", 1024, b"\n", [(0, 12)]),
    (b"one\ntwo\nsix\nten\nsum\n", 6, b"\n", [(0, 8), (8, 16), (16, 20)]),
    (b"one\ntwo\nand a long rest.", 4, b"\n", [(0, 8), (8, 24)]),
    (b"one long record.", 5, b"\n", [(0, 16)]),
    (b"before\0behind\n", 100, b"\n", [(0, 14)]),
    (b"xxxx\n", 5, b"\n", [(0, 5)]),
    (b"a\r\nb\r\nc\r\n", 4, b"\r\n", [(0, 6), (6, 9)]),
    (b"\r\n\r\n\r\n", 1, b"\r\n", [(0, 4), (4, 6)]),
    (b"Subject: x1\r\n\r\ntext", 1024, b"\r\n\r\n", [(0, 19)]),
    (b"a||b||c||d", 4, b"||", [(0, 6), (6, 10)]),
    (bytes.fromhex("AB00FF00CD00FF00EF"), 4, bytes.fromhex("00FF00"), None),
    (b"hi", 1024, b"\r\n\r\n\r\n", [(0, 2)]),
    (b"xaaaay", 1, b"aa", [(0, 3), (3, 6)]),
]


@pytest.mark.parametrize(("data", "size", "pattern", "want"), DELIMITED)
def test_delimited_golden(spark, data, size, pattern, want):
    want = S.delimited(data, size, pattern) if want is None else want
    assert got(frame(spark, [data]), B.delimited_ranges(F.col("data"), size, pattern)) == [want]


PARTITION = [
    (b"", 4, 10, []),
    (b"a\nb\nc\n", 1 << 40, 10, [(0, 2), (2, 4), (4, 6)]),
    (b"first\nother\n", 1, 10, [(0, 12)]),
    (b"one long record.", 8, 10, [(0, 16)]),
    (b"a" * 20 + b"\nb\n", 8, 10, [(0, 21), (21, 23)]),
    (b"a\n\n\nb\n", 8, 10, [(0, 2), (2, 4), (4, 6)]),
    (b"aa\nbbbb\ncccccccccccc\ndd\n", 4, 10, [(0, 8), (8, 21), (21, 24)]),
    (b"\n" * 5, 4, 10, [(0, 2), (2, 4), (4, 5)]),
    (b"a\r\nb\r\nc\r\n", 2, 13, [(0, 5), (5, 9)]),
]


@pytest.mark.parametrize(("data", "parts", "byte", "want"), PARTITION)
def test_partition_golden(spark, data, parts, byte, want):
    assert got(frame(spark, [data]), B.partition_ranges(F.col("data"), parts, byte)) == [want]


def test_fixed(spark):
    data = [b"", b"x", b"x" * 9, b"x" * 16]
    assert got(frame(spark, data), B.fixed_ranges(F.col("data"), 4)) == [S.fixed(d, 4) for d in data]
    assert got(frame(spark, data), B.fixed_ranges(F.col("data"), 0)) == [S.fixed(d, 1) for d in data]
    counts = frame(spark, data).select("k", B.fixed_count(F.col("data"), 4).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in counts] == [0, 1, 3, 4]
    at = frame(spark, data).select("k", B.fixed_bounds(F.col("data"), 4, 2).alias("r")).orderBy("k").collect()
    assert [r["r"] and tuple(r["r"]) for r in at] == [None, None, (8, 9), (8, 12)]


def random_data(rng, n):
    alphabet = rng.choice([b"a\n", b"ab\n", b"\x00\xff\n", b"aa\nb"])
    return [bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_against_the_plain_planners(spark, seed):
    rng = random.Random(seed)
    data = random_data(rng, 300)
    df = frame(spark, data).cache()
    for size in (0, 1, 3, 10):
        pattern = rng.choice([b"\n", b"aa", b"\n\n", b"a\n", b"\xff"])
        assert got(df, B.delimited_ranges(F.col("data"), size, pattern)) == [S.delimited(d, size, pattern) for d in data], (size, pattern)
    for parts in (1, 2, 5, 100, 1000):
        byte = rng.choice([10, ord("a"), 255])
        assert got(df, B.partition_ranges(F.col("data"), parts, byte)) == [S.partition(d, parts, byte) for d in data], (parts, byte)
    df.unpersist()


@pytest.mark.parametrize("seed", range(3))
def test_several_sources(spark, seed):
    rng = random.Random(seed)
    data = random_data(rng, 9)
    df = frame(spark, data).withColumnRenamed("k", "source_index")
    for parts in (1, 3, 8, 500):
        rows = R.multi_source(df, "data", parts).orderBy("worker_index", "source_index").collect()
        assert [tuple(r)[:4] for r in rows] == S.multi(data, parts, 10), parts
    assert V.workers_in_order(R.multi_source(df, "data", 3)).where(~F.col("in_order")).isEmpty()


def test_running_start_over_several_runs(spark):
    df = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    rows = R.running_start(df, "i", "v", "before", per_run=8).orderBy("i").collect()
    assert [r["before"] for r in rows] == [sum(j % 7 for j in range(i)) for i in range(50)]


def test_checks_find_faults(spark):
    df = frame(spark, [b"ab\ncd\nef\n"])
    bad = spark.createDataFrame([(0, 0, 0, 2, 2), (0, 1, 3, 9, 6)], "k long, index long, start long, end_exclusive long, length long")
    assert not V.coverage(bad, df, "data", "k").first()["whole"]
    assert [r["contiguous"] for r in V.contiguity(bad, "k").orderBy("index").collect()] == [True, False]
    assert [r["aligned"] for r in V.alignment(bad.join(df, "k"), "data", "k").orderBy("index").collect()] == [False, True]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "id int"), spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(map(tuple, V.exactly_once(a, b, "id").collect())) == [(1, 2, 1), (3, 0, 1)]
    assert V.order_free_checksum(a, "id").first() == V.order_free_checksum(a.orderBy(F.desc("id")), "id").first() != V.order_free_checksum(b, "id").first()


def test_binary_framing(spark):
    df = frame(spark, [b"ab\xffcd\xff\xff\x80e", b"", b"\xff"])
    rows = R.framed(df, "data", 0xFF, "k").orderBy("k", "line_index").collect()
    assert [(r["k"], r["offset"], bytes(r["record"])) for r in rows] == [(0, 0, b"ab"), (0, 3, b"cd"), (0, 6, b""), (0, 7, b"\x80e"), (2, 0, b"")]


def test_search_beyond_the_first_block(spark, monkeypatch):
    monkeypatch.setattr(B, "SEARCH_BLOCK", 4)
    rng = random.Random(8)
    data = random_data(rng, 200) + [b"x" * 50 + b"\n" + b"y" * 3]
    df = frame(spark, data)
    for parts in (2, 5, 100):
        assert got(df, B.partition_ranges(F.col("data"), parts, 10)) == [S.partition(d, parts, 10) for d in data]
    rows = R.multi_source(df.withColumnRenamed("k", "source_index"), "data", 7).orderBy("worker_index", "source_index").collect()
    assert [tuple(r)[:4] for r in rows] == S.multi(data, 7, 10)


def test_many_parts_meet_by_key(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_PARTS", 2)
    data = random_data(random.Random(5), 12)
    rows = R.multi_source(frame(spark, data).withColumnRenamed("k", "source_index"), "data", 9).orderBy("worker_index", "source_index").collect()
    assert [tuple(r)[:4] for r in rows] == S.multi(data, 9, 10)


def test_records_by_range_and_offsets(spark):
    data = [d for d in random_data(random.Random(9), 60) if d]
    df = frame(spark, data)
    rows = R.framed_by_range(df, "data", 4, 10, "k").orderBy("k", "line_index").collect()
    firsts = {(r["k"], r["index"]): r["record_offset"] for r in R.record_offsets(df, "data", 4, "k").collect()}
    for k, d in enumerate(data):
        lines = d.split(b"\n")[: None if d[-1:] != b"\n" else -1]
        mine = [r for r in rows if r["k"] == k]
        assert [bytes(r["record"]) for r in mine] == lines and [r["line_index"] for r in mine] == list(range(len(lines)))
        plan = S.partition(d, 4, 10)
        assert [next(i for i, (a, b) in enumerate(plan) if a <= r["offset"] < b or a <= r["offset"] == b == len(d)) for r in mine] == [r["range_index"] for r in mine]
        assert [firsts[k, i] for i in range(len(plan))] == [d[:a].count(b"\n") for a, _ in plan]


def test_strict_records(spark):
    df = frame(spark, [b"a\nb\n", b"", b"a"])
    assert [len(r["r"]) for r in df.select("k", B.records(F.col("data"), 10, strict=True).alias("r")).orderBy("k").collect()] == [2, 0, 1]
    assert [bytes(x) for x in frame(spark, [b"a\n\nb"]).select(B.records(F.col("data")).alias("r")).first()["r"]] == [b"a", b"", b"b"]
    with pytest.raises(Exception, match="empty record"):
        frame(spark, [b"a\n\nb"]).select(B.records(F.col("data"), 10, strict=True)).collect()


def test_worker_plan_faults(spark):
    data = [b"ab\ncd\nef\n", b"", b"x\ny\nz"]
    df = frame(spark, data).withColumnRenamed("k", "source_index")
    schema = "worker_index long, source_index long, start long, end_exclusive long, length long"

    def faults(rows):
        return {r["fault"] for r in V.worker_plan_faults(spark.createDataFrame(rows, schema), df, "data").collect()}

    for parts in (1, 2, 3, 50):
        assert V.worker_plan_faults(R.multi_source(df, "data", parts), df, "data").collect() == []
    good = [(0, 0, 0, 6, 6), (1, 0, 6, 9, 3), (1, 2, 0, 5, 5)]
    assert faults(good) == set()
    assert faults(good[:2]) == {"source not covered"}
    assert faults([(0, 0, 0, 5, 5), (1, 0, 5, 9, 4), (1, 2, 0, 5, 5)]) == {"start splits a record", "end splits a record"}
    assert faults([(0, 0, 0, 6, 7), *good[1:]]) == {"length"}
    assert faults([(0, 0, 0, 3, 3), (1, 0, 6, 9, 3), (1, 2, 0, 5, 5)]) == {"gap or overlap"}
    assert faults([*good, (2, 7, 0, 1, 1)]) == {"unknown source"}
    assert faults([*good[:2], (3, 2, 0, 5, 5)]) == {"workers not compact"}
    assert faults([(1, 0, 0, 6, 6), (0, 0, 6, 9, 3), (1, 2, 0, 5, 5)]) >= {"worker falls"}
    assert faults([(0, 0, 0, 9, 9), (1, 2, 0, 2, 2), (1, 2, 2, 2, 0), (1, 2, 2, 8, 6)]) >= {"empty range", "out of bounds"}
    assert faults([(1, 0, 0, 9, 9), (0, 2, 0, 5, 5)]) == {"workers out of order"}


def test_worker_outside_the_request(spark):
    ranges = R.partitioned(frame(spark, [b"a\nb\n"]), "data", 4, 10, "k")
    assert R.worker(ranges, 3, 4).count() == 0
    with pytest.raises(ValueError):
        R.worker(ranges, 4, 4)
