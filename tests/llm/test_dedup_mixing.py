"""Exact dedup and source mixing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm import dedup, mixing
from spanforge.llm.common import LOWER, UPPER


def lower(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def dedup_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slots", [1 << 20, 64])  # the second filter is full at once
def test_dedup(spark, slots):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Äpfel", "äpfel", "Apfel", "aPFEL", "", None, f"t{rng.randrange(300)}"])) for i in range(2000)]
    got = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_slots=slots)
    assert sorted(map(tuple, got.drop("text").collect()), key=repr) == dedup_brute(rows)


def test_dedup_awkward(awkward, nothing):
    got = dedup.exact_dedup(awkward)
    assert got.columns.count("kept") == 1 and "a.b" in got.columns
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()]
    assert sorted(found, key=repr) == dedup_brute(rows)
    assert dedup.exact_dedup(nothing).collect() == []


def test_dedup_filter_spares_single_rows(spark):
    hashed = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("__sha"))
    bitmap = dedup.repeat_bitmap(hashed, 1 << 16)
    bits = bitmap.select(F.explode("words").alias("w")).agg(F.sum(F.bit_count("w"))).first()[0]
    assert 0 < bits < 1000  # of 5000 rows in 65536 slots few share one
    assert dedup._tested(hashed, bitmap, 1 << 16).where("__maybe").count() < 100
    twice = hashed.unionByName(hashed.limit(700))
    assert dedup._tested(twice, dedup.repeat_bitmap(twice, 1 << 16), 1 << 16).where("__maybe").count() >= 1400


def test_dedup_without_columns(awkward):
    got = dedup.exact_dedup(awkward, keep_columns=False)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == dedup_brute(rows)


def words(t):
    return len((t or "").encode().split())


def check_mix(rows, got, weights=(3, 1, 2)):
    """rows (id, text, source); got {(id, text): (size, source_size, target, taken)}"""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        w = {s: weights[order.index(s) % 3] for s in free}
        share = {s: left * w[s] / sum(w.values()) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: share.get(s, 2.0 * sizes[s]) for s in order}
    taken = defaultdict(int)
    for (_, t, s), (size, source_size, target, n) in zip(rows, got, strict=True):
        assert size == words(t) and source_size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, target)
        assert 0 <= n <= 2 * size
        taken[s] += n
    for s in order:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix(spark, block):
    rng = random.Random(block)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 60, 700]))), rng.choice(["a", "a", "a", "a", "b", "é", "z", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, slots, sources = mixing.mix(docs, block_words=block, keep_columns=False)
    by = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in out.collect()}
    check_mix(rows, [by[i] for i, _, _ in rows])
    again, _, _ = mixing.mix(docs.repartition(7), block_words=block, keep_columns=False)
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {i: v[3] for i, v in by.items()}
    # every stretch of the schedule gives each source its share
    order = [r["src"] for r in slots.orderBy("t").collect()]
    part = order[: len(order) // 2]
    for k, s in enumerate(sources):
        assert abs(part.count(k) - len(part) * s.slots / len(order)) <= 12, (k, s)


def test_mix_awkward(awkward, nothing):
    out, _, _ = mixing.mix(awkward)
    rows = out.collect()
    assert out.columns.count("size") == 1 and len(rows) == 10
    check_mix([(r["doc_id"], r["text"], r["source"]) for r in rows], [(r["size"], r["source_size"], r["target"], r["taken"]) for r in rows])
    assert mixing.mix(nothing)[0].collect() == [] and mixing.mixed_documents(nothing).collect() == []
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_targets_reshare():
    assert mixing.targets([("a", 10), ("b", 100)], (3, 1), 1.5, 2.0) == [20.0, 145.0]
    assert mixing.targets([("a", 0)], (3,), 1.5, 2.0) == [0.0]


def test_dedup_of_one_large_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)] + [(None, "same text")] * 5
    got = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.drop("text").collect()), key=repr) == dedup_brute(rows)


def test_mixed_documents_shuffle_no_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}" for _ in range(rng.choice([0, 1, 5, 60, 300]))), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(docs)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(docs)[0].collect() if r["size"]}
    got = [tuple(r) for r in out.collect()]
    assert Counter(i for i, _, _ in got) == Counter({i: n for i, n in want.items() if n}) and set(got) <= set(rows)
    assert len(set(want.values())) > 1


def test_mixed_documents_of_repeated_rows(spark):
    rows = [(7, "a few words that repeat", "a")] * 90 + [(i, f"other words {i}", "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [r for r in mixing.mix(docs)[0].collect()]
    want = Counter()
    for r in taken:
        want[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == Counter({i: n for i, n in want.items() if n})
