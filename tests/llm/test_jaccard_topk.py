"""The similarity join and the top-k search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import jaccard as J
from spanforge.llm import topk as K
from spanforge.llm.graph import components


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def join_brute(rows):
    """{row number: (class id, links)} over rows (id, text)"""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, min(ids, default=None), links[k]))
    return sorted(out, key=repr)


def families(rng, n):
    rows = []
    while len(rows) < n:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [J.BLOCK, 3])
def test_join(spark, block):
    rows = families(random.Random(block), 300)
    got = J.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=repr) == join_brute(rows)


def test_large_group_in_blocks(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        copy = list(words)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = J.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=16)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=repr) == join_brute(rows)


def test_join_awkward(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = J.similar(awkward).collect()
    alone = [k for k, (_, t) in enumerate(rows) if not shingle_set(t)]
    want = join_brute([r for k, r in enumerate(rows) if k not in alone]) + [(rows[k][0], rows[k][0], 0) for k in alone]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=repr) == sorted(want, key=repr)
    assert J.similar(nothing).collect() == []
    left = J.one_of_each_class(awkward)
    assert left.columns == awkward.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["text"] and r["doc_id"])[0] == (1, "one two three four five six seven")
    assert left.where("doc_id = 2").isEmpty() and left.where("text is null or text = ''").count() == 3


def test_pruning_keeps_what_can_reach_the_threshold():
    assert all(J.LEAST[h] < 0.8 * h for h in J.LEAST) and J.LEAST[J.HASHES] > 0.4 * J.HASHES
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 2**32, (3, J.HASHES), dtype=np.uint32)
    sig[1] = sig[0]
    sig[1, ::6] += 1  # five sixths agree
    assert J.plausible(sig, np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


def test_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = np.unique(base[:1200]), np.unique(base[300:])
    agree = (J.min_hashes(a) == J.min_hashes(b)).mean()
    assert abs(agree - 900 / 1500) < 0.2


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def top_brute(rows, k, query):
    import math

    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]  # noqa: B905
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int, h string")


@pytest.mark.parametrize("scale", [0.3, 1e4])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(K, "GROUP_ROWS", 100)
    monkeypatch.setattr(K, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, scale, (400, 8)), 2).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (420, [1.0, None] * 4), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8), (461, [0.5, 0.25]), (480, [0.5, 0.25])]
    df = vectors(spark, [(*r, None, None, "h") for r in rows])
    got = K.exact_top_k(df, F.expr("vec_id % 20 = 0"), k=20)
    want = top_brute([(i, v if v is None or len(v) == 8 else [*v, *[0.0] * 6]) for i, v in rows], 20, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want


def test_few_candidates_and_none(spark):
    df = vectors(spark, [(0, [1.0], None, None, None), (20, [2.0], None, None, None), (21, [2.0], None, None, None)])
    got = K.exact_top_k(df, F.expr("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 20, 8192), (0, 2, 21, 8192), (20, 1, 21, 16384), (20, 2, 0, 8192)]
    assert K.exact_top_k(df.limit(0), F.expr("vec_id % 20 = 0")).collect() == []


def test_bounds_leave_most_pairs_unread():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(0, 0.12, (4096, 64))).astype(np.int64)
    best = K.Best(16, 20)
    ids = np.arange(4096)
    first = K.nra_block(x[:16], ids[:16], x[:2048], ids[:2048], best)
    second = K.nra_block(x[:16], ids[:16], x[2048:], ids[2048:], best)
    assert second < first and second < 0.25 * 16 * 2048


@pytest.mark.parametrize("scale", [1, 10**4, 10**6])  # sums in float32, float64, int64
@pytest.mark.parametrize("copies", [19, 20, 21, 22])
def test_own_row_does_not_raise_the_bar(copies, scale):
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.normal(0, 0.12, (500, 64))).astype(np.int64) * scale
    x[:copies] = 4 * x[0]  # the query and its copies, far above all others
    x[100] = x[200]
    ids = np.arange(500)
    ids[1] = 0  # a row that repeats the query's id
    best = K.Best(3, 20)
    at = [0, 5, 100]
    K.nra_block(x[at], ids[at], x, ids, best)
    for q, (got_ids, got_scores) in zip(at, best.rows, strict=True):
        want = sorted((-int(s), int(j)) for s, j in zip(x @ x[q], ids, strict=True) if j != ids[q])[:20]
        assert list(zip((-got_scores).tolist(), got_ids.tolist(), strict=True)) == want
