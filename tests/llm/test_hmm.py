"""The language model against brute force on small alphabets and corpora."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import hmm as H


def small_model(rng, states=3, classes=4):
    emit, move, start = rng.random((classes, states)), rng.random((states, states)), rng.random(states)
    return H.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), {})


def brute(model, sequence):
    """P(sequence) and the expected counts, by all state paths."""
    s = len(model.start)
    total, start, move, emit = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit)
    for path in itertools.product(range(s), repeat=len(sequence)):
        p = model.start[path[0]] * math.prod(model.emit[c, z] for c, z in zip(sequence, path, strict=True)) * math.prod(model.move[a, b] for a, b in itertools.pairwise(path))
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            move[a, b] += p
        for c, z in zip(sequence, path, strict=True):
            emit[c, z] += p
    return total, start / total, move / total, emit / total


def test_likelihood_and_counts(monkeypatch):
    rng = np.random.default_rng(0)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (1, 6, 3, 2, 6)]
    want = [brute(model, x) for x in sequences]
    for cells, every in ((1 << 18, 16), (8, 2), (12, 3), (1, 1)):
        monkeypatch.setattr(H, "SCALE_STEPS", every)
        monkeypatch.setattr(H, "BATCH_CELLS", cells)  # texts are trained on in blocks of few steps
        got = np.zeros(len(sequences))
        for which, length, grid in H._batches(sequences, cells):
            got[which] = H.log_likelihood(model, length, grid)
        assert np.allclose(got, [math.log10(w[0]) for w in want])
        counts = H.expected_counts(model, sequences)
        for k in range(3):
            assert np.allclose(counts[k], sum(w[k + 1] for w in want))


def test_long_sequences_do_not_vanish():
    model = small_model(np.random.default_rng(1))
    x = np.random.default_rng(2).integers(0, 4, 30_000)
    ((_, length, grid),) = H._batches([x])
    log = H.log_likelihood(model, length, grid)[0]
    assert -math.inf < log < -1000
    alpha, total = model.start * model.emit[x[0]], 0.0
    for c in x[1:]:
        total, alpha = total + math.log10(alpha.sum()), (alpha / alpha.sum()) @ model.move * model.emit[c]
    assert abs(log - total - math.log10(alpha.sum())) < 1e-6


def test_blocks_do_not_change_the_counts(monkeypatch):
    rng = np.random.default_rng(6)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (1, 70, 33, 70, 64, 5, 16)]
    whole = H.expected_counts(model, sequences)
    for cells in (1, 30, 50, 200):
        ((_, length, grid),) = H._batches(sequences, 1 << 18)
        monkeypatch.setattr(H, "BATCH_CELLS", cells)
        counts = np.zeros(3), np.zeros((3, 3)), np.zeros_like(model.emit)
        H._add_counts(model, length, grid, *counts)
        assert all(np.allclose(a, b) for a, b in zip(counts, whole, strict=True))


def test_a_long_text_takes_little_memory():
    import resource

    model, x = small_model(np.random.default_rng(1)), np.random.default_rng(2).integers(0, 4, 400_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    H.expected_counts(model, [x])
    ((_, length, grid),) = H._batches([x])
    H.log_likelihood(model, length, grid)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # kilobytes


def test_totals_by_runs(spark):
    rng = random.Random(7)
    rows = [(w, b, rng.randrange(5)) for b in range(40) for w in ["the", *rng.sample([f"w{k}" for k in range(60)], 10)]]
    each = spark.createDataFrame(rows, "word string, bucket int, c long")
    total = Counter()
    for w, _, c in rows:
        total[w] += c
    for run in (7, 1000):
        got = H.with_totals(each, 40, run_buckets=run).select("word", "bucket", "c").collect()
        assert sorted(map(tuple, got)) == sorted((w, b, total[w]) for w, b, _ in rows)


def test_copies_without_ids_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 400 + [(1, "another")], "doc_id long, text string").repartition(16)
    got = H.score_texts(docs, F.lit(False)).collect()
    assert len(got) == 401 and len({(r["n_tokens"], round(r["score"], 9)) for r in got if r["doc_id"] is None}) == 1


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    model = small_model(rng)
    data = [rng.permutation(np.repeat([0, 1], 5)) for _ in range(20)] + [rng.permutation(np.repeat([2, 3], 5)) for _ in range(20)]
    logs = []
    for _ in range(15):
        logs.append(sum(H.log_likelihood(model, n, g).sum() for _, n, g in H._batches(data)))
        model = H.reestimate(model, *H.expected_counts(model, data))
    assert logs[-1] > logs[0] and logs[-1] > sum(math.log10(0.25) * len(x) for x in data)


def unigram(rows, held_out):
    """rows (id, text) -> (train_tokens, {row: (n_tokens, n_known, base_score)})"""
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n = sum(c.values())
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)))
    return n, out


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 2000])
def test_scores(spark, bucket_bytes):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "é", f"w{rng.randrange(40)}", f"rare{rng.randrange(10**6)}"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.score_texts(docs, F.expr("doc_id % 7 = 2"), bucket_bytes=bucket_bytes).collect()
    n, want = unigram(rows, lambda i: i % 7 == 2)
    by = {r["doc_id"]: r for r in got}
    for i, k, known, base in want:
        r = by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (k, known, n, i % 7 == 2)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_words_of_a_class_and_the_unseen_one_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} common common") for i in range(1500)], "doc_id long, text string").withColumn("held_out", F.lit(False)).withColumn("bucket", F.lit(0))
    words = docs.mapInPandas(H._count_words, "word binary, bucket int, c long")
    fitted = H.fit(docs, words.groupBy("word").agg(F.sum("c").alias("c")).withColumn("bucket", F.lit(0)), 1)
    total = np.zeros(H.TAILS)
    for r in words.groupBy("word").agg(F.sum("c").alias("c")).collect():
        w = bytes(r["word"])
        if w not in fitted.model.singles:
            k = H.tail_class(w) - H.SINGLES
            total[k] += (r["c"] + 1) / 10 ** fitted.tail_log[k]
    used = total > 0
    assert np.allclose(total[used] + 10 ** -fitted.tail_log[used], 1)
    assert np.allclose(fitted.model.emit.sum(axis=0), 1) and np.allclose(fitted.model.move.sum(axis=1), 1)


def test_awkward(spark, awkward, nothing):
    rule = F.expr("doc_id = 2")
    got = H.score_texts(awkward, rule).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    n, want = unigram(rows, lambda i: i == 2)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got if r["doc_id"]) == sorted(w[:3] for w in want if w[0])
    assert len(got) == 10 and {r["train_tokens"] for r in got} == {n}
    assert H.score_texts(nothing, rule).collect() == []
    untrained = H.score_texts(awkward, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_classes_are_kept_by_last_bytes(monkeypatch):
    """What a task keeps grows with the endings of its words, not with the words."""
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcd\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    singles = {w: i for i, w in enumerate(sorted(set(words))[:20])}
    want = [singles[w] if w in singles else H.tail_class(w) for w in words]
    for most in (H.CACHE_TAILS, 5):
        monkeypatch.setattr(H, "CACHE_TAILS", most)
        classes = H.Classes(singles)
        got = [x for at in range(0, 3000, 100) for x in classes.of(words[at : at + 100]).tolist()]
        assert got == want and len(classes) <= len({w[-3:] for w in words}) < len(set(words))
    assert H.Classes(singles).of([]).dtype == H.np.int64
