"""The pipeline's stages one by one, and whole."""

import hashlib

import pytest

import corpus_pipeline
from spanforge.llm import mixing, quality
from tests.llm.test_dedup_mixing import lower, words
from tests.llm.test_jaccard_topk import join_brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, new))
        docs = new
    return {n: (a, b) for n, a, b in out}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    for name, (before, after) in stages.items():
        assert name == "encode" or after.columns == before.columns


def test_quality(stages, spark, sf_dir):
    before, after = stages["quality"]
    w = quality.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [(i, t) for i, t in pairs(before) if quality.score(w, [(t or "").encode()])[0] >= 0.3]
    assert sorted(pairs(after)) == sorted(want) and len(want) < before.count()


def test_exact_dedup(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for i, t in pairs(before):
        best[lower(t)] = max(best.get(lower(t), -1), i)
    assert sorted(i for i, _ in pairs(after)) == sorted(best.values())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    classes = {c for _, c, _ in join_brute([(i, t) for i, t in pairs(before) if words(t)])}
    alone = {i for i, t in pairs(before) if not words(t)}
    assert sorted(i for i, _ in pairs(after)) == sorted(classes | alone)


def test_mix(stages):
    before, after = stages["mix"]
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(before)[0].collect() if r["size"]}
    count = {}
    for i, _ in pairs(after):
        count[i] = count.get(i, 0) + 1
    assert all(count.get(i, 0) == int(x + 0.5) for i, x in taken.items()) and set(count) <= set(taken)
    assert abs(sum(words(t) for _, t in pairs(after)) / sum(1.5 * words(t) for _, t in pairs(before)) - 1) < 0.1


def test_encode_and_run(stages, spark, sf_dir):
    before, after = stages["encode"]
    want = sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(before))
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, after.collect()))


def test_awkward_rows_and_names_pass_all_stages(spark, sf_dir, awkward, nothing):
    for df, some in ((awkward, True), (nothing, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            assert name == "encode" or out.columns == df.columns, name
            rows = out.collect()
            assert bool(rows) == some or name == "quality", name
            if name not in ("mix", "encode"):
                assert {tuple(r) for r in rows} <= {tuple(r) for r in df.collect()}, name
    kept = corpus_pipeline.exact_dedup_stage(spark, awkward, sf_dir).collect()
    assert len({(r["text"] or "").lower() for r in kept}) == len(kept)
    assert corpus_pipeline.encode_stage(spark, awkward, sf_dir).count() == 10


def test_empty(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_row_stays_where_ids_repeat_or_are_null(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, far = long + " x", " ".join(f"v{k}" for k in range(60))
    rows = [(7, long, "a"), (7, long, "a"), (7, long.upper(), "b"), (3, long, "c"), (None, far, "d"), (None, far, "d"), (None, far.upper(), "e"), (9, "one", "f"), (None, None, "g"), (None, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = corpus_pipeline.exact_dedup_stage(spark, df, "")
    got = exact.collect()
    assert exact.columns == df.columns and all(tuple(r) in rows for r in got)
    assert sorted(((r["text"] or "").lower(), r["doc_id"]) for r in got) == sorted([("", None), (long, 7), (far, None), ("one", 9)], key=lambda r: r[0])
    rows = [(7, long, "a"), (7, long, "a"), (7, near, "b"), (8, near, "c"), (None, near, "i"), (None, far, "d"), (None, far, "d"), (None, far + " y", "e"), (7, "one", "f"), (None, None, "g"), (None, "", "h"), (7, "two", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    assert len(got) == 6 and set(got) <= set(rows)
    assert sum(t is not None and t.startswith("w0") and i == 7 for i, t, _ in got) == 1 and sum(t is not None and t.startswith("v0") for _, t, _ in got) == 1
    assert {t for _, t, _ in got} >= {"one", "two", "", None}
