"""The record_ranges data source and documents read through it."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import documents as D
from spanforge.plans.files import plan_file
from spanforge.sources import read_documents, record_ranges, register


def read(spark, path, **options):
    register(spark)
    return spark.read.format("record_ranges").options(**options).load(path if isinstance(path, str) else json.dumps(path))


def jsonl(folder, name, records, end="\n"):
    path = folder / name
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in records) + end)
    return str(path)


def test_every_record_once_in_its_range(spark, tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"text": f"grüße {i}", "value": i} for i in range(1000)], "")
    df = read(spark, path, parts=4)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert b"".join(bytes(r["record"]) for r in sorted(rows, key=lambda r: r["offset"])) == open(path, "rb").read()
    plan = plan_file(path, 4)
    for r in rows:
        owner = plan.ranges[r["range_index"]]
        assert owner.start <= r["offset"] < owner.end
    lines = D.global_lines(df).orderBy("offset").select("line_index").collect()
    assert [x[0] for x in lines] == list(range(1000))


def test_small_blocks_and_giant_records(spark, tmp_path):
    data = [b"x" * n + b"\n" for n in (0, 1, 5_000_000, 3)]
    path = tmp_path / "big"
    path.write_bytes(b"".join(data))
    rows = read(spark, str(path), parts=3).orderBy("offset").collect()
    assert [bytes(r["record"]) for r in rows] == data


def test_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(record_ranges, "BLOCK", 4)
    path = tmp_path / "f"
    path.write_bytes(b"ab\ncdefghij\nk\n\nlm")
    got = [(o, e.tolist(), d) for o, e, d in record_ranges._blocks(str(path), 0, 17, 17, 10)]
    assert b"".join(d for _, _, d in got) == path.read_bytes()
    assert all(path.read_bytes()[o : o + len(d)] == d for o, _, d in got)
    with pytest.raises(OSError, match="splits"):
        list(record_ranges._blocks(str(path), 0, 5, 17, 10))
    with pytest.raises(OSError, match="changed"):
        list(record_ranges._blocks(str(path), 0, 5, 16, 10))


def test_several_files_workers_and_collapsed_parts(spark, tmp_path):
    a, b = jsonl(tmp_path, "a", ["1", "2", "3"]), jsonl(tmp_path, "b", ["4"])
    rows = read(spark, [a, b, a], parts=2).collect()
    assert sorted((r["source_index"], bytes(r["record"])) for r in rows) == [(0, b"1\n"), (0, b"2\n"), (0, b"3\n"), (1, b"4\n"), (2, b"1\n"), (2, b"2\n"), (2, b"3\n")]
    one = read(spark, b, parts=5)
    assert one.rdd.getNumPartitions() == 5 and one.count() == 1
    assert read(spark, b, parts=5, worker=4).count() == 0
    with pytest.raises(Exception, match="worker"):
        read(spark, b, parts=2, worker=2).count()
    empty = tmp_path / "empty"
    empty.write_bytes(b"")
    assert read(spark, str(empty), parts=3).count() == 0


def documents(spark, path, parts=1, **options):
    return D.json_documents(D.global_lines(read(spark, path, parts=parts)), source_name=path.rsplit("/", 1)[1], **options).orderBy("line_index")


@pytest.mark.parametrize(("options", "want"), [({"limit": 0}, []), ({"limit": 1}, [0]), ({"limit": 5}, range(5)), ({"skip": 2}, range(2, 10)), ({"skip": 2, "limit": 5}, range(2, 7))])
def test_skip_and_limit(spark, tmp_path, options, want):
    path = jsonl(tmp_path, "f.jsonl", [{"text": f"record-{i}", "value": i} for i in range(10)])
    assert [r["id"] for r in documents(spark, path, **options).collect()] == [f"f.jsonl/{i}" for i in want]


def test_skip_counts_in_each_range(spark, tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"text": "x" * 20} for _ in range(12)])
    begins = [r.start // 33 for r in plan_file(path, 3).ranges]  # a line has 33 bytes
    assert [r["line_index"] for r in documents(spark, path, parts=3, skip=1, limit=2).collect()] == [b + k for b in begins for k in (1, 2)]


def test_bad_lines_keep_their_number(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_bytes(b'{"text":"a"}\nnot json\n{"text":"\xff"}\n{"text":"b","id":"own"}\r\n\n[1]\n{"text":""}\n{"text":"c"}')
    assert [(r["line_index"], r["id"], r["text"]) for r in documents(spark, str(path)).collect()] == [(0, "f.jsonl/0", "a"), (3, "own", "b"), (7, "f.jsonl/7", "c")]


def test_keys_and_metadata(spark, tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"body": "b", "custom": "c", "metadata": {"source": "s", "row": 1}, "value": 2}])
    row = documents(spark, path, text_key="body", id_key="custom", default_metadata={"batch": "p", "source": "no"}, file_path="/p").first()
    assert (row["id"], row["text"], row["metadata"]) == ("c", "b", {"batch": "p", "source": "s", "row": "1", "value": "2", "file_path": "/p"})


def test_media(spark, tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"text": "t", "media": [{"media_bytes": "AAEC"}, {"media_bytes": None}]}])
    row = documents(spark, path).first()
    assert [x and bytes(x) for x in row["media"]] == [b"\0\1\2", None]


def test_sums_reject_other_records(spark, tmp_path):
    good = read(spark, jsonl(tmp_path, "g", [{"id": 1, "value": 5}, {"id": 2, "value": 7}]))
    assert tuple(D.record_sums(good).first())[:2] == (2, 12)
    bad = read(spark, jsonl(tmp_path, "b", [{"id": 1}]))
    with pytest.raises(Exception, match="integer"):
        D.record_sums(bad).collect()


def test_stats_add_up(spark, tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"text": "ab"}, {"text": "cde"}])
    assert tuple(D.document_stats(documents(spark, path)).first()) == (0, 1, 2, 5)
    assert read(spark, path).where(F.col("local_line") == 1).count() == 1


def upper(record, name, line):
    """An adapter: its own fields, and the place it was given."""
    return {"text": record["body"].upper(), "id": f"{name}#{line}", "media": [], "metadata": {"line": line, "kind": record.get("kind")}}


def broken(record, name, line):
    raise KeyError("body")


LINES = [
    json.dumps({"text": "first", "lang": "en", "n": 3, "metadata": {"lang": "xx", "deep": [1, 2]}}),
    "{not json", json.dumps({"text": "", "id": "empty"}), "5", "",
    json.dumps({"text": "größe", "id": 7}),
    json.dumps({"text": None, "media": [{"media_bytes": "aGk="}, {"media_bytes": None}]}),
    *[json.dumps({"text": f"row {k}"}) for k in range(40)],
]


def as_rows(df):
    return sorted((r["source_index"], r["line_index"], r["id"], r["text"], tuple(map(bytes, filter(None, r["media"]))), tuple(sorted(r["metadata"].items()))) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_documents(spark, tmp_path, parts):
    path = jsonl(tmp_path, "talk.jsonl", LINES)
    got = as_rows(read_documents(spark, path, parts, default_metadata={"lang": "none", "set": "a"}))
    assert got[:3] == [
        (0, 0, "talk.jsonl/0", "first", (), (("deep", "[1,2]"), ("lang", "en"), ("n", "3"), ("set", "a"))),
        (0, 5, "7", "größe", (), (("lang", "none"), ("set", "a"))),
        (0, 6, "talk.jsonl/6", "", (b"hi",), (("lang", "none"), ("set", "a"))),
    ]
    assert [(line, i, t) for _, line, i, t, _, _ in got[3:]] == [(7 + k, f"talk.jsonl/{7 + k}", f"row {k}") for k in range(40)]
    register(spark)
    alone = spark.read.format("record_documents").option("parts", parts).load(path)  # the planner counts by itself
    assert [r[:4] for r in as_rows(alone)] == [r[:4] for r in got]
    kept = as_rows(read_documents(spark, path, parts, keep_empty=True, add_file_path=True))
    assert (0, 2, "empty", "") in [r[:4] for r in kept] and all(("file_path", path) in r[5] for r in kept)


def test_documents_of_several_files(spark, tmp_path):
    a, b = jsonl(tmp_path, "a", LINES, ""), jsonl(tmp_path, "b", LINES[:2])
    more = spark.createDataFrame([("up", "stream")], "id string, text string")
    got = read_documents(spark, [a, b, a], 5, upstream=more)
    lines = sorted((r["source_index"], r["line_index"]) for r in got.where("id <> 'up'").collect())
    one = [0, 5, 6, *range(7, 47)]
    assert lines == [(0, k) for k in one] + [(1, 0)] + [(2, k) for k in one] and got.where("id = 'up'").count() == 1
    stats = D.document_stats(got.where("id <> 'up'")).collect()
    assert sorted(r["input_files"] for r in stats) == [1, 1, 1] and sum(r["documents"] for r in stats) == 2 * len(one) + 1
    assert "Exchange" not in got.where("id <> 'up'")._jdf.queryExecution().executedPlan().toString()


def test_adapters(spark, tmp_path):
    path = jsonl(tmp_path, "f", [{"body": "ab", "kind": "x"}, {"body": "cd"}])
    got = as_rows(read_documents(spark, path, 2, adapter="tests.test_source:upper"))
    assert got == [(0, 0, "f#0", "AB", (), (("kind", "x"), ("line", "0"))), (0, 1, "f#1", "CD", (), (("kind", None), ("line", "1")))]
    with pytest.raises(Exception, match="worker 0, .*line 0: KeyError"):
        read_documents(spark, path, 1, adapter="tests.test_source:broken").collect()


def test_ranks_and_limits(spark, tmp_path):
    path = jsonl(tmp_path, "f", [{"text": f"t{k}"} for k in range(50)])
    whole = as_rows(read_documents(spark, path, 4))
    ranks = [as_rows(read_documents(spark, path, 4, rank=r, world_size=4)) for r in range(4)]
    assert sorted(x for r in ranks for x in r) == whole and all(ranks)
    cut = [as_rows(read_documents(spark, path, 4, rank=r, skip=2, limit=3)) for r in range(4)]
    assert cut == [r[2:5] for r in ranks]
    assert as_rows(read_documents(spark, path, 4, limit=0)) == []
    one = jsonl(tmp_path, "one", [{"text": "x" * 100}])
    assert [len(as_rows(read_documents(spark, one, 3, rank=r))) for r in range(3)] == [1, 0, 0]
    for wrong, why in (({"world_size": 5}, "world_size"), ({"rank": 4}, "rank"), ({"rank": -1}, "rank")):
        with pytest.raises(ValueError, match=why):
            read_documents(spark, path, 4, **wrong)
    assert as_rows(read_documents(spark, path, 4, plan=plan_file(path, 4))) == whole
    with pytest.raises(ValueError, match="not of"):
        read_documents(spark, one, 4, plan=plan_file(path, 4))
    with pytest.raises(ValueError, match="parts"):
        read_documents(spark, path, 3, plan=plan_file(path, 4))


def test_failures_name_their_worker(spark, tmp_path):
    path = jsonl(tmp_path, "f", ['{"id": 1, "value": 2}', '{"id": "x"}'])
    with pytest.raises(Exception, match="worker 0, source_index 0, local_line 1"):
        D.record_sums(read(spark, path, parts=1)).collect()
    with pytest.raises(OSError, match=r"worker 3, source 1 \(.*\), range \[0, 5\): .*changed"):
        reader = record_ranges.RecordReader({"path": path})
        list(reader.blocks(3, 1, path, 0, 5, 4))


def test_files_by_uri(tmp_path):
    path = jsonl(tmp_path, "f.jsonl", [{"k": k} for k in range(20)])
    plan, far = plan_file(path, 3), plan_file(f"file://{path}", 3)
    assert [r.row() for r in plan.ranges] == [r.row() for r in far.ranges]
    from spanforge.plans import files

    assert files.source_size(f"local://{path}".replace("local", "file")) == plan.file_size
    with files.open_source(f"file://{path}") as f:
        assert f.read(5) == open(path, "rb").read(5)
