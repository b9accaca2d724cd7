"""Token output and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from spanforge.llm import bpe, common, orc_tokens
from spanforge.llm.common import scratch_dir

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "don't  it's we'll.. I'M ''s 'st Éa̐b Straße İstanbul ΣΑΣ ΌΣΟΣ, foo<|endoftext|>bar <|ENDOFTEXT|>. <|startoftext|>, a\x1cb\x85c\xa0d 日本語テキスト、です。 x²½ 12.5% é ́a ﬁn K",
    "", " ", "\n\t", "<|endoftext|>", "word, word. word!? (word) \"word\" &&& *** a-b_c", "İİ ǅ ß ŉ", "a" * 300, "x" * 5000 + " " + "ab" * 900, "🙂🙃 é", "é́ ,é.",
]


def test_word_ids():
    from tokenizers import Tokenizer

    tok, ours = Tokenizer.from_file(WORDS), orc_tokens.WordEncoder(WORDS)
    for texts in (TEXTS, TEXTS[::-1], [" ".join(TEXTS)] * 2):
        got = ours.encode(texts)
        for t, raw in zip(texts, got, strict=True):
            assert np.frombuffer(raw, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_another_make():
    from tokenizers import Tokenizer

    ours = orc_tokens.WordEncoder(WORDS)
    ours.direct = False
    tok = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(r, dtype="<u4").tolist() for r in ours.encode(TEXTS)] == [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def check_files(rows, got):
    """rows (id, text); got (id, start, n, crc) in any order: ids ascend, starts add up, and every row has its ids."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(WORDS), []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    got, at = sorted(got, key=lambda r: r[1]), 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order) and sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 30, 500])
def test_files(spark, part_bytes):
    rng = random.Random(0)
    rows = [(k * 3, " ".join(rng.choice(TEXTS[0].split()) for _ in range(rng.randrange(30)))) for k in range(200)]
    rng.shuffle(rows)
    path = scratch_dir(spark)
    orc_tokens.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS, part_bytes=part_bytes)
    check_files(rows, map(tuple, orc_tokens.token_digests(spark, path).collect()))
    found = orc_tokens.lookup(spark, path, [30, 33, 31])
    assert sorted(r["doc_id"] for r in found.collect()) == [30, 33]
    assert "In(doc_id" in found._jdf.queryExecution().toString()


def rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_files_have_bloom_filters_run_lengths_and_stripes(spark, monkeypatch):
    import glob

    path = scratch_dir(spark)
    monkeypatch.setitem(orc_tokens.ORC_OPTIONS, "orc.stripe.size", str(1 << 18))
    docs = spark.range(60_000).selectExpr("id * 2 as doc_id", "concat('word', id, ' some text ', sha2(cast(id as string), 256)) as text")
    orc_tokens.write_token_ids(docs, path, WORDS)
    (name,) = glob.glob(path.removeprefix("file://") + "/*.orc")
    java = spark._jvm.org.apache
    reader = java.orc.OrcFile.createReader(java.hadoop.fs.Path(name), java.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getNumberOfRows() == 60_000 and reader.getRowIndexStride() == 1000 and reader.getStripes().size() > 1
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    doc_id = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
    kinds = {(x.getColumn(), str(x.getKind())) for x in footer.getStreamsList()}
    assert {(doc_id, "ROW_INDEX"), (doc_id, "BLOOM_FILTER_UTF8"), (doc_id, "DATA")} <= kinds
    assert str(footer.getColumns(doc_id).getKind()) == "DIRECT_V2" == str(footer.getColumns(reader.getSchema().getMaximumId()).getKind())  # run lengths
    assert rows_scanned(orc_tokens.read_token_ids(spark, path)) == 60_000
    found = orc_tokens.lookup(spark, path, [30_000])
    assert rows_scanned(found) <= 1024 and [r["doc_id"] for r in found.collect()] == [30_000]  # a row group
    assert rows_scanned(orc_tokens.lookup(spark, path, [30_001])) <= 1024  # between two ids: Bloom filter and statistics
    assert rows_scanned(orc_tokens.lookup(spark, path, [500_000])) == 0


def test_many_rows_without_ids_fill_several_parts(spark):
    path = scratch_dir(spark)
    rows = [(None if k % 3 else k, f"text {k} of many words") for k in range(600)]
    orc_tokens.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS, part_bytes=2000)
    got = orc_tokens.token_digests(spark, path)
    check_files(rows, map(tuple, got.collect()))
    assert orc_tokens.read_token_ids(spark, path).where("doc_id is null").select("part").distinct().count() > 2


def test_files_awkward(spark, awkward, nothing):
    for df in (awkward, nothing):
        path = scratch_dir(spark)
        orc_tokens.write_token_ids(df, path, WORDS)
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        check_files(rows, map(tuple, orc_tokens.token_digests(spark, path).collect()))


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe():
    rng = random.Random(1)
    enc, ours = reference_encoding(), bpe.Encoder(RANKS, P.PATTERN)
    texts = TEXTS + ["".join(rng.choice("abcdeéñü日🙂 .,'\n\t  123") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t, (csv, decoded) in zip(texts, ours.encode(texts), strict=True):
        assert csv.decode() == ",".join(map(str, enc.encode_ordinary(t))) and decoded == t.encode()


def test_long_pieces_in_windows(monkeypatch):
    """Windows that join, windows that don't, and both queries, against the library's whole-piece encoding."""
    enc, ours = reference_encoding(), bpe.Encoder(RANKS, P.PATTERN)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcaab\xc3\xa9") for _ in range(rng.randrange(2, 200))) for _ in range(30)]
    pieces += [bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randrange(200, 1200))) for _ in range(4)]
    pieces += [unit * (n // len(unit)) for unit in (b"a", b"ab", b"abc", b"haha-", b"=", b"\xe6\x97\xa5", b"lalol", b"x" * 7 + b"y") for n in (193, 1001)]
    pieces += [b"q" * 700 + bytes(rng.choice(b"etaoinshrdlu") for _ in range(900)) + b"ab" * 400 + b"q" * 333]
    for p in pieces:
        want = enc._core_bpe.encode_single_piece(p)
        for step in (bpe.LONG_PIECE, 40):
            monkeypatch.setattr(bpe, "LONG_PIECE", step)
            if len(p) > step:
                assert list(map(int, ours._long(p)[0].split(b","))) == want, p[:60]
            monkeypatch.undo()
        assert [int(x) for x in ours._query([p], bpe.MERGE_ALL)[0][0].split(b",")] == want
        if len(p) < 600:
            assert [int(x) for x in ours._query([p])[0][0].split(b",")] == want


def test_one_very_long_piece():
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(60_000))
    ours = bpe.Encoder(RANKS, P.PATTERN)
    ((csv, decoded),) = ours.encode([text])
    assert csv.decode() == ",".join(map(str, reference_encoding().encode_ordinary(text))) and decoded == text.encode()


def test_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    monkeypatch.setattr(bpe, "POSITIONS", 5)
    enc, ours = reference_encoding(), bpe.Encoder(RANKS, P.PATTERN)
    assert [c.decode() for c, _ in ours.encode(TEXTS)] == [",".join(map(str, enc.encode_ordinary(t))) for t in TEXTS]


def test_round_trip(spark, awkward, nothing):
    enc = reference_encoding()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = bpe.bpe_round_trip(awkward, RANKS, P.PATTERN).collect()
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = bpe.bpe_digests(awkward, RANKS, P.PATTERN).collect()
    want = [(i, len(enc.encode_ordinary(t or "")), sha(",".join(map(str, enc.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, digests), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_round_trip(nothing, RANKS, P.PATTERN).collect() == []
    assert base64.b64decode("") == b""


def test_pieces_stay_from_task_to_task(monkeypatch):
    met = []
    learn = bpe.Encoder.learn
    monkeypatch.setattr(bpe.Encoder, "learn", lambda self, pieces: (met.extend(pieces), learn(self, pieces))[1])
    ids, texts = pa.array([1, 2]), pa.array(["qwzxj vbnmkq", "qwzxj plokmi"])
    for _ in range(2):  # two tasks of one worker
        got = [list(coded) for _, coded in bpe._texts(iter([pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])]), RANKS, P.PATTERN)]
        assert [d for part in got for _, d in part] == [t.encode() for t in texts.to_pylist()]
    assert sorted(met) == sorted({"qwzxj", " vbnmkq", " plokmi"})
    common.give_memory_back()  # at the end of a task of another operator
    assert not common._kept


def test_recent_keys_outlive_a_full_table():
    known = common.Recent(3000)
    for i in range(200):
        known.make_room()
        for key in known.missing({"often", f"once {i}"}):
            assert key != "often" or not i
            known.put(key, i, 20)
        assert known["often"] == 0 and len(known) + len(known.older) <= 3000 // 200 + 2


def test_values_are_cut_out_of_their_buffers(monkeypatch):
    """The queries' answers are read without an object for each value, and a piece is looked up once for all texts of a slice."""
    for kind in (pa.string(), pa.binary()):
        rows = pa.chunked_array([pa.array(["a", "", "é1"], kind), pa.array([], kind), pa.array(["x", "yy", "z"], kind).slice(1)])
        assert bpe._values(rows) == rows.cast(pa.binary()).to_pylist()
    met = []
    ours, missing = bpe.Encoder(RANKS, P.PATTERN), common.Recent.missing
    monkeypatch.setattr(common.Recent, "missing", lambda self, keys: (met.extend(keys), missing(self, keys))[1])
    for _ in range(2):
        assert [d for _, d in ours.encode(["qwzxj vbnmkq"] * 3)] == [b"qwzxj vbnmkq"] * 3
    assert sorted(met) == [" vbnmkq", "qwzxj"]


def test_ascii_words_are_not_normalised(monkeypatch):
    met, letters = [], orc_tokens.WordEncoder._letters
    monkeypatch.setattr(orc_tokens.WordEncoder, "_letters", lambda self, word: (met.append(word), letters(self, word))[1])
    from tokenizers import Tokenizer

    tok, ours = Tokenizer.from_file(WORDS), orc_tokens.WordEncoder(WORDS)
    text = "Some words, some signs: words. words! 3rd été, don't été"
    (raw,) = ours.encode([text])
    assert np.frombuffer(raw, dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert met and not [w for w in met if w.isalpha()]
    assert ours.known.held == sum(200 + len(k) + len(v) for k, v in ours.known.items())
