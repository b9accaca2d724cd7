"""The secret scan on planted secrets, and the classifier's gradients, cover and accuracy."""

import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from spanforge.llm import quality as Q
from spanforge.llm import secrets as S

KEY = "password = hunter2hunter2"


def spans_of(text):
    return [(S.KINDS[k], text[s:e]) for s, k, e in S.find_secrets(text)[1]]


def base_brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


@pytest.mark.parametrize(
    "text",
    [
        "", "nothing here", KEY, "API_KEY: 'abcdef' apikey=abc token=token:abcdefgh", "passWORD\"=\"x/y+z=.-_", "AKIA" + "A" * 15, "x AKIA" + "Z9" * 8 + "!", "f" * 23, "g" + "0f" * 12, "toKen: abcdef",
        "secret  ==abc123 secret : : zzzzzz", "übertoken=ßabcdef password=é", "token=" + "a" * 6 + "\nsecret=" + "b" * 5,
    ],
)
def test_base(text):
    assert S.find_secrets(text)[0] == base_brute(text)
    assert set(S.find_secrets(text)[0]) <= set(S.find_secrets(text)[1])


WRAPS = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "percent-gzip": lambda t: "".join(f"%{b:02X}" for b in gzip.compress(t.encode(), mtime=0)),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", ["", *WRAPS])
def test_wrapped(outer, inner):
    hidden = WRAPS[outer](WRAPS[inner](KEY) if inner else KEY)
    text = f"grüße {hidden} tail"
    found = [(s, e) for s, k, e in S.find_secrets(text)[1] if k == 0]
    assert any(6 <= s and e <= 6 + len(hidden) for s, e in found), found


def test_spans_map_to_their_source():
    text = "é token%3Dabc%64ef. end"
    assert ("assign", "token%3Dabc%64ef.") in spans_of(text)
    coded = base64.b64encode(b"xx " + KEY.encode() + b" yy").decode()
    (span,) = [t for k, t in spans_of(f"<{coded}>") if k == "assign"]
    assert coded[4:].startswith(span[:8]) and len(span) <= len(coded) - 4


def test_cycles_and_limits_end():
    text = "%2525252541%41" + KEY
    assert S.find_secrets(text)[2] < 10
    bomb = base64.b64encode(zlib.compress(b"a" * 1_000_000)).decode()
    assert S.find_secrets(bomb, limit=10_000)[3] == 1
    nested = KEY
    for _ in range(8):
        nested = base64.b64encode(nested.encode()).decode()
    assert S.find_secrets(nested)[2] == 9 and S.find_secrets(nested)[1]


def test_layers_that_are_hardly_text():
    """A secret among control characters, or in bytes that are no UTF-8."""
    for raw in (bytes(range(1, 32)) * 3 + KEY.encode() + bytes(range(1, 32)), b"\xff\xfe\x00\x81" * 9 + KEY.encode() + b"\xc3\x28" * 9):
        for coded in (base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw, mtime=0)).decode(), lines_of(raw, 64)):
            assert "assign" in [k for k, _ in spans_of(f"<{coded}>")], coded


def test_many_escapes_of_one_sign():
    import time

    began = time.process_time()
    _, _, layers, _ = S.find_secrets("%" + "25" * 4000 + "41" + " " + KEY)
    assert layers == 4002 and time.process_time() - began < 20


def test_scan_awkward(awkward, nothing):
    assert S.secret_scan(awkward).count() == 10
    assert S.secret_scan(awkward).where("spans <> ''").count() == 0
    assert S.secret_scan(nothing).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 110, n, dtype=np.uint8).tobytes() for n in (0, 3, 90, 700, 1200)]
    y, weight = np.array([0, 1, 0, 1, 1]), np.array([1.0, 2, 1, 0.5, 1])
    w = {k: v.astype(np.float32) for k, v in Q.initial(3).items()}
    w["bias"] += 0.01
    w["b1"] += rng.uniform(0.03, 0.09, Q.HIDDEN).astype(np.float32)  # off the kink, where the empty text's hidden units would lie
    lay = Q.Layout(texts)
    g = Q.gradients(w, lay, y, weight)

    def loss(w):
        p = Q.head(w, Q.pooled_chunks(Q.block_maxima(w, lay), lay), lay)[2]
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / len(y)

    for k in w:
        flat = np.abs(g[k].ravel())
        for i in np.argsort(-flat)[:3]:
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k].ravel()[i] += 1e-3
            down[k].ravel()[i] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g[k].ravel()[i]) < 0.05 * flat[i] + 2e-3, (k, i)


def network_brute(w, text):
    """The network in plain loops over bytes, positions, blocks and chunks."""
    unit = Q.BLOCK * Q.STRIDE
    blocks = (len(text) + Q.WIDTH + unit - 1) // unit
    padded = text + bytes(blocks * unit + Q.WIDTH - len(text))
    block = []
    for b in range(blocks):
        best = [0.0] * Q.FILTERS
        for k in range(Q.BLOCK):
            at = (b * Q.BLOCK + k) * Q.STRIDE
            if at >= len(text):
                continue
            x = [float(v) for byte in padded[at : at + Q.WIDTH] for v in w["embed"][byte]]
            for f in range(Q.FILTERS):
                best[f] = max(best[f], float(w["bias"][f]) + sum(v * float(c) for v, c in zip(x, w["filters"][:, f], strict=True)))
        block.append(best)
    chunks, first = [], 0
    while True:
        inside = block[first : first + Q.CHUNK]
        chunks.append([max(b[f] for b in inside) for f in range(Q.FILTERS)])
        if first + Q.CHUNK >= blocks:
            break
        first += Q.STEP
    by_filter = list(zip(*chunks, strict=True))
    feats = [sum(c) / len(c) for c in by_filter] + [max(c) for c in by_filter] + [min(c) for c in by_filter]
    hidden = [max(0.0, float(w["b1"][h]) + sum(x * float(c) for x, c in zip(feats, w["w1"][:, h], strict=True))) for h in range(Q.HIDDEN)]
    z = float(w["b2"][0]) + sum(h * float(c) for h, c in zip(hidden, w["w2"], strict=True))
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(5)
    w = {k: (v + rng.normal(0, 0.05, v.shape)).astype(np.float32) for k, v in Q.initial(4).items()}
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 57, 58, 59, 63, 64, 500, 512, 513, 900, 1500)]
    want = [network_brute(w, t) for t in texts]
    assert np.allclose(Q.score(w, texts), want, atol=2e-5)
    monkeypatch.setattr(Q, "SLICE_BLOCKS", 3)  # texts are scored in slices
    monkeypatch.setattr(Q, "SLICE_BYTES", 100)
    assert np.allclose(Q.score(w, texts), want, atol=2e-5)


def test_a_long_text_takes_little_memory():
    import resource

    text = b"some words of a long text " * 800_000  # 20 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    Q.score(Q.initial(), [text])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


def test_texts_of_any_length_are_fitted_on(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "%%%&&&*** ") * (2000 if i % 5 == 0 else 3)) for i in range(30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    w = Q.train(docs, labels)
    assert Q.score(w, [b"good words here " * 2000])[0] > 0.8 > 0.2 > Q.score(w, [b"%%%&&&*** " * 2000])[0]
    assert np.array_equal(Q.train(docs.repartition(5), labels)["filters"], w["filters"])
    few = Q.train(docs, labels, fit_bytes=2000)  # only short texts fit
    assert not np.array_equal(few["filters"], w["filters"])


def test_scores_cover_the_whole_text_and_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    good = [bytes(rng.choice(list(b"abcdefgh "), 600).astype(np.uint8)) for _ in range(60)]
    bad = [g[:-90] + b"%%%&&&***" * 10 for g in good]
    w = Q.fit(good + bad, np.array([1] * 60 + [0] * 60), 0.5)
    long_good = b" ".join(good[:40])
    alone = [Q.score(w, [t])[0] for t in (good[0], bad[0], long_good)]
    assert alone[0] > 0.5 > alone[1]
    assert np.array_equal(Q.score(w, [good[0], bad[0], long_good]), alone)
    junk_at_the_end = Q.score(w, [long_good + b"%%%&&&***" * 1500])[0]
    assert junk_at_the_end < alone[2]


def test_classify(spark, sf_dir, awkward, nothing):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = Q.classify(awkward, labels, fit_rows=20)
    assert out.count() == 10 and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    assert out.where("doc_id is null and held_out").isEmpty()
    assert Q.classify(nothing, labels, fit_rows=20).collect() == []
    none = labels.limit(0)
    assert {r["score"] for r in Q.classify(awkward, none).collect()} == {0.5}
    scored = Q.add_scores(awkward, Q.initial(), score_col="score")
    assert scored.columns.count("score") == 1 and "a.b" in scored.columns and scored.count() == 10
    assert {r["a.b"] for r in scored.collect()} == {"dot", None}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = Q.classify(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(cast(predicted = quality as int))", "count(*)").first()
    assert r[0] >= 0.9, r


LONG = "".join(f"line {k} of some words {k * k}\n" for k in range(40)) + KEY + " and more after it\n" + "x y z " * 30


def lines_of(data, width, end="\n"):
    coded = base64.b64encode(data).decode()
    return end.join(coded[k : k + width] for k in range(0, len(coded), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\n    "])
@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("pack", [str.encode, lambda t: gzip.compress(t.encode(), mtime=0), lambda t: zlib.compress(t.encode()), lambda t: bz2.compress(t.encode()), lambda t: lzma.compress(t.encode())])
def test_base64_over_lines(pack, width, end):
    for shift in range(6):  # the secret and the last line's width move
        coded = lines_of(pack("a" * shift * 9 + LONG), width, end)
        text = f"-----BEGIN DATA-----{end}{coded}{end}-----END DATA-----"
        _, spans, _, closed = S.find_secrets(text)
        got = [(s, e) for s, k, e in spans if k == 0]
        assert any(20 <= s and e <= 20 + len(end) + len(coded) and e - s >= 4 * len(KEY) // 3 for s, e in got), (shift, got)
        assert closed == 0


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), bz2.compress, lzma.compress])
def test_all_members(pack):
    coded = base64.b64encode(pack(b"nothing here") + pack(b"nor here") + pack(KEY.encode())).decode()
    assert "assign" in [k for k, _ in spans_of(f"<{coded}>")] and S.find_secrets(coded)[3] == 0


@pytest.mark.parametrize("quote", [urllib.parse.quote, urllib.parse.quote_plus])
@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, lzma.compress])
def test_url_form_with_plain_characters(pack, quote):
    for k in range(10):
        coded = quote(pack(LONG.encode() + bytes([65 + k]) * k))
        text = f"a=b%20c&data={coded}&tail=1"
        got = [(s, e) for s, kind, e in S.find_secrets(text)[1] if kind == 0]
        assert (13, 13 + len(coded)) in got and S.find_secrets(text)[3] == 0


def test_cut_off_blobs_count():
    blob = gzip.compress((KEY + " " + "".join(map(str, range(4000)))).encode(), mtime=0)
    assert S.find_secrets(base64.b64encode(blob[:-300]).decode())[3] == 1
    assert S.find_secrets(base64.b64encode(blob).decode())[3] == 0
    assert "assign" in [k for k, _ in spans_of(base64.b64encode(blob[:-300]).decode())]


def test_long_base64_is_opened():
    coded = base64.b64encode(b"word " * 5000 + KEY.encode()).decode()
    _, spans, _, closed = S.find_secrets(coded, limit=1000)
    assert any(k == 0 for _, k, _ in spans) and closed == 0


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, lzma.compress])
def test_large_layers_are_scanned_in_blocks(pack):
    for at in range(100_000, 100_900, 37):  # over the edges of blocks, which cut characters of two bytes
        data = ("é" * 3 + "z") * 20_000
        data = data.encode()[: at - at % 7] + KEY.encode() + b" " + base64.b64encode(b"x AKIA" + b"Q7" * 8) + b" " + data.encode()[at - at % 7 :]
        coded = base64.b64encode(pack(pack(data))).decode()
        _, spans, _, closed = S.find_secrets(coded, limit=1000)
        assert {(s, k, e) for s, k, e in spans if k < 2} >= {(0, 0, len(coded)), (0, 1, len(coded))} and closed == 1


def test_many_directly_nested_layers():
    data = KEY.encode()
    for _ in range(100):
        data = gzip.compress(data, mtime=0)
    assert "assign" in [k for k, _ in spans_of(base64.b64encode(data).decode())]
