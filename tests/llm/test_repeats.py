"""Repeat removal against brute force, over ordinary, periodic and crowded texts."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import repeats as R


def removal_brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        mark = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if mark[k] and not (k and mark[k - 1]))
        kept = bytes(b for b, m in zip(d, mark, strict=True) if not m)
        out.append((i, len(d), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng):
    letters = "abcdefgé "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, twin = text(70), text(200)
    rows = [text(rng.randrange(0, 300)) for _ in range(40)]
    rows += [text(rng.randrange(30)) + passage + text(rng.randrange(30)) for _ in range(30)]
    rows += [twin, twin, twin[:90] + "X" + twin[90:], twin[5:], "a" * 150, "ab" * 100, "a" * 39, "a" * 41, None, "", passage[:40], passage[:39]]
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [8192, 2])  # bins over 2 stretches are dealt by digest
def test_removal(spark, limit):
    rows = corpus(random.Random(limit))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = R.Repeats(docs, length=40, gram=8, bin_limit=limit).removal()
    assert sorted(map(tuple, got.collect()), key=repr) == removal_brute(rows, 40)


def words_brute(rows, words):
    """{row: words in strings of so many words that start elsewhere too}"""
    data = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(d[k : k + words]) for d in data for k in range(len(d) - words + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        mark = bytearray(len(d))
        for k in range(len(d) - words + 1):
            if seen[tuple(d[k : k + words])] > 1:
                mark[k : k + words] = b"\1" * words
        out.append((i, sum(mark)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [8192, 2])
def test_words(spark, limit):
    rng = random.Random(limit)
    text = lambda n: " ".join(rng.choice(["a", "der", "l\n\n", "é", "xyz"]) + str(rng.randrange(40)) for _ in range(n))
    passage = text(25)
    rows = [text(rng.randrange(0, 90)) for _ in range(30)] + [text(rng.randrange(9)) + "\t" + passage + "  " + text(rng.randrange(9)) for _ in range(20)]
    rows += [rows[3], rows[4].replace(" ", "\n"), " ".join(passage.split()[:20]), " ".join(passage.split()[:19]), "a " * 60, None, ""]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    repeats = R.Repeats(docs, length=20, gram=4, bin_limit=limit, unit="words")
    got = {bytes(r["tk"]): r["n_removed"] for r in repeats._cut().collect()}
    assert sorted(((i, got.get(hashlib.sha256((t or "").encode()).digest(), 0)) for i, t in rows), key=repr) == words_brute(rows, 20)


def test_query_on_words_and_bytes(spark, awkward, nothing):
    rows = corpus(random.Random(8)) + [(900 + k, f"{k} " * 3 + "it is so " * 20 + f"end{k}") for k in range(3)]
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, words=10).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == removal_brute(rows, 40)
    assert sorted(((r["doc_id"], r["n_repeated_words"]) for r in got), key=repr) == words_brute(rows, 10)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = R.remove_repeats(awkward).collect()
    assert sorted(((r["doc_id"], r["n_repeated_words"]) for r in got), key=repr) == words_brute(rows, 50)
    assert R.remove_repeats(nothing).collect() == []


def test_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = R.Repeats(awkward).removal().collect()
    assert sorted(map(tuple, got), key=repr)[:4] == removal_brute(rows, 400)[:4]
    assert sorted(map(tuple, got), key=repr) == removal_brute([(i, t) for i, t in rows], 400)
    assert R.Repeats(nothing).removal().collect() == []


def maximal_brute(contents, length):
    """{string: places} of the strings of at least length bytes that occur twice and can be extended on neither side in all places."""
    places = {}
    for c, s in enumerate(contents):
        for i in range(len(s)):
            for j in range(i + length, len(s) + 1):
                places.setdefault(s[i:j], []).append((c, i))
    out = {}
    for s, at in places.items():
        before = {contents[c][i - 1 : i] if i else (c,) for c, i in at}
        after = {contents[c][i + len(s) : i + len(s) + 1] or (c,) for c, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out[s] = sorted(at)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=24).map(str.encode), max_size=5), st.integers(8, 11))
def test_maximal_repeats(contents, length):
    got = {}
    found = [(n, f.members[lo:hi]) for f in R.maximal_repeats(contents, length) for lo, hi, n in f.intervals]
    for n, at in found:
        c, i = at[0]
        got[contents[c][i : i + n]] = sorted(at)
        assert all(contents[c][i : i + n] == contents[at[0][0]][at[0][1] : at[0][1] + n] for c, i in at)
    assert got == maximal_brute(contents, length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=60).map(str.encode), min_size=1, max_size=4))
def test_stretches_cover_every_string_and_equal_ones_meet(texts):
    bins = {}
    for t in texts:
        v, first, last, twice = R.stretches(t, 12, 4)
        starts = [k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)]
        assert starts == list(range(max(0, len(t) - 11)))
        for x, a, b, own in zip(v, first, last, twice, strict=True):
            inner = Counter(t[k : k + 12] for k in range(a, b + 1))
            assert own or max(inner.values()) == 1
            for s in inner:
                assert bins.setdefault(s, x) == x


def test_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs = spark.createDataFrame([(k, "".join(rng.choice("xyz") for _ in range(30)) + passage + str(k) * 30) for k in range(6)], "doc_id long, text string")
    groups = R.Repeats(docs, length=50, gram=8).groups().collect()
    assert groups and max(len(g["digests"]) for g in groups) == 6
    assert max(g["length"] for g in groups) <= 62


def test_merged():
    assert R.merged([(5, 9), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 9)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=20).map(str.encode), max_size=4).map(lambda x: x + x[:2] + x[:1]), st.integers(8, 11))
def test_copies_count_as_occurrences(contents, length):
    often = Counter(contents)
    once = list(often)
    got = {}
    for f in R.maximal_repeats(once, length, list(often.values())):
        for lo, hi, n in f.intervals:
            c, i = f.members[lo]
            got[once[c][i : i + n]] = sum(often[once[c]] for c, _ in f.members[lo:hi])
    assert got == {s: len(at) for s, at in maximal_brute(contents, length).items()}


def repeats_of(df, length, limit):
    """{(string, its places in the rows)} of groups()."""
    r = R.Repeats(df, length=length, gram=8, bin_limit=limit)
    text = {bytes(x["tk"]): (x["text"].encode(), x["n"]) for x in r.texts.collect()}
    found = {}
    for x in r.found.collect():
        found.setdefault((x["bin"], bytes(x["digest"])), []).append((bytes(x["tk"]), x["first"]))
    out = set()
    for g in r.groups().collect():
        at = [(tk, first + s) for d, s in zip(g["digests"], g["starts"], strict=True) for tk, first in found[g["bin"], bytes(d)]]
        strings = {text[tk][0][p : p + g["length"]] for tk, p in at}
        assert len(strings) == 1
        out.add((strings.pop(), tuple(sorted(at))))
    return out, text


@pytest.mark.parametrize("limit", [8192, 1])  # bins over 1 stretch are dealt by digest
def test_groups_of_copies_and_long_passages(spark, limit):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    twin, passage = word(300), word(400)
    rows = [twin, twin, *[word(30) + passage + word(30) for _ in range(5)]]
    groups, text = repeats_of(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 50, limit)
    by_string = {}
    for t, n in text.values():
        for k in range(len(t) - 49):
            by_string.setdefault(t[k : k + 50], []).append(n)
    cover = {string[k : k + 50] for string, _ in groups for k in range(len(string) - 49)}
    assert cover == {s for s, n in by_string.items() if sum(n) > 1}
    assert all(sum(text[tk][1] for tk, _ in at) == sum(n for t, n in text.values() for k in range(len(t)) if t.startswith(s, k)) for s, at in groups)


def test_groups_do_not_depend_on_the_bin_limit(spark):
    df = spark.createDataFrame(corpus(random.Random(3)), "doc_id long, text string")
    few, many = repeats_of(df, 40, 1)[0], repeats_of(df, 40, 8192)[0]
    assert few == many and few


def test_word_codes():
    """Equal words have equal codes wherever they stand; words that differ seldom agree; white space is ASCII's, as in bytes.split()."""
    rng = random.Random(8)
    words = [str(k) for k in range(20_000)] + ["größe", "\x1c", "a\u00a0b", "日本", "x" * 5000, "\x00", "\x00\x00"]
    code = {w: R.word_codes(w.encode()) for w in words}
    assert {len(c) for c in code.values()} == {R.CODE} and len(set(code.values())) > 16_800  # 17,200 of 65,536 are expected
    for _ in range(20):
        some = [rng.choice(words) for _ in range(rng.randrange(400))]
        text = "".join(rng.choice([" ", "\t\n ", "\x0b", "\r\x0c"]) + w for w in some) + rng.choice(["", " "])
        assert R.word_codes(text.encode()) == b"".join(code[w] for w in some) and text.encode().split() == [w.encode() for w in some]
    assert R.word_codes(b"") == R.word_codes(b" \n") == b""
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    assert len({R.word_codes(w) for w in words}) > 0.96 * len(set(words))


def test_texts_hashed_as_one_keep_their_stretches(monkeypatch):
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(90))) for _ in range(60)] + [b"a" * 50, b"a" * 50, b"", b"a" * 11, b"ab" * 6]
    each = [R.stretches(t, 12, 4) for t in texts]
    whole = [list(zip(*(c.tolist() for c in x), strict=True)) for x in each]
    for most in (1, 200, 1 << 20):
        monkeypatch.setattr(R, "JOINED_BYTES", most)
        got: list[list] = [[] for _ in texts]
        for i, *row in zip(*(c.tolist() for c in R.stretches_of(texts, 12, 4)), strict=True):
            got[i].append(tuple(row))
        assert got == whole


def test_spans_leave_the_worker_once(spark):
    """Families become spans where they are found: their intervals take no way through the JVM."""
    r = R.Repeats(spark.createDataFrame(corpus(random.Random(3)), "doc_id long, text string"), length=40, gram=8)
    assert r.spans()._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_all_equal_sees_every_byte():
    rng = random.Random(2)
    line = bytes(rng.randrange(256) for _ in range(40))
    a = R.np.arange(40 - 12 + 1)
    for k in range(40):
        other = line[:k] + bytes([line[k] ^ 1]) + line[k + 1 :]
        for second, same in ((line, True), (other, False)):
            assert R._all_equal(R.np.frombuffer(line + second + bytes(8), dtype="u1"), a, a + 40, 12) is same
