"""Repeated byte strings across documents: common-prefix interval trees over enhanced suffix arrays.

Every string of `length` bytes belongs to the bin of the least hash among the GRAM-byte strings in it (its
minimiser), so that equal strings meet in one bin. Consecutive strings of a text with the same
minimiser value form one stretch. Only stretches of bins that hold two or more strings go on; stretches of equal content
become one that counts them. For the stretches of a bin a suffix array of the strings' starts is built,
with the longest common prefixes between neighbours; a stack scan over it enumerates the prefix intervals of at least
`length` bytes, and those whose occurrences are preceded by different bytes, or begin their stretch,
are maximal repeats, given out with all their occurrences. A stretch that stands n times counts as n occurrences.

Texts can be read as words instead of bytes (unit="words"): each word becomes CODE bytes by its hash, and the same trees
find the strings of `length` words. Two words that differ agree by chance once in 65,536.

Bins meet by key after one count and one content per stretch; texts with equal content travel once. A bin
of more than bin_limit different stretches, as a passage in a large part of all documents has, is not
given to one task: its strings are dealt by their digests instead, each with all that agree in its first `length` bytes,
in suffix order; the same scan gives their intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_memory_back, materialise, small_batches

LENGTH, GRAM = 400, 32
#: The same for strings of words.
WORDS, WORD_GRAM, CODE = 50, 8, 2
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BIN_LIMIT = 8192
TURN_BYTES = 1_500_000
JOINED_BYTES = 64 << 10
SLOTS = 1 << 25
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FIRST = itemgetter(0)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size bytes; equal runs have equal hashes."""
    n = len(b)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=total[1:])
    return _mix((total[size:] - total[:-size]) * _power(INVERSE, n - size + 1))


def _sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    x = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    x[:n] = h
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, first, last, often): runs of starts of strings with one minimiser value; often: where the value occurs twice in the run."""
    return stretches_of([text], length, gram)[1:]


def stretches_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which text, bin, first, last, often) of the stretches of all texts, in their order. The texts of a turn are hashed as one; strings over
    an edge between two are left out."""
    parts, held, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if held and size + len(text) > JOINED_BYTES:
            parts.append(_joined_stretches(texts, held, length, gram))
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        parts.append(_joined_stretches(texts, held, length, gram))
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 4 + (np.empty(0, dtype=bool),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _joined_stretches(texts: list[bytes], which: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(texts[i]) for i in which], dtype=np.int64)
    begin = np.cumsum(size) - size
    h = window_hashes(np.frombuffer(b"".join([texts[i] for i in which]), dtype=np.uint8), gram)
    w = length - gram + 1
    least = _sliding_least(h, w)
    cut = np.empty(len(least) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    cut[begin] = cut[begin + size - length + 1] = True
    run = np.flatnonzero(cut)
    run, end = run[:-1], run[1:]
    text = np.searchsorted(begin, run, side="right") - 1
    own = run <= (begin + size - length)[text]
    run, end, text = run[own], end[own], text[own]
    # runs over w strings, as periodic text has, are cut, so that no stretch is longer than length + w - 1 and most are copies
    inside = -(-(end - run) // w)
    first = np.repeat(run, inside) + w * (np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside))
    last = np.minimum(first + w, np.repeat(end, inside)) - 1
    text = np.repeat(text, inside)
    value = least[first]
    # a value that occurs at two places of its run can hold a repeat of its own
    known = np.unique(value)
    place = np.flatnonzero(h <= known[-1])
    rank = np.minimum(np.searchsorted(known, h[place]), len(known) - 1)
    hit = known[rank] == h[place]
    at = np.sort(rank[hit] * len(h) + place[hit])
    row = np.searchsorted(known, value) * len(h)
    twice = np.searchsorted(at, row + last + w) - np.searchsorted(at, row + first) > 1
    return np.array(which, dtype=np.int64)[text], value.view(np.int64), first - begin[text], last - begin[text], twice


def _equal_runs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the size bytes at a[i] and b[i] are equal, for each i."""
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))  # eight bytes from each offset on
    out = np.ones(len(a), dtype=bool)
    for at in [*range(0, size - 7, 8), size - 8]:
        out &= words[a + at] == words[b + at]
    return out


def _all_equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> bool:
    """Whether the size bytes at a[i] and b[i] are equal for every i. Where the pair a byte before is asked about too, the last byte settles it."""
    if not len(a):
        return True
    key = np.sort((b - a) * len(buf) + a)
    after = np.concatenate(([False], np.diff(key) == 1))
    apart, at = np.divmod(key, len(buf))
    end = at[after] + size - 1
    return bool((buf[end] == buf[end + apart[after]]).all() and _equal_runs(buf, at[~after], (at + apart)[~after], size).all())


class Family:
    """Strings that agree in their first `length` bytes, as a piece of a suffix array, with its prefix intervals.

    members: (content, start) in suffix order; intervals: (lo, hi, common length) of the maximal repeats, whose occurrences are
    members[lo:hi] in all copies of their contents; reach: for each member the length of the longest maximal repeat that it is
    an occurrence of, or 0.
    """

    __slots__ = ("intervals", "members", "reach")

    def __init__(self, members: list[tuple]):
        self.members, self.intervals, self.reach = members, [], []


def maximal_repeats(contents: list[bytes], length: int, copies: list[int] | None = None) -> Iterator[Family]:
    """Every maximal repeat of at least length bytes within and across contents, of which copies[i] stand for contents[i] (one if not given).

    The suffix array holds the starts of strings of length bytes, sorted by a fingerprint of those bytes (checked
    byte by byte; above that depth any order does) and then by what follows.
    """
    size = np.array([len(c) for c in contents], dtype=np.int64)
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(contents) + bytes(8), dtype=np.uint8)
    per = np.maximum(size - length + 1, 0)
    if not per.sum():
        return
    owner = np.repeat(np.arange(len(contents)), per)
    start = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + begin[owner]
    h = window_hashes(buf[:-8], length)[start]
    order = np.argsort(h)
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    near = np.flatnonzero(same)
    meet = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))  # equal ones in order of their places
    order[meet] = np.sort(np.cumsum(np.concatenate(([True], ~same)))[meet] * len(order) + order[meet]) % len(order)
    if not _all_equal(buf, start[order[near]], start[order[near + 1]], length):  # two strings share a fingerprint: the order of the bytes parts them
        for lo, hi in _spans(same):
            order[lo:hi] = sorted(order[lo:hi], key=lambda i: buf[start[i] : start[i] + length].tobytes())
        same = _equal_runs(buf, start[order[1:]], start[order[:-1]], length)
    left = np.where(start > begin[owner], buf[np.maximum(start - 1, 0)].astype(np.int64), 256 + owner)
    n = np.ones(len(contents), dtype=np.int64) if copies is None else np.array(copies, dtype=np.int64)
    alone = ~np.concatenate(([False], same)) & ~np.concatenate((same, [False]))
    alone &= (left[order] > 255) & (n[owner[order]] > 1)  # a copied content that shares its first string with no other
    spans = sorted(_spans(same, left[order]) + [(i, i + 1) for i in np.flatnonzero(alone).tolist()])
    rows = order[np.concatenate([np.arange(lo, hi) for lo, hi in spans])] if spans else order[:0]
    c = owner[rows]
    members = zip(c.tolist(), (start[rows] - begin[c]).tolist(), left[rows].tolist(), n[c].tolist(), strict=True)
    for lo, hi in spans:
        each = [(contents[k][at + length :], before, often, (k, at)) for k, at, before, often in islice(members, hi - lo)]
        each.sort(key=FIRST)
        family = Family([x[3] for x in each])
        _scan(family, each, length)
        yield family


def _spans(same: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """[lo, hi) of the runs of equal neighbours; with left, only of those preceded by different bytes (else no interval in them is maximal)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2] + 1
    if left is not None and len(lo):
        cuts = np.column_stack((lo, hi)).ravel()
        pad = np.append(left, 0)
        keep = np.minimum.reduceat(pad, cuts)[::2] != np.maximum.reduceat(pad, cuts)[::2]
        lo, hi = lo[keep], hi[keep]
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def _common_prefix(a: bytes, b: bytes) -> int:
    """Of a and b, which sorts behind it or equals it."""
    if b.startswith(a):
        return len(a)
    low, top = 0, min(len(a), len(b))
    while top - low > 1:  # the common prefix's length lies in [low, top)
        mid = (low + top) // 2
        low, top = (mid, top) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _scan(family: Family, rows: Iterable[tuple], length: int) -> None:
    """Stack scan of the common-prefix intervals of sorted (tail, byte before or a number above 255, copies, ...): keeps those whose members are
    preceded by different bytes. Copies of a content share a whole tail; where it begins they are preceded by different bytes.
    An interval closes before those around it, so the first to hold a member is the longest: each member is settled once."""
    stack: list[list] = []  # common length of the tails, first row, the byte before all rows or None
    unsettled: list[int] = []
    reach, intervals, k, here = family.reach, family.intervals, -1, None
    for row in chain(rows, (None,)):
        if here is None:
            here = row
            continue
        tail, mark, n = here[:3]
        k += 1
        common = _common_prefix(tail, row[0]) if row is not None else -1
        here = row
        reach.append(0)
        unsettled.append(k)
        first = k
        if n > 1:
            mark = None if mark > 255 else mark
            if stack and stack[-1][0] == len(tail):
                if stack[-1][2] != mark:
                    stack[-1][2] = None
            else:
                stack.append([len(tail), k, mark])
        while stack and stack[-1][0] > common:
            depth, first, inner = stack.pop()
            if mark is not None and mark != inner:
                mark = None
            if mark is None:
                intervals.append((first, k + 1, length + depth))
                while unsettled and unsettled[-1] >= first:
                    reach[unsettled.pop()] = length + depth
        if stack and stack[-1][0] == common:
            if stack[-1][2] != mark:
                stack[-1][2] = None
        elif common >= 0:
            stack.append([common, first, mark])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


# ---- the tasks ----


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time: as Python objects a whole one can take many times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _raw(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def word_codes(raw: bytes) -> bytes:
    """CODE bytes for each word of raw, cut at ASCII white space: of a hash of the word, by prefix sums as in window_hashes()."""
    n = len(raw)
    if not n:
        return b""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[b]
    edge = np.flatnonzero(np.diff(inside))
    first, end = edge[::2], edge[1::2]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=total[1:])
    h = _mix((total[end] - total[first]) * _power(INVERSE, n)[first])
    return (h >> np.uint64(64 - 8 * CODE)).astype(f"<u{CODE}").tobytes()


def _word_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tk, text) -> (doc_id, tk, text) with CODE bytes for each word of the text, cut at ASCII white space."""
    for part in _slices(batches, 1000):
        rows = [word_codes(text.encode()) for text in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "tk", "text"])
    give_memory_back()


def _bins(length: int, gram: int):
    """(tk, text) -> (tk, bin, strings): the bins of a text; strings is 2 where one stretch alone may hold a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 500):
            which, value, _, _, twice = stretches_of([_raw(x) for x in part.column(1).to_pylist()], length, gram)
            order = np.lexsort((value, which))
            which, value = which[order], value[order]
            new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (value[1:] != value[:-1])))[: len(value)])
            strings = np.add.reduceat(1 + twice[order].astype(np.int64), new) if len(new) else new
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which[new])), pa.array(value[new]), pa.array(strings)], names=["tk", "bin", "strings"])

    return run


def _contents(length: int, gram: int):
    """(tk, text, n, bins) -> (bin, digest, tk, first, n, twice, content): the stretches of a text in the given bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bin", "digest", "tk", "first", "n", "twice", "content"]
        for part in _slices(batches, 200):
            out: list[list] = [[] for _ in names]
            tks, texts, ns, bins = (part.column(k).to_pylist() for k in range(4))
            raws, wanted = [_raw(x) for x in texts], [set(x) for x in bins]
            for t, v, first, last, twice in zip(*(x.tolist() for x in stretches_of(raws, length, gram)), strict=True):
                if v in wanted[t]:
                    content = raws[t][first : last + length]
                    for column, x in zip(out, (v, hashlib.blake2b(content, digest_size=16).digest(), tks[t], first, ns[t], twice, content), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return run


FAMILIES = "bin long, digests array<binary>, starts array<long>, reach array<long>, intervals array<struct<lo:int,hi:int,length:int>>"


def _family_rows(families: Iterator[tuple[int, list[bytes], Family]]) -> Iterator[pa.RecordBatch]:
    """(bin, digest of each member, family) -> FAMILIES."""
    interval = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("length", pa.int32())])
    types = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(interval))
    out: list[list] = [[] for _ in types]
    members = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["bin", "digests", "starts", "reach", "intervals"])

    for key, digests, f in families:
        values = (key, digests, [s for _, s in f.members], f.reach, [{"lo": a, "hi": b, "length": n} for a, b, n in f.intervals])
        for column, x in zip(out, values, strict=True):
            column.append(x)
        members += len(f.members)
        if members > 50_000:
            yield made()
            out, members = [[] for _ in types], 0
    yield made()


SPANS = "bin long, digest binary, s long, e long"


def _span_rows(families: Iterator[tuple[int, list[bytes], Family]]) -> Iterator[pa.RecordBatch]:
    """(bin, digest of each member, family) -> SPANS: the repeats' spans in the stretches, joined as far as one batch shows them."""
    spans: dict = {}
    members = 0

    def made() -> pa.RecordBatch:
        rows = [(b, d, s, e) for (b, d), x in spans.items() for s, e in merged(x)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["bin", "digest", "s", "e"])

    for key, digests, f in families:
        for d, (_, s), n in zip(digests, f.members, f.reach, strict=True):
            if n:
                spans.setdefault((key, d), []).append((s, s + n))
        members += len(f.members)
        if members > 200_000:
            yield made()
            spans, members = {}, 0
    yield made()


def _families(length: int, rows_of=_family_rows, turn_bytes: int = TURN_BYTES):
    """(bin, digest, n, content) sorted by bin -> FAMILIES, or what rows_of makes: the maximal repeats of each bin.
    As many whole bins as make up turn_bytes share a suffix array; strings of different bins are never equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        size = 0

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            found = maximal_repeats([c for *_, c in rows], length, [n for _, _, n, _ in rows])
            yield from rows_of((rows[f.members[0][0]][0], [rows[c][1] for c, _ in f.members], f) for f in found)

        for batch in _slices(batches, 1000):
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= turn_bytes and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from flush(held)

    return run


def _dealt_families(length: int, rows_of=_family_rows):
    """(string, tail, bin, digest, s, n, before) sorted by string and tail -> FAMILIES, or what rows_of makes: the maximal repeats that begin with each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in _slices(batches, 1000) for row in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True))

        def families() -> Iterator[tuple[int, list[bytes], Family]]:
            for _, of in groupby(rows, key=lambda row: row[0]):
                family, bins = Family([]), []

                def read(of=of, family=family, bins=bins) -> Iterator[tuple[bytes, int, int]]:
                    for _, tail, b, digest, s, n, before in of:
                        bins[:] = [b]
                        family.members.append((digest, s))
                        yield tail, 256 + len(family.members) if before is None else before, n

                _scan(family, read(), length)
                if family.intervals:
                    yield bins[0], [d for d, _ in family.members], family

        yield from rows_of(families())

    return run


def _removed(length: int, code: int):
    """(tk, text, spans) -> (tk, n_removed, n_spans, kept), spans joined; kept: the digest of what stays. code: bytes of a unit, to which spans are drawn in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 200):
            out: list[list] = [[], [], [], []]
            for tk, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw, cover = _raw(text), merged([(x["s"], x["e"]) for x in spans])
                if code > 1:
                    cover = [(s, e) for s, e in ((-(-s // code) * code, e // code * code) for s, e in cover) if e - s >= length]
                digest, at = hashlib.sha256(), 0
                for s, e in cover:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                for column, x in zip(out, (tk, sum(e - s for s, e in cover) // code, len(cover), digest.hexdigest()), strict=True):
                    column.append(x)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["tk", "n_removed", "n_spans", "kept"])

    return run


# ---- the operator ----


class Repeats:
    """The repeats of at least `length` bytes in the texts of docs: groups(), spans() per distinct text, removal() per document.

    tk is the digest of a text. A null text is empty; matches never cross texts; texts shorter than length have none. Rows that
    repeat a text are documents of their own, so all of a text of length bytes or more that occurs twice is repeated.
    Very long texts give as many stretches as their length asks for. Extra columns are ignored; an empty table gives empty results.

    unit: "bytes", or "words", where length, gram and n_removed count words; places count CODE bytes a word.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", id_col: str = "doc_id", bin_limit: int = BIN_LIMIT, unit: str = "bytes"):
        small_batches(docs.sparkSession)
        self.code = CODE if unit == "words" else 1
        length, gram = length * self.code, gram * self.code
        self.length, self.bin_limit, self.written = length, bin_limit, []
        col = F.coalesce(docs[text], F.lit(""))
        tk = F.unhex(F.sha2(F.encode(col, "UTF-8"), 256))
        self.docs = docs.select(docs[id_col].alias("doc_id"), tk.alias("tk"), col.alias("text"))
        if unit == "words":
            some = self.docs.where(F.octet_length("text") >= 2 * (length // CODE) - 1)  # a word and what parts it from the next
            self.docs = self._write(some.mapInArrow(_word_bytes, self.docs.select("doc_id", "tk").schema.add("text", "binary")))
        long = self.docs.where(F.octet_length("text") >= length)
        seen = long.select("tk", "text").mapInArrow(_bins(length, gram), "tk binary, bin long, strings long")
        seen = self._write(seen)
        open_ = seen.groupBy("bin").agg(F.sum("strings").alias("strings")).where("strings > 1").select("bin")
        wanted = self._write(seen.join(open_, "bin").select("tk", "bin").distinct().groupBy("tk").agg(F.collect_list("bin").alias("bins")))  # of one text: as long as it at most
        # each distinct text once, with the number of documents that have it
        texts = self._only(long, wanted).groupBy("tk").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        self.texts = self._write(texts.join(wanted, "tk"))
        found = self.texts.select("tk", "text", "n", "bins").mapInArrow(_contents(length, gram), "bin long, digest binary, tk binary, first long, n long, twice boolean, content binary")
        self.found = self._write(found)
        stretch = self.found.groupBy("bin", "digest").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"), F.first("content").alias("content"))
        self.stretch = self._write(stretch)
        bins = self.stretch.groupBy("bin").agg(F.count("*").alias("different"), F.max("twice").alias("own"), F.max("n").alias("most"))
        self.bins = bins.where("different > 1 OR own OR most > 1")

    def _write(self, df: DataFrame) -> DataFrame:
        self.written.append(materialise(df))
        return self.written[-1]

    def discard(self) -> None:
        """Takes the intermediate tables away; what was made of them must have been written."""
        for df in self.written:
            discard(df)
        self.written = []

    @staticmethod
    def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows whose tk is in keys and a few others: a Bloom filter of bounded size spares the rest the shuffle."""
        n, slots = keys.count(), 1 << 10
        while slots < min(8 * n, SLOTS):
            slots *= 2
        slot = F.pmod(F.xxhash64("tk"), F.lit(slots))
        words = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("__bits"))
        # at most SLOTS / 64 rows of 16 bytes
        tested = docs.withColumn("__slot", slot).join(F.broadcast(words), F.expr("__slot div 64 = __word"))
        return tested.where("(shiftright(__bits, cast(__slot % 64 as int)) & 1L) = 1L").select(*docs.columns)

    def families(self, rows_of=_family_rows, schema: str = FAMILIES) -> DataFrame:
        """FAMILIES rows: suffix-array pieces with their maximal repeats as intervals; or what rows_of makes of them."""
        rows = self.stretch.join(self.bins.where(F.col("different") <= self.bin_limit).select("bin"), "bin").select("bin", "digest", "n", "content")
        out = rows.repartition("bin").sortWithinPartitions("bin", "digest").mapInArrow(_families(self.length, rows_of), schema)
        if self.bins.where(F.col("different") > self.bin_limit).isEmpty():
            return out
        return out.unionByName(self._large(rows_of, schema))

    def groups(self) -> DataFrame:
        """(bin, length, digests, starts): each maximal repeat with all its occurrences; found maps a stretch's digest to its texts and places,
        of which there may be many to one digest (a stretch that stands twice repeats as a whole)."""
        each = self.families().select("bin", "digests", "starts", F.explode("intervals").alias("i"))
        part = lambda c: F.slice(c, F.col("i.lo") + 1, F.col("i.hi") - F.col("i.lo"))
        return each.select("bin", F.col("i.length").cast("long").alias("length"), part("digests").alias("digests"), part("starts").alias("starts"))

    def _large(self, rows_of, schema: str) -> DataFrame:
        """families() of bins over bin_limit: strings are dealt by their digests. Only those preceded by different bytes, or that
        begin a stretch, go on with what follows them: all others are occurrences of a longer repeat that begins before them."""
        rows = self.stretch.join(self.bins.where(F.col("different") > self.bin_limit).select("bin"), "bin")
        before = F.conv(F.hex(F.expr("substring(content, s, 1)")), 16, 10).cast("int")
        strings = rows.select("bin", "digest", "n", "content", F.explode(F.sequence(F.lit(0), F.length("content") - self.length)).alias("s"))
        strings = strings.select("bin", "digest", "n", F.col("s").cast("long").alias("s"), F.when(F.col("s") > 0, before).alias("before"), F.unhex(F.sha2(F.expr(f"substring(content, s + 1, {self.length})"), 256)).alias("string"))
        of = strings.groupBy("string").agg(F.count("*").alias("c"), F.count("before").alias("inner"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.max(F.when(F.col("s") == 0, F.col("n"))).alias("whole"))
        kept = of.where("(c > 1 AND (c > inner OR lo < hi)) OR whole > 1").select("string")
        hits = strings.join(kept, "string").groupBy("bin", "digest").agg(F.collect_list(F.struct("string", "s", "before")).alias("hits"))  # within one stretch
        each = rows.join(hits, ["bin", "digest"]).select("bin", "digest", "n", "content", F.explode("hits").alias("h"))
        tail = F.expr(f"substring(content, cast(h.s AS int) + 1 + {self.length})")
        each = each.select("h.string", tail.alias("tail"), "bin", "digest", "h.s", "n", "h.before")
        return each.repartition("string").sortWithinPartitions("string", "tail").mapInArrow(_dealt_families(self.length, rows_of), schema)

    def spans(self) -> DataFrame:
        """(tk, spans): of each text with repeats the spans found, not yet joined."""
        each = self.families(_span_rows, SPANS)
        of = each.groupBy("bin", "digest").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # within one stretch
        placed = self.found.select("bin", "digest", "tk", "first").join(of, ["bin", "digest"])
        shifted = placed.select("tk", F.transform("spans", lambda x: F.struct((x["s"] + F.col("first")).alias("s"), (x["e"] + F.col("first")).alias("e"))).alias("spans"))
        return shifted.groupBy("tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # within one text

    def _cut(self) -> DataFrame:
        """(tk, n_removed, n_spans, kept): of each distinct text with repeats what goes and the digest of what stays."""
        cut = self.texts.select("tk", "text").join(self.spans(), "tk").select("tk", "text", "spans")
        done = cut.mapInArrow(_removed(self.length, self.code), "tk binary, n_removed long, n_spans long, kept string")
        return materialise(done)

    def removal(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each document without its repeated bytes."""
        return _removal(self.docs, self._cut()).drop("tk")


def _removal(docs: DataFrame, done: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    plain = docs.select("doc_id", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    out = plain.join(done.withColumnRenamed("tk", "__tk"), F.col("tk") == F.col("__tk"), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), "tk")


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Repeats.removal(), and behind it n_repeated_words: how many words of a document lie in strings of `words` words that also start
    elsewhere. Passages of many short words are shorter than `length` bytes, so they count there and stay. Both passes discard their tables."""
    by_words = Repeats(docs, words, WORD_GRAM, text, id_col, unit="words")
    passages = by_words._cut().select(F.col("tk").alias("__at"), F.col("n_removed").alias("n_repeated_words"))
    by_words.discard()
    by_bytes = Repeats(docs, length, GRAM, text, id_col)
    out = _removal(by_bytes.docs, by_bytes._cut())
    by_bytes.discard()
    out = out.join(passages, F.col("tk") == F.col("__at"), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_repeated_words", F.lit(0).cast("long")).alias("n_repeated_words"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
strings AS (SELECT r, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) AS i FROM d),
hit AS (SELECT r, i FROM (SELECT r, i, md5(b[i + 1:i + {LENGTH}]) AS k FROM strings) QUALIFY count(*) OVER (PARTITION BY k) > 1),
cut AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT r, min(i) AS s, max(i) + {LENGTH} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM cut) GROUP BY r, g),
kept AS (SELECT r, s, d.b[lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) + 1:s] AS part FROM spans JOIN d USING (r)
         UNION ALL SELECT r, octet_length(b), b[e + 1:octet_length(b)] FROM (SELECT r, coalesce(max(e), 0) AS e FROM d LEFT JOIN spans USING (r) GROUP BY r) JOIN d USING (r)),
whole AS (SELECT r, sha256(unhex(string_agg(hex(part), '' ORDER BY s))) AS kept_sha256 FROM kept GROUP BY r),
totals AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
wat AS (SELECT r, ws, unnest(range(1, len(ws) - {WORDS - 2})) AS i FROM d),
whit AS (SELECT r, i FROM (SELECT r, i, md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')) AS k FROM wat) QUALIFY count(*) OVER (PARTITION BY k) > 1),
words AS (SELECT r, sum(least({WORDS}, coalesce(next - i, {WORDS}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM whit) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       kept_sha256, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated_words
FROM d JOIN whole USING (r) LEFT JOIN totals USING (r) LEFT JOIN words USING (r)
"""
