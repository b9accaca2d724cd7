"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words (A-Z lower-cased, cut at ASCII white space). Texts with the same
set are copies and become one node that counts them. Nodes that agree in a band of MinHash values meet in
a bucket; within it the MinHash values of each pair are compared BATCH at a time, and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below TOLERANCE. What is left
spans candidate groups (connected components), whose members meet once more with their shingle sets; pairs
that survive the same comparison there are verified exactly, and each node's links are counted.

No step emits all pairs: buckets and groups of any size are compared in blocks of BLOCK nodes, a pair of
blocks to a task's turn, and yield at most one spanning edge and one count for each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Bounded, give_memory_back, materialise, one_of_each, small_batches, worker_keeps_nothing
from .graph import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of 4/5 or more
ROWS, BANDS, BATCH = 4, 24, 16
HASHES = ROWS * BANDS
TOLERANCE = 1e-6
BLOCK = 1024
CACHE_BYTES = 64 << 20
#: Below this many rows the table of texts to verify is broadcast as ids (8 bytes each).
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240229)
FACTOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(SHINGLE)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, cache: Bounded) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of five words; a shorter text is one run, an empty one none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    try:
        h = np.array([cache[w] for w in words], dtype=np.uint64)
    except KeyError:
        cache.make_room()
        for w in [w for w in set(words) if w not in cache]:
            cache.put(w, xxhash.xxh3_64_intdigest(w), len(w))
        h = np.array([cache[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total += h[k : k + n] * POWERS[k]
    return np.unique(_mix(total + np.uint64(min(SHINGLE, len(h)))))


def min_hashes(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1024):
        np.minimum(best, (s[at : at + 1024, None] * FACTOR + OFFSET).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(hashes: int, tolerance: float = TOLERANCE) -> int:
    """The fewest agreeing values among so many at which the similarity, uniform before, still reaches the
    threshold with a probability of tolerance."""
    t, n = NUMERATOR / DENOMINATOR, hashes + 1
    total = 0.0
    for m in range(hashes + 1):
        total += comb(n, m) * t**m * (1 - t) ** (n - m)  # P(similarity >= t | m agree) = P(Binomial(n, t) <= m)
        if total >= tolerance:
            return m
    return hashes


LEAST = {h: least_matches(h) for h in range(BATCH, HASHES + 1, BATCH)}


def plausible(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) of rows of sig survive the incremental comparison."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for h in range(BATCH, HASHES + 1, BATCH):
        seen[alive] += (sig[a[alive], h - BATCH : h] == sig[b[alive], h - BATCH : h]).sum(axis=1)
        alive = alive[seen[alive] >= LEAST[h]]
        if not len(alive):
            break
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _pairs(side: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a turn's rows, some at a time: all of one block, or those of block i with block j."""
    n = len(side)
    if i == j:
        step = max(1, (1 << 19) // max(n, 1))
        for at in range(0, n, step):
            a, b = np.nonzero(np.arange(at, min(n, at + step))[:, None] < np.arange(n)[None, :])
            yield a + at, b
    else:
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        step = max(1, (1 << 19) // max(len(right), 1))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row it is connected with by the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _turns(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that agree in the first columns, from sorted batches: several groups in each batch."""
    held: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in range(keys):
            c = batch.column(k)
            change |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(change) + 1

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    import pyarrow.compute  # noqa: F401

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = bounds(batch)
        same = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys))
        if held and not same:
            yield joined()
            held = []
        if not len(cut):
            held.append(batch)
            continue
        if held:
            held.append(batch.slice(0, cut[0]))
            yield joined()
            held = []
            if len(cut) > 1:
                yield batch.slice(cut[0], cut[-1] - cut[0])
        else:
            yield batch.slice(0, cut[-1])
        held = [batch.slice(cut[-1])]
    if held:
        yield joined()


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[int, int]]:
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in range(keys):
        c = batch.column(k)
        change |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, sig) sorted by (key, i, j) -> spanning edges (a, b) of the plausible pairs."""
    for batch in _turns(batches, 3):
        sig, nodes = _signatures(batch.column(5)), batch.column(4)
        i_of, j_of, side = (batch.column(k).to_numpy() for k in (1, 2, 3))
        two_a, two_b, from_, to = [], [], [], []
        for s, e in _groups(batch, 3):
            if e - s == 2:
                if i_of[s] == j_of[s] or side[s] != side[s + 1]:
                    two_a.append(s)
                    two_b.append(s + 1)
                continue
            pa_, pb_ = [], []
            for a, b in _pairs(side[s:e], int(i_of[s]), int(j_of[s])):
                ok = plausible(sig[s:e], a, b)
                pa_.append(a[ok])
                pb_.append(b[ok])
                if len(pa_) > 8:  # keep a spanning set only
                    label = _least_labels(e - s, np.concatenate(pa_), np.concatenate(pb_))
                    at = np.flatnonzero(label != np.arange(e - s))
                    pa_, pb_ = [at], [label[at]]
            if pa_:
                label = _least_labels(e - s, np.concatenate(pa_), np.concatenate(pb_))
                at = np.flatnonzero(label != np.arange(e - s))
                from_.append(at + s)
                to.append(label[at] + s)
        a, b = np.array(two_a, dtype=np.int64), np.array(two_b, dtype=np.int64)
        ok = plausible(sig, a, b)
        a, b = np.concatenate([a[ok], *from_]), np.concatenate([b[ok], *to])
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])
    give_memory_back()


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets."""
    n = len(sets)
    if len(a) <= 4 * n:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    owner, inverse = owner[keep], shared[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total, width = np.zeros((n, n), dtype=np.float32), 4096
    for at in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        lo, hi = np.searchsorted(inverse, (at, at + width))
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[lo:hi], inverse[lo:hi] - at] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, copies, set) sorted by (key, i, j) -> (node, links, label): links counts the documents
    that the turn's verified pairs link to node, label is the least node they connect it with."""
    for batch in _turns(batches, 3):
        nodes = batch.column(4)
        i_of, j_of, side, copies = (batch.column(k).to_numpy() for k in (1, 2, 3, 5))
        which, links, label_of = [], [], []
        for s, e in _groups(batch, 3):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(6).slice(s, e - s).to_pylist()]
            sig = np.stack([min_hashes(x) for x in sets])
            size = np.array([len(x) for x in sets])
            mine, keep_a, keep_b = np.zeros(e - s, dtype=np.int64), [], []
            for a, b in _pairs(side[s:e], int(i_of[s]), int(j_of[s])):
                ok = plausible(sig, a, b)
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                both = _common(sets, a, b)
                ok = DENOMINATOR * both >= NUMERATOR * (size[a] + size[b] - both)
                a, b = a[ok], b[ok]
                np.add.at(mine, a, copies[s:e][b])
                np.add.at(mine, b, copies[s:e][a])
                keep_a.append(a)
                keep_b.append(b)
            label = _least_labels(e - s, np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else np.arange(e - s)
            at = np.flatnonzero(mine > 0)
            which.append(at + s)
            links.append(mine[at])
            label_of.append(label[at] + s)
        if which:
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(links)), nodes.take(pa.array(np.concatenate(label_of)))], names=["node", "links", "label"])
    give_memory_back()


def _in_turns(rows: DataFrame, payload: list[str], block: int) -> DataFrame:
    """rows (key, n, node, ...): n rows have the key. -> (key, i, j, side, node, *payload), each row once for every pair of
    blocks that its block is in; dealt and sorted by (key, i, j). Nodes of a turn come in order."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    out = rows.select("key", "node", *payload, own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    out = out.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", *payload)
    return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def signed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc_id, ref, text_md5, node, sig, bands): node is the digest of the shingle set, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_keeps_nothing()
        cache = Bounded(CACHE_BYTES)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node, sig, bands = [], [], []
                for text_ in part.column(3).to_pylist():
                    s = shingles(text_, cache)
                    if not len(s):
                        node.append(None), sig.append(None), bands.append(None)
                        continue
                    m = min_hashes(s)
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(m.tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(m[k : k + ROWS].tobytes(), seed=k) - (1 << 63) for k in range(0, HASHES, ROWS)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "ref", "text_md5", "node", "sig", "bands"])
        give_memory_back()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _ref(docs, text, id_col).alias("ref"), text_md5(docs[text]).alias("text_md5"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ref long, text_md5 binary, node binary, sig binary, bands array<long>")


def text_md5(col: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(col, F.lit("")), "UTF-8")))


def one_of_each_class(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each class of docs, with all its columns: that of the least doc_id, null being greater than any, and of the least text digest
    where ids repeat. Texts without shingles all stay."""
    found = materialise(_classes(docs, text, id_col, BLOCK, keep=True))
    key = [F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")]
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (text_md5(docs[text]) == F.col("__md5"))
    drop = materialise(found.where("NOT keep").select(*key).distinct())
    left = docs.join(drop, same, "left_anti")
    again = materialise(found.where("keep").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select("__id", "__md5"))
    if again.isEmpty():
        return left
    rows = left.join(again, same, "left_semi")
    return left.join(again, same, "left_anti").unionByName(one_of_each(rows, [rows[id_col].cast("long"), text_md5(rows[text])], rows.columns))


def _ref(docs: DataFrame, text: str, id_col: str):
    """Where a row's text can be found again; it need not be unique."""
    return F.coalesce(docs[id_col].cast("long"), F.xxhash64(docs[text]))


def similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, text_md5, class_id, copies, n_links), one row per document.

    class_id: the least doc_id of the documents that chains of links connect; copies: the documents with the same
    shingle set, this one included; n_links: the other documents, copies included, whose similarity is 4/5 or
    more. A text of one to four words is one shingle. A null text or one without words has no shingles: it links to
    nothing, not even to others like it, and is a class of its own, as is a null id without links (class_id null).
    Rows that repeat an id count each; extra columns are ignored; an empty table gives an empty result.
    """
    return _classes(docs, text, id_col, block)


def _classes(docs: DataFrame, text: str, id_col: str, block: int, keep: bool = False) -> DataFrame:
    """similar(); with keep also whether a row has the least id and text digest of its class (null without shingles)."""
    top = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    small_batches(docs.sparkSession)
    docs_signed = materialise(signed(docs, text, id_col))
    some = docs_signed.where(F.col("node").isNotNull())
    nodes = materialise(some.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("ref").alias("ref"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), *([F.min(top).alias("top")] if keep else [])))

    # buckets of two nodes or more
    banded = nodes.select("node", F.explode("bands").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = banded.join(counts, "key").join(nodes.select("node", "sig"), "node")
    edges = _in_turns(met, ["sig"], block).mapInArrow(_bucket_edges, "a binary, b binary").distinct()
    groups = materialise(components(edges))
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))

    # the members' shingle sets, from their texts
    members = nodes.join(groups, "node").join(sizes, "label").select("node", F.col("label").alias("key"), "n", "copies", "ref")
    members = materialise(members)
    refs = members.select(F.col("ref").alias("__ref")).distinct()
    if members.count() <= BROADCAST_IDS:
        refs = F.broadcast(refs)
    rows = docs.select(_ref(docs, text, id_col).alias("__at"), docs[text].alias("text"))
    texts = rows.join(refs, F.col("__at") == F.col("__ref"), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Bounded(CACHE_BYTES)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                s = [shingles(x, cache).tobytes() for x in batch.column(0).slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in s], pa.binary()), pa.array(s, pa.binary())], names=["node", "set"])
        give_memory_back()

    found = texts.mapInArrow(sets, "node binary, set binary").groupBy("node").agg(F.first("set").alias("set"))
    turns = _in_turns(members.join(found, "node"), ["copies", "set"], block)
    partial = materialise(turns.mapInArrow(_verified, "node binary, links long, label binary"))
    links = partial.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(partial.select(F.col("node").alias("a"), F.col("label").alias("b")))
    least = classes.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("class_least"))
    if keep:
        tops = classes.join(nodes.select("node", "top"), "node").groupBy("label").agg(F.min("top").alias("class_top"))
        least = least.join(tops, "label")
    classes = classes.join(least, "label").join(links, "node").select("node", "class_least", "links", *(["class_top"] if keep else []))
    about = nodes.select("node", "copies", "least", *(["top"] if keep else [])).join(classes, "node", "left")
    chosen = [F.coalesce("class_top", "top").alias("top")] if keep else []
    about = about.select(F.col("node").alias("__node"), "copies", F.coalesce("class_least", "least").alias("class_least"), F.coalesce("links", F.lit(0)).alias("links"), *chosen)
    out = docs_signed.select("doc_id", "text_md5", "node").join(about, F.col("node") == F.col("__node"), "left")
    one = F.lit(1).cast("long")
    return out.select("doc_id", "text_md5", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_least")).alias("class_id"), F.coalesce("copies", one).alias("copies"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", one) - 1).alias("n_links"), *([F.when(F.col("node").isNotNull(), top.eqNullSafe(F.col("top"))).alias("keep")] if keep else []))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END)) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, common = na AND common = nb AS same FROM pairs JOIN (SELECT doc_id AS a, n AS na FROM sizes) USING (a) JOIN (SELECT doc_id AS b, n AS nb FROM sizes) USING (b)
          WHERE {DENOMINATOR} * common >= {NUMERATOR} * (na + nb - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
linked AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS others FROM links GROUP BY 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(class_id AS BIGINT) AS class_id, CAST(coalesce(others, 0) + 1 AS BIGINT) AS copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w JOIN class USING (doc_id) LEFT JOIN linked USING (doc_id)
"""
