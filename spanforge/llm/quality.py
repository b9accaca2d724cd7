"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes slide over the whole text STRIDE bytes at a time;
their rectified responses are max-pooled over overlapping chunks. A document's chunks are combined by
the mean, maximum and minimum of each filter, and a hidden layer turns those into one probability. Text of little variety
shows as few filters responding, noise as the filters that learned it, and a document with both by the mean.

The network is fitted on the driver on a bounded sample of labelled rows (fit_rows per class in hash order, as far as their texts of
any length add up to fit_bytes) with weights that restore the classes' shares among all labelled rows. Every text is then
scored whole, in parallel, with the weights (some tens of kilobytes) sent along with the tasks. Responses are made
SLICE_BLOCKS blocks at a time, so that a text takes a few bytes of memory a byte, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_memory_back, numbered, renamed, small_batches, worker_keeps_nothing

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 6, 2, 8, 24, 16
#: Positions in a block, blocks in a chunk and from one chunk to the next: 512 bytes, 64 of which overlap.
BLOCK, CHUNK, STEP = 32, 8, 7
FIT_ROWS, FIT_BYTES, EPOCHS, BATCH, LEAST_STEPS = 1500, 64 << 20, 14, 32, 700
SLICE_BYTES, SLICE_BLOCKS = 1 << 19, 1 << 13
THRESHOLD = 0.3

Weights = dict[str, np.ndarray]


def initial(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    n = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return {
        "embed": 0.5 * n(256, EMBED),
        "filters": n(WIDTH * EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED / 8)),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "w1": n(3 * FILTERS, HIDDEN) / np.float32(np.sqrt(3 * FILTERS / 2)),
        "b1": np.zeros(HIDDEN, dtype=np.float32),
        "w2": n(HIDDEN) / np.float32(np.sqrt(HIDDEN)),
        "b2": np.zeros(1, dtype=np.float32),
    }


class Layout:
    """Texts laid end to end, each from a new block on and with zeros behind it."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        unit = BLOCK * STRIDE
        blocks = (size + WIDTH + unit - 1) // unit
        first = np.cumsum(blocks) - blocks
        self.data = np.zeros(int(blocks.sum()) * unit + WIDTH, dtype=np.uint8)
        for t, b in zip(texts, first.tolist(), strict=True):
            self.data[b * unit : b * unit + len(t)] = np.frombuffer(t, dtype=np.uint8)
        self.n_blocks = int(blocks.sum())
        #: the positions behind the end of each text, in order
        self.outside = np.concatenate([np.arange(f * BLOCK - (-n // STRIDE), (f + b) * BLOCK) for f, b, n in zip(first.tolist(), blocks.tolist(), size.tolist(), strict=True)])
        chunks = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
        self.chunk_first = np.cumsum(chunks) - chunks
        self.chunks = chunks
        inner = np.arange(int(chunks.sum())) - np.repeat(self.chunk_first, chunks)
        start = np.repeat(first, chunks) + inner * STEP
        last = np.repeat(first + blocks, chunks) - 1
        #: blocks of each chunk; the last chunk of a text repeats its last block
        self.blocks = np.minimum(start[:, None] + np.arange(CHUNK), last[:, None])

    def window_bytes(self, at: np.ndarray) -> np.ndarray:
        """The WIDTH bytes under the filters at positions of any shape, in a last axis."""
        return self.data[at[..., None] * STRIDE + np.arange(WIDTH)]


def responses(w: Weights, lay: Layout, first: int, last: int) -> np.ndarray:
    """(blocks, BLOCK, filters): the rectified responses in the blocks [first, last)."""
    data = lay.data[first * BLOCK * STRIDE : last * BLOCK * STRIDE + WIDTH]
    embedded = w["embed"][data]
    view = np.lib.stride_tricks.as_strided(embedded, ((last - first) * BLOCK, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
    out = view @ w["filters"]
    out += w["bias"]
    np.maximum(out, 0, out=out)
    lo, hi = np.searchsorted(lay.outside, (first * BLOCK, last * BLOCK))
    out[lay.outside[lo:hi] - first * BLOCK] = 0
    return out.reshape(-1, BLOCK, FILTERS)


def block_maxima(w: Weights, lay: Layout) -> np.ndarray:
    """(blocks, filters): the greatest response of each filter in each block."""
    out = np.empty((lay.n_blocks, FILTERS), dtype=np.float32)
    for at in range(0, lay.n_blocks, SLICE_BLOCKS):
        end = min(lay.n_blocks, at + SLICE_BLOCKS)
        responses(w, lay, at, end).max(axis=1, out=out[at:end])
    return out


def head(w: Weights, pooled: np.ndarray, lay: Layout):
    """pooled: (chunks, filters) -> features, hidden layer, probability of each text."""
    mean = np.add.reduceat(pooled, lay.chunk_first, axis=0) / lay.chunks[:, None].astype(np.float32)
    feats = np.concatenate((mean, np.maximum.reduceat(pooled, lay.chunk_first, axis=0), np.minimum.reduceat(pooled, lay.chunk_first, axis=0)), axis=1)
    hidden = np.maximum(feats @ w["w1"] + w["b1"], 0)
    z = (hidden @ w["w2"] + w["b2"]).astype(np.float64)
    return feats, hidden, 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def pooled_chunks(blocks: np.ndarray, lay: Layout) -> np.ndarray:
    """(chunks, filters): the greatest of each chunk's blocks."""
    out = blocks[lay.blocks[:, 0]]
    for k in range(1, CHUNK):
        np.maximum(out, blocks[lay.blocks[:, k]], out=out)
    return out


def score(w: Weights, texts: list[bytes]) -> np.ndarray:
    """The probability of each whole text to have label 1, rounded so that grouping of texts can't show."""
    out, at = [], 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= SLICE_BYTES):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        lay = Layout(part)
        blocks = block_maxima(w, lay)
        out.append(head(w, pooled_chunks(blocks, lay), lay)[2])
    return np.round(np.concatenate(out), 6) if out else np.empty(0)


def gradients(w: Weights, lay: Layout, y: np.ndarray, weight: np.ndarray) -> Weights:
    inside, blocks = np.empty((lay.n_blocks, FILTERS), dtype=np.int64), np.empty((lay.n_blocks, FILTERS), dtype=np.float32)
    for first in range(0, lay.n_blocks, SLICE_BLOCKS):
        last = min(lay.n_blocks, first + SLICE_BLOCKS)
        resp = responses(w, lay, first, last)
        inside[first:last] = resp.argmax(axis=1)
        blocks[first:last] = np.take_along_axis(resp, inside[first:last, None], axis=1)[:, 0]
    per_chunk = blocks[lay.blocks]
    pick = per_chunk.argmax(axis=1)
    pooled = np.take_along_axis(per_chunk, pick[:, None], axis=1)[:, 0]
    block = np.take_along_axis(lay.blocks, pick, axis=1)
    at = block * BLOCK + inside[block, np.arange(FILTERS)]  # (chunks, filters): position of the maximum
    feats, hidden, p = head(w, pooled, lay)
    dz = ((p - y) * weight / len(y)).astype(np.float32)
    dh = dz[:, None] * w["w2"] * (hidden > 0)
    df = dh @ w["w1"].T
    doc = np.repeat(np.arange(len(y)), lay.chunks)
    top, low = feats[:, FILTERS : 2 * FILTERS], feats[:, 2 * FILTERS :]
    d = (df[:, :FILTERS] / lay.chunks[:, None])[doc]
    for part, ends in ((df[:, FILTERS : 2 * FILTERS], top), (df[:, 2 * FILTERS :], low)):
        hit = pooled == ends[doc]
        d = d + part[doc] * hit / np.add.reduceat(hit, lay.chunk_first, axis=0, dtype=np.float32)[doc]
    d = (d * (pooled > 0)).astype(np.float32)
    seen = lay.window_bytes(at)  # (chunks, filters, WIDTH) bytes
    dx = d[:, :, None] * w["filters"].T[None]
    dembed = np.empty_like(w["embed"])
    flat, dx = seen.ravel(), dx.reshape(-1, EMBED)
    for k in range(EMBED):
        dembed[:, k] = np.bincount(flat, weights=dx[:, k], minlength=256)
    dfilters = np.einsum("cf,cfk->kf", d, w["embed"][seen].reshape(len(at), FILTERS, -1), optimize=True)
    return {"embed": dembed, "filters": dfilters, "bias": d.sum(axis=0), "w1": feats.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ dz, "b2": dz.sum(keepdims=True)}


def fit(texts: list[bytes], labels: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 7) -> Weights:
    """share: of label 1 among all labelled rows. Without rows of both labels the network tells all texts that share."""
    w = initial(seed)
    share = min(max(share, 1e-3), 1 - 1e-3)
    w["b2"][:] = np.log(share / (1 - share))
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        w["w2"][:] = 0
        return w
    weight = np.where(labels == 1, share * len(labels) / ones, (1 - share) * len(labels) / (len(labels) - ones))
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    batches = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))  # small samples are seen more often
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            g = gradients(w, Layout([texts[i] for i in part]), labels[part], weight[part])
            step += 1
            rate = 0.006 * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def in_training(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Weights:
    """Fits on at most fit_rows labelled training rows of each class, in hash order; the rest of the labels gives the classes' shares.
    A row whose text doesn't fit into what the rows before it leave of fit_bytes, which bounds the driver's memory, is passed over."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & in_training(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__y"))
    counts = dict(known.groupBy("__y").count().collect())
    own = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_col].alias("__doc"), own.alias("__text"), F.octet_length(own).alias("__size"), F.xxhash64(own).alias("__hash"))
    sample: list = []
    for y in (0, 1):
        # ids only, in hash order; some have no text
        ids = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(3 * fit_rows).select("__id")
        met = rows.join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
        chosen, left = [], fit_bytes // 2
        for r in met.select("__id", "__hash", "__size").orderBy(F.xxhash64("__id"), "__id", "__hash").limit(fit_rows).collect():
            if r["__size"] <= left:
                left -= r["__size"]
                chosen.append((r["__id"], r["__hash"]))
        if chosen:
            picked = docs.sparkSession.createDataFrame(chosen, met.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).schema).distinct()
            got = rows.join(F.broadcast(picked), (F.col("__doc") == F.col("__i")) & (F.col("__hash") == F.col("__h")))
            texts = got.groupBy("__i", "__h").agg(F.first("__text").alias("__text")).orderBy(F.xxhash64("__i"), "__i", "__h").select("__text").collect()
            sample += [(r[0].encode(), y) for r in texts]
    total = sum(counts.values())
    return fit([t for t, _ in sample], np.array([y for _, y in sample], dtype=np.int64), counts.get(1, 0) / total if total else 0.5)


def _scored(weights: Weights, at: int):
    """Arrow batches with the score of the text in column `at` behind their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps_nothing()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                p = score(weights, [(x or "").encode() for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "__score"])
        give_memory_back()

    return run


def add_scores(docs: DataFrame, weights: Weights, text: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs and the score of each whole text; a null text scores as an empty one, a very long one
    in slices, repeated rows alike. A column named like score_col is replaced; any other name will do. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != score_col.lower() or c == text]
    rows = numbered(docs, kept)
    scored = rows.mapInArrow(_scored(weights, kept.index(text)), T.StructType([*rows.schema.fields, T.StructField("__score", T.DoubleType())]))
    return renamed(scored, [*kept, score_col])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document. A null id is not held out. A null text scores as an empty
    one. Rows that repeat an id are scored each by their own text. With no labels every score is the share of label 1, or 0.5. Other columns
    are ignored. An empty table gives an empty result."""
    weights = train(docs, labels, text=text, id_col=id_col, **options)
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"))
    scored = rows.mapInArrow(_scored(weights, 1), T.StructType([*rows.schema.fields, T.StructField("__score", T.DoubleType())]))
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
