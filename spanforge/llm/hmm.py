"""Hidden Markov language model over words, trained by Baum-Welch on the whole training corpus.

A text is a sequence of words and an end token. The model emits classes from its latent states and
words from their classes: P(text) = P(class sequence; HMM) * product of P(word | class). The SINGLES most
frequent tokens are classes of their own; the rest fall into TAILS classes by their last bytes, where a word's
probability is (c + 1) / (N_class + V_class + 1) with its count c in the training texts, an unseen word counting 0.

Word counts are made per bucket of documents, summed by word over all buckets, and sent back to the buckets
that use them, so nothing that grows with the vocabulary is broadcast or collected. Expected transition and
emission counts of each Baum-Welch round are accumulated over the rows of a task and summed across
tasks; the driver holds only the model: STATES * (STATES + SINGLES + TAILS) numbers. From a random start the first rounds read
a share of the training rows each, by hash, which doubles every other round (SHARES); the last ones read all. Every round's rows are
read on the cluster, and grow with the input.

The scaled forward recursion gives the exact likelihood of the class sequence; texts of a batch advance together, and
only the current step of the forward values is held. Training goes back over blocks of steps, whose forward values are made again from the
block's first, so that a text of any length takes bounded memory.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_memory_back, materialise, small_batches

STATES, SINGLES, TAILS = 8, 1024, 96
END = b"\n"  # no word holds white space
#: 1 / share of the training rows that each round before the full ones reads.
SHARES, ROUNDS = (32, 32, 16, 16, 8, 8, 4, 4, 2), 2
BUCKET_BYTES, LEAST_BUCKETS, RUN_BUCKETS = 12 << 20, 24, 1000
BATCH_CELLS, SLICE_ROWS, SCALE_STEPS = 180_000, 3000, 16
CACHE_TAILS = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end token."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def tail_class(word: bytes) -> int:
    return SINGLES + zlib.crc32(word[-3:]) % TAILS


class Classes(dict):
    """last bytes -> class, for those that a task has met; singles go first. Far fewer than the words, they stay in the processor's cache."""

    def __init__(self, singles: dict[bytes, int]):
        super().__init__()
        self.singles = singles

    def __missing__(self, last: bytes) -> int:
        got = self[last] = tail_class(last)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_TAILS:
            self.clear()
        single = self.singles.get
        return np.array([self[w[-3:]] if (c := single(w)) is None else c for w in words], dtype=np.int64)


@dataclass
class Model:
    start: np.ndarray  # (S)
    move: np.ndarray  # (S, S)
    emit: np.ndarray  # (C, S): of class c from state s
    singles: dict[bytes, int]


def _batches(sequences: list[np.ndarray], cells: int = BATCH_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, lengths, classes (time, sequence)), longest first, of at most so many cells or one sequence."""
    size = np.array([len(x) for x in sequences])
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, cells // int(size[order[at]]))
        part = order[at : at + n]
        at += n
        length = size[part]
        grid = np.zeros((int(length[0]), len(part)), dtype=np.int64)
        for k, i in enumerate(part):
            grid[: length[k], k] = sequences[i]
        yield part, length, grid


def _active(length: np.ndarray, steps: int) -> list[int]:
    """How many of the sequences, longest first, are longer than t, for each t."""
    return np.searchsorted(-length, -np.arange(steps), side="left").tolist()


def _advance(model: Model, before: np.ndarray, emitted: np.ndarray, t: int, out: np.ndarray) -> np.ndarray | None:
    """Puts the forward values of step t into out; returns what those of step t - 1 were divided by first, if so."""
    total = None
    if t % SCALE_STEPS == 0:
        total = before.sum(axis=1)
        before /= total[:, None]
    np.matmul(before, model.move, out=out)
    out *= emitted
    return total


def log_likelihood(model: Model, length: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """log10 of each sequence's probability.

    The forward values are scaled to a sum of 1 every SCALE_STEPS steps; the logarithms of the scales and of the last sum add up to the result.
    """
    steps, n = grid.shape
    active, block = [*_active(length, steps), 0], max(1, BATCH_CELLS // n)
    log, alpha, other = np.zeros(n), np.empty((n, len(model.start))), np.empty((n, len(model.start)))
    k = n
    for first in range(0, steps, block):
        emitted = model.emit[grid[first : first + block, : active[first]]]
        for i in range(len(emitted)):
            t, m = first + i, active[first + i]
            if not t:
                np.multiply(model.start, emitted[0], out=alpha)
                continue
            if m < k:  # these have ended
                log[m:k] += np.log10(alpha[m:k].sum(axis=1))
                k = m
            total = _advance(model, alpha[:m], emitted[i, :m], t, other[:m])
            if total is not None:
                log[:m] += np.log10(total)
            alpha, other = other, alpha
    log[:k] += np.log10(alpha[:k].sum(axis=1))
    return log


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over the sequences."""
    s = len(model.start)
    counts = np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit)
    for _, length, grid in _batches(sequences):
        _add_counts(model, length, grid, *counts)
    return counts


def _add_counts(model: Model, length: np.ndarray, grid: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    """Adds one batch's expected counts, block of steps by block, last first."""
    steps, n = grid.shape
    s, block = len(model.start), max(1, BATCH_CELLS // n)
    active = [*_active(length, steps), 0]
    back = np.ascontiguousarray(model.move.T)
    firsts = [model.start * model.emit[grid[0]]]  # forward values of each block's first step
    for first in range(0, steps - block, block):
        alpha, other = firsts[-1].copy(), np.empty_like(firsts[-1])
        for t in range(first + 1, first + block + 1):
            m = active[t]
            _advance(model, alpha[:m], model.emit[grid[t, :m]], t, other[:m])
            alpha, other = other, alpha
        firsts.append(alpha[: active[first + block]].copy())
    later = None  # beta of the step behind the block
    for first in range((len(firsts) - 1) * block, -1, -block):
        size, k = min(block, steps - first), active[first]
        part, live = grid[first : first + size, :k], np.arange(first, first + size)[:, None] < length[None, :k]
        emitted = model.emit[part]
        alpha = np.zeros((size, k, s))
        alpha[0] = firsts[first // block]
        for i in range(1, size):
            m = active[first + i]
            _advance(model, alpha[i - 1, :m], emitted[i, :m], first + i, alpha[i, :m])
        beta = np.ones_like(alpha)
        onward = np.zeros_like(alpha)  # emission * beta of step t + 1, for the moves out of step t; scaled like beta of step t
        for i in range(size - 1, -1, -1):
            t = first + i
            m = active[t + 1]
            if not m:
                continue
            nxt, now = onward[i, :m], beta[i, :m]
            if i + 1 < size:
                np.multiply(emitted[i + 1, :m], beta[i + 1, :m], out=nxt)
            else:
                np.multiply(model.emit[grid[t + 1, :m]], later[:m], out=nxt)
            np.matmul(nxt, back, out=now)
            if t % SCALE_STEPS == 0:
                factor = 1 / now.sum(axis=1)[:, None]
                nxt *= factor
                now *= factor
        later = beta[0].copy()
        beta *= alpha
        weight = beta.sum(axis=2)
        weight[~live] = 1
        beta /= weight[:, :, None]  # now the probability of each state at each step
        alpha /= weight[:, :, None]
        if not first:
            start += beta[0].sum(axis=0)
        move += model.move * (alpha.reshape(-1, s).T @ onward.reshape(-1, s))
        where, states = part[live], beta[live]
        for j in range(s):
            emit[:, j] += np.bincount(where, weights=states[:, j], minlength=len(emit))


def reestimate(model: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Maximum of the expected counts, each class smoothed by a little of its share in all states."""
    share = (emit.sum(axis=1) + 0.5) / (emit.sum() + 0.5 * len(emit))
    start, move, emit = start + 0.1, move + 0.1, emit + share[:, None] * 2
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), model.singles)


def initial(singles: dict[bytes, int], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    move = rng.uniform(0.5, 1.5, (STATES, STATES)) + 4 * np.eye(STATES)
    emit = rng.uniform(0.5, 1.5, (SINGLES + TAILS, STATES))
    return Model(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), singles)


def class_sequences(train: DataFrame, singles: dict[bytes, int]) -> DataFrame:
    """(share, classes) of each training text: a number below the first of SHARES, by hash, and two bytes a token. Every round reads them,
    and the texts are cut into words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(singles)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [classes.of(tokens(x)).astype(np.uint16).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["share", "classes"])
        give_memory_back()

    share = F.pmod(F.xxhash64("text", "doc_id"), F.lit(max(SHARES))).cast("int")
    return materialise(train.select(share.alias("share"), "text").mapInArrow(run, "share int, classes binary"))


def baum_welch_round(coded: DataFrame, model: Model) -> Model:
    """One round over the rows of coded: each task adds up its rows, the sums meet by number of the entry. Without rows the model stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(0).slice(at, SLICE_ROWS).to_pylist()]
                new = expected_counts(model, rows)
                total = new if total is None else tuple(a + b for a, b in zip(total, new, strict=True))
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "v"])

    got = coded.select("classes").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    if not got:
        return model
    flat = np.zeros(STATES + STATES * STATES + (SINGLES + TAILS) * STATES)
    for k, v in got:  # as many entries as the model has
        flat[k] = v
    a, b = STATES, STATES + STATES * STATES
    return reestimate(model, flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(-1, STATES))


def train_model(coded: DataFrame, model: Model, shares=SHARES, rounds: int = ROUNDS) -> Model:
    """Rounds over growing shares of the rows, then over all of them."""
    at = 0
    for one_in in shares:
        n = max(shares) // one_in
        at = at if at + n <= max(shares) else 0  # the next rows in turn
        model = baum_welch_round(coded.where(f"share >= {at} AND share < {at + n}"), model)
        at += n
    for _ in range(rounds):
        model = baum_welch_round(coded, model)
    return model


@dataclass
class Fitted:
    model: Model
    n_tokens: int
    n_distinct: int
    #: of each tail class: log10 of the denominator of P(word | class)
    tail_log: np.ndarray


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, bucket, c): the words of each bucket with their counts in its training rows. Rows come sorted by bucket."""

    def rows(bucket: int, known: Counter, other: Counter) -> Iterator[pd.DataFrame]:
        words = [*known, *(w for w in other if w not in known)]
        count = np.zeros(len(words), dtype=np.int64)
        count[: len(known)] = list(known.values())
        for at in range(0, len(words), 200_000):
            part = words[at : at + 200_000]
            yield pd.DataFrame({"word": part, "bucket": np.full(len(part), bucket, dtype=np.int32), "c": count[at : at + 200_000]})

    now, known, other = None, Counter(), Counter()
    for frame in batches:
        for bucket, held_out, text in zip(frame["bucket"], frame["held_out"], frame["text"], strict=True):
            if bucket != now:
                if now is not None:
                    yield from rows(now, known, other)
                now, known, other = bucket, Counter(), Counter()
            (other if held_out else known).update(tokens(text))
    if now is not None:
        yield from rows(now, known, other)


def score_texts(docs: DataFrame, held_out, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    held_out: a boolean column; such rows are scored, not learned from. base_score is the add-one unigram
    model, score the HMM's log10 probability. A null text is empty: its one token is the end. Rows that
    repeat an id are scored each by itself; a null id or a null held_out counts as not held out. With no training rows every token is unseen.
    Extra columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small_batches(docs.sparkSession)
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    # rows that repeat id and text are dealt by the part of the input they are read in as well
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int"))
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    each = dealt.mapInPandas(_count_words, "word binary, bucket int, c long")
    # one row for each bucket that has the word
    words = materialise(with_totals(each, buckets))
    fitted = fit(rows, words, rounds)
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInPandas(_scorer(fitted), schema)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))  # ids are text on the way: pandas has no null integers


def with_totals(each: DataFrame, buckets: int, run_buckets: int = RUN_BUCKETS) -> DataFrame:
    """each (word, bucket, c) with c summed over all buckets of the word. No task holds more than run_buckets rows of a word, or one row
    for each run of so many buckets."""
    if buckets <= run_buckets:
        return each.withColumn("c", F.sum("c").over(Window.partitionBy("word")))
    each = materialise(each.withColumn("run", F.expr(f"bucket div {run_buckets}")))
    runs = each.groupBy("word", "run").agg(F.sum("c").alias("c"))
    totals = runs.select(F.col("word").alias("w"), F.col("run").alias("r"), F.sum("c").over(Window.partitionBy("word")).alias("total"))
    return each.join(totals, F.expr("word = w AND run = r")).select("word", "bucket", F.col("total").alias("c"))


def fit(rows: DataFrame, words: DataFrame, rounds: int) -> Fitted:
    """words: (word, bucket, c). Each word once: in its least bucket."""
    once = words.groupBy("word").agg(F.max("c").alias("c")).where("c > 0")
    once = materialise(once)
    n, v = once.agg(F.sum("c"), F.count("*")).first()
    top = once.orderBy(F.desc("c"), "word").limit(SINGLES).collect()  # a bounded table: the model's own classes
    singles = {bytes(r[0]): i for i, r in enumerate(top)}
    used = [F.lit(bytearray(w)) for w in singles]
    tail = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(TAILS)).cast("int")
    sums = once.where(~F.col("word").isin(*used) if used else F.lit(True)).groupBy(tail.alias("k")).agg(F.sum("c"), F.count("*")).collect()
    total = np.ones(TAILS)
    for k, c, d in sums:
        total[k] += c + d
    model = initial(singles)
    train = rows.where(~F.col("held_out"))
    if n:
        model = train_model(class_sequences(train, singles), model, rounds=rounds)
    return Fitted(model, int(n or 0), int(v or 0), np.log10(total))


def _scorer(fitted: Fitted):
    base = float(np.log10(fitted.n_tokens + fitted.n_distinct + 1))

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        number = {w: i for i, w in enumerate(words["word"])}
        count = words["c"].to_numpy(dtype=np.int64)
        model = fitted.model
        kind = Classes(model.singles).of(list(number))
        log_c = np.log10(count + 1.0)
        inside = np.where(kind >= SINGLES, log_c - fitted.tail_log[np.maximum(kind - SINGLES, 0)], 0.0)
        out = {k: np.zeros(len(docs)) for k in ("base_score", "score")}
        n, known = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        texts = docs["text"].tolist()
        for at in range(0, len(texts), SLICE_ROWS):
            rows = [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(tokens, texts[at : at + SLICE_ROWS])]
            for i, r in enumerate(rows, at):
                n[i], known[i] = len(r), int((count[r] > 0).sum())
                out["base_score"][i] = log_c[r].sum() - len(r) * base
                out["score"][i] = inside[r].sum()
            for which, length, grid in _batches([kind[r] for r in rows]):
                out["score"][at + which] += log_likelihood(model, length, grid)
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n, "n_known": known, "train_tokens": fitted.n_tokens, **out})

    return run
