"""Exact top-k inner products by no-random-access aggregation over per-dimension sorted lists.

Queries and candidates are dealt into blocks. In a block every dimension is a list of the
candidates sorted by that component, read from the top for positive query components and from the
bottom for negative ones. The lists are read in rounds, all to the same depth. What a candidate has shown counts; in
each dimension not yet shown it has at most the value at the list's frontier and at least the list's last value. That gives
lower and upper bounds of its score; one that no list has shown yet has the frontier everywhere, which is the bound of all outsiders. A
pair of query and candidate closes when its upper bound falls below the k-th best lower bound (or the k-th score
that earlier blocks settled). When few pairs are open, outsiders can't qualify any more, and reading goes on for the open
ones alone: their scores grow by what the next stretch of each list shows, pairs close on the way, and those left at the lists' ends have their
final scores. No candidate is looked up out of turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, materialise

QUERY_BLOCK = 4096
QUERIES_AT_ONCE = 1024
CANDIDATE_BLOCK = 2048
GROUP_ROWS = 16384
#: Eighths of the lists that have been read when bounds are looked at; more dimensions need more depth before anything closes.
ROUNDS = (2, 4, 5, 6, 7)
PAIRS = 20_000


def _kind(q: np.ndarray, x: np.ndarray):
    """The float or integer type in which all sums below are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if top < 2**23 else np.float64 if top < 2**52 else np.int64


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in range(n)]
        self.bar = np.full(n, -np.inf)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.rows[q][0], ids)), np.concatenate((self.rows[q][1], scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.rows[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.bar[q] = scores[order[-1]]


def nra_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, best: Best) -> int:
    """Adds the candidates x (rows of integers) to the best of the queries q; returns how many pairs were read to the end."""
    n = len(x)
    if not n:
        return 0
    kind = _kind(q, x)
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    both = np.concatenate((up, down), axis=1)
    lists = np.sort(x, axis=0)  # each dimension's list
    low, high = lists[0], lists[-1]
    own = q_ids[:, None] == x_ids  # pairs of a row with its own id are no candidates and must not raise the bar
    open_ = ~own
    depths = [min(n - 1, n * e // 8) for e in ROUNDS]
    for at in depths:
        top, bottom = lists[n - 1 - at], lists[at]  # the frontiers
        # the greater of value and frontier: what is behind the frontier isn't shown yet
        upper = both @ np.concatenate((np.maximum(x, top), np.minimum(x, bottom)), axis=1).astype(kind).T
        bar = best.bar.copy()
        if not np.isfinite(bar).all() and n >= best.k:
            lower = both @ np.concatenate((np.where(x >= top, x, low), np.where(x <= bottom, x, high)), axis=1).astype(kind).T
            lower[own] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            bar = np.maximum(bar, np.partition(lower, n - best.k, axis=1)[:, n - best.k])
        open_ &= upper >= bar[:, None]
        if open_.sum() <= 4 * best.k * len(q):
            break
    full = 0
    qi, xi = np.nonzero(open_)
    for start in range(0, len(qi), PAIRS):
        pairs, scores = _read_on(q, x, qi[start : start + PAIRS], xi[start : start + PAIRS], lists, [d for d in (*depths, n - 1) if d > at], (top, bottom), bar)
        full += len(scores)
        cut = np.flatnonzero(np.diff(pairs[0])) + 1
        for of, ids, got in zip(np.split(pairs[0], cut), np.split(x_ids[pairs[1]], cut), np.split(scores, cut), strict=True):
            if len(of):
                best.add(int(of[0]), ids, got)
    return full


def _read_on(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, lists: np.ndarray, depths: list[int], frontier: tuple, bar: np.ndarray):
    """((query rows, candidate rows), scores) of the pairs that stay open while the lists are read on to their ends."""
    n = len(lists)
    qs, xs = q[qi].astype(np.int64), x[xi].astype(np.int64)
    shown = np.where(qs > 0, xs >= frontier[0], xs <= frontier[1])
    scores = (qs * xs * shown).sum(axis=1)
    for at in depths:
        top, bottom = lists[n - 1 - at], lists[at]
        more = np.where(qs > 0, xs >= top, xs <= bottom) & ~shown
        scores += (qs * xs * more).sum(axis=1)
        shown |= more
        if at < n - 1:
            upper = scores + (qs * np.where(qs > 0, top, bottom) * ~shown).sum(axis=1)
            keep = upper >= bar[qi]
            qi, xi, qs, xs, shown, scores = (v[keep] for v in (qi, xi, qs, xs, shown, scores))
    return (qi, xi), scores


def _matrix(vectors, dims: int) -> np.ndarray:
    """Rows of floor values, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds the k other rows of greatest score,
    the inner product of floor(scale * component). Ties go to the smaller id. Queries and candidates
    with a null id take no part, nor do vectors that are null or hold a null or non-finite component; shorter vectors count as filled up
    with zeros. Rows that repeat an id are candidates of their own, but not of their own id. Empty tables give empty results. Scores beyond 63 bits are not supported.
    """
    each = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long"))
    fine = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = materialise(vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), each.alias("v"), is_query.alias("is_query")).withColumn("h", F.xxhash64("v")))
    n, n_q, dims = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("v"))).first()
    groups, blocks = bucket_count(n, GROUP_ROWS), bucket_count(n_q, QUERY_BLOCK)
    dims = dims or 0
    spread = F.xxhash64("vec_id")
    number = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    # every block of queries meets every group of candidates once, by key
    left = rows.where("is_query").select("vec_id", "v", "h", F.pmod(spread, F.lit(blocks)).cast("int").alias("qb"), F.explode(number(groups)).alias("g"))
    right = rows.select("vec_id", "v", "h", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("g"), F.explode(number(blocks)).alias("qb"))

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        queries, candidates = queries.sort_values(["vec_id", "h"]), candidates.sort_values(["vec_id", "h"])
        q, x = _matrix(queries["v"].tolist(), dims), _matrix(candidates["v"].tolist(), dims)
        q_ids, x_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        rows: list = []
        for first in range(0, len(q), QUERIES_AT_ONCE):
            some = slice(first, first + QUERIES_AT_ONCE)
            best = Best(len(q[some]), k)
            for at in range(0, len(x), CANDIDATE_BLOCK):
                nra_block(q[some], q_ids[some], x[at : at + CANDIDATE_BLOCK], x_ids[at : at + CANDIDATE_BLOCK], best)
            rows += best.rows
        lens = [len(r[0]) for r in rows]
        cat = lambda i: np.concatenate([r[i] for r in rows]) if rows else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"query_id": np.repeat(q_ids, lens), "qrow": np.repeat(np.arange(len(q)), lens), "vec_id": cat(0), "score": cat(1)})

    part = left.groupBy("qb", "g").cogroup(right.groupBy("qb", "g")).applyInPandas(run, "query_id long, qrow long, vec_id long, score long")
    # groups * k rows a query
    order = Window.partitionBy("query_id", "qrow").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
