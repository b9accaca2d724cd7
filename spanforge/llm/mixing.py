"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents, shuffled by a hash, laid end to end and cut into
equal blocks. Slot t of the mix takes the golden-ratio point frac((t + 1) * phi), which falls
into one source's interval of the cumulative weights, so after any number of slots each source
has had its share to within a few blocks. The r-th slot of a source reads block r mod n of epoch
r div n; a source stops when its target is met, its last slot taking only the words still missing.

Only one row per source reaches the driver. Ranks and offsets are prefix sums in two levels
(per hash bucket or run of slots, then over the buckets), so no task holds a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, materialise

PHI = (math.sqrt(5) - 1) / 2
RUN = 1 << 16
DOCS_PER_BUCKET = 2000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    docs: int
    weight: float
    target: float
    #: words to take, words in a block, slots needed
    take: int
    block: int
    slots: int


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], budget: float, cap: float) -> list[float]:
    """Share budget * all sizes by weight; what exceeds cap * size is shared anew by weight among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = budget * sum(n for _, n in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(w[i] for i in sorted(open_))
        share = {i: left * w[i] / total for i in sorted(open_)}
        full = [i for i, x in share.items() if x > cap * sizes[i][1]]
        if not full:
            for i, x in share.items():
                out[i] = x
            break
        for i in full:
            out[i] = float(cap * sizes[i][1])
            left -= out[i]
            open_.discard(i)
    return out


def plan_sources(rows: list[tuple[str | None, int, int]], weights=(3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_words: int = 4096) -> list[Source]:
    """rows: (source, words, documents). Sources in code point order, null last; small sources get smaller blocks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    want = targets([(r[0], r[1]) for r in rows], weights, budget, cap)
    out = []
    for i, ((name, size, docs), target) in enumerate(zip(rows, want, strict=True)):
        take = min(math.floor(target + 0.5), math.floor(cap * size))
        block = max(1, min(block_words, size // 256))
        per, full, rest = -(-size // block), take // max(size, 1), take % max(size, 1)
        out.append(Source(name, size, docs, weights[i % len(weights)], target, take, block, full * per + -(-rest // block)))
    return out


def _pick(index: Column, values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index + 1)


def schedule(spark, sources: list[Source]) -> DataFrame:
    """(t, src, rank, epoch, block, words): the slots of the mix in order t. words: how many of the block's first are taken."""
    total = sum(s.slots for s in sources)
    if not total:
        return spark.createDataFrame([], "t long, src int, rank long, epoch long, block long, words long")
    edges, at = [], 0
    for s in sources[:-1]:
        at += s.slots
        edges.append(at / total)
    # three-distance theorem: any phi^-2 / p consecutive points hit an interval of length p
    slots = math.ceil((1 / PHI) ** 2 * total) + 8
    frac = lambda c: c - F.floor(c)
    high, low = F.expr("(id + 1) div 1048576"), F.expr("(id + 1) % 1048576")
    # in two parts, or the product would lose its last digits for large t
    point = frac(frac(high * F.lit(math.fmod(PHI * 1048576, 1))) + frac(low * F.lit(PHI)))
    src = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("x"))) if edges else F.lit(0)
    t = spark.range(slots).select(F.col("id").alias("t"), point.alias("x")).select("t", src.cast("int").alias("src"), F.expr(f"t div {RUN}").alias("run"))
    counts = t.groupBy("src", "run").agg(F.count("*").alias("n"))
    before = counts.select("src", "run", (F.sum("n").over(Window.partitionBy("src").orderBy("run")) - F.col("n")).alias("before"))
    inside = t.withColumn("r", F.row_number().over(Window.partitionBy("src", "run").orderBy("t")))
    ranked = inside.join(before, ["src", "run"]).select("t", "src", (F.col("before") + F.col("r") - 1).alias("rank"))
    i = F.col("src")
    per = _pick(i, [max(1, -(-s.size // s.block)) for s in sources], "long")
    size, block, take = (_pick(i, [getattr(s, n) for s in sources], "long") for n in ("size", "block", "take"))
    out = ranked.where(F.col("rank") < _pick(i, [s.slots for s in sources], "long")).select("t", "src", "rank", per.alias("per"), size.alias("size"), block.alias("b"), take.alias("take"))
    out = out.selectExpr("t", "src", "rank", "rank div per as epoch", "rank % per as block", "size", "b", "take")
    return out.selectExpr("t", "src", "rank", "epoch", "block", "least(b, size - block * b, take - epoch * size - block * b) as words")


def _shuffle_key(docs: DataFrame, id_col: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[text], F.lit(""))))


def mix(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_words: int = 4096, text: str = "text", source: str = "source", id_col: str = "doc_id", keep_columns: bool = True, own_names: tuple[str, str, str, str] = ("size", "source_size", "target", "taken"), key_name: str | None = None) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(documents, slots, sources). The documents keep all rows and columns and gain size,
    source_size, target and taken: how many of the document's words the mix reads, repeats counted.

    Documents are shuffled by the MD5 of id and text. A null text has no words, a null source is a source of its own, the last. Documents without
    words are taken 0 times. Rows with the same id, text and source may stand in for one another.
    Input columns named like a result column are replaced. Empty tables give empty results. Without keep_columns the documents have id and source
    only; key_name: a column with the MD5 in whose order a source's documents lie.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    key = _shuffle_key(docs, id_col, text)
    if keep_columns:
        cols = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in own_names or c in (text, source, id_col)]
    else:
        cols = [docs[id_col], docs[source]]
    rows = docs.select(*cols, size.alias("__size"), key.alias("__key"))
    own = [c for c in rows.columns if c not in ("__size", "__key")]
    if not keep_columns:
        rows = materialise(rows)  # two numbers a document: the texts are read once
    totals = rows.groupBy(source).agg(F.sum("__size"), F.count("*")).collect()  # one row a source
    sources = plan_sources([(r[0], r[1], r[2]) for r in totals], weights, budget, cap, block_words)
    slots = schedule(spark, sources)
    buckets = [bucket_count(s.docs, DOCS_PER_BUCKET, 1 << 16) for s in sources]
    params = spark.createDataFrame(
        [(s.name, i, s.size, s.target, s.block, n) for i, (s, n) in enumerate(zip(sources, buckets, strict=True))],
        "__name string, __src int, __source_size long, __target double, __block long, __n long",
    )
    # one row a source, as many as the driver has seen
    rows = rows.join(F.broadcast(params), F.col(source).cast("string").eqNullSafe(F.col("__name")), "left").withColumn("__b", F.expr("(cast(conv(substring(__key, 1, 8), 16, 10) as bigint) * __n) div 4294967296"))
    sums = rows.groupBy("__src", "__b").agg(F.sum("__size").alias("__in"))
    base = sums.select("__src", "__b", (F.sum("__in").over(Window.partitionBy("__src").orderBy("__b")) - F.col("__in")).alias("__base"))
    order = Window.partitionBy("__src", "__b").orderBy("__key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(base, ["__src", "__b"]).withColumn("__start", F.col("__base") + F.sum("__size").over(order) - F.col("__size"))
    if not keep_columns:
        placed = materialise(placed)
    spans = placed.where("__size > 0").select("__src", "__start", "__block", "__size", F.explode(F.expr("sequence(__start div __block, (__start + __size - 1) div __block)")).alias("block"))
    spans = spans.select(F.col("__src").alias("src"), "__start", "block", F.expr("greatest(__start - block * __block, 0L)").alias("a"), F.expr("least(__start + __size - block * __block, __block)").alias("b"))
    taken = spans.join(slots.select("src", "block", "words"), ["src", "block"]).groupBy("src", "__start").agg(F.sum(F.expr("greatest(least(b, words) - a, 0L)")).alias("__sum"))
    placed = placed.join(taken.select(F.col("src").alias("__s"), F.col("__start").alias("__at"), "__sum"), F.expr("__src = __s and __size > 0 and __start = __at"), "left")
    values = (F.col("__size"), F.col("__source_size"), F.col("__target"), F.coalesce("__sum", F.lit(0)).cast("long"))
    key_col = [F.col("__key").alias(key_name)] if key_name else []
    return placed.select(*[F.col(f"`{c}`") for c in own], *[v.alias(n) for v, n in zip(values, own_names, strict=True)], *key_col), slots, sources


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents as the mix reads them, with the columns of docs: each as many times as its taken words fill it, to
    the nearest whole number, so that one at the edge of what its source gives is in or out. Documents without words are out."""
    names = {"text": text, "source": source, "id_col": id_col, "own_names": ("__size", "__source_size", "__target", "__taken")}
    times = F.expr("cast(floor(__taken / __size + 0.5) as int)")
    copies = F.explode(F.expr("sequence(1, __times)")).alias("__copy")
    # Only ids, sizes and keys are shuffled: a pass takes a source's documents in order of their keys, so each number of times has a range of
    # keys, and a document finds its own by its key. One row for each source and number of times.
    out, _, _ = mix(docs, keep_columns=False, key_name="__key", **names, **options)
    ranges = out.where("__size > 0").withColumn("__times", times).groupBy(F.col(source).cast("string").alias("__name"), "__times")
    ranges = ranges.agg(F.min("__key").alias("__lo"), F.max("__key").alias("__hi")).collect()
    ranges.sort(key=lambda r: (r["__name"] is not None, r["__name"] or "", r["__lo"], r["__hi"]))
    if any(a["__name"] == b["__name"] and b["__lo"] <= a["__hi"] for a, b in zip(ranges[:-1], ranges[1:], strict=True)):
        # rows that repeat id and text, and the mix takes some of them more often than others: each row keeps its own number
        out, _, _ = mix(docs, **names, **options)
        out = out.where("__size > 0").withColumn("__times", times).where("__times > 0")
    else:
        ranges = docs.sparkSession.createDataFrame([tuple(r) for r in ranges if r["__times"]], "__name string, __times int, __lo string, __hi string")
        keyed = docs.where(docs[text].rlike(WORD)).withColumn("__key", _shuffle_key(docs, id_col, text))
        out = keyed.join(F.broadcast(ranges), docs[source].cast("string").eqNullSafe(F.col("__name")) & F.col("__key").between(F.col("__lo"), F.col("__hi")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop("__copy")


# Whole passes of a source take each of its documents as often; the last pass takes them in shuffled order, up to what is still missing.
ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
src AS (SELECT source, n, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS budget
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s GROUP BY source)),
placed AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
           sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM src),
free AS (SELECT min_by((budget - full_before, open_weight, cap / w), cap / w) AS x FROM placed WHERE (budget - full_before) * w / open_weight <= cap),
aims AS (SELECT source, n, CASE WHEN x IS NULL OR cap / w < x[3] THEN cap ELSE x[1] * w / x[2] END AS target, cap FROM placed, free),
takes AS (SELECT source, n, target, CAST(least(floor(target + 0.5), floor(cap)) AS BIGINT) AS take FROM aims),
starts AS (SELECT doc_id, size, source, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start FROM s)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE take // n * size + greatest(0, least(size, take % n - start)) END AS taken
FROM starts JOIN takes ON takes.source IS NOT DISTINCT FROM starts.source
"""
