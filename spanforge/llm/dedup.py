"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

The texts are read once for their digests, which are written down; all that follows looks at those. Pass 1 takes two slots of
every digest and counts the rows of each slot; the slots that two or more rows share form a bitmap. A text can repeat only if both of its slots
are set. Pass 2 tests every row against the broadcast bitmap: rows that cannot repeat
pass straight through, and only the others shuffle, without their texts unless the
caller keeps them.

The bitmap has at most 2 * max_slots bits whatever the input's size, which bounds
the broadcast; its words travel a thousand to a row. Beyond about max_slots / 8 rows it fills up and more rows shuffle; the
result stays exact, because the filter only ever spares rows that are surely single.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialise

#: 64 MB for both functions' bits.
MAX_SLOTS = 1 << 28
#: Words of 64 bits in a row of the bitmap.
ROW_WORDS = 1024


def _slot(digest, slots: int, fn: int):
    return F.pmod(F.xxhash64(digest, F.lit(fn)), F.lit(slots)) + F.lit(fn * slots)


def repeat_bitmap(hashed: DataFrame, slots: int, digest: str = "__sha") -> DataFrame:
    """(at, words): the slots of each of the two hash functions that two or more rows share, as rows of ROW_WORDS words."""
    pairs = hashed.select(F.explode(F.array(*[_slot(F.col(digest), slots, fn) for fn in (0, 1)])).alias("slot"))
    shared = pairs.groupBy("slot").agg(F.count("*").alias("n")).where("n >= 2")
    words = shared.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    rows = words.groupBy(F.expr(f"word div {ROW_WORDS}").alias("at")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(word % {ROW_WORDS} as int)"), "bits"))).alias("m"))
    return rows.select("at", F.expr(f"transform(sequence(0, {ROW_WORDS - 1}), i -> coalesce(m[i], 0L))").alias("words"))


def _tested(rows: DataFrame, bitmap: DataFrame, slots: int) -> DataFrame:
    """rows (with __sha) and __maybe: whether both slots are set."""
    hits = []
    for fn in (0, 1):
        part = bitmap.select(F.col("at").alias(f"__at{fn}"), F.col("words").alias(f"__words{fn}"))
        # at most 2 * max_slots / 8 bytes
        rows = rows.withColumn(f"__slot{fn}", _slot(F.col("__sha"), slots, fn)).join(F.broadcast(part), F.expr(f"__slot{fn} div {64 * ROW_WORDS} = __at{fn}"), "left")
        hits.append(F.expr(f"coalesce(shiftright(__words{fn}[cast(__slot{fn} div 64 % {ROW_WORDS} as int)], cast(__slot{fn} % 64 as int)) & 1L, 0L) = 1L"))
    return rows.withColumn("__maybe", hits[0] & hits[1])


def _named(names, *columns) -> list:
    return [c.alias(n) for c, n in zip(columns, names, strict=True)]


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_slots: int = MAX_SLOTS, own_names: tuple[str, str, str, str] = ("keep_id", "group_size", "kept", "text_sha256"), keep_columns: bool = True) -> DataFrame:
    """All rows and columns of docs (the id alone without keep_columns) plus keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty, a very long one is read whole. Of
    a group the row with the largest id stays; a null id counts as smaller than any other, and a
    group with null ids only keeps them all. Rows that repeat text and id alike are one record and
    share its fate (each counts in group_size). Input columns named like a result column are
    replaced. An empty table gives an empty result.
    """
    sha = F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(docs[text], F.lit(""))), "UTF-8"), 256))
    hashed = materialise(docs.select(docs[id_col].alias("__id"), sha.alias("__sha")))
    rows = hashed.count()
    slots = 1 << 10
    while slots < min(8 * rows, max_slots):
        slots *= 2
    bitmap = materialise(repeat_bitmap(hashed, slots))
    possible = _tested(hashed, bitmap, slots).where("__maybe")
    groups = materialise(possible.groupBy("__sha").agg(F.max("__id").alias("__most"), F.count("*").alias("__n")).where("__n > 1"))
    if keep_columns:
        columns = [c for c in docs.columns if c.lower() not in own_names or c in (text, id_col)]
        tested = docs.select(*[docs[f"`{c}`"] for c in columns], sha.alias("__sha"))
    else:
        columns, tested = [id_col], hashed.select(F.col("__id").alias(id_col), "__sha")
    tested = _tested(tested, bitmap, slots)
    own, code = [F.col(f"`{c}`") for c in columns], F.lower(F.hex("__sha"))
    through = tested.where(~F.col("__maybe")).select(*own, *_named(own_names, F.col(id_col), F.lit(1).cast("long"), F.lit(True), code))
    maybe = tested.where(F.col("__maybe")).select(*own, "__sha")
    # groups over a thousandth of all rows, of which there are fewer than a thousand, come to their rows by broadcast;
    # in the join by digest such rows get keys that match nothing and spread them out
    large = F.broadcast(groups.where(F.col("__n") > max(1000, rows // 1000)).toDF("__large", "__large_most", "__large_n"))
    marked = maybe.join(large, F.col("__sha") == F.col("__large"), "left")
    apart = F.unhex(F.md5(F.concat_ws(",", F.col(id_col).cast("string"), F.spark_partition_id()).cast("binary")))
    marked = marked.withColumn("__key", F.when(F.col("__large").isNull(), F.col("__sha")).otherwise(apart))
    joined = marked.join(groups.withColumnRenamed("__sha", "__group"), F.col("__key") == F.col("__group"), "left")
    n = F.coalesce("__large_n", "__n", F.lit(1).cast("long"))
    most = F.when(F.col("__large").isNotNull(), F.col("__large_most")).when(F.col("__n").isNotNull(), F.col("__most")).otherwise(F.col(id_col))
    repeated = joined.select(*own, *_named(own_names, most, n, F.col(id_col).eqNullSafe(most), code))
    return through.unionByName(repeated)


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
