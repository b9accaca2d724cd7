"""JSON-lines records to documents, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytescan import count_of


def global_lines(records: DataFrame) -> DataFrame:
    """records with line_index: the number of each record in its source, by counting the ranges' records once."""
    counts = records.groupBy("source_index", "range_index").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source_index").orderBy("range_index").rowsBetween(Window.unboundedPreceding, 0)
    base = counts.select("source_index", "range_index", (F.sum("n").over(order) - F.col("n")).alias("base"))  # a row a range
    return records.join(base, ["source_index", "range_index"]).withColumn("line_index", F.col("base") + F.col("local_line")).drop("base")


def _over(top: Column, lower: Column) -> Column:
    """Both maps; where they share a key, top's value."""
    return F.map_concat(F.map_filter(lower, lambda k, v: ~F.array_contains(F.map_keys(top), k)), top)


def json_documents(
    records: DataFrame, source_name: str | None = None, text_key: str = "text", id_key: str = "id", default_metadata: dict[str, str] | None = None,
    file_path: str | None = None, skip: int = 0, limit: int = -1, keep_empty: bool = False, name_col: str | None = None,
) -> DataFrame:
    """(source_index, range_index, line_index, id, text, media, metadata) of the records (with line_index) that are JSON objects.

    Records that are not UTF-8 or not JSON are left out, but keep their line number. A missing id is name/line_index. Other
    fields go to metadata, over those of a metadata object, over default_metadata. media is an array of the decoded media_bytes. A document
    with neither text nor media is left out unless keep_empty. skip and limit count per range, as each range has one owner.
    """
    text = F.col("record").cast("string")
    rows = records.where(F.is_valid_utf8(F.col("record").cast("string"))).withColumn("v", F.try_parse_json(text)).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.withColumn("m", F.from_json(text, "map<string,string>"))
    name = F.col(name_col) if name_col else F.lit(source_name)
    reserved = [text_key, id_key, "media", "metadata"]
    rest = F.map_filter("m", lambda k, v: ~k.isin(*reserved))
    inner = F.coalesce(F.from_json(F.element_at("m", "metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    layers = [rest, inner]
    if default_metadata:
        layers.append(F.create_map(*[F.lit(x) for kv in default_metadata.items() for x in kv]).cast("map<string,string>"))
    metadata = layers[0]
    for lower in layers[1:]:  # what is above wins
        metadata = _over(metadata, lower)
    if file_path is not None:
        path = F.create_map(F.lit("file_path"), F.lit(file_path))
        metadata = F.map_concat(F.map_filter(metadata, lambda k, v: k != "file_path"), path)
    media = F.transform(F.from_json(F.element_at("m", "media"), "array<struct<media_bytes:string>>"), lambda x: F.unbase64(x["media_bytes"]))
    docs = rows.select(
        "source_index", "range_index", "line_index",
        F.coalesce(F.element_at("m", id_key), F.concat_ws("/", name, F.col("line_index"))).alias("id"),
        F.coalesce(F.element_at("m", text_key), F.lit("")).alias("text"),
        F.coalesce(media, F.array().cast("array<binary>")).alias("media"), metadata.alias("metadata"),
    )
    if not keep_empty:
        docs = docs.where((F.col("text") != "") | (F.size("media") > 0))
    if skip or limit >= 0:
        nth = F.row_number().over(Window.partitionBy("source_index", "range_index").orderBy("line_index"))
        docs = docs.withColumn("nth", nth).where(F.col("nth") > skip)
        docs = (docs.where(F.col("nth") <= skip + limit) if limit >= 0 else docs).drop("nth")
    return docs


def document_stats(docs: DataFrame) -> DataFrame:
    """(source_index, input_files, documents, doc_len): each source is one input file, however many ranges it is read in."""
    return docs.groupBy("source_index").agg(F.lit(1).cast("long").alias("input_files"), F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("doc_len"))


def record_sums(records: DataFrame) -> DataFrame:
    """(record_count, value_sum, bytes) of JSON records that must have an integer id and an integer value; another one fails with its
    worker, source and line."""
    where = [c for c in ("range_index", "source_index", "local_line", "offset") if c in records.columns]
    parsed = records.select(F.from_json(F.col("record").cast("string"), "id bigint, value bigint").alias("r"), F.octet_length("record").alias("n"), *where)
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{'worker' if c == 'range_index' else c} "), F.col(c).cast("string")) for c in where])
    sure = F.when(F.col("r.id").isNull() | F.col("r.value").isNull(), F.raise_error(F.concat(F.lit("record without integer id and value: "), place))).otherwise(F.col("r.value"))
    return parsed.select(sure.cast("long").alias("value"), "n").agg(F.count("*").alias("record_count"), F.sum("value").cast("long").alias("value_sum"), F.sum("n").cast("long").alias("bytes"))


def line_count(data, delimiter=b"\n"):
    return count_of(data, delimiter)
