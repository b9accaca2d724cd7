"""One query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytescan as B
from .operators import documents as D
from .operators import ranges as R
from .operators import verify as V
from .plans.files import list_files
from .scratch import scratch_dir
from .sources import read_documents, register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, data): each row's text as a source of bytes; null is empty."""
    return _table(spark, sf_dir, table).select(F.col(key).cast("long").alias(key), B.utf8(F.coalesce(F.col(text), F.lit(""))).alias("data"))


# ---- DuckDB building blocks: d(key, text, size) are the sources, ends(key, b) the ends of their records ----


def _d(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"d AS (SELECT CAST({key} AS BIGINT) AS key, coalesce({text}, '') AS text, strlen(coalesce({text}, '')) AS size FROM {table})"


def _ends(mark: str, width: int = 1) -> str:
    return f"""pieces AS (SELECT key, size, unnest(string_split(text, {mark})) AS p, generate_subscripts(string_split(text, {mark}), 1) AS i FROM d),
ends AS (SELECT key, b FROM (SELECT key, size, sum(strlen(p) + {width}) OVER (PARTITION BY key ORDER BY i) AS b FROM pieces) WHERE b <= size)"""


_POSITIONS = """ends AS (SELECT key, strlen(text[1:i - 1]) + strlen('{0}') AS b FROM (SELECT key, text, unnest(range(1, length(text) + 1)) AS i FROM d) WHERE substr(text, i, length('{0}')) = '{0}')"""


def _delimited_sql(d: str, ends: str, size: int, key: str = "doc_id", width: int = 1) -> str:
    return f"""WITH RECURSIVE {d}, {ends}, c AS (
 SELECT key, CAST(size AS BIGINT) AS size, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM d WHERE size > 0
 UNION ALL
 SELECT c.key, c.size, c.idx + 1, c.e, CAST(coalesce(min(x.b), c.size) AS BIGINT) FROM c LEFT JOIN ends x ON x.key = c.key AND x.b - {width} >= c.e + {max(size, 1)}
 WHERE c.e < c.size GROUP BY c.key, c.size, c.idx, c.e)
SELECT key AS {key}, idx AS index, s AS start, e AS end_exclusive, e - s AS length FROM c WHERE idx >= 0"""


def _partition_ctes(d: str, ends: str, parts: int) -> str:
    return f"""{d}, {ends}, p AS (
 SELECT key, CAST(size AS BIGINT) AS size, CAST(least({parts}, size) AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last FROM d WHERE size > 0
 UNION ALL
 SELECT p.key, p.size, p.n, p.i + 1, CAST(CASE WHEN (p.size * (p.i + 1)) // p.n <= p.last THEN p.last ELSE coalesce(min(x.b), p.size) END AS BIGINT)
 FROM p LEFT JOIN ends x ON x.key = p.key AND x.b > (p.size * (p.i + 1)) // p.n WHERE p.i + 1 < p.n GROUP BY p.key, p.size, p.n, p.i, p.last),
edges AS (SELECT DISTINCT key, size, last AS s FROM p WHERE last < size),
ranges AS (SELECT key, CAST(row_number() OVER w - 1 AS BIGINT) AS index, s AS start, CAST(coalesce(lead(s) OVER w, size) AS BIGINT) AS end_exclusive, size FROM edges WINDOW w AS (PARTITION BY key ORDER BY s))"""


def _partition_sql(d: str, ends: str, parts: int, key: str = "doc_id", where: str = "") -> str:
    return f"WITH RECURSIVE {_partition_ctes(d, ends, parts)} SELECT key AS {key}, index, start, end_exclusive, end_exclusive - start AS length FROM ranges {where}"


def _multi_ctes(d: str, ends: str, parts: int) -> str:
    return f"""{d}, {ends}, placed AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY key) - size AS BIGINT) AS prefix, CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
aims AS (SELECT i, CAST((total * i) // n AS BIGINT) AS aim FROM (SELECT any_value(total) AS total, least({parts}, any_value(total)) AS n FROM placed WHERE total > 0), range(1, 1000000) AS r(i) WHERE i < n),
moved AS (SELECT i, aim, CASE WHEN aim = prefix THEN aim ELSE prefix + coalesce(min(b), any_value(size)) END AS edge
 FROM aims JOIN placed ON size > 0 AND aim >= prefix AND aim < prefix + size LEFT JOIN ends ON ends.key = placed.key AND b > aim - prefix GROUP BY i, aim, prefix),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last UNION ALL
 SELECT f.i + 1, CAST(CASE WHEN m.aim <= f.last OR m.edge <= f.last THEN f.last ELSE m.edge END AS BIGINT) FROM f JOIN moved m ON m.i = f.i + 1),
edges AS (SELECT DISTINCT last AS s FROM f WHERE last < (SELECT any_value(total) FROM placed)),
workers AS (SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS worker_index, s, coalesce(lead(s) OVER (ORDER BY s), (SELECT any_value(total) FROM placed)) AS e FROM edges),
plan AS (SELECT worker_index, key AS source_index, CAST(greatest(s, prefix) - prefix AS BIGINT) AS start, CAST(least(e, prefix + size) - prefix AS BIGINT) AS end_exclusive
 FROM workers JOIN placed ON size > 0 AND s < prefix + size AND prefix < e)"""


def _multi_sql(d: str, ends: str, parts: int, final: str = "SELECT worker_index, source_index, start, end_exclusive, end_exclusive - start AS length FROM plan") -> str:
    return f"WITH RECURSIVE {_multi_ctes(d, ends, parts)} {final}"


NL, SPACE = _ends("chr(10)"), _ends("' '")

# ---- search ----


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(CASE WHEN instr(text, chr(10)) > 0 THEN strlen(text[1:instr(text, chr(10)) - 1]) ELSE -1 END AS BIGINT) AS first_nl, CAST(CASE WHEN instr(text, 'th') > 0 THEN strlen(text[1:instr(text, 'th') - 1]) ELSE -1 END AS BIGINT) AS first_th FROM d")
def find_first_delim(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", *[F.coalesce(B.find_first(F.col("data"), p), F.lit(-1).cast("long")).alias(n) for p, n in ((b"\n", "first_nl"), (b"th", "first_th"))])


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS n_nl, CAST(len(string_split(text, ' ')) - 1 AS BIGINT) AS n_space FROM d")
def delim_count(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", B.count_of(F.col("data"), b"\n").alias("n_nl"), B.count_of(F.col("data"), b" ").alias("n_space"))


# ---- fixed ----


@query(f"WITH {_d()} SELECT key AS doc_id, CAST((size + 255) // 256 AS BIGINT) AS n_chunks FROM d")
def fixed_count(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", B.fixed_count(F.col("data"), 256).alias("n_chunks"))


def _fixed_sql(d: str, size: int, key: str) -> str:
    return f"WITH {d} SELECT key AS {key}, i AS index, i * {size} AS start, CAST(least((i + 1) * {size}, size) AS BIGINT) AS end_exclusive, CAST(least((i + 1) * {size}, size) - i * {size} AS BIGINT) AS length FROM (SELECT key, size, unnest(range(0, CAST((size + {size - 1}) // {size} AS BIGINT))) AS i FROM d)"


@query(_fixed_sql(_d(), 256, "doc_id"))
def fixed_ranges_256(spark, sf_dir):
    return R.fixed(_sources(spark, sf_dir), "data", 256, "doc_id")


@query(_fixed_sql(_d("region", "r_regionkey", "r_name"), 1, "r_regionkey"))
def fixed_size_zero_clamp(spark, sf_dir):
    return R.fixed(_sources(spark, sf_dir, "region", "r_regionkey", "r_name"), "data", 0, "r_regionkey")


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(300 AS BIGINT) AS start, CAST(least(400, size) AS BIGINT) AS end_exclusive FROM d WHERE size > 300")
def fixed_at_index(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", B.fixed_bounds(F.col("data"), 100, 3).alias("r")).where("r IS NOT NULL").select("doc_id", "r.start", "r.end_exclusive")


@query(f"WITH {_d('benchmark', 'item_id')}, c AS (SELECT key, text, size, unnest(range(0, CAST((size + 63) // 64 AS BIGINT))) AS i FROM d) SELECT key AS item_id, i AS index, substr(hex(encode(text)), CAST(128 * i + 1 AS BIGINT), 128) AS payload FROM c")
def fixed_payload_hex(spark, sf_dir):
    src = _sources(spark, sf_dir, "benchmark", "item_id")
    return R.payloads(R.fixed(src, "data", 64, "item_id", "data"), "data").select("item_id", "index", F.hex("payload").alias("payload"))


# ---- delimited ----


@query(_delimited_sql(_d(), NL, 512))
def delim_nl_512(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir), "data", 512, b"\n", "doc_id")


@query(_delimited_sql(_d(), SPACE, 200))
def delim_space_200(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir), "data", 200, b" ", "doc_id")


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(0 AS BIGINT) AS index, CAST(0 AS BIGINT) AS start, CAST(size AS BIGINT) AS end_exclusive, CAST(size AS BIGINT) AS length FROM d WHERE size > 0")
def delim_nul_absent(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir), "data", 64, b"\0", "doc_id")


@query(_delimited_sql(_d("benchmark", "item_id"), SPACE, 0, "item_id"))
def delim_size_zero(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir, "benchmark", "item_id"), "data", 0, b" ", "item_id")


@query(_delimited_sql(_d(), _ends("'. '", 2), 100, "doc_id", 2))
def pattern_multi(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir), "data", 100, b". ", "doc_id")


@query(_delimited_sql(_d("benchmark", "item_id"), _POSITIONS.format("thth"), 4, "item_id", 4))
def pattern_overlap(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir, "benchmark", "item_id"), "data", 4, b"thth", "item_id")


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(0 AS BIGINT) AS index, CAST(0 AS BIGINT) AS start, CAST(size AS BIGINT) AS end_exclusive, CAST(size AS BIGINT) AS length FROM d WHERE size > 0")
def pattern_absent(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir), "data", 64, b"\x01\x02\x01", "doc_id")


@query(f"WITH {_d('region', 'r_regionkey', 'r_name')} SELECT key AS r_regionkey, CAST(0 AS BIGINT) AS index, CAST(0 AS BIGINT) AS start, CAST(size AS BIGINT) AS end_exclusive, CAST(size AS BIGINT) AS length FROM d WHERE size > 0")
def pattern_longer_than_data(spark, sf_dir):
    return R.delimited(_sources(spark, sf_dir, "region", "r_regionkey", "r_name"), "data", 4, b"x" * 100, "r_regionkey")


# ---- N-way ----


@query(_partition_sql(_d(), NL, 4))
def part_nl_4(spark, sf_dir):
    return R.partitioned(_sources(spark, sf_dir), "data", 4, 10, "doc_id")


@query(_partition_sql(_d(), SPACE, 8))
def part_space_8(spark, sf_dir):
    return R.partitioned(_sources(spark, sf_dir), "data", 8, 32, "doc_id")


@query(_partition_sql(_d("nation", "n_nationkey", "n_name"), _ends("'A'"), 1000, "n_nationkey"))
def part_n_gt_len(spark, sf_dir):
    return R.partitioned(_sources(spark, sf_dir, "nation", "n_nationkey", "n_name"), "data", 1000, ord("A"), "n_nationkey")


@query(_partition_sql(_d(), NL, 1))
def part_one(spark, sf_dir):
    return R.partitioned(_sources(spark, sf_dir), "data", 1, 10, "doc_id")


@query(_partition_sql(_d(), NL, 4, where="WHERE index = 2"))
def part_worker_k(spark, sf_dir):
    return R.worker(R.partitioned(_sources(spark, sf_dir), "data", 4, 10, "doc_id"), 2, 4)


# ---- several sources ----


def _indexed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumnRenamed(key, "source_index")


@query(_multi_sql(_d(), NL, 8))
def multi_docs_8(spark, sf_dir):
    return R.multi_source(_indexed(_sources(spark, sf_dir), "doc_id"), "data", 8)


_TWICE = "d AS (SELECT CAST(n_nationkey + 25 * k AS BIGINT) AS key, n_name AS text, strlen(n_name) AS size FROM nation, range(2) AS t(k))"


@query(_multi_sql(_TWICE, _ends("'A'"), 7))
def multi_dup_sources(spark, sf_dir):
    names = _sources(spark, sf_dir, "nation", "n_nationkey", "n_name")
    both = names.unionByName(names.withColumn("n_nationkey", F.col("n_nationkey") + 25))
    return R.multi_source(_indexed(both, "n_nationkey"), "data", 7, ord("A"))


_SOME_EMPTY = "d AS (SELECT CAST(item_id AS BIGINT) AS key, CASE WHEN item_id % 3 = 0 THEN '' ELSE text END AS text, strlen(CASE WHEN item_id % 3 = 0 THEN '' ELSE text END) AS size FROM benchmark)"


@query(_multi_sql(_SOME_EMPTY, SPACE, 16))
def multi_with_empty(spark, sf_dir):
    src = _sources(spark, sf_dir, "benchmark", "item_id").withColumn("data", F.expr("CASE WHEN item_id % 3 = 0 THEN X'' ELSE data END"))
    return R.multi_source(_indexed(src, "item_id"), "data", 16, 32)


@query(_multi_sql(_d(), NL, 8, "SELECT CAST(count(*) AS BIGINT) AS workers, CAST(sum(r) AS BIGINT) AS ranges, CAST(sum(b) AS BIGINT) AS bytes, CAST(min(b) AS BIGINT) AS least_bytes, CAST(max(b) AS BIGINT) AS most_bytes, max(b) / avg(b) AS imbalance FROM (SELECT worker_index, count(*) AS r, sum(end_exclusive - start) AS b FROM plan GROUP BY 1)"))
def worker_stats(spark, sf_dir):
    return R.worker_stats(multi_docs_8(spark, sf_dir))


@query(_multi_sql(_d("benchmark", "item_id"), SPACE, 5, "SELECT worker_index, CAST(count(*) AS BIGINT) AS n_rows, CAST(min(source_index) AS BIGINT) AS first_source, CAST(max(source_index) AS BIGINT) AS last_source FROM plan GROUP BY 1"))
def worker_rows(spark, sf_dir):
    rows = R.worker_rows(R.multi_source(_indexed(_sources(spark, sf_dir, "benchmark", "item_id"), "item_id"), "data", 5, 32))
    return rows.select("worker_index", F.size("rows").cast("long").alias("n_rows"), F.expr("rows[0].source_index").alias("first_source"), F.element_at("rows", -1)["source_index"].alias("last_source"))


@query(_multi_sql(_d(), NL, 8, "SELECT source_index, true AS in_order FROM plan GROUP BY 1"))
def workers_in_order(spark, sf_dir):
    return V.workers_in_order(multi_docs_8(spark, sf_dir))


# ---- checks ----


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(size AS BIGINT) AS covered, CAST(size AS BIGINT) AS size, true AS whole FROM d")
def plan_coverage(spark, sf_dir):
    src = _sources(spark, sf_dir)
    return V.coverage(R.partitioned(src, "data", 4, 10, "doc_id"), src, "data", "doc_id")


@query(f"WITH RECURSIVE {_partition_ctes(_d(), NL, 4)} SELECT key AS doc_id, index, true AS aligned FROM ranges")
def plan_alignment(spark, sf_dir):
    return V.alignment(R.partitioned(_sources(spark, sf_dir), "data", 4, 10, "doc_id", "data"), "data", "doc_id")


@query(f"WITH RECURSIVE {_partition_ctes(_d(), NL, 4)} SELECT key AS doc_id, index, true AS contiguous FROM ranges")
def plan_contiguity(spark, sf_dir):
    return V.contiguity(R.partitioned(_sources(spark, sf_dir), "data", 4, 10, "doc_id"), "doc_id")


@query("SELECT CAST(0 AS BIGINT) AS differing")
def plan_determinism(spark, sf_dir):
    plan = lambda: R.partitioned(_sources(spark, sf_dir), "data", 4, 10, "doc_id")
    return V.differing(plan(), plan()).agg(F.count("*").alias("differing"))


# ---- framing ----


@query(f"WITH {_d()}, {NL} SELECT key AS doc_id, CAST(i - 1 AS BIGINT) AS line_index, CAST(sum(strlen(p) + 1) OVER (PARTITION BY key ORDER BY i) - strlen(p) - 1 AS BIGINT) AS \"offset\", hex(encode(p)) AS record FROM pieces QUALIFY NOT (p = '' AND i = max(i) OVER (PARTITION BY key))")
def frame_records(spark, sf_dir):
    return R.framed(_sources(spark, sf_dir), "data", 10, "doc_id").withColumn("record", F.hex("record"))


@query(f"WITH RECURSIVE {_partition_ctes(_d(), NL, 4)} SELECT r.key AS doc_id, index, CAST(count(b) AS BIGINT) AS record_offset FROM ranges r LEFT JOIN ends x ON x.key = r.key AND x.b <= r.start GROUP BY 1, 2")
def record_offsets(spark, sf_dir):
    return R.record_offsets(_sources(spark, sf_dir), "data", 4, "doc_id")


@query("SELECT CAST(item_id AS BIGINT) AS item_id, text AS line FROM benchmark")
def strip_carriage_return(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), B.without_carriage_return(F.concat("text", F.lit("\r"))).alias("line"))


# ---- JSON lines ----


def _talks(spark, sf_dir, record) -> DataFrame:
    """Each conversation as a source of JSON lines, planned in three ranges, framed: RECORD columns with line_index and name."""
    lines = _table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("line"))
    src = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("t"))
    src = src.select(F.col("conv_id").alias("source_index"), B.utf8(F.col("t")).alias("data"))
    each = R.framed_by_range(src, "data", 3, 10, "source_index")
    return each.withColumn("name", F.concat(F.lit("talk-"), F.col("source_index").cast("string"), F.lit(".jsonl")))


_LINES = "l AS (SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_index FROM conversations)"


@query(f"WITH {_LINES} SELECT CAST(conv_id AS BIGINT) AS source_index, line_index, 'talk-' || conv_id || '.jsonl/' || line_index AS id, text, role FROM l WHERE text <> ''")
def jsonl_docs_ids(spark, sf_dir):
    docs = D.json_documents(_talks(spark, sf_dir, F.to_json(F.struct("role", "text"))), name_col="name")
    return docs.select("source_index", "line_index", "id", "text", F.element_at("metadata", "role").alias("role"))


@query(f"WITH {_LINES} SELECT CAST(conv_id AS BIGINT) AS source_index, line_index, 'talk-' || conv_id || '.jsonl/' || line_index AS id FROM l WHERE turn % 3 <> 0 AND text <> ''")
def jsonl_malformed(spark, sf_dir):
    record = F.when(F.col("turn") % 3 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("role", "text")))
    return D.json_documents(_talks(spark, sf_dir, record), name_col="name").select("source_index", "line_index", "id")


@query(f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_index) AS nth FROM l WHERE text <> '') SELECT CAST(conv_id AS BIGINT) AS source_index, line_index, text FROM r WHERE nth > 1 AND nth <= 3")
def jsonl_skip_limit(spark, sf_dir):
    one = _talks(spark, sf_dir, F.to_json(F.struct("role", "text"))).withColumn("range_index", F.lit(0).cast("long"))
    return D.json_documents(one, name_col="name", skip=1, limit=2).select("source_index", "line_index", "text")


@query(f"WITH {_d()} SELECT key AS doc_id, CAST(size AS BIGINT) AS n_bytes, md5(text) AS media_md5 FROM d")
def media_base64(spark, sf_dir):
    media = F.array(F.struct(F.base64("data").alias("media_bytes")))
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), media.alias("media")))
    zero = F.lit(0).cast("long")
    docs = D.json_documents(_sources(spark, sf_dir).select(zero.alias("source_index"), zero.alias("range_index"), zero.alias("line_index"), B.utf8(record).alias("record")), "x")
    return docs.select(F.col("id").cast("long").alias("doc_id"), F.octet_length(F.col("media")[0]).cast("long").alias("n_bytes"), F.md5(F.col("media")[0]).alias("media_md5"))


@query(f"WITH {_LINES} SELECT CAST(conv_id AS BIGINT) AS source_index, CAST(1 AS BIGINT) AS input_files, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS doc_len FROM l WHERE text <> '' GROUP BY 1")
def document_stats(spark, sf_dir):
    return D.document_stats(D.json_documents(_talks(spark, sf_dir, F.to_json(F.struct("role", "text"))), name_col="name"))


# ---- files: JSON lines are written to the shared folder and read by planned ranges ----


def _written(spark, lines: DataFrame, parts: int) -> DataFrame:
    """The column `value` as text files, read back through the record_ranges source in that many ranges."""
    path = scratch_dir(spark)
    lines.select("value").write.text(path)
    register(spark)
    return spark.read.format("record_ranges").option("parts", parts).option("path", json.dumps(list_files(path))).load()


@query("SELECT role, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS doc_len, CAST(count(DISTINCT conv_id || '/' || turn) AS BIGINT) AS ids FROM conversations WHERE text <> '' GROUP BY 1")
def documents_by_format(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    path = scratch_dir(spark)
    talks.write.text(path)
    docs = read_documents(spark, list_files(path), 8)
    own = lambda k: F.element_at("metadata", k)
    return docs.groupBy(own("role").alias("role")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("doc_len"), F.count_distinct("id").alias("ids"))


@query(_multi_sql(_d(), NL, 8, "SELECT CAST(count(*) AS BIGINT) AS faults FROM plan WHERE end_exclusive <= start"))
def worker_plan_faults(spark, sf_dir):
    src = _indexed(_sources(spark, sf_dir), "doc_id")
    return V.worker_plan_faults(R.multi_source(src, "data", 8), src, "data").agg(F.count("*").alias("faults"))


@query("SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(sum(o_custkey) AS BIGINT) AS value_sum, CAST(sum(strlen('{\"id\":' || o_orderkey || ',\"value\":' || o_custkey || '}') + 1) AS BIGINT) AS bytes FROM orders")
def jsonl_count_sum(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))).alias("value"))
    return D.record_sums(_written(spark, orders, 8))


@query("SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1")
def range_source_e2e(spark, sf_dir):
    lines = _table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("value"))
    read = _written(spark, lines, 6).select(F.from_json(F.col("record").cast("string"), "o_orderkey bigint, o_orderpriority string").alias("r"))
    return read.groupBy(F.col("r.o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("r.o_orderkey").alias("key_sum"))


@query("SELECT count(*) AS expected, CAST(0 AS BIGINT) AS wrong FROM events")
def exactly_once(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id")
    read = _written(spark, events.select(F.to_json(F.struct("event_id")).alias("value")), 5)
    seen = read.select(F.from_json(F.col("record").cast("string"), "event_id bigint")["event_id"].alias("event_id"))
    wrong = V.exactly_once(seen, events, "event_id").agg(F.count("*").alias("wrong"))
    return events.agg(F.count("*").alias("expected")).crossJoin(wrong)  # two single rows


@query("SELECT sha256(string_agg(line, '' ORDER BY n_regionkey, n_nationkey)) AS checksum FROM (SELECT n_regionkey, n_nationkey, n_regionkey || ':' || n_nationkey || ':' || count(*) || chr(10) AS line FROM nation GROUP BY 1, 2)")
def sorted_checksum(spark, sf_dir):
    return V.sorted_checksum(_table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")


_HALF = "CAST(sum(CAST('0x' || substr(md5(o_orderkey || ':' || o_custkey), {}, 15) AS HUGEINT)) AS VARCHAR)"


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, {_HALF.format(1)} AS high, {_HALF.format(16)} AS low FROM orders")
def additive_checksum(spark, sf_dir):
    return V.additive_checksum(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
