"""The operators of this package over the driver's tables: one query each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, jaccard, mixing, repeats, topk
from .common import scratch_dir, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents")).drop("text_md5")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs, _, _ = mix(table(spark, sf_dir, "documents"), keep_columns=False)
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), keep_columns=False)


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .orc_tokens import token_digests, write_token_ids

    path = scratch_dir(spark)
    write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": jaccard.ORACLE, "op5_mixing": mixing.ORACLE, "op6_repeats": repeats.ORACLE, "op7_top_k": topk.ORACLE, "op8_exact_dedup": dedup.ORACLE}
