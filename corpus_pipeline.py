"""A cleaning pipeline over documents: each stage keeps, drops or repeats documents and hands them on.

quality      documents that the classifier rejects go
exact_dedup  one of equal texts stays
near_dedup   one of each class of similar texts stays
mix          documents are taken as often as the sources' target weights ask
encode       token ids of what is left, by digest, and their decoded bytes

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all that its predecessor kept; all but the
last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, dedup, jaccard, mixing, quality
from spanforge.llm.common import materialise, one_of_each, shrink_heaps, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on the labelled ones among docs, doesn't reject.

    A null text counts as empty, a very long one is read whole; rows that repeat text fare alike, whatever their ids; any column
    names will do. Without labels all rows score the share of good ones. An empty table gives an empty one.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_scores(docs, weights, score_col="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest id.

    A null text equals an empty one; a null id is less than any. Of rows that tie, as with repeated ids or null ids only, the one of the least
    digest of all columns stays. Very long texts meet by their digests. An empty table gives an empty one.
    """
    found = dedup.exact_dedup(docs, own_names=("__keep_id", "__group_size", "__kept", "__sha256")).where("__kept")
    # of rows that share the largest id, or have none, one stays
    groups = one_of_each(found.where("__group_size > 1"), [F.col("__sha256")], docs.columns)
    return found.where("__group_size = 1").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(groups)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts: that of the least id, and of the least text digest where ids repeat.

    Null and empty texts have no shingles and all stay; a null id is greater than any; very long texts count whole. An empty
    table gives an empty one.
    """
    return jaccard.one_of_each_class(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the sources' targets ask for.

    Null and empty texts have no words and go; a null source is one of its own; a very long text counts with all its words; rows that tie may stand in
    for one another. An empty table gives an empty one. Texts aren't shuffled; the executors first give back heap that earlier stages made them grow by.
    """
    shrink_heaps(spark)
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for each row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids; a very long one is encoded whole; repeated rows give repeated results; a null id stays null;
    other columns are left behind. An empty table gives an empty one. The work is Python's, so the executors first give back heap that
    earlier stages made them grow by.
    """
    shrink_heaps(spark)
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: The classifier, the similarity classes and the encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
