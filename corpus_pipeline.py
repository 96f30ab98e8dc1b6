"""A training-corpus pipeline over `documents`: quality, language, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads
again as the next stage's docs.

Defined results: null and empty texts are scored by the quality stage like others, have no language and so go with the language stage
(and count as one empty text in the exact stage, and as no one's copy in the near stage); very long texts are worked on whole; of rows
with equal texts the one with the largest doc_id stays, of near copies the one with the smallest; where ids repeat or are null, rows are
told apart by their place in docs instead, and the last or first row stays; empty tables pass through empty; other columns, whatever
their names, are carried along by all stages but the last, which ignores them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricehist.llm import dedup_exact, dedup_near, langid, packing, quality
from pricehist.llm.common import stored, table
from pricehist.llm.queries import WORD_BPE


def _kept(docs: DataFrame, dedup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that dedup keeps, with all their columns."""
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").take(1)
    # Numbers depend on how the scan is split, so they are written before they are used twice.
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered") if odd else docs.withColumn(row, F.col("doc_id"))
    kept = dedup(rows.select(F.col(row).alias("doc_id"), "text")).filter("kept")
    return rows.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, dedup_exact.dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda rows: dedup_near.near_duplicates(rows, width=5, least=80))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality", keep_good_quality),
    ("language", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]
#: SQL cannot express the models; tests hold the rows of each stage against a plain version over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
