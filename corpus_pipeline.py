"""Stages of a training-data pipeline over ``documents``; registered as query ``pipeline``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Null and empty texts go in the first
stage (they have no language). An empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epivigil.llm import decontaminate, language, neardup, packing, quality_rules
from epivigil.llm.common import table
from epivigil.session import ship, written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that no known language is near to, or that have no letters."""
    ship(spark)
    return language.predict(docs.select(*DOCUMENTS), language.train(docs)).where(~F.col("rejected")).select(*DOCUMENTS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that break a quality rule."""
    return quality_rules.quality_rules(docs, keep=DOCUMENTS[:1] + DOCUMENTS[2:] + ("text",)).where("kept").select(*DOCUMENTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (0.80 or more of their 5-word shingles shared): the one with the smallest doc_id.

    A row goes for its own text only: rows that share an id but not a text are told apart, and of rows without an id those go that
    repeat a text. Of rows that repeat an id and a text one stays. A row with an id stays rather than one without.
    """
    ship(spark)
    docs = docs.select(*DOCUMENTS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = neardup.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENTS)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "_at"]
    rows = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(*order).drop("_at")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")  # numbers follow the sorted ids
    found = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80).where("kept")
    kept = rows.join(found.select(F.col("doc_id").alias("_row"), "n_shingles"), "_row")
    wordless = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    return kept.where(~wordless).unionByName(kept.where(wordless).dropDuplicates(["doc_id", "text"])).select(*DOCUMENTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark"), error_rate=0.05)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 1024 tokens."""
    ship(spark)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(cut, ["doc_id", "piece"], capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
