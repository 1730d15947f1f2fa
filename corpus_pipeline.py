"""A corpus pipeline over ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results of all stages: an empty table gives an empty table; rows with a null doc_id and rows that repeat are documents like any other;
extra columns pass through, whatever their names, up to packing, which ignores them; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import decontaminate, line_dedup, minhash_join, packing, quality_mil
from quarrygraph.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.7 or more).

    A null or empty text is scored like any other; rows that repeat stay or go together; without usable labels every score is 0.5, so none stays.
    """
    return quality_mil.score(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; a document that loses all lines stays, with an empty text.

    A null text stays null; of documents that tie for a line the largest doc_id keeps it, and all rows of that doc_id do; n_chars is counted anew
    where a line went.
    """
    out = line_dedup.dedup_lines(docs).withColumn("text", F.coalesce("kept_text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, null last, of rows that repeat one.

    Texts without words, null ones too, are not near anything, so each stays.
    """
    return minhash_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item; null and empty texts hold none, and rows that repeat stay or go together."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; a null or empty text is the end id alone, and rows that repeat are packed one by one."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Fitting a model and tokenising are not SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
