"""Documents through the stages of training-data preparation, each written and read again.

A document is a doc_id: rows that share one stand or fall together, and rows without one pass
all stages that decide by id. Stages keep whatever columns the documents have; all but the
last return exactly those. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm import minhash, packing, quality, secrets, toxicity
from wordtide.llm.tables import table
from wordtide.session import cut_lineage

NEAR_WORDS = 5
NEAR_PERCENT = 80
SECRET = "[SECRET]"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents without those ids: only ids are moved if they are few."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold stay."""
    found = toxicity.flagged(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _without(docs, found.where("predicted = 1"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score at or over the threshold stay."""
    found = quality.judged(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return _without(docs, found.where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest id stays."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=NEAR_WORDS, percent=NEAR_PERCENT)
    return _without(docs, found.where(~F.col("kept")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them become a marker, and n_chars follows the text."""
    found = secrets.redact(docs, "text", SECRET)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which batch each part of each document goes to."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# The classifiers are no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
