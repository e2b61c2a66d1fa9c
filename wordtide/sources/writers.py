"""Writers: clean corpus, hits by word, pair sheets, JSON bundles, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.sources.versions import folder, new_name, publish, versions

# Schema of the clean corpus, headers of the pair sheets.
CLEAN_SCHEMA = {
    "textID": "long",
    "doc_text": "string",
    "#words": "long",
    "year": "long",
    "genre": "string",
    "subgen": "long",
    "source": "string",
    "title": "string",
}
PAIR_COLUMNS = ["lemma", "id_a", "id_b", "cluster_a", "cluster_b", "time_a", "time_b", "a", "b"]
CONTROL_COLUMNS = ["fieldname_gold", "fieldname_gold_reason", "_golden"]
CONTROL_VALUES = ["identical", "", "TRUE"]
# Stands for null in CSV tables, where nothing between two commas is an empty text.
NULL_MARK = "\ue000"
SOURCE_FILE = "source_file"
# Parts that the rows of a word are dealt to.
JSON_SALTS = 256


def clean_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with the fixed schema; other columns are left out. A rerun replaces the table."""
    df.select([F.col(f"`{c}`").cast(t).alias(c) for c, t in CLEAN_SCHEMA.items()]).write.mode(mode).parquet(path)


def append_clean_corpus(df: DataFrame, path: str, file_col: str = "path") -> None:
    """The same, one partition per source file: files written before are replaced, others stay.

    So a second run over a file changes nothing. A file that has no documents any more keeps
    those it had. `readers.clean_corpus` reads the table. Rows are rebalanced by file, so that a
    small file ends in one part and a large one in several.
    """
    name = F.substring_index(F.col(file_col), "/", -1)
    file = F.concat_ws("-", F.substring(name, 1, 80), F.substring(F.md5(F.col(file_col)), 1, 12)).alias(SOURCE_FILE)
    typed = df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in CLEAN_SCHEMA.items()], file)
    typed.hint("rebalance", SOURCE_FILE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        SOURCE_FILE
    ).parquet(path)


def hits_by_word(df: DataFrame, path: str) -> None:
    """CSV, one folder per word; a word without hits gets none.

    Rows are rebalanced by word first: rare words end in one file each, a
    frequent word is split over many, whatever the number of scan tasks.
    """
    columns = ["corpus_id", "sentence", "start_idx", "end_idx", "word"]
    df.select(columns).hint("rebalance", "word").write.mode("overwrite").partitionBy("word").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def pair_sheet(pairs: DataFrame, path: str, control: bool = False) -> None:
    """Tab-separated pairs in shuffled order; fails if a pair mixes two lemmas.

    The sheet has no quotes: tabs and line ends within texts become blanks.
    """
    checked = pairs.withColumn(
        "lemma",
        F.when(F.col("lemma_a") == F.col("lemma_b"), F.col("lemma_a")).otherwise(
            F.raise_error(F.lit("A pair mixes two lemmas"))
        ),
    )
    order = F.md5(F.concat_ws("-", F.lit("42"), *[F.col(c) for c in PAIR_COLUMNS]))
    texts = {c: F.regexp_replace(c, r"[\t\r\n]", " ") for c, t in checked.dtypes if t == "string" and c in PAIR_COLUMNS}
    sheet = checked.orderBy(order).withColumns(texts).select(PAIR_COLUMNS)
    if control:
        sheet = sheet.select(
            "*", *[F.lit(v).alias(c) for c, v in zip(CONTROL_COLUMNS, CONTROL_VALUES)]
        )
    sheet.write.mode("overwrite").csv(
        path, sep="\t", header=True, emptyValue="", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def json_by_word(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per word; rows are rebalanced by word and a hash, so that a word of
    any size is dealt to many tasks, and small words end in few files.
    """
    hashed = [c for c, t in df.dtypes if "map<" not in t]
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(JSON_SALTS)))
    dealt.hint("rebalance", "word", "_salt").drop("_salt").write.mode("overwrite").partitionBy("word").json(path)


def finished_words(spark: SparkSession, path: str) -> DataFrame:
    """Words that have an output folder; reads no data columns."""
    return spark.read.schema("word string").json(path).select("word").distinct()


def csv_table(df: DataFrame, path: str) -> None:
    """CSV that `readers.feature_vectors` reads back as it was; null and empty texts differ."""
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', nullValue=NULL_MARK, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def parquet_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def compute_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the saved result, or compute and save it first.

    A result counts as saved once it is published, so a run that died while writing is done
    again. Where two runs compute at once, both read what was published first.
    """
    if versions(spark, path).isEmpty():
        name = new_name()
        compute().write.parquet(folder(path, name))
        publish(spark, path, name)
    first = versions(spark, path).orderBy("version", "name").first()
    return spark.read.parquet(folder(path, first["name"]))
