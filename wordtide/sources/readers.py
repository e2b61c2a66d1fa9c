"""Readers: corpus files, metadata, token hits, stored clusters, word lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions.periods import lenient_number
from wordtide.operators.blocks import fits_broadcast
from wordtide.operators.ranking import first_rows
from wordtide.session import cut_lineage
from wordtide.sources.writers import CLEAN_SCHEMA, CONTROL_COLUMNS, NULL_MARK, PAIR_COLUMNS

# Field names and types of the files.
METADATA_COLUMNS = ["textID", "#words", "year", "genre", "subgen", "source", "title", "publication_info"]
HIT_SCHEMA = "corpus_id long, sentence string, start_idx int, end_idx int"
HIT_PARTITION_SCHEMA = HIT_SCHEMA + ", word string"
TAGGED_SCHEMA = "word string, sentence string, tag string, bnc_index string"
CLUSTER_SCHEMA = "k_clusters int, layer int, cluster_id int, sentence_uids array<string>"


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per text file below root: path, value."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def corpus_records(spark: SparkSession, root: str, separator: str = "@@", start: str = r"^\d{7}") -> DataFrame:
    """path, value: a row per document of the files below root, beginning with its id, the marker left out.

    Files are split and read by many tasks, with the marker as the end of a record. What comes before
    the first marker of a file belongs to no document. A record that does not begin with an id
    was cut off at a marker inside a text: it goes back to the document before it. Only such
    texts are moved, and no file is ever a single row. A marker without id that ends a file is
    lost, and where a split of a file cuts through three or more of the marker's characters in a
    row, they are read as Spark's reader cuts them.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(root, lineSep=separator)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # rising within a block
        "value",
        F.rlike("value", F.lit(start)).alias("starts"),
    )
    # Without texts: the records of first blocks, and those without an id.
    marks = cut_lineage(rows.where("block = 0 or not starts").select("path", "block", "at", "starts"), "marks")
    first = cut_lineage(marks.where("block = 0").groupBy("path").agg(F.min("at").alias("at")), "first")
    key = ["path", "at"]
    parts = cut_lineage(marks.where("not starts").select("path", "block", "at").join(first, key, "left_anti"), "parts")
    documents = _without(rows, first, key).where("starts")
    if parts.isEmpty():
        return documents.select("path", "value")
    # The document of each part, from the places of all records of the files concerned.
    places = rows.select("path", "block", "at", "starts")
    concerned = parts.select("path").distinct()
    places = _without(places.join(F.broadcast(concerned) if fits_broadcast(concerned) else concerned, "path", "left_semi"), first, key)
    order = W.partitionBy("path").orderBy("block", "at")
    owned = places.withColumn("owner", F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(order))
    # Parts in front of the first document belong to the preamble.
    owned = cut_lineage(owned.where("not starts").select("path", "block", "at", "owner"), "owned")
    pieces = owned.where("owner is not null").select("path", "at", "owner", "block").unionByName(
        owned.where("owner is not null").select("path", F.col("owner").alias("at"), "owner", F.lit(-1).cast("long").alias("block")).distinct()
    )
    pieces = cut_lineage(pieces, "pieces")
    texts = rows.select("path", "at", "value").join(F.broadcast(pieces) if fits_broadcast(pieces) else pieces, key)
    whole = texts.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("all"))
    whole = whole.select("path", F.concat(F.lit(separator), F.array_join(F.transform("all", lambda p: p["value"]), separator)).alias("value"))
    # A marker may have begun with the last characters of another one.
    again = whole.select("path", F.explode(F.slice(F.split("value", f"{separator}(?={start.removeprefix('^')})"), 2, 1 << 30)).alias("value"))
    owners = cut_lineage(pieces.where("block = -1").select(*key), "owners")
    return _without(documents, owners, key).select("path", "value").unionByName(again)


def _without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows without those of a written table of keys, which is sent to the tasks if it is small."""
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, list(key), "left_anti")


def clean_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The table of `writers.clean_corpus` or `writers.append_clean_corpus`, with the fixed columns."""
    return spark.read.parquet(path).select([F.col(f"`{c}`").cast(t).alias(c) for c, t in CLEAN_SCHEMA.items()])


def corpus_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated metadata; header lines go, as their id is no number."""
    schema = ", ".join(f"`{name}` string" for name in METADATA_COLUMNS)
    raw = spark.read.schema(schema).csv(path, sep="\t", quote="", encoding="ISO-8859-1")
    return coerce_metadata(decode_escapes(raw))


def decode_escapes(df: DataFrame) -> DataFrame:
    r"""Turn \uXXXX and \xXX sequences of string columns into their characters.

    Text without a backslash passes through untouched.
    """

    def decode(c):
        parts = F.split(c, r"\\(?=u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
        digits = lambda part: F.when(part.startswith("u"), 4).otherwise(2)
        code = lambda part: F.decode(
            F.unhex(F.lpad(F.substr(part, F.lit(2), digits(part)), 4, "0")), "UTF-16BE"
        )
        tail = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda part: F.concat(code(part), F.substr(part, digits(part) + 2)),
        )
        return F.when(F.contains(c, F.lit("\\")), F.concat(parts[0], F.array_join(tail, ""))).otherwise(c)

    return df.select(
        [decode(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def coerce_metadata(raw: DataFrame) -> DataFrame:
    """Numbers where they parse, null elsewhere; rows without a numeric id go."""
    numeric = ["textID", "#words", "year", "subgen"]
    return (
        raw.withColumns({c: lenient_number(F.col(f"`{c}`")).cast("long") for c in numeric})
        .dropna(subset=["textID"])
        .select([f"`{c}`" for c in METADATA_COLUMNS])
    )


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token_hits(spark: SparkSession, path: str, words: Sequence[str] | None = None) -> DataFrame:
    """Hits written by `writers.hits_by_word`; only the folders of `words` are read."""
    df = spark.read.schema(HIT_PARTITION_SCHEMA).csv(path, header=True, multiLine=True, escape='"')
    return df if words is None else df.where(F.col("word").isin(list(words)))


def tagged(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all frames, each with the name of its source; duplicates stay."""
    parts = [tagged(df, name) for name, df in frames.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tagged_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAGGED_SCHEMA).csv(path, sep="\t", header=False)


def articles(
    spark: SparkSession, table_name: str, limit: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Rows of a catalog table or view, lower-cased names; all of them, or the first `limit` by `order`."""
    df = spark.table(table_name)
    df = df.toDF(*[c.lower() for c in df.columns])
    if limit is None:
        return df
    if not order:
        raise ValueError("A limit needs columns to order by, or its rows are not determined.")
    return first_rows(df, limit, list(order))


def jdbc_articles(spark: SparkSession, url: str, table_name: str, **options: str) -> DataFrame:
    """The same over JDBC; give partitionColumn, lowerBound, upperBound, numPartitions."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table_name, **options).load()
    return df.toDF(*[c.lower() for c in df.columns])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a JSON array, in their order: position, word."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "word"))


def stored_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTER_SCHEMA).parquet(path)


def feature_vectors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written by `writers.csv_table`; quotes, commas, line ends, blanks and empty texts are kept."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue=NULL_MARK, emptyValue="")


def pair_sheet(spark: SparkSession, path: str, control: bool = False) -> DataFrame:
    """Pairs written by `writers.pair_sheet`; what is empty in the sheet is an empty text."""
    numbers = {"id_a", "id_b", "cluster_a", "cluster_b"}
    columns = PAIR_COLUMNS + (CONTROL_COLUMNS if control else [])
    schema = ", ".join(f"{c} {'int' if c in numbers else 'string'}" for c in columns)
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="")
    return rows.fillna("", [c for c in columns if c not in numbers])
