"""Corpus files, metadata, word lists, stores: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.periods import lenient_number, to_year
from wordtide.operators import sampling as S, usage as U
from wordtide.operators.vectors import pool
from wordtide.plans.corpus import attach_metadata, split_records
from wordtide.registry.common import (
    STRIP, documents, exploded, rounded, table, usages, with_parts, year_of,
)
from wordtide.session import new_path
from wordtide.sources import readers, writers

def _raw_texts(spark, sf):
    """Each document as a marked one of several lines, sentences with ` the ` redacted."""
    text = F.replace("text", F.lit(" the "), F.lit(f" {T.REDACTION_MARK} "))
    mark = F.concat(F.lit("@@"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(" "))
    return documents(spark, sf).select(F.concat(mark, text).alias("value"))


def _raw_metadata(spark, sf):
    """Metadata of each labelled document, all strings, some broken."""
    name = F.col("doc_id").cast("string")
    return table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("x"), name))
        .otherwise(F.concat(name, F.lit(".0")))
        .alias("textID"),
        F.when(F.col("doc_id") % 10 == 5, F.concat(name, F.lit("d"))).otherwise(name).alias("#words"),
        F.when(F.col("doc_id") % 10 != 7, year_of("doc_id").cast("string")).alias("year"),
        F.concat(F.lit("genre"), F.col("toxic").cast("string")).alias("genre"),
        F.when(F.col("quality") == 1, "1e2").otherwise("-").alias("subgen"),
        F.concat(F.lit("src "), name).alias("source"),
        F.concat(F.lit("title "), name).alias("title"),
        F.lit("printed").alias("publication_info"),
    )


def _metadata(spark, sf):
    """The same written as a tab-separated file with header lines and read back."""
    path = new_path(spark, "metadata")
    raw = _raw_metadata(spark, sf)
    names = spark.range(1).select([F.lit(c).alias(c) for c in raw.columns])
    names.unionByName(raw).write.csv(path, sep="\t", quote="")
    return readers.corpus_metadata(spark, path)


def metadata_coerce(spark, sf):
    return _metadata(spark, sf).withColumns(
        {c: F.col(f"`{c}`").cast("double") for c in ["#words", "year", "subgen"]}
    ).withColumnRenamed("#words", "words")


def doc_split_clean(spark, sf):
    texts, out = new_path(spark, "texts"), new_path(spark, "clean")
    _raw_texts(spark, sf).write.text(texts)
    metadata = _metadata(spark, sf)
    for _ in range(2):  # a second run over the same files changes nothing
        documents = split_records(readers.corpus_records(spark, texts))
        writers.append_clean_corpus(attach_metadata(documents, metadata), out)
    clean = readers.clean_corpus(spark, out)
    return clean.select(
        "textID", "doc_text", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in
                                [("#words", "words"), ("year", "year"), ("subgen", "subgen")]],
        "genre", "source", "title",
    )


def corpora_union(spark, sf):
    """At most 200 ASCII-only texts of each of two corpora."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    both = {
        name: S.sample_n(df.withColumn("text", T.ascii_only(F.col("text"))), 200, ["key"])
        for name, df in {"documents": docs, "conversations": turns}.items()
    }
    return readers.union_sources(both)


def usage_store_merge(spark, sf):
    """A written usage store and a later one, one row per usage."""
    columns = ["word", "usage_id", "vector", "label", "year"]
    old, new = usages(spark, sf).where("label < 5"), usages(spark, sf).where("label >= 5")
    path = new_path(spark, "usages")
    writers.parquet_table(old.select(columns), path)
    merged = U.merge_stores(readers.table(spark, path), new.select(columns))
    return exploded(merged, ["word", "usage_id", "label", "year"], "vector")


def tsv_tagged_scan(spark, sf):
    path = new_path(spark, "tagged")
    turns = table(spark, sf, "conversations").select(
        F.col("role").alias("word"),
        F.translate("text", "\n\r\t\"\\", "     ").alias("sentence"),
        F.length("text").cast("string").alias("tag"),
        F.concat_ws("-", "conv_id", "turn").alias("bnc_index"),
    )
    turns.write.csv(path, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.tagged_occurrences(spark, path)


def wordlist_scan(spark, sf):
    """Documents per entry of a JSON word list made of their languages."""
    path = new_path(spark, "words")
    docs = table(spark, sf, "documents")
    docs.agg(F.to_json(F.collect_set("lang"))).write.text(path)
    words = readers.word_list(spark, path)
    return docs.join(words, docs.lang == words.word).groupBy("word").agg(F.count("*").alias("n"))


def sql_scan_limit(spark, sf):
    table(spark, sf, "documents").withColumnRenamed("doc_id", "Doc_ID").createOrReplaceTempView("articles")
    rows = readers.articles(spark, "articles", 5_000_000, ["doc_id"])
    return rows.select("doc_id", F.col(rows.columns[3]).alias("fourth"))


def feature_semi_join(spark, sf):
    """Feature rows, from CSV, of the usages in a sample."""
    path = new_path(spark, "features")
    size = range(64)
    vectors = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in size])
    writers.csv_table(vectors, path)
    features = readers.feature_vectors(spark, path, ", ".join(["vec_id long", *(f"f{i} double" for i in size)]))
    sample = S.sample_n(table(spark, sf, "embeddings").select("vec_id"), 200, ["vec_id"])
    kept = features.join(sample, "vec_id", "left_semi")
    return kept.select("vec_id", *[rounded(F.col(f"f{i}")).alias(f"f{i}") for i in size])


def compute_once(spark, sf):
    path = new_path(spark, "once")
    count = lambda: table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    writers.compute_once(spark, path, count)
    return writers.compute_once(spark, path, count)


def centroids_roundtrip(spark, sf):
    """Mean vector of each word and label, saved and read back."""
    path = new_path(spark, "centroids")
    writers.parquet_table(pool(usages(spark, sf), ["word", "label"]), path)
    return exploded(readers.table(spark, path), ["word", "label"], "vector")


def abbrev_sentences(spark, sf):
    parts = documents(spark, sf).select("doc_id", T.abbreviation_aware_sentences(F.col("text")).alias("all"))
    return parts.select("doc_id", F.posexplode_outer("all").alias("idx", "sentence")).where("sentence is not null")


def year_cast(spark, sf):
    year = F.when(F.col("doc_id") % 10 == 7, "n/a").otherwise(year_of("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", to_year(year).cast("double").alias("year"))


def lenient_numbers(spark, sf):
    """Numbers of mixed spelling: plain, with blanks, with exponent, with a suffix."""
    text = F.get(
        F.array(
            F.concat(F.lit(" "), F.col("n_chars").cast("string")),
            F.concat(F.col("n_chars").cast("string"), F.lit("d")),
            F.concat(F.col("n_chars").cast("string"), F.lit("e1 ")),
            F.lit(""),
            F.lit("1.5.2"),
        ),
        (F.col("doc_id") % 5).cast("int"),
    )
    return table(spark, sf, "documents").select("doc_id", lenient_number(text).alias("value"))


QUERIES = {
    f.__name__: f
    for f in [
        metadata_coerce, doc_split_clean, corpora_union, usage_store_merge, tsv_tagged_scan, wordlist_scan,
        sql_scan_limit, feature_semi_join, compute_once, centroids_roundtrip, abbrev_sentences, year_cast,
        lenient_numbers,
    ]
}

_METADATA = """m AS (
  SELECT doc_id AS "textID",
         CASE WHEN doc_id % 10 <> 5 THEN CAST(doc_id AS DOUBLE) END AS words,
         CASE WHEN doc_id % 10 <> 7 THEN CAST(1950 + doc_id % 73 AS DOUBLE) END AS year,
         'genre' || toxic AS genre, CASE WHEN quality = 1 THEN 100.0::DOUBLE END AS subgen,
         'src ' || doc_id AS source, 'title ' || doc_id AS title, 'printed' AS publication_info
  FROM labels WHERE doc_id % 10 <> 3)"""
_STRIP_X = STRIP.format("x")
_ALL_LINES = f"""l AS (
  SELECT doc_id AS "textID", replace(text, ' the ', ' @ @ @ @ @ @ @ @ @ @ ') AS line FROM documents),
d AS (
  SELECT "textID", array_to_string([{_STRIP_X} FOR x IN
      regexp_extract_all({STRIP.format('line')}, '[^.!?]*[.!?]+|[^.!?]+')
      IF NOT contains(x, '@ @ @ @ @ @ @ @ @ @') AND {_STRIP_X} <> ''], ' ') AS doc_text
  FROM l)"""

ORACLES = {
    "metadata_coerce": with_parts(_METADATA) + "SELECT * FROM m",
    "doc_split_clean": with_parts(_METADATA, _ALL_LINES) + """
      SELECT d."textID", doc_text, words, year, subgen, genre, source, title FROM d LEFT JOIN m ON m."textID" = d."textID" """,
    "corpora_union": r"""
      WITH a AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text FROM documents
                 UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations)
      SELECT source, key, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || key), key) AS r FROM a) WHERE r <= 200""",
    "usage_store_merge": """
      SELECT 'w' || vec_id % 5 AS word, vec_id AS usage_id, label, CAST(1950 + vec_id % 73 AS INTEGER) AS year,
             CAST(unnest(range(len(embedding))) AS INTEGER) AS dim,
             round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0::DOUBLE AS value FROM embeddings""",
    "tsv_tagged_scan": """
      SELECT role AS word, translate(text, chr(10) || chr(13) || chr(9) || '"' || chr(92), '     ') AS sentence,
             CAST(length(text) AS VARCHAR) AS tag, conv_id || '-' || turn AS bnc_index FROM conversations""",
    "wordlist_scan": "SELECT lang AS word, count(*) AS n FROM documents GROUP BY lang",
    "sql_scan_limit": "SELECT doc_id, source AS fourth FROM documents ORDER BY doc_id LIMIT 5000000",
    "feature_semi_join": "SELECT vec_id, "
    + ", ".join(f"round(f[{i + 1}], 6) + 0.0::DOUBLE AS f{i}" for i in range(64)) + """
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings ORDER BY md5('42-' || vec_id), vec_id LIMIT 200)""",
    "compute_once": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "centroids_roundtrip": """
      SELECT 'w' || vec_id % 5 AS word, label, dim, round(avg(x), 6) + 0.0::DOUBLE AS value FROM (
        SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
      GROUP BY 1, 2, 3""",
    "year_cast": "SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN CAST(1950 + doc_id % 73 AS DOUBLE) END AS year FROM documents",
    "lenient_numbers": """
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(n_chars AS DOUBLE) WHEN 2 THEN n_chars * 10.0::DOUBLE END AS value FROM documents""",
}
