"""Tables of the test data and SQL parts shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions.periods import PERIOD_BOUNDS
from wordtide.functions.vectors import as_doubles

WORDS = ["the", "de", "and"]
PERIODS = [f"({lo}, {hi}]" for lo, hi in zip(PERIOD_BOUNDS, PERIOD_BOUNDS[1:])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by a unique key over the cores when a scan has too few splits.

    The given tables are single files; files of many splits stay as they are.
    """
    context = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= 2 * context.defaultParallelism:
        return df
    return df.repartition(context.defaultParallelism, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def year_of(key: str) -> Column:
    return (1950 + F.col(key) % 73).cast("int")


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, usage_id, vector, label, year from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id") % 5).alias("word"),
        F.col("vec_id").alias("usage_id"),
        as_doubles(F.col("embedding")).alias("vector"),
        "label",
        year_of("vec_id").alias("year"),
    )


def exploded(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per dimension, values rounded, no negative zero."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "_v")).select(
        *keys, "dim", rounded(F.col("_v")).alias("value")
    )


def rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places) + F.lit(0.0)


SENTENCES_OF = "regexp_extract_all({0}, '[^.!?]*[.!?]+|[^.!?]+')"
TOKENS_OF = r"regexp_extract_all({0}, '\p{{L}}+|\d+|[^\s\p{{L}}\d]')"
STRIP = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
WORD_LIST = "('the', 'de', 'and')"

SENTENCES = f"""s AS (
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS sent_idx, unnest(a) AS sentence
  FROM (SELECT doc_id, {SENTENCES_OF.format('text')} AS a FROM documents))"""
TOKENS = f"""t AS (
  SELECT doc_id, sent_idx, CAST(unnest(range(len(k))) AS INTEGER) AS pos, unnest(k) AS tok, sentence
  FROM (SELECT doc_id, sent_idx, sentence, {TOKENS_OF.format('sentence')} AS k FROM s))"""
HITS = f"""hits AS (
  SELECT doc_id AS corpus_id, sent_idx, {STRIP.format('sentence')} AS sentence, tok AS word,
         pos AS start_idx, pos + 1 AS end_idx
  FROM t WHERE tok IN {WORD_LIST})"""
BINS = "bins(lo, hi, period) AS (VALUES " + ", ".join(
    f"({lo}, {hi}, '({lo}, {hi}]')" for lo, hi in zip(PERIOD_BOUNDS, PERIOD_BOUNDS[1:])
) + ")"
USAGES = """u AS (
  SELECT vec_id AS usage_id, 'w' || CAST(vec_id % 5 AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vector,
         label, CAST(1950 + vec_id % 73 AS INTEGER) AS year
  FROM embeddings)"""
DIMENSIONS = """e AS (
  SELECT usage_id, word, label, year, CAST(unnest(range(len(vector))) AS INTEGER) AS dim, unnest(vector) AS x FROM u)"""
CONTEXTS = f"""n AS (
  SELECT doc_id, sent_idx, sentence,
         coalesce(lag(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx), '') AS before,
         coalesce(lead(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx), '') AS after,
         coalesce(string_agg(sentence, '') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS longer,
         coalesce(string_agg(sentence, '') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), '') AS further
  FROM s),
w0 AS (
  SELECT doc_id, sent_idx, {TOKENS_OF.format('longer')} AS kb, {TOKENS_OF.format('sentence')} AS kw,
         {TOKENS_OF.format('further')} AS ka, greatest(10, len({TOKENS_OF.format('before')})) AS nb,
         greatest(10, len({TOKENS_OF.format('after')})) AS na FROM n),
w AS (
  SELECT doc_id, sent_idx, kw, kb[greatest(1, len(kb) - nb + 1):len(kb)] AS kb, ka[1:na] AS ka FROM w0),
c AS (
  SELECT * FROM (
    SELECT doc_id AS corpus_id, sent_idx, CAST(unnest(range(len(kw))) AS INTEGER) AS start_idx, unnest(kw) AS word,
           kb || kw || ka AS context, len(kb) AS skip FROM w)
  WHERE word IN {WORD_LIST}),
ctx AS (SELECT corpus_id, sent_idx, start_idx, word, context, CAST(skip + start_idx AS INTEGER) AS position FROM c)"""


def sql_start(p: str) -> str:
    return (
        f"CASE WHEN {p} >= 0 AND {p} < len(context) THEN coalesce(list_max([i FOR i IN range(len(context)) "
        f"IF i <= {p} AND context[i + 1] IN ('.', '!', '?')]), -1) + 1 ELSE {p} + 1 END"
    )


def sql_end(p: str) -> str:
    return (
        f"coalesce(list_min([i FOR i IN range(len(context)) IF i >= {p} AND context[i + 1] IN ('.', '!', '?')]), "
        f"greatest(len(context), {p}))"
    )


BOUNDS = f"""b1 AS (SELECT *, {sql_start('position')} AS bos, {sql_end('position')} AS eos FROM ctx),
b2 AS (SELECT *, {sql_start('(bos - 2)')} AS first, {sql_end('(eos + 1)')} AS last FROM b1)"""
SNIPPETS = """sn AS (
  SELECT corpus_id, sent_idx, start_idx, word,
    replace(replace(replace(replace(replace(
      array_to_string([CASE WHEN i = position THEN '[[' || context[i + 1] || ']]' ELSE context[i + 1] END
                       FOR i IN range(greatest(first, 0), least(last + 1, len(context)))], ' '),
      '< p >', ''), '/ /', ''), '& lt ;', '<'), '& gt ;', '>'), '  ', ' ') AS text
  FROM b2)"""


def with_parts(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
