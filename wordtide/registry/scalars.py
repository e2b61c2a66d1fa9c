"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.vectors import columns_of, with_one_hot
from wordtide.operators import hits as H, usage as U
from wordtide.operators.ranking import rank_by_number
from wordtide.registry.common import (
    HITS, SENTENCES, TOKENS, USAGES, WORDS, documents, rounded, table, usages, with_parts, year_of,
)
from wordtide.session import new_path
from wordtide.sources import writers


def text_wrap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.wrap(F.col("text")).alias("wrapped"))


def row_predicates(spark, sf):
    """Documents of one year with words; those marked toxic go, unmarked ones stay."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    kept = joined.where((year_of("doc_id") == 2008) & (F.col("n_chars") > 0) & ~F.col("toxic").eqNullSafe(1))
    return kept.select("doc_id", "n_chars", "lang")


def row_lookup(spark, sf):
    """The row at position 100, the start of its text and its length."""
    docs = table(spark, sf, "documents")
    place = rank_by_number(docs.select("doc_id"), "doc_id", "position").where("position = 100")
    return docs.join(place, "doc_id", "left_semi").select("doc_id", F.substring("text", 1, 1000).alias("start"), F.length("text").alias("n"))


def relabel_row(spark, sf):
    named = usages(spark, sf).select("usage_id", F.col("label").cast("string").alias("cluster"))
    return U.relabel(named, "usage_id", 220, "cluster")


def code_by_first_seen(spark, sf):
    return U.code_by_first_seen(table(spark, sf, "documents"), "source", "doc_id")


def vector_columns(spark, sf):
    points = usages(spark, sf)
    named = points.select("usage_id", F.concat("word", F.col("label")).alias("y"), *columns_of(F.col("vector"), 64))
    return named.select("usage_id", "y", *[rounded(F.col(f"dimension{i}")).alias(f"dimension{i}") for i in range(64)])


def one_hot(spark, sf):
    """The number of classes comes from the labels."""
    points = with_one_hot(usages(spark, sf).select("usage_id", "label"), "label", "hot").select("usage_id", "hot")
    return points.select("usage_id", *[F.get("hot", F.lit(i)).alias(f"c{i}") for i in range(10)])


def label_lookup(spark, sf):
    label = U.period_labels(F.col("toxic"), {0: "clean", 1: "toxic"})
    return table(spark, sf, "labels").select("doc_id", label.alias("label"), U.period_labels(F.col("quality"), None).alias("raw"))


def json_record(spark, sf):
    """Sentence records as JSON, one folder per word, read back by field."""
    path = new_path(spark, "records")
    found = H.collect_hits(documents(spark, sf), WORDS)
    record = F.to_json(F.struct("sentence", F.col("start_idx").alias("pos")))
    writers.json_by_word(found.select("word", "corpus_id", record.alias("label")), path)
    back = spark.read.schema("corpus_id long, label string, word string").json(path)
    fields = F.from_json("label", "sentence string, pos int")
    finished = writers.finished_words(spark, path)
    return back.join(finished, "word", "left_semi").select(
        "word", "corpus_id", fields["sentence"].alias("sentence"), fields["pos"].alias("pos")
    )


def file_stem(spark, sf):
    name = F.concat("source", F.lit("."), "lang", F.lit(".json"))
    return table(spark, sf, "documents").select("doc_id", T.name_before_dot(name).alias("stem"))


def exclude_words(spark, sf):
    found = H.collect_hits(documents(spark, sf), WORDS).where(~F.col("word").isin(["de"]))
    return found.groupBy("word").agg(F.count("*").alias("n"))


def composite_key(spark, sf):
    keyed = usages(spark, sf).select(F.concat("word", F.col("label")).alias("y"))
    return keyed.groupBy("y").agg(F.count("*").alias("n"))


def template_row(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("role").alias("word"), F.col("text").alias("sentence"), F.concat_ws("-", "conv_id", "turn").alias("bnc_index")
    )
    return U.append_example(turns, "model")


def ascii_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ascii_only(F.col("text")).alias("text"))


def short_sentences(spark, sf):
    sentences = H.sentence_table(documents(spark, sf))
    return sentences.where(F.length("sentence") < 150)


QUERIES = {
    f.__name__: f
    for f in [
        text_wrap, row_predicates, row_lookup, relabel_row, code_by_first_seen, vector_columns, one_hot, label_lookup,
        json_record, file_stem, exclude_words, composite_key, template_row, ascii_text, short_sentences,
    ]
}

ORACLES = {
    "text_wrap": r"""
      SELECT doc_id, regexp_replace(regexp_replace(
        rtrim(translate(text, chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '     ')),
        '(.{0,49}\S)(?: +|$)|(\S{50})', '\1\2<br>', 'g'), '<br>$', '') AS wrapped FROM documents""",
    "row_predicates": """
      SELECT d.doc_id, n_chars, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
      WHERE 1950 + d.doc_id % 73 = 2008 AND n_chars > 0 AND toxic IS DISTINCT FROM 1""",
    "row_lookup": """
      SELECT doc_id, substring(text, 1, 1000) AS start, CAST(length(text) AS INTEGER) AS n
      FROM documents ORDER BY doc_id LIMIT 1 OFFSET 100""",
    "relabel_row": "SELECT vec_id AS usage_id, CASE WHEN vec_id = 220 THEN 'Target' ELSE CAST(label AS VARCHAR) END AS cluster FROM embeddings",
    "code_by_first_seen": """
      SELECT source AS source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source""",
    "vector_columns": with_parts(USAGES) + "SELECT usage_id, word || label AS y, "
    + ", ".join(f"round(vector[{i + 1}], 6) + 0.0::DOUBLE AS dimension{i}" for i in range(64)) + " FROM u",
    "one_hot": "SELECT vec_id AS usage_id, "
    + ", ".join(f"CASE WHEN label = {i} THEN 1 ELSE 0 END AS c{i}" for i in range(10)) + " FROM embeddings",
    "label_lookup": """
      SELECT doc_id, CASE toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS label, CAST(quality AS VARCHAR) AS raw FROM labels""",
    "json_record": with_parts(SENTENCES, TOKENS, HITS) + "SELECT word, corpus_id, sentence, start_idx AS pos FROM hits",
    "file_stem": "SELECT doc_id, split_part(source || '.' || lang || '.json', '.', 1) AS stem FROM documents",
    "exclude_words": with_parts(SENTENCES, TOKENS, HITS)
    + "SELECT word, count(*) AS n FROM hits WHERE word NOT IN ('de') GROUP BY word",
    "composite_key": with_parts(USAGES) + "SELECT word || label AS y, count(*) AS n FROM u GROUP BY 1",
    "template_row": """
      SELECT role AS word, text AS sentence, conv_id || '-' || turn AS bnc_index FROM conversations
      UNION ALL SELECT 'model(_man_is_a)', 'That man is like a model.', NULL""",
    "ascii_text": r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents",
    "short_sentences": with_parts(SENTENCES)
    + "SELECT doc_id AS corpus_id, sent_idx, sentence FROM s WHERE length(sentence) < 150",
}
