"""Hits, counts over time, shares, collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.periods import decade, period
from wordtide.operators import colloc, hits as H, profile as P
from wordtide.operators.pairs import with_snippets
from wordtide.plans.time_profile import hits_over_time
from wordtide.registry.common import (
    BINS, BOUNDS, CONTEXTS, HITS, SENTENCES, SNIPPETS, TOKENS, WORDS, documents, rounded, table, with_parts, year_of,
)
from wordtide.session import new_path
from wordtide.sources import readers, writers


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return H.collect_hits(documents(spark, sf), WORDS)


def hits_per_period(spark, sf):
    return hits_over_time(documents(spark, sf), WORDS, "doc_id", "text", year_of("doc_id"))


def hits_roundtrip(spark, sf):
    path = new_path(spark, "hits")
    writers.hits_by_word(_hits(spark, sf), path)
    return readers.token_hits(spark, path, ["the", "and"])


def first_occurrence(spark, sf):
    sentences = H.sentence_table(documents(spark, sf)).withColumn("words", T.tokens(F.col("sentence")))
    tags = F.transform("words", lambda w: F.length(w).cast("string"))
    return sentences.select(
        "corpus_id",
        "sent_idx",
        T.first_position(F.col("words"), "the").cast("double").alias("first_pos"),
        T.tag_of_first(F.col("words"), tags, "the").alias("tag"),
    )


def kwic(spark, sf):
    contexts = H.hit_contexts(documents(spark, sf), WORDS)
    return contexts.select(
        "corpus_id", "sent_idx", "start_idx", "word", T.context_window(F.col("context"), F.col("position")).alias("text")
    )


def sentence_bounds(spark, sf):
    contexts = H.hit_contexts(documents(spark, sf), WORDS)
    words, at = F.col("context"), F.col("position")
    return contexts.select(
        "corpus_id",
        "sent_idx",
        "start_idx",
        T.sentence_start(words, at).cast("long").alias("bos"),
        T.sentence_end(words, at).cast("long").alias("eos"),
    )


def snippet(spark, sf):
    contexts = H.hit_contexts(documents(spark, sf), WORDS)
    return with_snippets(contexts).select("corpus_id", "sent_idx", "start_idx", "word", "text")


def trim_snippet(spark, sf):
    offset = ((F.col("corpus_id") + F.col("start_idx")) % 11).cast("int")
    trimmed = T.trim_around_target(F.col("text"), offset, F.col("sent_idx") % 2 == 0)
    return kwic(spark, sf).select("corpus_id", "sent_idx", "start_idx", trimmed.alias("text"))


def dependents_joined(spark, sf):
    """Words left and right of the hit in its sentence, joined by hyphens."""
    found = _hits(spark, sf).withColumn("words", T.tokens(F.col("sentence")))
    left = F.slice("words", F.lit(1), F.col("start_idx"))
    right = F.slice("words", F.col("start_idx") + 2, F.size("words"))
    return found.select(
        "corpus_id",
        "sent_idx",
        "start_idx",
        F.array_join(left, "-").alias("token_lefts"),
        F.array_join(right, "-").alias("token_rights"),
    )


def _profile(spark, sf):
    """Hits of `the` with year and, where the paper is labelled, a part of speech."""
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    found = H.collect_hits(docs, ["the"]).select("corpus_id", "sent_idx", "start_idx")
    attributes = labels.select(
        F.col("doc_id").alias("corpus_id"), F.when(F.col("quality") == 1, "NOUN").otherwise("VERB").alias("token_pos")
    )
    dated = H.attach_year(found, docs, "doc_id", year_of("doc_id"))
    return H.annotate(dated, attributes, ["corpus_id"])


def attr_shares(spark, sf):
    return P.shares(P.attribute_counts(_profile(spark, sf), "year", "token_pos"))


def attr_pivot_year(spark, sf):
    return P.pivot_shares(attr_shares(spark, sf), "year", "token_pos", ["NOUN", "VERB"])


def attr_pivot_binned(spark, sf):
    binned = _profile(spark, sf).withColumn("period", period(F.col("year")))
    counted = P.shares(P.binned_attribute_counts(binned, "period", "token_pos"))
    return P.pivot_shares(counted, "period", "token_pos", ["NOUN", "VERB"], binned=True)


def nominal_shares(spark, sf):
    """Shares of source among hits that are no verbs; hits without part of speech stay."""
    sources = documents(spark, sf).select(F.col("doc_id").alias("corpus_id"), F.col("lang").alias("token_dep"))
    kept = _profile(spark, sf).where(~F.col("token_pos").eqNullSafe("VERB"))
    return P.shares(P.attribute_counts(H.annotate(kept, sources, ["corpus_id"]), "year", "token_dep"))


def attr_roundtrip(spark, sf):
    """Attributes with quotes, commas and line ends in their texts."""
    path = new_path(spark, "attributes")
    odd = F.array(*[F.lit(x) for x in ('"', 'say "hi", you', "a\nb", "c\\d", " e ")])
    writers.csv_table(_profile(spark, sf).withColumn("token_text", F.get(odd, F.col("start_idx") % 5)), path)
    schema = "corpus_id long, sent_idx int, start_idx int, year int, token_pos string, token_text string"
    return readers.feature_vectors(spark, path, schema)


def decade_counts(spark, sf):
    dated = table(spark, sf, "documents").select(decade(year_of("doc_id")).alias("decade"))
    return dated.groupBy("decade").agg(F.count("*").alias("n"))


def period_bins(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", year_of("doc_id").alias("year"), period(year_of("doc_id")).alias("period")
    )


def distinct_values(spark, sf):
    return P.distinct_values(table(spark, sf, "documents"), "lang")


def year_range(spark, sf):
    return P.year_range(table(spark, sf, "documents").select(year_of("doc_id").alias("year")))


def year_histogram(spark, sf):
    dated = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return P.year_histogram(dated).select("bin", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "n")


def text_concat(spark, sf):
    return P.joined_text_offsets(H.sentence_table(documents(spark, sf))).select("corpus_id", "sent_idx", "char_start")


def bigram_counts(spark, sf):
    counts = colloc.ngram_counts(colloc.ngrams_of_texts(documents(spark, sf), 2))
    return colloc.frequent(counts, 3, colloc.without(["the"]))


def bigram_counts_across(spark, sf):
    stream = colloc.ngrams_of_stream(H.sentence_table(documents(spark, sf)), 2, across_docs=True)
    return colloc.frequent(colloc.ngram_counts(stream), 3, colloc.without(["the"]))


def trigram_counts(spark, sf):
    # In slices for counting; repeated ids spread by their texts.
    docs = colloc.in_slices(table(spark, sf, "documents"), ["doc_id", "text"])
    return colloc.frequent(colloc.ngram_counts(colloc.ngrams_of_texts(docs, 3)), 3)


def bigram_llr(spark, sf):
    bigrams = colloc.ngrams_of_texts(documents(spark, sf), 2)
    best = colloc.best(colloc.likelihood_ratio(bigrams, 3, colloc.without(["the"])), 40)
    return best.select("w1", "w2", "n", rounded(F.col("llr"), 4).alias("llr"))


QUERIES = {
    f.__name__: f
    for f in [
        hits_per_period, hits_roundtrip, first_occurrence, kwic, sentence_bounds, snippet, trim_snippet,
        dependents_joined, attr_shares, attr_pivot_year, attr_pivot_binned, nominal_shares, attr_roundtrip,
        decade_counts, period_bins, distinct_values, year_range, year_histogram, text_concat, bigram_counts,
        bigram_counts_across, trigram_counts, bigram_llr,
    ]
}

_KWIC = """kw AS (
  SELECT corpus_id, sent_idx, start_idx, word,
    array_to_string([CASE WHEN i = position THEN '[[' || context[i + 1] || ']]' ELSE context[i + 1] END
                     FOR i IN range(greatest(position - 10, 0), least(position + 11, len(context)))], ' ') AS text
  FROM ctx)"""
_PROFILE = """p AS (
  SELECT t.doc_id AS corpus_id, sent_idx, pos AS start_idx, CAST(1950 + t.doc_id % 73 AS INTEGER) AS year,
         CASE WHEN quality = 1 THEN 'NOUN' WHEN l.doc_id IS NOT NULL THEN 'VERB' END AS token_pos
  FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id WHERE tok = 'the')"""
_SHARES = """sh AS (
  SELECT year, token_pos, n, total, round_even(n / total * 100, 0) / 100 AS proportion FROM (
    SELECT year, token_pos, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY year) AS BIGINT) AS total
    FROM p GROUP BY year, token_pos)
  WHERE token_pos IS NOT NULL)"""
_STREAM = """st AS (
  SELECT doc_id, tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY sent_idx, pos) AS w2,
         lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY sent_idx, pos) AS w3 FROM t)"""

ORACLES = {
    "hits_per_period": with_parts(SENTENCES, TOKENS, HITS, BINS) + """
      SELECT w.word, b.period, count(h.corpus_id) AS n
      FROM bins b CROSS JOIN (VALUES ('the'), ('de'), ('and')) w(word)
      LEFT JOIN hits h ON h.word = w.word AND 1950 + h.corpus_id % 73 > b.lo AND 1950 + h.corpus_id % 73 <= b.hi
      GROUP BY w.word, b.period""",
    "hits_roundtrip": with_parts(SENTENCES, TOKENS, HITS) + """
      SELECT corpus_id, sentence, start_idx, end_idx, word FROM hits WHERE word IN ('the', 'and')""",
    "first_occurrence": with_parts(SENTENCES) + r"""
      SELECT doc_id AS corpus_id, sent_idx,
             CASE WHEN coalesce(list_position(k, 'the'), 0) > 0 THEN CAST(list_position(k, 'the') - 1 AS DOUBLE) END AS first_pos,
             CASE WHEN coalesce(list_position(k, 'the'), 0) > 0 THEN '3' ELSE 'X' END AS tag
      FROM (SELECT doc_id, sent_idx, regexp_extract_all(sentence, '\p{L}+|\d+|[^\s\p{L}\d]') AS k FROM s)""",
    "kwic": with_parts(SENTENCES, CONTEXTS, _KWIC) + "SELECT * FROM kw",
    "sentence_bounds": with_parts(SENTENCES, CONTEXTS, BOUNDS)
    + "SELECT corpus_id, sent_idx, start_idx, CAST(bos AS BIGINT) AS bos, CAST(eos AS BIGINT) AS eos FROM b2",
    "snippet": with_parts(SENTENCES, CONTEXTS, BOUNDS, SNIPPETS) + "SELECT * FROM sn",
    "trim_snippet": with_parts(SENTENCES, CONTEXTS, _KWIC) + """,
      q AS (SELECT *, string_split(text, ' ') AS a, (corpus_id + start_idx) % 11 AS cut FROM kw),
      r AS (SELECT *, list_position(a, '[[' || word || ']]') AS place FROM q)
      SELECT corpus_id, sent_idx, start_idx,
        array_to_string(CASE WHEN sent_idx % 2 = 0 THEN a[least(cut, place - 1) + 1 : len(a)]
                             ELSE a[1 : len(a) - least(cut, len(a) - place)] END, ' ') AS text
      FROM r""",
    "dependents_joined": with_parts(SENTENCES, TOKENS, HITS) + r"""
      SELECT corpus_id, sent_idx, start_idx,
             array_to_string(k[1:start_idx], '-') AS token_lefts, array_to_string(k[start_idx + 2:], '-') AS token_rights
      FROM (SELECT *, regexp_extract_all(sentence, '\p{L}+|\d+|[^\s\p{L}\d]') AS k FROM hits)""",
    "attr_shares": with_parts(SENTENCES, TOKENS, _PROFILE, _SHARES) + "SELECT * FROM sh",
    "attr_pivot_year": with_parts(SENTENCES, TOKENS, _PROFILE, _SHARES) + """
      SELECT year, sum(proportion) FILTER (token_pos = 'NOUN') AS "NOUN", sum(proportion) FILTER (token_pos = 'VERB') AS "VERB"
      FROM sh GROUP BY year""",
    "attr_pivot_binned": with_parts(SENTENCES, TOKENS, _PROFILE, BINS) + """
      SELECT period, round_even(coalesce(noun / nullif(total, 0), 0) * 100, 0) / 100 AS "NOUN",
             round_even(coalesce(verb / nullif(total, 0), 0) * 100, 0) / 100 AS "VERB"
      FROM (SELECT b.period, count(p.corpus_id) AS total, count(*) FILTER (token_pos = 'NOUN') AS noun,
                   count(*) FILTER (token_pos = 'VERB') AS verb
            FROM bins b LEFT JOIN p ON p.year > b.lo AND p.year <= b.hi GROUP BY b.period)""",
    "nominal_shares": with_parts(SENTENCES, TOKENS, _PROFILE) + """
      SELECT year, token_dep, n, total, round_even(n / total * 100, 0) / 100 AS proportion FROM (
        SELECT year, lang AS token_dep, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY year) AS BIGINT) AS total
        FROM p JOIN documents d ON d.doc_id = p.corpus_id
        WHERE token_pos IS DISTINCT FROM 'VERB' GROUP BY year, lang)""",
    "attr_roundtrip": with_parts(SENTENCES, TOKENS, _PROFILE) + """
      SELECT *, ['"', 'say "hi", you', 'a' || chr(10) || 'b', 'c' || chr(92) || 'd', ' e '][start_idx % 5 + 1] AS token_text FROM p""",
    "decade_counts": """
      SELECT CAST((1950 + doc_id % 73) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM documents GROUP BY 1""",
    "period_bins": with_parts(BINS) + """
      SELECT doc_id, CAST(1950 + doc_id % 73 AS INTEGER) AS year, period
      FROM documents LEFT JOIN bins ON 1950 + doc_id % 73 > lo AND 1950 + doc_id % 73 <= hi""",
    "distinct_values": "SELECT DISTINCT lang FROM documents",
    "year_range": """
      SELECT CAST(min(1950 + doc_id % 73) AS INTEGER) AS min_year, CAST(max(1950 + doc_id % 73) AS INTEGER) AS max_year,
             count(*) AS n_rows FROM documents""",
    "year_histogram": """
      WITH y AS (SELECT year(o_orderdate) AS y FROM orders),
      r AS (SELECT min(y) AS lo, (max(y) - min(y)) / 10 AS w FROM y)
      SELECT b AS bin, round(lo + b * w, 6) AS lo, round(lo + b * w + w, 6) AS hi, count(y) AS n
      FROM (SELECT unnest(range(10)) AS b) CROSS JOIN r LEFT JOIN y ON least(floor((y - r.lo) / r.w), 9) = b GROUP BY ALL""",
    "text_concat": with_parts(SENTENCES) + """
      SELECT doc_id AS corpus_id, sent_idx, CAST(sum(length(sentence) + 1) OVER (ORDER BY doc_id, sent_idx)
             - length(sentence) - 1 AS BIGINT) AS char_start FROM s""",
    "bigram_counts": with_parts(SENTENCES, TOKENS, _STREAM) + """
      SELECT w1, w2, count(*) AS n FROM st WHERE w2 IS NOT NULL AND (w1 = 'the' OR w2 = 'the')
      GROUP BY w1, w2 HAVING count(*) >= 3""",
    "bigram_counts_across": with_parts(SENTENCES, TOKENS) + """, q AS (
        SELECT tok AS w1, lead(tok) OVER (ORDER BY doc_id, sent_idx, pos) AS w2 FROM t)
      SELECT w1, w2, count(*) AS n FROM q WHERE w2 IS NOT NULL AND (w1 = 'the' OR w2 = 'the')
      GROUP BY w1, w2 HAVING count(*) >= 3""",
    "trigram_counts": with_parts(SENTENCES, TOKENS, _STREAM) + """
      SELECT w1, w2, w3, count(*) AS n FROM st WHERE w3 IS NOT NULL GROUP BY w1, w2, w3 HAVING count(*) >= 3""",
    "bigram_llr": with_parts(SENTENCES, TOKENS, _STREAM) + """,
      uni AS (SELECT tok, count(*) AS n FROM t GROUP BY tok),
      big AS (SELECT w1, w2, count(*) AS n FROM st WHERE w2 IS NOT NULL AND (w1 = 'the' OR w2 = 'the')
              GROUP BY w1, w2 HAVING count(*) >= 3),
      o AS (SELECT w1, w2, big.n, CAST(big.n AS DOUBLE) AS a, CAST(u2.n - big.n AS DOUBLE) AS b,
                   CAST(u1.n - big.n AS DOUBLE) AS c, CAST(g.n - u1.n - u2.n + big.n AS DOUBLE) AS d, CAST(g.n AS DOUBLE) AS g
            FROM big JOIN uni u1 ON u1.tok = w1 JOIN uni u2 ON u2.tok = w2, (SELECT sum(n) AS n FROM uni) g)
      SELECT w1, w2, n, round(llr, 4) AS llr FROM (
        SELECT w1, w2, n, 2 * (a * ln(a / ((a + b) * (a + c) / g + 1e-20) + 1e-20)
                             + b * ln(b / ((a + b) * (b + d) / g + 1e-20) + 1e-20)
                             + c * ln(c / ((c + d) * (a + c) / g + 1e-20) + 1e-20)
                             + d * ln(d / ((c + d) * (b + d) / g + 1e-20) + 1e-20)) AS llr FROM o)
      ORDER BY llr DESC, w1, w2 LIMIT 40""",
}
