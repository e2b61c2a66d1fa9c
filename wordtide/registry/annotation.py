"""Annotation sets: sampled snippets, usage pairs, control pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.functions.periods import period
from wordtide.operators import hits as H, pairs as A
from wordtide.registry.common import BINS, BOUNDS, CONTEXTS, PERIODS, SENTENCES, SNIPPETS, WORDS, documents, with_parts, year_of
from wordtide.session import cut_lineage, new_path
from wordtide.sources import readers, writers


def snippet_sample(spark, sf):
    """One snippet per word, cluster and period; clusters are ids modulo 7."""
    contexts = H.hit_contexts(documents(spark, sf), WORDS)
    usages = contexts.select(
        "word",
        (F.col("corpus_id") % 7).cast("int").alias("cluster"),
        period(year_of("corpus_id")).alias("period"),
        F.concat_ws("-", "corpus_id", "sent_idx", "start_idx").alias("usage_id"),
        "context",
        "position",
    )
    return A.sample_snippets(A.prepare_snippets(usages), PERIODS)


def _sheet(spark, name, pairs, control=False):
    """The pairs after a trip through a tab-separated sheet."""
    path = new_path(spark, name)
    writers.pair_sheet(pairs, path, control)
    return readers.pair_sheet(spark, path, control)


def usage_pairs(spark, sf):
    return _sheet(spark, "pairs", A.usage_pairs(cut_lineage(snippet_sample(spark, sf))))


def pair_counts(spark, sf):
    pairs = A.usage_pairs(cut_lineage(snippet_sample(spark, sf)))
    return pairs.groupBy("lemma").agg(F.count("*").alias("n"))


def control_pairs(spark, sf):
    sampled = cut_lineage(snippet_sample(spark, sf))
    return _sheet(spark, "control", A.control_pairs(sampled, pairs_per_usage=2), control=True)


QUERIES = {f.__name__: f for f in [snippet_sample, usage_pairs, pair_counts, control_pairs]}

_SAMPLE = """x AS (
  SELECT word, CAST(corpus_id % 7 AS INTEGER) AS cluster, period, text,
         corpus_id || '-' || sent_idx || '-' || start_idx AS sid
  FROM sn LEFT JOIN bins ON 1950 + corpus_id % 73 > lo AND 1950 + corpus_id % 73 <= hi),
own AS MATERIALIZED (SELECT word, cluster, period, text, min(md5('42-' || sid) || sid) AS k FROM x GROUP BY ALL),
ce AS MATERIALIZED (
  SELECT cl.word, cl.cluster, b.period, row_number() OVER (PARTITION BY cl.word ORDER BY
           (SELECT count(*) FROM own o WHERE o.word = cl.word AND o.cluster = cl.cluster AND o.period = b.period),
           md5('42-' || cl.word || '-' || cl.cluster || '-' || b.period), cl.cluster, b.period) AS turn
  FROM (SELECT DISTINCT word, cluster FROM x) cl CROSS JOIN bins b),
mo AS MATERIALIZED (SELECT word, count(*) AS most FROM ce GROUP BY word),
cand AS MATERIALIZED (
  SELECT ce.word, turn AS step, turn, text, k FROM ce JOIN own USING (word, cluster, period)
  UNION ALL
  SELECT ce.word, most + turn, turn, text, k FROM ce JOIN mo USING (word)
    JOIN (SELECT word, cluster, text, min(k) AS k FROM own GROUP BY ALL) USING (word, cluster)
    QUALIFY row_number() OVER (PARTITION BY ce.word, turn ORDER BY k) <= 2 * most
  UNION ALL
  SELECT ce.word, 2 * most + turn, turn, text, k FROM ce JOIN mo USING (word)
    JOIN (SELECT word, text, min(k) AS k FROM own GROUP BY ALL) USING (word)
    QUALIFY row_number() OVER (PARTITION BY ce.word, turn ORDER BY k) <= 2 * most),
st AS (
  SELECT word, most, CAST(0 AS BIGINT) AS step, []::VARCHAR[] AS used, []::BIGINT[] AS done, NULL::VARCHAR AS pick, NULL::BIGINT AS turn
  FROM mo
  UNION ALL
  SELECT word, most, step, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END,
         CASE WHEN pick IS NULL THEN done ELSE list_append(done, turn) END, pick, turn
  FROM (SELECT s.word, s.most, s.step + 1 AS step, s.used, s.done,
               arg_min(c.text, c.k) FILTER (NOT list_contains(s.used, c.text) AND NOT list_contains(s.done, c.turn)) AS pick,
               min(c.turn) AS turn
        FROM st s LEFT JOIN cand c ON c.word = s.word AND c.step = s.step + 1 WHERE s.step < 3 * s.most
        GROUP BY s.word, s.most, s.step, s.used, s.done)),
sm AS (
  SELECT ce.word, CAST(row_number() OVER (PARTITION BY ce.word ORDER BY cluster, period) - 1 AS INTEGER) AS id, cluster, period, pick AS text
  FROM st JOIN ce ON ce.word = st.word AND ce.turn = st.turn WHERE pick IS NOT NULL)"""
_PARTS = with_parts(SENTENCES, CONTEXTS, BOUNDS, SNIPPETS, BINS, _SAMPLE).replace("WITH ", "WITH RECURSIVE ", 1)
_NUMBER = "CAST('0x' || substr(md5('42-' || word || '-' || id || '-' || draw || '-{0}'), 1, 15) AS BIGINT) % 2"

ORACLES = {
    "snippet_sample": _PARTS + "SELECT * FROM sm",
    "usage_pairs": _PARTS + """
      SELECT a.word AS lemma, a.id AS id_a, b.id AS id_b, a.cluster AS cluster_a, b.cluster AS cluster_b,
             a.period AS time_a, b.period AS time_b, a.text AS a, b.text AS b
      FROM sm a JOIN sm b ON a.word = b.word AND a.id < b.id""",
    "pair_counts": _PARTS + "SELECT word AS lemma, count(*) * (count(*) - 1) // 2 AS n FROM sm GROUP BY word",
    "control_pairs": _PARTS + f""",
      o AS (SELECT *, row_number() OVER (PARTITION BY word, id ORDER BY md5('42-' || word || '-' || id || '-' || cut)) - 1 AS draw
            FROM (SELECT sm.*, unnest(range(11)) AS cut FROM sm)),
      f AS (SELECT *, {_NUMBER.format('side')} = 1 AS from_start, {_NUMBER.format('order')} = 1 AS swapped,
                   string_split(text, ' ') AS w FROM o WHERE draw < 2),
      t AS (SELECT *, list_min([i FOR i IN range(1, len(w) + 1) IF starts_with(w[i], '[[') AND ends_with(w[i], ']]')]) AS place FROM f),
      k AS (SELECT *, array_to_string(CASE WHEN from_start THEN w[least(cut, place - 1) + 1 : len(w)]
                                           ELSE w[1 : len(w) - least(cut, len(w) - place)] END, ' ') AS copy FROM t)
      SELECT word AS lemma, id AS id_a, id AS id_b, cluster AS cluster_a, cluster AS cluster_b, period AS time_a, period AS time_b,
             CASE WHEN swapped THEN copy ELSE text END AS a, CASE WHEN swapped THEN text ELSE copy END AS b,
             'identical' AS fieldname_gold, '' AS fieldname_gold_reason, 'TRUE' AS _golden FROM k""",
}
