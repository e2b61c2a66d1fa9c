"""Samples, shuffles and gates."""

from __future__ import annotations

from wordtide.functions.periods import period
from wordtide.operators import hits as H, sampling as S
from wordtide.operators.ranking import hash_order, rank_by_hash
from wordtide.registry.common import BINS, SENTENCES, TOKENS, documents, table, with_parts, year_of
from wordtide.session import cut_lineage

GATE_WORDS = ["the", "de", "and", "under", "hahahe", "model"]


def _dated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", period(year_of("doc_id")).alias("period"))


def sample_n(spark, sf):
    return S.sample_n(table(spark, sf, "documents").select("doc_id", "source"), 200, ["doc_id"])


def sample_per_period(spark, sf):
    return S.sample_per_group(_dated(spark, sf), ["period"], 5, ["doc_id"])


def sample_replace(spark, sf):
    return S.draw_with_replacement(_dated(spark, sf), "period", "doc_id", n=10)


def sample_fraction(spark, sf):
    return S.draw_with_replacement(_dated(spark, sf), "period", "doc_id", fraction=0.1)


def shuffle(spark, sf):
    """Place of each document in the shuffled order."""
    keyed = table(spark, sf, "documents").select("doc_id", hash_order("doc_id").alias("_hash"))
    return rank_by_hash(keyed, [], "_hash", ["doc_id"], "place").select("doc_id", "place")


def min_size_gate(spark, sf):
    found = H.collect_hits(documents(spark, sf), GATE_WORDS).select("word", "corpus_id", "sent_idx", "start_idx")
    # Written once, as the gate reads it twice and the text should be searched once.
    return S.gated_sample(cut_lineage(found), "word", ["corpus_id", "sent_idx", "start_idx"])


QUERIES = {f.__name__: f for f in [sample_n, sample_per_period, sample_replace, sample_fraction, shuffle, min_size_gate]}

_DATED = """d AS (
  SELECT doc_id, period FROM documents JOIN bins ON 1950 + doc_id % 73 > lo AND 1950 + doc_id % 73 <= hi),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY md5('42-' || doc_id), doc_id) - 1 AS rank FROM d),
z AS (SELECT period, count(*) AS size FROM d GROUP BY period)"""
_PICK = "CAST('0x' || substr(md5('42-' || period || '-' || draw), 1, 15) AS BIGINT) % size"

ORACLES = {
    "sample_n": "SELECT doc_id, source FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 200",
    "sample_per_period": with_parts(BINS, _DATED) + "SELECT doc_id, period FROM r WHERE rank < 5",
    "sample_replace": with_parts(BINS, _DATED) + f"""
      SELECT w.period, draw, r.doc_id FROM (
        SELECT period, draw, {_PICK} AS pick FROM z, (SELECT unnest(range(10)) AS draw)) w
      JOIN r ON r.period = w.period AND r.rank = w.pick""",
    "sample_fraction": with_parts(BINS, _DATED) + f"""
      SELECT w.period, draw, r.doc_id FROM (
        SELECT period, draw, {_PICK} AS pick
        FROM (SELECT period, size, unnest(range(CAST(round_even(size * 0.1::DOUBLE, 0) AS BIGINT))) AS draw FROM z)) w
      JOIN r ON r.period = w.period AND r.rank = w.pick""",
    "shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) - 1 AS place FROM documents",
    "min_size_gate": with_parts(SENTENCES, TOKENS) + """, g AS (
        SELECT tok AS word, doc_id AS corpus_id, sent_idx, pos AS start_idx,
               count(*) OVER (PARTITION BY tok) AS size,
               row_number() OVER (PARTITION BY tok ORDER BY md5('42-' || doc_id || '-' || sent_idx || '-' || pos), doc_id, sent_idx, pos) AS rank
        FROM t WHERE tok IN ('the', 'de', 'and', 'under', 'hahahe', 'model'))
      SELECT word, corpus_id, sent_idx, start_idx FROM g WHERE size > 100 AND rank <= 200""",
}
