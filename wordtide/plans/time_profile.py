"""Hits of words over time, from a corpus with years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from wordtide.functions.periods import PERIOD_BOUNDS
from wordtide.operators import hits as H
from wordtide.operators import profile as P


def hits_over_time(
    papers: DataFrame,
    words: Sequence[str],
    id_col: str,
    text_col: str,
    year: Column,
    bounds: Sequence[int] = PERIOD_BOUNDS,
) -> DataFrame:
    """word, period, n for every word and bin."""
    hits = H.collect_hits(papers, words, id_col, text_col)
    return P.hits_per_period(H.count_by_year(hits, papers, id_col, year), words, bounds)


def attribute_profile(hits: DataFrame, annotations: DataFrame, keys: Sequence[str], time: str, attribute: str) -> DataFrame:
    """time, attribute, n, total, proportion from hits and a table of per-hit attributes."""
    return P.shares(P.attribute_counts(H.annotate(hits, annotations, keys), time, attribute))
