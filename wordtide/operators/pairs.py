"""Snippets for annotation: one per cluster and period, their pairs, control pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators.blocks import attach_small, fits_broadcast
from wordtide.operators.ranking import hash_order, top_per_group
from wordtide.operators.sampling import hash_number
from wordtide.operators.usage import period_labels
from wordtide.session import cut_lineage

# Words that an annotation set may leave out.
EXCLUDED_WORDS = ("address", "mean")
# Up to so many chosen ids travel as a list that Spark tests before anything else.
FEW_IDS = 10_000


def with_snippets(usages: DataFrame, affixation: bool = False, min_context: int | None = None) -> DataFrame:
    """Adds `text`, the snippet of each usage's context; usages without one go.

    The test comes before the text is made. The edges are a column of their own:
    they are used several times.
    """
    words, position = F.col("context"), F.col("position")
    return (
        usages.where(T.snippet_wanted(words, position, affixation, min_context))
        .withColumn("_edge", T.snippet_edges(words, position))
        .withColumn("text", T.snippet_text(words, position, F.col("_edge")))
        .drop("_edge")
    )


def prepare_snippets(
    usages: DataFrame,
    labels: dict | None = None,
    affixation: bool = False,
    excluded: Sequence[str] = (),
    min_context: int | None = None,
) -> DataFrame:
    """word, cluster, period, snippet_id, text from usages with context and position.

    Usages: word, cluster, period, usage_id, context, position. Words in `excluded`
    are left out, and usages with fewer than `min_context` tokens.
    """
    kept = usages.where(~F.col("word").isin(list(excluded)))
    return with_snippets(kept, affixation, min_context).select(
        "word",
        "cluster",
        period_labels(F.col("period"), labels).alias("period"),
        F.col("usage_id").alias("snippet_id"),
        "text",
    )


def sample_snippets(snippets: DataFrame, periods: Sequence[str], seed: int = 42) -> DataFrame:
    """One unused snippet for every cluster of a word and every asked period.

    A text is used once per word. Cells choose in turn, those with fewer texts of their own first,
    then by hash: each takes the first text of its own, in hash order, that no earlier cell took.
    Cells left over choose in the same turn among what their cluster has left, in any period, then
    among what the word has left. The cell keeps its cluster and period, and stays out when the
    word has no text left. Columns: word, id, cluster, period, text.

    All words choose at once, by rounds of claims on digests: every cell claims its next text, a
    text keeps the claimant whose turn comes first, the others claim again. That ends where
    choosing in turn does. Texts are made for the chosen snippets only.
    """
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    order = F.struct(hash_order("snippet_id", seed=seed).alias("hash"), F.col("snippet_id").alias("snippet_id")).alias("_key")
    keyed = snippets.select("word", "cluster", "period", digest, order)
    texts = cut_lineage(keyed.groupBy("word", "cluster", "period", "digest").agg(F.min("_key").alias("_key")), "texts")
    cells = cut_lineage(_cells(texts, periods, seed), "cells")
    # A word never needs more texts of one cell or cluster than it has cells.
    most = cells.groupBy("word").agg(F.count("*").alias("_most"))
    chosen, used = None, None
    for place in (["word", "cluster", "period"], ["word", "cluster"], ["word"]):
        open_ = cells if chosen is None else cells.join(chosen, ["word", "turn"], "left_anti")
        if open_.isEmpty():
            break
        places = open_.select(place).distinct()
        offered = texts.join(F.broadcast(places) if fits_broadcast(places) else places, place, "left_semi")
        offered = offered.groupBy(*place, "digest").agg(F.min("_key").alias("_key"))
        if used is not None:
            offered = offered.join(F.broadcast(used) if fits_broadcast(used) else used, ["word", "digest"], "left_anti")
        offered = _numbered(offered, most, place)
        won = _claims(open_, offered, place)
        chosen = won if chosen is None else cut_lineage(chosen.unionByName(won), "chosen")
        used = cut_lineage(chosen.select("word", "digest"), "used")
    named = cells.join(chosen, ["word", "turn"])
    wanted = cut_lineage(named.select("word", "cluster", "period", "digest", "snippet_id"), "named")
    key = ["word", "snippet_id", "digest"]
    # By id first: a list of ids is looked up before the texts are made, which a test of the digest needs.
    found = snippets.select("word", "snippet_id", "text")
    small = wanted.select("word", "snippet_id").distinct()
    if wanted.count() <= FEW_IDS:
        found = found.where(F.col("snippet_id").isin([row["snippet_id"] for row in small.select("snippet_id").distinct().collect()]))
    found = found.join(F.broadcast(small) if fits_broadcast(small) else small, ["word", "snippet_id"], "left_semi")
    shown = cut_lineage(found, "shown").withColumn("digest", digest).dropDuplicates(key)
    # At most clusters x periods rows per word.
    number = F.row_number().over(W.partitionBy("word").orderBy("cluster", "period")) - 1
    return wanted.join(shown, key).select("word", number.alias("id"), "cluster", "period", "text")


def _cells(texts: DataFrame, periods: Sequence[str], seed: int) -> DataFrame:
    """word, cluster, period, turn of every cluster and asked period; turns count from 1 in a word."""
    asked = F.explode(F.array_distinct(F.array(*[F.lit(p) for p in periods]))).alias("period")
    every = texts.select("word", "cluster").distinct().select("word", "cluster", asked)
    own = texts.groupBy("word", "cluster", "period").agg(F.count("*").alias("_own"))
    counted = every.join(own, ["word", "cluster", "period"], "left").fillna(0, ["_own"])
    order = ["_own", hash_order("word", "cluster", "period", seed=seed), "cluster", "period"]
    turn = F.row_number().over(W.partitionBy("word").orderBy(*order))
    return counted.select("word", "cluster", "period", turn.alias("turn"))


def _numbered(offered: DataFrame, most: DataFrame, place: list[str]) -> DataFrame:
    """The first texts of each place with their position from 1, as many as the word has cells."""
    bounded = attach_small(offered, most, ["word"], ["digest"])
    first = top_per_group(bounded, place, [F.col("_key")], F.col("_most"), ["digest"], "position")
    return cut_lineage(first.select(*place, "position", "digest", F.col("_key.snippet_id").alias("snippet_id")), "offered")


def _claims(open_: DataFrame, offered: DataFrame, place: list[str]) -> DataFrame:
    """word, turn, digest, snippet_id: what each open cell takes of the texts offered in its place.

    Cells of one place have the same list, so the n-th of them starts at its n-th text: those
    before are taken by the time of its turn.
    """
    start = F.row_number().over(W.partitionBy(*place).orderBy("turn"))
    claims = open_.select(*place, "turn", start.alias("position"))
    while True:
        claimed = cut_lineage(claims.join(offered, [*place, "position"]), "claims")
        first = claimed.groupBy("word", "digest").agg(F.min("turn").alias("_first"))
        judged = cut_lineage(claimed.join(first, ["word", "digest"]), "judged")
        lost = F.col("turn") > F.col("_first")
        if judged.where(lost).isEmpty():
            return claimed.select("word", "turn", "digest", "snippet_id")
        claims = judged.select(*place, "turn", (F.col("position") + lost.cast("int")).alias("position"))


def usage_pairs(sampled: DataFrame) -> DataFrame:
    """All unordered pairs of a word's sampled snippets, in the columns of a pair sheet.

    Input is the annotation sample, ids 0 .. n-1 per word. Each snippet names its
    partners by id and meets them in an equi-join on (word, id), so no task holds
    the pairs of a word together.
    """
    sizes = sampled.groupBy("word").agg(F.count("*").alias("_n"))
    a = sampled.join(sizes, "word").where(F.col("id") + 1 < F.col("_n"))
    a = a.withColumn("id_b", F.explode(F.sequence(F.col("id") + 1, (F.col("_n") - 1).cast("int")))).drop("_n")
    b = sampled.select(
        "word",
        F.col("id").alias("id_b"),
        F.col("cluster").alias("cluster_b"),
        F.col("period").alias("time_b"),
        F.col("text").alias("b"),
    )
    pairs = a.join(b, ["word", "id_b"])
    return pairs.select(
        F.col("word").alias("lemma"),
        F.col("word").alias("lemma_a"),
        F.col("word").alias("lemma_b"),
        F.col("id").alias("id_a"),
        "id_b",
        F.col("cluster").alias("cluster_a"),
        "cluster_b",
        F.col("period").alias("time_a"),
        "time_b",
        F.col("text").alias("a"),
        "b",
    )


def control_pairs(
    sampled: DataFrame, shift: bool = True, pairs_per_usage: int = 1, max_offset: int = 10, seed: int = 42
) -> DataFrame:
    """Each snippet with a copy of itself, shortened at one end when `shift`.

    Copies of a snippet have distinct offsets in 0 .. max_offset; which end is cut
    and which of the two comes first follow from hashes.
    """
    if pairs_per_usage > 1 and not shift:
        raise ValueError(f"Without shift the {pairs_per_usage} pairs of a usage would be identical.")
    if pairs_per_usage > max_offset:
        raise ValueError(f"Only max_offset={max_offset} different pairs per usage can be made.")
    who = [F.lit(str(seed)), F.col("word"), F.col("id")]
    offsets = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(max_offset)),
            lambda o: F.struct(F.md5(F.concat_ws("-", *[w.cast("string") for w in who], o.cast("string"))), o.alias("o")),
        )
    )
    chosen = F.transform(F.slice(offsets, 1, pairs_per_usage), lambda o: o["o"])
    draws = sampled.select("*", F.posexplode(chosen).alias("draw", "offset"))
    from_start = hash_number(*who, F.col("draw"), F.lit("side")) % 2 == 1
    swapped = hash_number(*who, F.col("draw"), F.lit("order")) % 2 == 1
    copy = T.trim_around_target(F.col("text"), F.col("offset"), from_start) if shift else F.col("text")
    made = draws.withColumn("_copy", copy).withColumn("_swapped", swapped)
    return made.select(
        F.col("word").alias("lemma"),
        F.col("word").alias("lemma_a"),
        F.col("word").alias("lemma_b"),
        F.col("id").alias("id_a"),
        F.col("id").alias("id_b"),
        F.col("cluster").alias("cluster_a"),
        F.col("cluster").alias("cluster_b"),
        F.col("period").alias("time_a"),
        F.col("period").alias("time_b"),
        F.when(F.col("_swapped"), F.col("_copy")).otherwise(F.col("text")).alias("a"),
        F.when(F.col("_swapped"), F.col("text")).otherwise(F.col("_copy")).alias("b"),
    )
