"""What clusterings say: distributions over periods, agreement, prototypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.vectors import squared_distance
from wordtide.operators import blocks as B
from wordtide.operators.ranking import rank_by_number, top_per_group
from wordtide.session import cut_lineage


def usage_distribution(
    labelled: DataFrame, group: Sequence[str] = (), label: str = "cluster", period: str = "period"
) -> DataFrame:
    """group, cluster, period, n for every cluster 0 .. max and every period present."""
    counts = labelled.groupBy(*group, label, period).agg(F.count("*").alias("n"))
    return _filled(counts, group, label, period, F.lit(0))


def soft_usage_distribution(
    soft: DataFrame, group: Sequence[str] = (), probabilities: str = "prob", period: str = "period"
) -> DataFrame:
    """The same from one probability per cluster and row: sums instead of counts."""
    exploded = soft.select(*group, period, F.posexplode(probabilities).alias("cluster", "_p"))
    sums = exploded.groupBy(*group, "cluster", period).agg(F.sum("_p").alias("n"))
    return _filled(sums, group, "cluster", period, F.lit(0.0))


def _filled(counts: DataFrame, group: Sequence[str], label: str, period: str, zero: Column) -> DataFrame:
    """Every cell of a group's grid; the cells come from the counts, not from the data."""
    counts = cut_lineage(counts)
    edges = counts.groupBy(*group).agg(F.max(label).alias("_top"), F.collect_set(period).alias("_periods"))
    grid = edges.select(*group, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias(label), "_periods").select(
        *group, label, F.explode("_periods").alias(period)
    )
    return grid.join(counts, [*group, label, period], "left").select(
        *group, label, period, F.coalesce("n", zero).alias("n")
    )


def normalized(distribution: DataFrame, group: Sequence[str] = (), period: str = "period") -> DataFrame:
    """Adds share: n over the sum of its period, 0 where that is 0."""
    total = F.sum("n").over(W.partitionBy(*group, period))
    return distribution.withColumn("share", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def clustering_intersection(labelled: DataFrame, labels: Sequence[str], id_col: str = "usage_id") -> DataFrame:
    """id, meta_label: equal exactly where all the clusterings put rows together.

    Meta labels number the tuples of labels in the order of their smallest id,
    so only one row per tuple is ranked.
    """
    key = F.to_json(F.struct(*[F.col(c) for c in labels]), {"ignoreNullFields": "false"})  # nulls are a label, too
    named = labelled.select(id_col, key.alias("_tuple"))
    tuples = named.groupBy("_tuple").agg(F.min(id_col).alias("_first"))
    ranked = rank_by_number(cut_lineage(tuples), "_first", "meta_label").select("_tuple", "meta_label")
    return B.attach_small(named, ranked, ["_tuple"], [id_col]).select(id_col, "meta_label")


def pair_agreement(labelled: DataFrame, labels: Sequence[str]) -> DataFrame:
    """agreement: share of ordered pairs together in all clusterings or apart in all.

    Pairs are counted, not made: for each subset of the clusterings the number of
    pairs together in it follows from group sizes, and the pairs apart in all of
    them from inclusion and exclusion over the subsets.
    """
    sizes = labelled.groupBy(*labels).agg(F.count("*").alias("_n"))
    subset = F.grouping_id()
    grouped = sizes.cube(*labels).agg(F.sum("_n").alias("_n"), subset.alias("_left_out"))
    pairs = (F.col("_n") * (F.col("_n") - 1)).cast("double")
    # A set bit means the clustering is left out of the subset.
    kept = F.lit(len(labels)) - F.bit_count("_left_out")
    sign = F.when(kept % 2 == 0, 1.0).otherwise(-1.0)
    together = F.sum(F.when(F.col("_left_out") == 0, pairs).otherwise(0.0))
    apart = F.sum(sign * pairs)
    every = F.sum(F.when(kept == 0, pairs).otherwise(0.0))
    return grouped.agg(F.try_divide(together + apart, every).alias("agreement"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, keys: Sequence[str] = ("word",)) -> DataFrame:
    """usage columns, cluster, distance: the nearest of the centroids of the point's word.

    Centroids (keys, cluster, centroid) are packed to one row per word first.
    """
    packed = centroids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_all"))
    joined = B.attach_small(points, packed, keys, ["usage_id"])
    gaps = F.transform(
        "_all", lambda c: F.struct(squared_distance(F.col("vector"), c["centroid"]).alias("gap"), c["cluster"].alias("cluster"))
    )
    return (
        joined.withColumn("_best", F.array_min(gaps))
        .withColumns({"cluster": F.col("_best.cluster"), "distance": F.sqrt("_best.gap")})
        .drop("_all", "_best")
    )


def nearest_members(
    assigned: DataFrame, group: Sequence[str] = ("word", "cluster"), n: int = 5, farthest: bool = False
) -> DataFrame:
    """group, usage_id, rank: the n members nearest to the centroid of each cluster.

    assigned: group, usage_id, distance.
    """
    order = F.col("distance").desc() if farthest else F.col("distance").asc()
    members = assigned.select(*group, "usage_id", "distance")
    return top_per_group(members, group, [order, F.col("usage_id")], n, ["usage_id"]).drop("distance")


def prototypes(
    members: DataFrame, contexts: DataFrame, group: Sequence[str] = ("word", "cluster"), window: int = 10
) -> DataFrame:
    """group, rank, text: the chosen members as text; a text shows once per cluster.

    contexts: usage_id, context (tokens), position, at least of the members.
    """
    shown = members.join(contexts, "usage_id").withColumn(
        "text", T.context_window(F.col("context"), F.col("position"), window)
    )
    return shown.groupBy(*group, "text").agg(F.min("rank").alias("rank")).select(*group, "rank", "text")


def code_by_first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, code: values numbered by where they first appear."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    return rank_by_number(first, "_first", "code").select(column, "code")


def labels_of_members(clusters: DataFrame, k: int, layer: int) -> DataFrame:
    """uid, cluster_id from stored clusters of one k and layer."""
    chosen = clusters.where((F.col("k_clusters") == k) & (F.col("layer") == layer))
    return chosen.select(F.explode("sentence_uids").alias("bnc_index"), F.col("cluster_id").cast("string"))


def join_clusters(occurrences: DataFrame, members: DataFrame, key: str = "bnc_index") -> DataFrame:
    """Full outer join: occurrences without cluster and members without occurrence stay."""
    return occurrences.join(members, key, "full_outer")


def relabel(df: DataFrame, key: str, value, column: str, label: str = "Target") -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) == F.lit(value), F.lit(label)).otherwise(F.col(column)))


def append_example(df: DataFrame, word: str, template: str = "That man is like a %s.") -> DataFrame:
    """The table plus one made-up occurrence of the word in the template sentence."""
    row = df.sparkSession.range(1).select(
        F.lit(f"{word}(_man_is_a)").alias("word"), F.format_string(template, F.lit(word)).alias("sentence")
    )
    return df.unionByName(row, allowMissingColumns=True)


def merge_stores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Usages of both stores; a word missing in one of them comes from the other."""
    return old.unionByName(new)


def period_labels(period: Column, labels: dict | None) -> Column:
    """Label of a period code; the code itself without a map."""
    if not labels:
        return period.cast("string")
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.create_map(*pairs)[period]
