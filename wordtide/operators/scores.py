"""Scores of clusterings: silhouette, Calinski-Harabasz, information criteria."""

from __future__ import annotations

from collections.abc import Sequence
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.operators import blocks as B
from wordtide.operators.arrays import lists, matrix
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_ROWS = 500


def calinski_harabasz(labelled: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """group, score: (between / (k - 1)) / (within / (n - k)), one pass over the points."""
    group = list(group)
    length2 = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    parts = labelled.groupBy(*group, label).agg(
        F.count("*").alias("_n"),
        F.sum(length2("vector")).alias("_squares"),
        B.sum_arrays("vector").alias("_total"),
    )
    # One row per cluster from here on.
    whole = parts.groupBy(*group).agg(
        F.sum("_n").alias("_n"),
        F.count("*").alias("_k"),
        F.sum("_squares").alias("_squares"),
        F.sum(length2("_total") / F.col("_n")).alias("_explained"),
        B.sum_arrays("_total").alias("_total"),
    )
    n, k = F.col("_n"), F.col("_k")
    between = F.col("_explained") - length2("_total") / n
    within = F.col("_squares") - F.col("_explained")
    ratio = F.try_divide(between * (n - k), within * (k - 1))
    # With no spread inside the clusters the score is 1.
    flat = F.abs(within) <= 1e-12 * F.col("_squares")
    return whole.select(*group, F.when(flat, 1.0).otherwise(ratio).alias("score"))


def squared_silhouette(labelled: DataFrame, group: Sequence[str], label: str = "label", id_col: str = "usage_id") -> DataFrame:
    """group, score: mean silhouette by squared Euclidean distances, linear in the points.

    Another measure than `silhouette`, in the same range. The mean squared distance of a point to
    a cluster follows from the cluster's count, sum and sum of squares, so the points are read
    once for these and once for their scores. Points without label take no part; a point alone
    in its cluster scores 0, as does every point of a single cluster.
    """
    group = list(group)
    known = labelled.where(F.col(label).isNotNull()).select(*group, F.col(label).alias("_label"), F.col(id_col).alias("_id"), "vector")
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    parts = known.groupBy(*group, "_label").agg(
        F.count("*").alias("n"), F.sum(squares(F.col("vector"))).alias("squares"), B.sum_arrays("vector").alias("total")
    )
    clusters = parts.groupBy(*group).agg(F.collect_list(F.struct("_label", "n", "squares", "total")).alias("_clusters"))
    joined = B.attach_small(known, clusters, group, ["_id"])

    def mean_gap(c: Column) -> Column:
        cross = F.aggregate(F.zip_with("vector", c["total"], lambda x, t: x * t), F.lit(0.0), lambda acc, x: acc + x)
        whole = c["n"] * F.col("_square") + c["squares"] - 2 * cross
        return F.greatest(whole, F.lit(0.0)) / F.when(c["_label"] == F.col("_label"), c["n"] - 1).otherwise(c["n"])

    own = F.filter("_clusters", lambda c: c["_label"] == F.col("_label"))[0]
    others = F.filter("_clusters", lambda c: c["_label"] != F.col("_label"))
    placed = joined.withColumn("_square", squares(F.col("vector"))).select(
        *group,
        F.when(own["n"] > 1, mean_gap(own)).alias("_a"),
        F.array_min(F.transform(others, mean_gap)).alias("_b"),
    )
    score = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    return placed.groupBy(*group).agg(F.avg(score).alias("score"))


def silhouette(
    points: DataFrame,
    group: Sequence[str],
    sizes: Sequence[int],
    block_rows: int = B.BLOCK_ROWS,
) -> DataFrame:
    """group, model, score: mean Euclidean silhouette of each clustering, exactly.

    Points have usage_id, vector and `labels`: one label per clustering, in
    0 .. size-1, or null for none. Blocks meet in pairs; distances of a pair of
    blocks are added up per point and cluster inside the task, for all
    clusterings together. No pair of points becomes a row. The work is quadratic
    in the points of a group by the nature of the score.
    """
    group = list(group)
    counts = cut_lineage(B.block_counts(points, group, block_rows))
    with_count = B.attach_small(points, counts.select(*group, "blocks"), group, ["usage_id"])
    placed = with_count.withColumn("block", F.pmod(F.xxhash64("usage_id"), F.col("blocks")).cast("int")).select(
        *group, "block", "blocks", "usage_id", "vector", "labels"
    )
    # A block is sent to each of its partners: as (block, other) and as (other, block).
    last = F.col("blocks") - 1
    left = placed.withColumn("other", F.explode(F.sequence(F.col("block"), last)))
    right = placed.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("block"))))
    keys = [*group, "block", "other"]
    right = right.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("first").alias("_block"),
        F.col("block").alias("_other"),
        *[F.col(c).alias(c) for c in ("usage_id", "vector", "labels")],
    )
    types = dict(points.dtypes)
    keyed = ", ".join(f"`{g}` {types[g]}" for g in group)
    sums = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*[f"_{k}" for k in keys]))
        .applyInArrow(
            _pair_sums(group, list(sizes)),
            f"{keyed}, usage_id {types['usage_id']}, labels array<int>, sums array<double>",
        )
    )
    per_point = sums.groupBy(*group, "usage_id").agg(
        F.first("labels").alias("labels"), B.sum_arrays("sums").alias("sums")
    )
    models = F.array(*[_silhouette_of(m, list(sizes)) for m in range(len(sizes))])
    scored = per_point.select(*group, F.posexplode(models).alias("model", "s"))
    return scored.where(F.col("s").isNotNull()).groupBy(*group, "model").agg(F.avg("s").alias("score"))


def _silhouette_of(model: int, sizes: list[int]) -> Column:
    """Per-point silhouette from its distance sums and the cluster sizes behind them."""
    skip, width = sum(sizes[:model]), sum(sizes)
    own = F.get("labels", F.lit(model))
    distance = F.slice("sums", skip + 1, sizes[model])
    members = F.slice("sums", width + skip + 1, sizes[model])
    size = F.get(members, own)
    a = F.get(distance, own) / (size - 1)
    means = F.zip_with(distance, members, lambda d, n: F.when(n > 0, d / F.greatest(n, F.lit(1.0))))
    others = F.transform(means, lambda m, i: F.when(i != own, m))
    b = F.array_min(others)
    s = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    return F.when(own.isNotNull(), F.when(size > 1, s).otherwise(0.0))


def _pair_sums(group, sizes):
    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({})
        same = key[-2].as_py() == key[-1].as_py()
        x, y = matrix(left, "vector"), matrix(right, "vector")
        ids, other_ids = left.column("usage_id").to_numpy(), right.column("usage_id").to_numpy()
        members, other_members = _members(left, sizes), _members(right, sizes)
        sums, other_sums = [], np.zeros((len(y), sum(sizes)))
        # Some rows of distances at a time: never the whole square in memory.
        for at in range(0, len(x), PAIR_ROWS):
            part = slice(at, at + PAIR_ROWS)
            squares = (x[part] ** 2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :]
            gaps = np.sqrt(np.maximum(squares - 2 * x[part] @ y.T, 0.0))
            if same:
                gaps[ids[part][:, None] == other_ids[None, :]] = 0.0
            sums.append(gaps @ other_members)
            if not same:
                other_sums += gaps.T @ members[part]
        sides = [(left, np.concatenate(sums), other_members)]
        if not same:
            sides.append((right, other_sums, members))
        parts = []
        for mine, total, behind in sides:
            counted = np.broadcast_to(behind.sum(axis=0), total.shape)
            parts.append(
                pa.table(
                    {
                        "usage_id": mine.column("usage_id"),
                        "labels": mine.column("labels"),
                        "sums": lists(np.concatenate([total, counted], axis=1)),
                    }
                )
            )
        out = pa.concat_tables(parts)
        names = {g: pa.array([k.as_py()] * out.num_rows, k.type) for g, k in zip(group, key)}
        return pa.table({**names, **{c: out.column(c) for c in out.column_names}})

    return run


def _members(table, sizes):
    """One-hot columns of all clusterings side by side."""
    import numpy as np

    labels = table.column("labels").combine_chunks()
    flat = labels.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(labels), len(sizes))
    return np.concatenate(
        [(flat[:, [m]] == np.arange(size)[None, :]).astype("float64") for m, size in enumerate(sizes)], axis=1
    )


def information_criteria(log_likelihood: Column, covariance: Column, k: Column, d: Column, n: Column) -> dict[str, Column]:
    """aic and bic of a mixture of k components in d dimensions over n points."""
    full = k * d * (d + 1) / 2
    # Free covariance parameters of each type.
    spread = (
        F.when(covariance == "full", full)
        .when(covariance == "diag", k * d)
        .when(covariance == "spherical", k)
        .when(covariance == "tied", d * (d + 1) / 2)
    )
    parameters = k * d + spread + k - 1
    return {
        "aic": 2 * parameters - 2 * log_likelihood,
        "bic": F.log(n.cast("double")) * parameters - 2 * log_likelihood,
    }
