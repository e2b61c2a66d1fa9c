"""Usage vectors: pooling, standardising, ranking by cosine, layout in two dimensions."""

from __future__ import annotations

from collections.abc import Sequence
import sys

from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions.vectors import as_doubles, cosine_similarity
from wordtide.operators import blocks as B
from wordtide.operators.arrays import lists, matrix
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usage_points(df: DataFrame, word: str, id_col: str, vector: str) -> DataFrame:
    """word, usage_id, vector as doubles: the shape the cluster operators take."""
    return df.select(
        F.col(word).alias("word"), F.col(id_col).alias("usage_id"), as_doubles(F.col(vector)).alias("vector")
    )


def pool(pieces: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Mean vector per key, for the sub-token vectors of an occurrence and layer."""
    mean = Summarizer.mean(array_to_vector(as_doubles(F.col(vector))))
    return pieces.groupBy(*keys).agg(vector_to_array(mean).alias(vector))


def moments(points: DataFrame, group: Sequence[str], vector: str = "vector") -> DataFrame:
    """Per group: mean and population standard deviation of each dimension."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector)))
    stats = points.groupBy(*group).agg(summary.alias("s"))
    n = F.col("s.count")
    # The summarizer divides by n - 1.
    population = F.transform(
        vector_to_array(F.col("s.variance")), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n)
    )
    return stats.select(*group, vector_to_array(F.col("s.mean")).alias("mean"), population.alias("deviation"))


def standardize(
    points: DataFrame, group: Sequence[str] = ("word",), id_col: str = "usage_id", vector: str = "vector"
) -> DataFrame:
    """Mean 0 and variance 1 per group and dimension; constant dimensions become 0."""
    stats = moments(points, group, vector)
    joined = B.attach_small(points, stats, group, [id_col])
    return joined.withColumn(vector, in_units(F.col(vector))).drop("mean", "deviation")


def in_units(vector: Column) -> Column:
    """The vector less the column `mean`, in units of the column `deviation`; 0 deviation counts as 1."""
    centred = F.zip_with(vector, "mean", lambda x, m: x - m)
    return F.zip_with(centred, "deviation", lambda x, d: x / F.when(d > 0, d).otherwise(1.0))


def cosine_to_target(points: DataFrame, target: Sequence[float], vector: str = "vector") -> DataFrame:
    """Adds `cosine` to one given vector, which travels as a literal."""
    other = F.lit([float(x) for x in target])
    return points.withColumn("cosine", cosine_similarity(as_doubles(F.col(vector)), other))


def project_2d(
    points: DataFrame, group: Sequence[str], id_col: str = "usage_id", block_rows: int = B.BLOCK_ROWS
) -> DataFrame:
    """x, y per point: its first two principal components within the group.

    Scatter matrices are summed over blocks; only such a d x d sum, never the
    points, meets in one task. The largest loading of a component is positive.
    """
    group = list(group)
    counts = cut_lineage(B.block_counts(points, group, block_rows))
    blocks = B.with_blocks(points.select(*group, id_col, "vector"), counts, group, id_col)
    means = cut_lineage(moments(points, group).select(*group, "mean"))
    broadcast = B.fits_broadcast(means)
    partial = B.per_block(blocks, counts, means, group, _scatter, "scatter array<double>, mean array<double>", broadcast)
    scatter = partial.groupBy(*group).agg(
        B.sum_arrays("scatter").alias("scatter"), F.first("mean").alias("mean")
    )
    types = dict(points.dtypes)
    keyed = ", ".join(f"`{g}` {types[g]}" for g in group)
    axes = scatter.mapInArrow(_axes(group), f"{keyed}, mean array<double>, axis1 array<double>, axis2 array<double>")
    schema = f"{id_col} {types[id_col]}, x double, y double"
    axes = cut_lineage(axes)
    placed = B.per_block(blocks, counts, axes, group, _project(id_col), schema, B.fits_broadcast(axes))
    result = cut_lineage(placed)
    blocks.unpersist()
    return result


def _scatter(points, models):
    centred = matrix(points, "vector") - matrix(models, "mean")[0]
    total = centred.T @ centred
    return {"scatter": lists(total.reshape(1, -1)), "mean": lists(matrix(models, "mean")[:1])}


def _axes(group):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            means = matrix(table, "mean")
            first, second = [], []
            # One d x d matrix per group: its size depends on the dimensions only.
            for flat in table.column("scatter").combine_chunks():
                square = np.asarray(flat.values)
                size = int(len(square) ** 0.5)
                _, axes = np.linalg.eigh(square.reshape(size, size))
                top = axes[:, ::-1][:, :2].T
                signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
                top = top * signs[:, None]
                first.append(top[0])
                second.append(top[1] if size > 1 else np.zeros(size))
            columns = {g: table.column(g) for g in group}
            out = {"mean": lists(means), "axis1": lists(np.stack(first)), "axis2": lists(np.stack(second))}
            yield from pa.table({**columns, **out}).to_batches()

    return run


def _project(id_col):
    def kernel(points, models):
        import pyarrow as pa

        centred = matrix(points, "vector") - matrix(models, "mean")[0]
        return {
            id_col: points.column(id_col),
            "x": pa.array(centred @ matrix(models, "axis1")[0]),
            "y": pa.array(centred @ matrix(models, "axis2")[0]),
        }

    return kernel
