"""Array-of-double vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers; never null."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(plain & (F.size(vector) > 0), F.lit(False))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(u: Column, v: Column) -> Column:
    """Null where either vector is all zeros."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def squared_distance(u: Column, v: Column) -> Column:
    gaps = F.zip_with(u, v, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1).otherwise(0)
    )


def with_one_hot(df: DataFrame, label: str, name: str, classes: int | None = None) -> DataFrame:
    """Adds the one-hot array of a label column; without a number of classes the largest label gives it."""
    if classes is None:
        classes = (df.agg(F.max(label)).first()[0] or 0) + 1
    return df.withColumn(name, one_hot(F.col(label), classes))


def columns_of(vector: Column, size: int, prefix: str = "dimension") -> list[Column]:
    """One column per dimension."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]


def sum_of_layers(stacked: Column, dims: int) -> Column:
    """Add up the blocks of a concatenated vector, leaving out the first one."""
    last = F.floor(F.size(stacked) / dims).cast("int") - 1
    blocks = F.filter(F.sequence(F.lit(0), last), lambda b: b > 0)
    zero = F.array_repeat(F.lit(0.0), dims)
    return F.aggregate(
        blocks,
        zero,
        lambda acc, b: F.zip_with(acc, F.slice(stacked, b * dims + 1, F.lit(dims)), lambda x, y: x + y),
    )
