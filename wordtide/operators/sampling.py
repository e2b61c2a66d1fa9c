"""Seeded samples. Rows are drawn by hash order, so results do not depend on
partitioning; a sample of n rows means at most n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.operators.ranking import first_rows, hash_order, rank_by_hash, top_per_group
from wordtide.session import cut_lineage

DRAWS_PER_TASK_ROW = 10_000


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, first by hash of their key; large samples are not sorted, see `first_rows`."""
    return first_rows(df.withColumn("_hash_order", hash_order(*key, seed=seed)), n, ["_hash_order", *key]).drop("_hash_order")


def sample_per_group(
    df: DataFrame, group: Sequence[str], n: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """At most n rows of each group; rows with a null group are left out."""
    order = [hash_order(*key, seed=seed), *map(F.col, key)]
    return top_per_group(df.dropna(subset=list(group)), group, order, n, key).drop("rank")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(*key, seed=seed), *key)


def draw_with_replacement(
    df: DataFrame, group: str, key: str, n: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Per group n draws, or bround(fraction * size) draws, each from all its rows.

    Draw i takes the row whose rank in hash order is a hash of (seed, group, i)
    modulo the group's size. Adds `draw`. `key` tells the rows of a group apart.
    """
    if (n is None) == (fraction is None):
        raise ValueError("Give either n or fraction.")
    # Keys are ranked; rows are read once more, for the keys that were drawn.
    keys = cut_lineage(df.where(F.col(group).isNotNull()).select(group, key), "keys")
    hashed = keys.withColumn("_hash", hash_order(key, seed=seed))
    ranked = rank_by_hash(hashed, [group], "_hash", [key], "_rank").drop("_hash")
    sizes = keys.groupBy(group).agg(F.count("*").alias("_size"))
    wanted = F.lit(n) if n is not None else F.bround(F.col("_size") * F.lit(fraction)).cast("long")
    draws = _numbered(sizes.withColumn("_draws", wanted.cast("long"))).withColumn(
        "_rank", F.pmod(hash_number(F.lit(str(seed)), F.col(group), F.col("draw")), F.col("_size"))
    )
    drawn = draws.select(group, "draw", "_rank").join(ranked, [group, "_rank"]).drop("_rank")
    return drawn.join(df, [group, key])


def hash_number(*parts: Column) -> Column:
    """Non-negative integer from the first 15 hex digits of an md5."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Rows draw = 0 .. _draws-1, made in two steps so no single row holds them all."""
    chunk = DRAWS_PER_TASK_ROW
    chunks = sizes.where("_draws > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_draws") - 1) / chunk)))
    )
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_draws")) - 1
    return (
        chunks.repartition("_chunk")
        .withColumn("draw", F.explode(F.sequence(first, last)))
        .drop("_chunk", "_draws")
    )


def gated_sample(
    df: DataFrame, word: str, key: Sequence[str], n: int = 200, more_than: int = 100, seed: int = 42
) -> DataFrame:
    """At most n rows per word, for words that have more than `more_than` rows.

    Reads df twice: pass a written table if it is costly to compute.
    """
    sizes = df.groupBy(word).agg(F.count("*").alias("_size")).where(F.col("_size") > more_than)
    sampled = sample_per_group(df, [word], n, key, seed)
    return sampled.join(sizes.select(word), word, "left_semi")
