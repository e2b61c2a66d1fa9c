"""Row numbers and best-n selections that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.session import cut_lineage

SALTS = 64
# Hex digits of the hash that make a bucket: 3 give 4096 even buckets per group.
PREFIX_DIGITS = 3
RANGE_BUCKETS = 256
BLOCK_ROWS = 10_000
# Up to so many rows are cut by Spark's limit; more by ranges of keys.
FEW = 10_000
RANGES = 1000


def hash_order(*key: str, seed: int = 42) -> Column:
    """md5 of seed and key: a random order that any engine can repeat."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int | Column,
    salt_key: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """The first n rows of each group, with their 1-based rank.

    A group is first cut down inside salted parts, so a hot group is sorted by
    many tasks and at most SALTS * n of its rows meet in one.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_key), F.lit(SALTS)))
    part = W.partitionBy(*group, "_salt").orderBy(*order)
    whole = W.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_part", F.row_number().over(part))
        .where(F.col("_part") <= n)
        .drop("_part", "_salt")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows by the order columns, nulls first; rows are not sorted.

    Few rows are taken by Spark's own limit. Beyond FEW, keys alone are sorted by range and
    counted per range; the n-th key becomes a bound, and the rows up to it pass a plain filter.
    Of rows that equal the bound in all order columns, as many as fit are taken.
    """
    order = list(order)
    if n <= FEW:
        return df.orderBy(*order).limit(n)
    count = df.count()
    if count <= n:
        return df
    keys = df.select(*order).repartitionByRange(min(RANGES, -(-count // FEW)), *order)
    keys = cut_lineage(keys.withColumn("_range", F.spark_partition_id()), "keys")
    before = 0
    for number, size in sorted(tuple(r) for r in keys.groupBy("_range").agg(F.count("*").alias("_n")).collect()):
        if before + size >= n:
            break
        before += size
    inside = keys.where(F.col("_range") == number).select(*order)
    row, types = inside.orderBy(*order).offset(n - before - 1).limit(1).first(), dict(df.dtypes)
    bound = F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])
    key = F.struct(*order)
    left = n - before - inside.where(key < bound).count()
    return df.where(key < bound).unionByName(df.where(key == bound).limit(left))


def rank_by_hash(
    df: DataFrame, group: Sequence[str], hash_col: str, ties: Sequence[str], rank: str = "rank"
) -> DataFrame:
    """Exact 0-based rank of every row in its group by a hexadecimal hash column.

    Rows are counted per hash prefix, the counts are summed up to offsets, and
    rows are numbered inside their prefix only.
    """
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, PREFIX_DIGITS))
    order = [F.col(hash_col), *map(F.col, ties)]
    return _sum_before(bucketed, list(group), order, F.lit(1), rank)


def rank_by_number(df: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row by a numeric column without repeats."""
    return sum_before(df, key, F.lit(1), rank)


def sum_before(df: DataFrame, key: str, weight: Column, name: str) -> DataFrame:
    """Sum of `weight` over all rows with a smaller key; keys are numbers without repeats.

    Quantile bounds only decide how even the buckets are, not the result.
    """
    steps = [i / RANGE_BUCKETS for i in range(1, RANGE_BUCKETS)]
    bounds = sorted(set(df.approxQuantile(key, steps, 1 / (2 * RANGE_BUCKETS))))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
    return _sum_before(df.withColumn("_bucket", bucket), [], [F.col(key)], weight, name)


def text_offset(df: DataFrame, doc: str, row: str, weight: Column, name: str) -> DataFrame:
    """Sum of `weight` over all rows before this one in the order (doc, row).

    Adds up per document, then per block of rows, then inside the block, so
    neither the whole frame nor one long document has to fit a task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(row) / BLOCK_ROWS)).withColumn("_weight", weight)
    # Small next to the data, and used three times below.
    per_block = cut_lineage(blocked.groupBy(doc, "_block").agg(F.sum("_weight").alias("_sum")))
    per_doc = per_block.groupBy(doc).agg(F.sum("_sum").alias("_sum"))
    doc_start = sum_before(per_doc, doc, F.col("_sum"), "_doc_start").select(doc, "_doc_start")
    earlier = W.partitionBy(doc).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        per_block.withColumn("_block_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .join(doc_start, doc)
        .select(doc, "_block", (F.col("_doc_start") + F.col("_block_start")).alias("_before"))
    )
    inside = W.partitionBy(doc, "_block").orderBy(row).rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(starts, [doc, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_weight", "_inside", "_before")
    )


def _sum_before(df: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    keys = [*group, "_bucket"]
    weighted = df.withColumn("_weight", weight)
    sums = weighted.groupBy(*keys).agg(F.sum("_weight").alias("_sum"))
    # One row per bucket: small, whatever the size of the group.
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        weighted.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_weight", "_inside", "_offset")
    )
