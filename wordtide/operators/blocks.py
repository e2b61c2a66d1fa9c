"""Points of a group in blocks of bounded size, and the sums taken over them.

A group (a word, a layer, both) may hold any number of points. Its points are
cut into blocks by a hash of their id; a block is what one task sees at a time.
Models such as centroids are small tables that are sent to every block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
import sys

from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.operators.streams import whole_groups
from wordtide.session import cut_lineage

BLOCK_ROWS = 5_000
BROADCAST_BYTES = 32 << 20
JOIN_SALTS = 64
HOT_ROWS = 100_000  # Rows of a key from which it is salted.
PARTS_PER_CORE = 4

# Executors get the functions below by value and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def attach_small(big: DataFrame, small: DataFrame, keys: Sequence[str], salt_key: Sequence[str]) -> DataFrame:
    """Inner join of a big frame with a table of few rows per key.

    The table is written and measured first, then joined by its size.
    """
    small = cut_lineage(small)
    return join_small(big, small, keys, salt_key, fits_broadcast(small))


def fits_broadcast(small: DataFrame) -> bool:
    """Whether the rows of a written table take at most BROADCAST_BYTES as text."""
    size = F.sum(F.length(F.to_json(F.struct("*"))).cast("long"))
    return (small.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def join_small(
    big: DataFrame, small: DataFrame, keys: Sequence[str], salt_key: Sequence[str], broadcast: bool
) -> DataFrame:
    """Broadcast the small side, or salt the keys of many rows so a hot key spreads over tasks."""
    if broadcast:
        return big.join(F.broadcast(small), list(keys))
    salted, copied = salted_sides(big, small, keys, salt_key)
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def salted_sides(
    big: DataFrame, small: DataFrame, keys: Sequence[str], salt_key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_salt`: keys of HOT_ROWS or more rows are dealt to JOIN_SALTS salts, others have salt 0.

    The small side, which may have as many keys as the big one, is copied for these keys only. They
    are at most big rows / HOT_ROWS, and are counted by one more pass over the big side's keys.
    """
    counted = big.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = cut_lineage(counted.where(F.col("_rows") >= HOT_ROWS).select(*keys, F.lit(True).alias("_hot")), "hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_key), F.lit(JOIN_SALTS)).cast("int")).otherwise(0)
    copied = small.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    salted = big.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_hot")
    return salted, copied


def block_counts(points: DataFrame, group: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per group: number of points and of blocks."""
    counted = points.groupBy(*group).agg(F.count("*").alias("points"))
    return counted.withColumn("blocks", F.ceil(F.col("points") / block_rows).cast("int"))


def with_blocks(points: DataFrame, counts: DataFrame, group: Sequence[str], id_col: str) -> DataFrame:
    """Adds `block`. Rows are placed and sorted by group and block and kept
    there, so passes over the blocks do not move them again. Unpersist at the end.

    Each pass reports once per partition to the driver, so their number follows the cores; a
    partition holds any number of blocks and hands them on one by one.
    """
    joined = attach_small(points, counts.select(*group, "blocks"), group, [id_col])
    block = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    keys = [*group, "block"]
    partitions = min(counts.agg(F.sum("blocks")).first()[0] or 1, PARTS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism)
    placed = joined.withColumn("block", block).drop("blocks").repartition(partitions, *keys)
    return placed.sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def per_block(
    blocks: DataFrame,
    counts: DataFrame,
    models: DataFrame,
    group: Sequence[str],
    kernel: Callable,
    schema: str,
    broadcast: bool,
) -> DataFrame:
    """Run kernel(points, model rows) on every block; adds the group columns.

    Models are a written table; `broadcast` says whether its size was checked to
    be small, see `fits_broadcast`. Small models go to every task and blocks stay where
    they are placed; others are joined to the blocks by group. The kernel gets two Arrow
    tables and returns a dict of output columns.
    """
    group = list(group)
    if broadcast:
        return _with_models(blocks, models, group, kernel, schema)
    each = counts.select(*group, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sent = join_small(each, models, group, ["block"], broadcast)
    types = dict(blocks.dtypes)
    keyed = ", ".join(f"`{g}` {types[g]}" for g in group)
    run = with_group(kernel, group)
    keys = [*group, "block"]
    theirs = [f"_{k}" for k in keys]
    sent = sent.withColumnsRenamed(dict(zip(keys, theirs)))
    return blocks.groupBy(*keys).cogroup(sent.groupBy(*theirs)).applyInArrow(run, f"{keyed}, {schema}")


def _with_models(blocks: DataFrame, models: DataFrame, group: list[str], kernel: Callable, schema: str) -> DataFrame:
    """The narrow way: a pass over the placed blocks, with all models at hand."""
    table = models.toArrow()
    held = {}
    for row, key in enumerate(zip(*(table.column(g).to_pylist() for g in group))):
        held.setdefault(key, []).append(row)
    sent = models.sparkSession.sparkContext.broadcast({key: table.take(rows) for key, rows in held.items()})
    types = dict(blocks.dtypes)
    keyed = ", ".join(f"`{g}` {types[g]}" for g in group)
    # Blocks without a model, such as those of finished words, stay in the JVM.
    met = blocks.join(F.broadcast(models.select(*group)), group, "left_semi")

    def run(batches):
        import pyarrow as pa

        apply = with_group(kernel, group)
        for table, ends in whole_groups(batches, [*group, "block"]):
            for low, high in zip([0, *ends[:-1]], ends):
                points = table.slice(low, high - low)
                key = tuple(points.column(g)[0] for g in group)
                of = sent.value.get(tuple(k.as_py() for k in key))
                out = apply(key, points, of) if of is not None else pa.table({})
                yield from out.to_batches()

    return met.mapInArrow(run, f"{keyed}, {schema}")


def with_group(kernel: Callable, group: list[str]) -> Callable:
    def run(key, points, models):
        import pyarrow as pa

        out = kernel(points, models) if points.num_rows and models.num_rows else None
        if not out:
            return pa.table({})
        rows = len(next(iter(out.values())))
        names = {name: pa.array([k.as_py()] * rows, k.type) for name, k in zip(group, key)}
        return pa.table({**names, **out})

    return run


def sum_arrays(column: str) -> Column:
    """Aggregate: element-wise sum of equally long arrays, combined map-side."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))
