"""Approximate nearest neighbours by NN-descent.

Equal vectors are one node. The first graph comes from small blocks of the cells around
sampled pivots. Then each round brings a node's neighbours and the nodes that name it
together; any two of them are neighbours of a neighbour, and whoever finds a nearer one
than the worst on its list takes it. Lists, rounds and the search are Spark joins over rows
(node, other, nearness). Queries walk the graph greedily: a pool of the best nodes seen, of
which all that were not yet opened are opened each round, until the pool stands still.

Joins go on until the lists stand still. The recall of a sample of queries is measured against
all rows, and the pool grows until it is reached.

Between joins vectors are rounded to bytes; final scores are those of the original vectors.
"""

from __future__ import annotations

import sys

from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.llm import vectors as V
from wordtide.llm import voronoi
from wordtide.llm.vectors import padded
from wordtide.operators.blocks import fits_broadcast
from wordtide.operators.ranking import top_per_group
from wordtide.operators.streams import whole_groups
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIST = 32
REVERSE = 32
# A bound against endless rounds; reaching it is an error. Lists stand still long before.
ROUNDS = 60
STILL = 0.02
CHECKED = 128
RECALL = 0.95
POOL = 224
CELL_ROWS = 150
MOST_PIVOTS = 4096
CELLS_OF_NODE = 3
BLOCK_ROWS = 1024

LISTS = "node long, other long, near double, old boolean, least double"


def search(
    data: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vector: str = "vector",
    list_size: int = LIST,
    reverse: int = REVERSE,
    rounds: int = ROUNDS,
    pool: int = POOL,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, id, score: for each id in queries the k nearest found rows of data by inner product.

    Queries are ids of data. Scores are inner products in double precision; ties go to the smaller id;
    the query's own id is left out. Null vectors, zero vectors and those with a null or non-finite
    component take no part; shorter vectors count as followed by zeros. A repeated id stands for its
    first vector in array order. The pool is doubled until a sample of the queries reaches `recall`. Where
    a pool for all rows does not reach it, or the walk finds fewer than k rows though there are more, the
    exact Voronoi join answers. Empty inputs give no rows.
    """
    usable = V.usable(data, id_col, vector).where(F.exists("vector", lambda x: x != 0))
    rows = usable.groupBy("id").agg(F.min("vector").alias("vector"))
    rows = cut_lineage(rows, "rows")
    size = max(V.dimensions(rows), 1)
    # Equal vectors meet through a minimum, so a very common vector is no hot group.
    nodes = cut_lineage(rows.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "nodes")
    total = nodes.count()
    asked = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    named = cut_lineage(rows.join(nodes, "vector").select("id", "node", "copies"), "named")
    asked = cut_lineage(named.join(asked, "id", "left_semi").select(F.col("id").alias("query_id"), "node"), "asked")
    small = cut_lineage(nodes.select("node", "vector").mapInArrow(_bytes(size), "node long, code binary, scale double"))
    lists = graph(nodes.select("node", "vector"), small, total, size, list_size, reverse, rounds)
    starts = asked.select("node").distinct()
    found = walk(lists, small, starts, pool)
    sample = cut_lineage(starts.orderBy(F.xxhash64("node"), "node").limit(CHECKED), "sample")
    least = least_scores(nodes, sample, min(k, total - 1), size)
    checked, wide = found, pool
    while measured_recall(checked, nodes, least, k, size) < recall:
        if wide >= total:
            exact = voronoi.top_k(rows, rows.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi"), k)
            return exact.select("query_id", "rank", "id", "score")
        wide *= 2
        checked = walk(lists, small, sample, wide)
    if wide > pool:
        found = walk(lists, small, starts, wide)
    return _exact(found, nodes, named, asked, rows, k, size)


def least_scores(nodes, sample, k, size) -> dict:
    """For each node of a sample the score of its k-th nearest other node, measured against all nodes."""
    drawn = nodes.join(F.broadcast(sample), "node", "left_semi").select("node", "vector").toArrow()
    if k < 1 or not drawn.num_rows:
        return {}
    own, vectors = drawn.column("node").to_numpy(), padded(drawn.column("vector"), size)
    best = W.partitionBy("node").orderBy(F.desc("score"))
    rows = (
        nodes.select("node", "vector").mapInArrow(_nearest(own, vectors, k, size), "node long, score double")
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k)
    )
    return {r["node"]: r["score"] for r in rows.collect()}  # as many as the sample


def measured_recall(found, nodes, least: dict, k: int, size: int) -> float:
    """The share of the nearest nodes of a sample, as least_scores tells, among those that _exact would rank; 1 without any."""
    if not least:
        return 1.0
    # Scores of one and the same pair may differ by rounding.
    rows = [(n, s - 1e-9 * max(1.0, abs(s))) for n, s in least.items()]
    bound = F.broadcast(found.sparkSession.createDataFrame(rows, "node long, _least double"))
    pairs = found.join(bound.select("node"), "node", "left_semi").select("node", "other")
    hits = _scored(pairs, nodes, size).join(bound, "node").where("score >= _least").groupBy("node").count()
    most = min(k, nodes.count() - 1)
    return sum(min(r["count"], most) for r in hits.collect()) / (most * len(rows))


def _scored(pairs, nodes, size):
    """node, other, score by the original vectors."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("vector").alias(f"_{side}"))
    return (
        pairs.join(of("node"), "node").join(of("other"), "other")
        .mapInArrow(_products(size), "node long, other long, score double")
    )


def _exact(found, nodes, named, asked, rows, k, size):
    """Best rows by the original vectors among all nodes in the pool of each query."""
    # A node with copies is a candidate for the queries that it stands for.
    pairs = found.select("node", "other").unionByName(asked.select("node", F.col("node").alias("other")).distinct())
    scored = _scored(pairs, nodes, size)
    members = top_per_group(named, ["node"], [F.col("id")], k + 1, ["id"], "_m").select(
        F.col("node").alias("other"), F.col("id")
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = (
        asked.join(scored, "node").join(members, "other").where("id <> query_id")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
    ranked = cut_lineage(ranked, "ranked")
    # One more row than candidates: the query's own.
    enough = min(k, max(rows.count() - 1, 0))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = cut_lineage(
        asked.join(counts, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < enough).select("query_id"), "short"
    )
    if short.isEmpty():
        return ranked
    again = voronoi.top_k(rows, rows.join(short.withColumnRenamed("query_id", "id"), "id", "left_semi"), k)
    whole = again.select("query_id", "rank", "id", "score")
    return ranked.join(short, "query_id", "left_anti").unionByName(whole)


def graph(nodes, small, total, size, list_size=LIST, reverse=REVERSE, rounds=ROUNDS) -> DataFrame:
    """Rows of LISTS: the list_size nearest others found for each node (node, vector).

    Rounds end when at most a share of STILL of the links is new, or after so many rounds. Lists that
    did not settle by then cost recall, which is measured: the exact join answers where it is too low.
    """
    pivots = max(1, min(MOST_PIVOTS, total // CELL_ROWS))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).select("vector").toArrow()
    lists = small.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("other"),
                         F.lit(0.0).alias("near"), F.lit(False).alias("old")).limit(0)
    if drawn.num_rows:
        placed = cut_lineage(
            nodes.mapInArrow(_cells(padded(drawn.column("vector"), size), size), "node long, cell int"), "cells"
        )
        counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_b"))
        keys = ["cell", "block"]
        block = F.pmod(F.xxhash64("node"), F.col("_b")).cast("int")
        # One row per pivot, MOST_PIVOTS at most.
        dealt = placed.join(F.broadcast(counts), "cell").withColumn("block", block).join(small, "node")
        lists = (
            dealt.select(*keys, "node", "code", "scale").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_all_pairs(list_size), "node long, other long, near double, old boolean")
        )
    lists = cut_lineage(best_lists(lists, list_size), "lists")
    # The bytes of all nodes go to every task if they are measured to be few.
    everywhere = fits_broadcast(small)
    for _ in range(rounds):
        ahead = lists.select(F.col("node").alias("at"), F.col("other").alias("member"), "old")
        back = lists.select("node", F.col("other"), F.col("old"), F.xxhash64("node", "other").alias("_h"))
        back = best_lists(
            back.select(F.col("other").alias("node"), F.col("node").alias("other"),
                        (F.col("_h") / 2.0**63).alias("near"), "old"), reverse,
        ).select(F.col("node").alias("at"), F.col("other").alias("member"), "old")
        met = ahead.unionByName(back)
        worst = lists.groupBy("node").agg(F.max("least").alias("least"))
        sides = cut_lineage(small.join(worst, "node", "left").withColumnRenamed("node", "member"), "sides")
        columns = ["at", "member", "old", "code", "scale", "least"]
        if everywhere:
            joined = met.repartition("at").sortWithinPartitions("at").join(F.broadcast(sides), "member")
        else:
            joined = met.join(sides, "member").repartition("at").sortWithinPartitions("at")
        better = joined.select(*columns).mapInArrow(
            _local_join(list_size), "node long, other long, near double, old boolean"
        )
        known = lists.select("node", "other", "near", F.lit(True).alias("old"))
        lists = cut_lineage(best_lists(known.unionByName(better), list_size), "lists")
        if lists.where(~F.col("old")).count() <= STILL * lists.count():
            return lists
    return lists


def walk(lists: DataFrame, small: DataFrame, starts: DataFrame, pool: int = POOL) -> DataFrame:
    """Rows of LISTS with the `pool` nearest nodes found for each start, by greedy steps from its own list."""
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = lists.join(small.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
        F.collect_list(F.struct("other", "code", "scale")).alias("links")  # as many as a list holds
    )
    # Placed by node once and kept, so a step moves open nodes only.
    links = packed.withColumnRenamed("node", "open").repartition(parts, "open").persist(StorageLevel.MEMORY_AND_DISK)
    asked = cut_lineage(starts.join(small, "node").withColumnsRenamed({"code": "_code", "scale": "_scale"}), "starts")
    first = lists.join(starts, "node", "left_semi").select("node", "other", "near", F.lit(False).alias("old"))
    held = cut_lineage(best_lists(first, pool), "pool")
    while True:
        opened = held.where(~F.col("old")).select("node", F.col("other").alias("open"), "least")
        if opened.isEmpty():
            break
        step = opened.join(asked, "node").repartition(parts, "open").join(links, "open")
        seen = step.select("node", "_code", "_scale", "least", "links").mapInArrow(
            _open, "node long, other long, near double, old boolean"
        )
        known = held.select("node", "other", "near", F.lit(True).alias("old"))
        held = cut_lineage(best_lists(known.unionByName(seen), pool), "pool")
    links.unpersist()
    return held


def best_lists(rows: DataFrame, size: int) -> DataFrame:
    """Rows of LISTS: for each node the others nearest to it, each once; `least` is the last one's nearness if the list is full."""
    placed = rows.select("node", "other", "near", "old").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(_best(size), LISTS)


def _bytes(size):
    """Vectors as 8-bit integers with a scale of their own."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = padded(batch.column("vector"), size)
            scale = np.abs(rows).max(axis=1) / 127
            codes = np.round(rows / scale[:, None]).astype("int8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)],
                ["node", "code", "scale"],
            )

    return run


def _floats(codes, scales):
    """Rows of byte vectors as numbers."""
    import numpy as np

    codes = codes.combine_chunks() if hasattr(codes, "combine_chunks") else codes
    flat = np.frombuffer(b"".join(codes.to_pylist()), dtype="int8").astype("float32")
    return flat.reshape(len(codes), -1) * np.asarray(scales, dtype="float32")[:, None]


def _cells(pivots, size):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        near = min(CELLS_OF_NODE, len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = padded(part.column("vector"), size)
                gap = (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
                cell = np.argpartition(gap, near - 1, axis=1)[:, :near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(part.column("node")), near)), pa.array(cell.ravel().astype("int32"))],
                    ["node", "cell"],
                )

    return run


def _rows(node, other, near, old):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(other), pa.array(np.asarray(near, dtype="float64")), pa.array(old, pa.bool_())],
        ["node", "other", "near", "old"],
    )


def _all_pairs(most):
    """The nearest of each node in its block."""

    def run(batches):
        import numpy as np

        for table, ends in whole_groups(batches, ["cell", "block"]):
            nodes, codes = table.column("node").to_numpy(), _floats(table.column("code"), table.column("scale"))
            for low, high in zip([0, *ends[:-1]], ends):
                if high - low < 2:
                    continue
                near = codes[low:high] @ codes[low:high].T
                np.fill_diagonal(near, -np.inf)
                n = min(most, high - low - 1)
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                own = nodes[low:high]
                yield _rows(
                    np.repeat(own, n), own[best.ravel()], np.take_along_axis(near, best, axis=1).ravel(),
                    np.zeros(n * len(own), dtype=bool),
                )

    return run


def _reduce(node, other, near, old, size):
    """Positions of the best `size` different others of each node, old ones before new among equals."""
    import numpy as np

    order = np.lexsort((~old, other, node))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (node[order][1:] != node[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -near[order], node[order]))]
    mine = node[order]
    rank = np.arange(len(order)) - np.searchsorted(mine, mine)
    return order[rank < size]


def _arrays(table):
    import numpy as np

    return [np.asarray(table.column(c).to_numpy(zero_copy_only=False)) for c in ("node", "other", "near", "old")]


def _best(size):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def shrink(table):
            if table.num_rows < 8 * size:
                return table
            arrays = _arrays(table)
            return table.take(pa.array(_reduce(*arrays, size)))

        for table, _ in whole_groups(batches, ["node"], shrink):
            arrays = _arrays(table)
            keep = _reduce(*arrays, size)
            node, other, near, old = (a[keep] for a in arrays)
            ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(node))
            counts = np.diff(ends, prepend=0)
            least = np.where(counts >= size, near[ends - 1], -np.inf)
            rows = _rows(node, other, near, old)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.repeat(least, counts))], [*rows.schema.names, "least"]
            )

    return run


def _local_join(size):
    """Neighbours of a node as candidates of each other; only what betters a list is told."""

    def run(batches):
        import numpy as np

        out = []
        count = 0
        for table, ends in whole_groups(batches, ["at"]):
            codes = _floats(table.column("code"), table.column("scale"))
            member, old = table.column("member").to_numpy(), table.column("old").to_numpy(zero_copy_only=False)
            least = table.column("least").to_numpy(zero_copy_only=False).astype("float64")
            least = np.where(np.isnan(least), -np.inf, least)
            for low, high in zip([0, *ends[:-1]], ends):
                own, kept = member[low:high], old[low:high].astype(bool)
                near = codes[low:high] @ codes[low:high].T
                fit = (near > least[low:high, None]) & ~(kept[:, None] & kept[None, :]) & (own[:, None] != own[None, :])
                one, two = np.nonzero(fit)
                out.append((own[one], own[two], near[one, two]))
                count += len(one)
            if count > 200_000:
                yield from _told(out, size)
                out, count = [], 0
        yield from _told(out, size)

    return run


def _told(out, size):
    import numpy as np

    if out:
        node, other, near = (np.concatenate(x) for x in zip(*out))
        old = np.zeros(len(node), dtype=bool)
        near = near.astype("float64")
        keep = _reduce(node, other, near, old, size)
        yield _rows(node[keep], other[keep], near[keep], old[keep])


def _open(batches):
    """The links of opened nodes that are nearer to the query than the last of its pool."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            links = part.column("links")
            counts = np.asarray(links.value_lengths())
            flat = links.flatten()
            other = np.asarray(flat.field("other"))
            theirs = _floats(flat.field("code"), flat.field("scale"))
            row = np.repeat(np.arange(len(counts)), counts)
            mine = _floats(part.column("_code"), part.column("_scale"))[row]
            near = np.einsum("nd,nd->n", mine, theirs).astype("float64")
            node, least = np.asarray(part.column("node"))[row], np.asarray(part.column("least"))[row]
            fit = (near > least) & (node != other)
            yield _rows(node[fit], other[fit], near[fit], np.zeros(int(fit.sum()), dtype=bool))


def _nearest(own, vectors, k, size):
    """node, score of the k nearest rows of a task for each of the given nodes, itself left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = np.full((len(own), 0), -np.inf)
        for batch in batches:
            score = vectors @ padded(batch.column(1), size).T
            score[own[:, None] == np.asarray(batch.column(0))[None, :]] = -np.inf
            best = np.concatenate([best, score], axis=1)
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
        row, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(best[row, at])], ["node", "score"])

    return run


def _products(size):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            one, two = (padded(batch.column(names.index(c)), size) for c in ("_node", "_other"))
            score = np.einsum("nd,nd->n", one, two)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("node")), batch.column(names.index("other")), pa.array(score)],
                ["node", "other", "score"],
            )

    return run
