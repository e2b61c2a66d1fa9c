"""Exact top-k inner products by a Voronoi join.

Pivots divide the space into cells. Queries and data are grouped by the cell of their
nearest pivot; a summary of each cell (radius, the members nearest to its pivot) gives
bounds on the scores between a group of queries and a cell. A query is sent only to cells
whose upper bound reaches the k-th best score that the summaries promise. Cells are cut
into blocks, and the queries that a cell needs into slices of bounded size; each pair of them is
solved in its own task, so neither a hot cell nor many queries meet in one. A block is sent as
often as the queries that reach its cell fill slices, a query to the blocks of these cells.

Bounds come from the
triangle inequality: q.x lies within |q| |x - p| of q.p for pivot p.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.llm import vectors as V
from wordtide.llm.vectors import best_of_block, nearest, padded
from wordtide.operators.ranking import top_per_group
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells follow the table within these bounds.
CELLS = 64
MOST_CELLS = 1024
CELL_ROWS = 65_536
PIVOT_SAMPLE = 4096
BLOCK_ROWS = 4096
SLICE_ROWS = 8192


def scaled(df: DataFrame, id_col: str, vector: str, factor: int = 256) -> DataFrame:
    """id and vector with each component x as floor(factor * x)."""
    kept = V.usable(df, id_col, vector)
    whole = F.transform("vector", lambda x: F.floor(x * float(factor)).cast("double"))
    return kept.select("id", whole.alias("vector"))


def top_k(
    data: DataFrame,
    queries: DataFrame,
    k: int,
    cells: int | None = None,
    sample: int = PIVOT_SAMPLE,
    block_rows: int = BLOCK_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank, id, score: for each query (id, vector) the k best rows of data by inner product.

    Ties go to the smaller id; rows with the query's id are left out. A repeated id counts once,
    by its best score. Fewer than k candidates are all returned; a query without candidates
    has no rows; `cells` follows the number of rows if not given; empty inputs give no rows. Vectors shorter than the longest count as followed
    by zeros. Scores are exact while they are integers below 2^53. The pivots come from the
    `sample` rows that are first by a hash of id; every other figure covers all rows.
    """
    size = max(V.dimensions(data), V.dimensions(queries), 1)
    drawn = data.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).select("vector").toArrow()
    if not drawn.num_rows:
        return _ranked(data.selectExpr("id as query_id", "id", "0D as score").limit(0), k)
    cells = cells or max(CELLS, min(MOST_CELLS, -(-data.count() // CELL_ROWS)))
    pivots = V.centres(padded(drawn.column("vector"), size), cells)
    placed = cut_lineage(data.mapInArrow(_place(pivots, size), "id long, vector array<double>, cell int, gap double"))
    asked = cut_lineage(queries.mapInArrow(_place(pivots, size), "id long, vector array<double>, cell int, gap double"))
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    near = placed.select("id", "cell", "gap").mapInArrow(_nearest_of_task(k + 1), "id long, cell int, gap double")
    first = top_per_group(near, ["cell"], [F.col("gap"), F.col("id")], k + 1, ["id"]).collect()
    groups = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    summary = {r["cell"]: (r["n"], r["radius"], sorted((f["gap"], f["id"]) for f in first if f["cell"] == r["cell"]))
               for r in rows}
    wanted = _group_bounds(pivots, summary, {g["cell"]: g["radius"] for g in groups}, k)
    blocks = {cell: -(-n // block_rows) for cell, (n, _, _) in summary.items()}
    reached = asked.mapInArrow(_targets(pivots, size, summary, wanted, k), "query_id long, query array<double>, to_cell int")
    met = {r["to_cell"]: r["n"] for r in reached.groupBy("to_cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    slices = {cell: -(-met.get(cell, 0) // slice_rows) for cell in blocks}
    sent = reached.select(
        "query_id", "query", "to_cell",
        F.pmod(F.xxhash64("query_id"), _by_cell(slices, "to_cell")).cast("int").alias("to_slice"),
        F.explode(F.sequence(F.lit(0), _by_cell(blocks, "to_cell") - 1)).alias("to_block"),
    )
    cut = _cut(placed, blocks, slices)
    solved = (
        cut.groupBy("cell", "block", "slice")
        .cogroup(sent.groupBy("to_cell", "to_block", "to_slice"))
        .applyInArrow(_solve(size, k), "query_id long, id long, score double")
    )
    return _ranked(solved, k)


def _by_cell(numbers: dict, cell: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col(cell)]


def _cut(placed: DataFrame, blocks: dict, slices: dict) -> DataFrame:
    """Rows with their block, once for every slice of queries that their cell meets; none for cells without queries."""
    return placed.drop("gap").where(_by_cell(slices, "cell") > 0).select(
        "id", "vector", "cell",
        F.pmod(F.xxhash64("id"), _by_cell(blocks, "cell")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), _by_cell(slices, "cell") - 1)).alias("slice"),
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A query has at most k rows from each block here."""
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group_bounds(pivots, summary, radii, k):
    """Which cells may hold a best row for any query of each query group."""
    import numpy as np

    out = {}
    for group, radius in radii.items():
        norm = np.linalg.norm(pivots[group]) + radius
        base = {c: float(pivots[group] @ pivots[c]) - radius * np.linalg.norm(pivots[c]) for c in summary}
        sure = [(base[c] - norm * gap, i) for c, (_, _, first) in summary.items() for gap, i in first]
        least = _kth(sure, k + 1)  # one more, as a query's own row may be among them
        high = {c: float(pivots[group] @ pivots[c]) + radius * np.linalg.norm(pivots[c]) for c in summary}
        out[group] = sorted(c for c, (_, r, _) in summary.items() if high[c] + norm * r >= least - _slack(least))
    return out


def _kth(sure, k):
    """The k-th largest promised score among distinct ids."""
    best = {}
    for score, i in sure:
        best[i] = max(score, best.get(i, score))
    ordered = sorted(best.values(), reverse=True)
    return ordered[k - 1] if len(ordered) >= k else float("-inf")


def _slack(score):
    """For rounding in the bounds; the scores themselves are exact."""
    return 1e-6 * (1 + abs(score)) if score > float("-inf") else 0.0


def _place(pivots, size):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                label, gap = nearest(padded(batch.column("vector"), size), pivots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vector"), pa.array(label.astype("int32")), pa.array(gap)],
                    ["id", "vector", "cell", "gap"],
                )

    return run


def _nearest_of_task(n):
    """The n members nearest to each pivot among a task's rows."""

    def run(batches):
        import heapq

        import pyarrow as pa

        held = {}
        for batch in batches:
            for i, cell, gap in zip(*(c.to_pylist() for c in batch.columns)):
                kept = held.setdefault(cell, {})
                kept[i] = min(gap, kept.get(i, gap))
                if len(kept) > 8 * n:
                    held[cell] = dict(heapq.nsmallest(n, kept.items(), key=lambda x: (x[1], x[0])))
        rows = [(i, c, g) for c, kept in held.items() for i, g in heapq.nsmallest(n, kept.items(), key=lambda x: x[1])]
        if rows:
            i, c, g = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, "int64"), pa.array(c, "int32"), pa.array(g, "float64")], ["id", "cell", "gap"]
            )

    return run


def _targets(pivots, size, summary, wanted, k):
    """Rows of queries for the cells that each needs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, asked = batch.column("id").to_pylist(), padded(batch.column("vector"), size)
            norms, scores = np.linalg.norm(asked, axis=1), asked @ pivots.T
            row, cell = [], []
            for at, (i, group) in enumerate(zip(ids, batch.column("cell").to_pylist())):
                sure = [
                    (scores[at, c] - norms[at] * gap, other)
                    for c in wanted[group]
                    for gap, other in summary[c][2]
                    if other != i
                ]
                least = _kth(sure, k)
                for c in wanted[group]:
                    if scores[at, c] + norms[at] * summary[c][1] >= least - _slack(least):
                        row.append(at)
                        cell.append(c)
            for a in range(0, len(row), 8192):
                part = slice(a, a + 8192)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row[part])),
                        batch.column("vector").take(pa.array(row[part])),
                        pa.array(cell[part], "int32"),
                    ],
                    ["query_id", "query", "to_cell"],
                )

    return run


def _solve(size, k):
    def run(data, queries):
        import numpy as np
        import pyarrow as pa

        if not data.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], "int64"), "id": pa.array([], "int64"),
                             "score": pa.array([], "float64")})
        found = best_of_block(
            np.asarray(queries.column("query_id")),
            padded(queries.column("query"), size),
            np.asarray(data.column("id")),
            padded(data.column("vector"), size),
            k,
        )
        return pa.table(dict(zip(["query_id", "id", "score"], map(pa.array, found))))

    return run
