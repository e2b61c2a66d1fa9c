"""k-means for every word and every k at once.

The state is a table (word, start, k, cluster, centroid). A step sends it to the
blocks of points, takes partial sums there, and adds them up by cluster. Models of a word
whose points are a single block take all their steps there. Seeds come from a few passes
over the points, however many are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
import sys

from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wordtide.operators import blocks as B
from wordtide.operators.arrays import lists, matrix
from wordtide.operators.ranking import top_per_group
from wordtide.session import cut_lineage, read_steps, write_step

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = ["start", "k", "cluster"]
# Passes that draw candidates for seeds, and how many each draws as a multiple of the largest k.
ROUNDS = 2
EXTRA = 5
# Steps of a fit at most, and the shift at which a model stands still.
STEPS = 300
SHIFT = 1e-4


def start_centroids(
    blocks: DataFrame,
    counts: DataFrame,
    group: Sequence[str],
    k_range: Sequence[int],
    starts: int = 1,
    seed: int = 42,
    below: bool = True,
) -> DataFrame:
    """Packed first centroids by oversampling (k-means||): group, start, k, centroids.

    Every word and start takes the point with the smallest -ln(u). Each of ROUNDS passes adds the
    EXTRA * k points, k being the largest asked for, with the smallest -ln(u) / gap, gap being the
    squared distance to the nearest candidate so far: draws in proportion to gap. Candidates weigh as
    many points as they are nearest to. Among them seeds are drawn one after the other, the next
    being that with the smallest -ln(u) / (weight * gap); without a gap left the first is taken again.
    u comes from the md5 of seed, start, the name of the draw and id, so it does not depend on how
    points are placed. Seeds for k are the first k of one sequence. A group gets the k below its
    size, or up to it if not `below`.
    """
    group, sizes = list(group), sorted({int(k) for k in k_range})
    kind = dict(blocks.dtypes)["usage_id"]
    each, most = [*group, "start"], max(sizes)
    start = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")
    first = blocks.select(*group, "usage_id", "vector", start).groupBy(*each).agg(
        F.min_by(F.struct("usage_id", "vector"), F.struct(_race(seed, F.col("start"), "0"), F.col("usage_id"))).alias("_p")
    )
    taken = cut_lineage(first.select(*each, F.array("_p.usage_id").alias("ids"), F.col("_p.vector").alias("centroids")), "seeds")
    schema = f"start int, score double, usage_id {kind}, vector array<double>"
    for turn in range(1, ROUNDS + 1):
        races = blocks.withColumn("race", F.array(*[_race(seed, F.lit(i), str(turn)) for i in range(starts)]))
        found = B.per_block(races, counts, taken, group, _draw(EXTRA * most), schema, B.fits_broadcast(taken))
        best = top_per_group(found, each, [F.col("score"), F.col("usage_id")], EXTRA * most, ["usage_id"])
        rows = F.array_sort(F.collect_list(F.struct("rank", "usage_id", "vector")))
        more = best.groupBy(*each).agg(rows.alias("_more"))
        taken = cut_lineage(
            taken.join(more, each, "left").select(
                *each,
                F.concat("ids", F.coalesce(F.transform("_more", lambda r: r["usage_id"]), F.array().cast(f"array<{kind}>"))).alias("ids"),
                F.concat(
                    "centroids", F.coalesce(F.flatten(F.transform("_more", lambda r: r["vector"])), F.array().cast("array<double>"))
                ).alias("centroids"),
            ),
            "seeds",
        )
    weighed = B.per_block(
        blocks, counts, taken, group, _weights, "start int, n array<double>", B.fits_broadcast(taken)
    ).groupBy(*each).agg(B.sum_arrays("n").alias("weights"))
    draw = lambda place: lambda i: _race(seed, F.col("start"), f"seed{place}", i)
    drawn = F.array(*[F.transform("ids", draw(place)) for place in range(most)])
    ready = taken.join(weighed, each).join(counts.select(*group, "points"), group).withColumn("races", drawn)
    types = dict(blocks.dtypes)
    keyed = ", ".join(f"`{g}` {types[g]}" for g in group)
    reduced = ready.select(*each, "points", "centroids", "weights", "races").mapInArrow(
        _reduce(group, most), f"{keyed}, start int, points long, centroids array<double>, seeds int"
    )
    wanted = F.explode(F.array(*map(F.lit, sizes))).alias("k")
    fits = F.col("k") < F.col("points") if below else F.col("k") <= F.col("points")
    size = (F.size("centroids") / F.col("seeds")).cast("int")
    return reduced.select("*", wanted).where(fits).select(
        *group, "start", "k", F.slice("centroids", F.lit(1), F.col("k") * size).alias("centroids")
    )


def _race(seed: int, start: Column, draw: str, key: Column | str = "usage_id") -> Column:
    """-ln(u) of a draw, u in (0, 1) from the first 13 hexadecimal digits of an md5."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), start.cast("string"), F.lit(draw), key.cast("string")))
    return -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / (16.0**13 + 1))


def lloyd(
    blocks: DataFrame,
    counts: DataFrame,
    models: DataFrame,
    group: Sequence[str],
    max_iter: int = STEPS,
    tol: float = SHIFT,
    broadcast: bool = False,
) -> DataFrame:
    """Repeat assign and update until the packed centroids of every model stand still.

    tol bounds the summed squared shift of a model as a share of its points' mean variance
    (1 if `counts` has no column `variance`). `converged` tells which models did
    not merely reach max_iter.
    """
    group = list(group)
    of = counts.select(*group, scale(counts).alias("_scale"), "blocks")
    scaled = cut_lineage(models.select(*group, "start", "k", "centroids").join(of, group), "models")
    alone = scaled.where("blocks = 1").drop("blocks")
    schema = "start int, k int, centroids array<double>, n array<double>, cost double, converged boolean"
    ended = cut_lineage(B.per_block(blocks, counts, alone, group, _settle(max_iter, tol), schema, broadcast), "ended")
    moving, paths = scaled.where("blocks > 1").select(*group, "start", "k", "centroids"), []
    if moving.isEmpty():
        return ended
    for _ in range(max_iter):
        seen = Observation()
        moved = step(blocks, counts, moving, group, broadcast).join(of.drop("blocks"), group)
        moved = moved.withColumn("shift", F.col("shift") / F.col("_scale")).drop("_scale")
        moved = moved.observe(seen, F.count_if(F.col("shift") > tol).alias("moving"))
        paths.append(write_step(moved))
        moving = read_steps(moved, paths[-1:]).where(F.col("shift") > tol)
        if not seen.get["moving"]:
            break
    # Every model rests in the table of its last step; those cut off still move.
    resting = read_steps(moved, paths).where(F.col("shift") <= tol)
    rest = resting.withColumn("converged", F.lit(True)).unionByName(moving.withColumn("converged", F.lit(False)))
    return cut_lineage(ended.unionByName(rest.drop("shift")))


def scale(counts: DataFrame) -> Column:
    """What shifts of a group are measured by: its mean variance, 1 if that is 0 or unknown."""
    known = F.col("variance") if "variance" in counts.columns else F.lit(1.0)
    return F.when(known > 0, known).otherwise(1.0)


def mean_variance(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, variance: the mean over the dimensions of the variance of each."""
    spread = vector_to_array(Summarizer.variance(array_to_vector(F.col("vector"))))
    found = points.groupBy(*group).agg(spread.alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x)
    return found.select(*group, (total / F.size("_v")).alias("variance"))


def packed(centroids: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per model, the centroids of its clusters behind each other in one array."""
    rows = F.array_sort(F.collect_list(F.struct("cluster", "centroid")))
    return centroids.groupBy(*group, "start", "k").agg(
        F.flatten(F.transform(rows, lambda r: r["centroid"])).alias("centroids")
    )


def unpacked(models: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, start, k, cluster, centroid, n, and converged where it is known."""
    kept = [*group, *STATE]
    also = ["converged"] if "converged" in models.columns else []
    size = (F.size("centroids") / F.col("k")).cast("int")
    return models.select("*", F.posexplode("n").alias("cluster", "_n")).select(
        *kept,
        *also,
        F.slice("centroids", F.col("cluster") * size + 1, size).alias("centroid"),
        F.col("_n").cast("long").alias("n"),
    )


def step(
    blocks: DataFrame, counts: DataFrame, models: DataFrame, group: Sequence[str], broadcast: bool = False
) -> DataFrame:
    """One assign and update of packed models: group, start, k, centroids, n, cost, shift.

    A cluster without points keeps its centroid.
    """
    schema = "start int, k int, n array<double>, cost double, totals array<double>, previous array<double>"
    partial = B.per_block(
        blocks, counts, models.select(*group, "start", "k", "centroids"), group, _partial_sums, schema, broadcast
    )
    summed = partial.groupBy(*group, "start", "k").agg(
        B.sum_arrays("n").alias("n"),
        F.sum("cost").alias("cost"),
        B.sum_arrays("totals").alias("totals"),
        F.first("previous").alias("previous"),
    )
    # Element i belongs to cluster floor(i / dimensions).
    of = "n[cast(floor(i / (size(totals) / k)) as int)]"
    mean = f"transform(totals, (t, i) -> if({of} > 0, t / {of}, previous[i]))"
    gap = "aggregate(zip_with(centroids, previous, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)"
    kept = [*group, "start", "k", "centroids", "n", "cost"]
    return summed.selectExpr("*", f"{mean} as centroids").selectExpr(*kept, f"{gap} as shift")


def assign(
    blocks: DataFrame, counts: DataFrame, models: DataFrame, group: Sequence[str], broadcast: bool = False
) -> DataFrame:
    """group, usage_id, start, k, label, distance to the nearest centroid."""
    types = dict(blocks.dtypes)
    schema = f"usage_id {types['usage_id']}, start int, k int, label int, distance double"
    return B.per_block(
        blocks, counts, models.select(*group, "start", "k", "centroids"), group, _labels, schema, broadcast
    )


def fit(
    points: DataFrame,
    group: Sequence[str],
    k_range: Sequence[int],
    starts: int = 1,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
    block_rows: int = B.BLOCK_ROWS,
    below: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Centroids and labels of the best start for each group and k.

    Points have the group columns, usage_id and vector. A group gets the k below its
    size, or up to it if not `below`; one too small for every k has no model.
    """
    group = list(group)
    counted = B.block_counts(points, group, block_rows).join(mean_variance(points, group), group)
    counts = cut_lineage(counted)
    blocks = B.with_blocks(points.select(*group, "usage_id", "vector"), counts, group, "usage_id")
    models = cut_lineage(start_centroids(blocks, counts, group, k_range, starts, seed, below))
    broadcast = B.fits_broadcast(models)
    state = lloyd(blocks, counts, models, group, max_iter, tol, broadcast)
    if starts > 1:
        best = state.groupBy(*group, "k").agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
        state = cut_lineage(state.join(best, [*group, "k", "start"], "left_semi"))
    labels = cut_lineage(assign(blocks, counts, state, group, broadcast))
    blocks.unpersist()
    return unpacked(state, group).drop("start"), labels.drop("start")


def _models(table):
    """start, k and the centroid matrix of each model among the rows."""
    import numpy as np

    starts, sizes = table.column("start").to_pylist(), table.column("k").to_pylist()
    for start, k, centroids in zip(starts, sizes, table.column("centroids")):
        yield start, k, np.asarray(centroids.values).reshape(k, -1)


def _nearest(points, centroids, squares=None):
    import numpy as np

    own = (points**2).sum(axis=1) if squares is None else squares
    sums = own[:, None] + (centroids**2).sum(axis=1)[None, :]
    gaps = np.maximum(sums - 2 * (points @ centroids.T), 0.0)
    labels = gaps.argmin(axis=1)
    return labels, gaps[np.arange(len(points)), labels]


def _partial_sums(points, models):
    import numpy as np
    import pyarrow as pa

    vectors = matrix(points, "vector")
    rows = []
    for start, k, centroids in _models(models):
        labels, gaps = _nearest(vectors, centroids)
        member = np.eye(k)[labels]
        rows.append((start, k, member.sum(axis=0), gaps.sum(), (member.T @ vectors).ravel(), centroids.ravel()))
    start, k, n, cost, totals, previous = zip(*rows)
    many = pa.list_(pa.float64())
    return {
        "start": pa.array(start, "int32"),
        "k": pa.array(k, "int32"),
        "n": pa.array(n, many),
        "cost": pa.array(cost, "float64"),
        "totals": pa.array(totals, many),
        "previous": pa.array(previous, many),
    }


def _labels(points, models):
    import numpy as np
    import pyarrow as pa

    vectors = matrix(points, "vector")
    found = []
    for start, k, centroids in _models(models):
        labels, _ = _nearest(vectors, centroids)
        found.append((start, k, labels, np.linalg.norm(vectors - centroids[labels], axis=1)))
    rows = len(vectors)
    return {
        "usage_id": pa.concat_arrays([points.column("usage_id").combine_chunks()] * len(found)),
        "start": pa.array(np.repeat([f[0] for f in found], rows).astype("int32")),
        "k": pa.array(np.repeat([f[1] for f in found], rows).astype("int32")),
        "label": pa.array(np.concatenate([f[2] for f in found]).astype("int32")),
        "distance": pa.array(np.concatenate([f[3] for f in found])),
    }


def _settle(max_iter, tol):
    """All steps of the models of points that are a single block."""

    def run(points, models):
        import pyarrow as pa

        rows = settled(matrix(points, "vector"), models, max_iter, tol)
        start, k, centroids, n, cost, converged = zip(*rows)
        many = pa.list_(pa.float64())
        return {
            "start": pa.array(start, "int32"),
            "k": pa.array(k, "int32"),
            "centroids": pa.array([c.ravel() for c in centroids], many),
            "n": pa.array(n, many),
            "cost": pa.array(cost, "float64"),
            "converged": pa.array(converged),
        }

    return run


def settled(vectors, models, max_iter=STEPS, tol=SHIFT):
    """start, k, centroids, n, cost, whether converged of each model after all its steps."""
    import numpy as np

    rows, squares = [], (vectors**2).sum(axis=1)
    finite = np.isfinite(squares).all()
    for (start, k, centroids), scale in zip(_models(models), models.column("_scale").to_pylist()):
        converged, ones = False, np.eye(k)
        for _ in range(max_iter):
            labels, gaps = _nearest(vectors, centroids, squares)
            n = np.bincount(labels, minlength=k).astype("float64")
            if finite:
                total = ones[labels].T @ vectors
            else:  # A point that is no number is one of its own cluster only.
                total = np.zeros_like(centroids)
                np.add.at(total, labels, vectors)
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
            shift, centroids = ((moved - centroids) ** 2).sum() / scale, moved
            if shift <= tol:
                converged = True
                break
        rows.append((start, k, centroids, n, gaps.sum(), converged))
    return rows


def _candidates(models, dims):
    """start and the matrix of candidates of each row."""
    import numpy as np

    for start, centroids in zip(models.column("start").to_pylist(), models.column("centroids")):
        yield start, np.asarray(centroids.values, dtype="float64").reshape(-1, dims)


def _gaps(vectors, candidates):
    """Squared distance to the nearest candidate, exact, and its place."""
    import numpy as np

    best, place = np.full(len(vectors), np.inf), np.zeros(len(vectors), dtype="int64")
    for i, candidate in enumerate(candidates):
        gap = ((vectors - candidate) ** 2).sum(axis=1)
        nearer = gap < best
        best[nearer], place[nearer] = gap[nearer], i
    return best, place


def _draw(most):
    """The points of a block that each start would take next, at most so many."""

    def run(points, models):
        import numpy as np
        import pyarrow as pa

        vectors, races = matrix(points, "vector"), matrix(points, "race")
        starts, scores, picked = [], [], []
        for start, candidates in _candidates(models, vectors.shape[1]):
            gaps, _ = _gaps(vectors, candidates)
            score = np.divide(races[:, start], gaps, out=np.full(len(gaps), np.inf), where=gaps > 0)
            # All that equal the last one go on: ids decide between them.
            bound = np.partition(score, most - 1)[most - 1] if len(score) > most else np.inf
            rows = np.flatnonzero((score <= bound) & (score < np.inf))
            starts += [start] * len(rows)
            scores.append(score[rows])
            picked.append(rows)
        rows = np.concatenate(picked)
        return {
            "start": pa.array(starts, "int32"),
            "score": pa.array(np.concatenate(scores)),
            "usage_id": points.column("usage_id").combine_chunks().take(pa.array(rows)),
            "vector": lists(vectors[rows]),
        }

    return run


def _weights(points, models):
    """How many points of a block each candidate is nearest to."""
    import numpy as np
    import pyarrow as pa

    vectors, starts, counts = matrix(points, "vector"), [], []
    for start, candidates in _candidates(models, vectors.shape[1]):
        starts.append(start)
        counts.append(np.bincount(_gaps(vectors, candidates)[1], minlength=len(candidates)).astype("float64"))
    return {"start": pa.array(starts, "int32"), "n": pa.array(counts, pa.list_(pa.float64()))}


def _reduce(group, most):
    """Seeds among the candidates of each row, drawn one after the other."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found, numbers = [], []
            for i, size in enumerate(column["points"].to_pylist()):
                weights = np.asarray(column["weights"][i].values)
                candidates = np.asarray(column["centroids"][i].values).reshape(len(weights), -1)
                races = [np.asarray(r.values) for r in column["races"][i]]
                picked = []
                for place in range(min(most, size)):
                    gaps = _gaps(candidates, candidates[picked])[0] if picked else np.ones(len(weights))
                    pull = weights * gaps
                    score = np.divide(races[place], pull, out=np.full(len(pull), np.inf), where=pull > 0)
                    picked.append(int(score.argmin()) if score.min() < np.inf else picked[0] if picked else 0)
                found.append(candidates[picked].ravel())
                numbers.append(len(picked))
            names = [*group, "start", "points", "centroids", "seeds"]
            columns = [*(column[c] for c in [*group, "start", "points"]), pa.array(found, pa.list_(pa.float64())), pa.array(numbers, "int32")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
