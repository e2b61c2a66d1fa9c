"""Gaussian mixtures for every word, covariance type and k at once.

The state is one row per model with its parameters in flat arrays. Words whose points fit in a
task take all their steps there, their models dealt over slices. For other words a step sends
the models to the blocks of points, which return sums of responsibilities and
moments; their totals give the next parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
import math
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtide.operators import blocks as B
from wordtide.operators import kmeans as K
from wordtide.operators.arrays import lists, matrix
from wordtide.operators.kmeans import settled
from wordtide.operators.scores import information_criteria
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The types in the order in which they are tried.
COVARIANCE_TYPES = ["full", "spherical", "tied", "diag"]
RIDGE = 1e-6
# Stands for the likelihood of models that have no parameters yet.
NO_LIKELIHOOD = -1e100
PARAMETERS = "weights array<double>, means array<double>, covariances array<double>"
# Points of a word up to this size are a task's.
TASK_BYTES = 64 << 20
# Parameters that a task or the driver handles at a time.
STATE_BYTES = 32 << 20
# Largest error of a log density for which it may be taken from sums of products.
ROUNDING = 1e-9


def fit(
    points: DataFrame,
    group: Sequence[str],
    k_range: Sequence[int],
    covariance_types: Sequence[str] | str | None = None,
    max_iter: int = 1000,
    starts: int = 5,
    seed: int = 42,
    tol: float = 1e-3,
    block_rows: int = B.BLOCK_ROWS,
) -> DataFrame:
    """Best start of each model: group, covariance, k, parameters, log_likelihood, aic, bic.

    Models start from k-means clusters and stop once the mean log-likelihood
    gains less than tol; `converged` tells which did so within max_iter.
    """
    group = list(group)
    types = [covariance_types] if isinstance(covariance_types, str) else list(covariance_types or COVARIANCE_TYPES)
    counts = cut_lineage(B.block_counts(points, group, block_rows).join(K.mean_variance(points, group), group))
    blocks = B.with_blocks(points.select(*group, "usage_id", "vector"), counts, group, "usage_id")
    first = cut_lineage(K.start_centroids(blocks, counts, group, k_range, starts, seed))
    size = F.size("centroids") / F.col("k")
    held = first.join(counts.select(*group, "points"), group).groupBy(*group).agg(
        F.max(size).cast("int").alias("dims"), (F.max(size * F.col("points")) * 8 <= TASK_BYTES).alias("fits")
    )
    held = cut_lineage(held)
    words = {r["fits"]: r for r in held.groupBy("fits").agg(F.count("*").alias("n"), F.max("dims").alias("dims")).collect()}
    fitted = []
    if True in words:
        sizes = [k for k in sorted({int(k) for k in k_range}) for _ in range(starts)]
        slices = _slices(sizes, types, words[True], points.sparkSession.sparkContext.defaultParallelism)
        small = held.where("fits").select(*group)
        fitted.append(_in_tasks(blocks, counts, first, small, group, types, max_iter, tol, slices, words[True]["n"]))
    if False in words:
        large = first.join(held.where("not fits").select(*group), group, "left_semi")
        fitted += _by_steps(blocks, counts, cut_lineage(large), group, types, max_iter, tol)
    if not fitted:
        fitted.append(_in_tasks(blocks, counts, first, held.select(*group), group, types, max_iter, tol, 1, 1))
    result = fitted[0]
    for more in fitted[1:]:
        result = result.unionByName(more)
    keys = [*group, "covariance", "k", "start"]
    best = result.groupBy(*group, "covariance", "k").agg(
        F.max_by("start", F.struct(F.nanvl("log_likelihood", F.lit(NO_LIKELIHOOD)), -F.col("start"))).alias("start")
    )
    chosen = result.join(best, keys, "left_semi").join(counts.select(*group, "points"), group)
    criteria = information_criteria(
        F.col("log_likelihood"),
        F.col("covariance"),
        F.col("k"),
        (F.size("means") / F.col("k")).cast("int"),
        F.col("points"),
    )
    fitted = cut_lineage(chosen.withColumns(criteria).drop("start", "points"))
    blocks.unpersist()
    return fitted


def _slices(sizes: list[int], types: list[str], words, cores: int) -> int:
    """Slices of a word's models: so many that all cores have some, and a slice's parameters are few."""
    wide = words["dims"] ** 2 if {"full", "tied"} & set(types) else 2 * words["dims"]
    least = math.ceil(8 * sum(sizes) * wide / STATE_BYTES)
    return min(len(sizes), max(1, least, math.ceil(B.PARTS_PER_CORE * cores / words["n"])))


def _in_tasks(
    blocks: DataFrame, counts: DataFrame, first: DataFrame, words: DataFrame, group: list[str],
    types: list[str], max_iter: int, tol: float, slices: int, n: int,
) -> DataFrame:
    """All steps of the models of the words given, by slices that each see all points of their word."""
    keys = [*group, "slice"]
    theirs = [f"_{key}" for key in keys]
    # Models are dealt to and fro by size, so that slices have about equal work.
    turn = (F.row_number().over(Window.partitionBy(*group).orderBy(F.col("k").desc(), "start")) - 1) % (2 * slices)
    dealt = F.when(turn < slices, turn).otherwise(2 * slices - 1 - turn)
    of = counts.select(*group, K.scale(counts).alias("_scale"))
    models = first.join(words, group, "left_semi").join(of, group).withColumn("slice", dealt)
    # A slice is few bytes and much work. Among many partitions, empty for the most part, few hold two.
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = min(16 * slices * n, max(1000, 4 * B.PARTS_PER_CORE * cores))
    sent = models.withColumnsRenamed(dict(zip(keys, theirs))).repartition(parts, *theirs)
    copied = B.attach_small(blocks, words, group, ["usage_id"]).select(
        *group, "vector", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    ).repartition(parts, *keys)
    schema = f"{_keyed(blocks, group)}, covariance string, k int, start int, {PARAMETERS}, log_likelihood double, converged boolean"
    run = B.with_group(_all_steps(types, max_iter, tol), group)
    return cut_lineage(copied.groupBy(*keys).cogroup(sent.groupBy(*theirs)).applyInArrow(run, schema))


def _by_steps(
    blocks: DataFrame, counts: DataFrame, first: DataFrame, group: list[str], types: list[str], max_iter: int, tol: float
) -> list[DataFrame]:
    """All steps of the models given as passes over the blocks, for some models at a time.

    The driver holds the parameters of the models at work, about STATE_BYTES, so steps are not written.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = blocks.sparkSession
    shaped = K.lloyd(blocks, counts, first, group, broadcast=B.fits_broadcast(first))
    none = F.array().cast("array<double>")
    start = shaped.select(
        *group,
        F.explode(F.array(*map(F.lit, types))).alias("covariance"),
        "k",
        "start",
        none.alias("weights"),
        F.col("centroids").alias("means"),
        none.alias("covariances"),
        F.lit(NO_LIKELIHOOD).alias("log_likelihood"),
    )
    start = cut_lineage(start)
    dims = F.size("means") / F.col("k")
    wide = F.when(F.col("covariance") == "full", F.size("means") * dims).when(F.col("covariance") == "tied", dims * dims)
    held = F.sum(8 * (F.coalesce(wide, F.size("means")) + F.size("means")))
    need, words = start.agg(held, F.count_distinct(*group)).first()
    turns, keys, ended = math.ceil(need / STATE_BYTES), [*group, "covariance", "k", "start"], []
    # Models of a word stay together where the words are many: a pass then meets the blocks of its words only.
    turn = F.pmod(F.xxhash64(*(group if words >= 4 * turns else keys)), F.lit(turns))
    for i in range(turns):
        own = start.where(turn == i)
        if own.isEmpty():
            continue
        # The first pass turns clusters into responsibilities of 0 and 1.
        moved = step(blocks, counts, own, group, True)
        schema, moving, rest = moved.schema, moved.toArrow(), []
        gain = (F.col("log_likelihood") - F.col("last")) / F.col("points")
        # A model whose likelihood is no number has come to its end, too.
        still = F.coalesce((F.abs(gain) < tol) | F.isnan(gain), F.lit(False))
        for _ in range(max_iter):
            sent = spark.createDataFrame(moving.select(schema.names), schema)
            moved = step(blocks, counts, sent, group, True).withColumn("still", still)
            stepped = moved.toArrow()
            rest.append(stepped.filter(stepped.column("still")))
            moving = stepped.filter(pc.invert(stepped.column("still")))
            if not moving.num_rows:
                break
        parameters = spark.createDataFrame(pa.concat_tables([*rest, moving]), moved.schema)
        final = cut_lineage(parameters.withColumnRenamed("still", "converged").drop("last", "points"))
        # One more pass scores the final parameters.
        scored = step(blocks, counts, final, group, True).select(*keys, "log_likelihood")
        ended.append(cut_lineage(final.drop("log_likelihood").join(scored, keys)))
    return ended


def step(blocks: DataFrame, counts: DataFrame, models: DataFrame, group: Sequence[str], broadcast: bool) -> DataFrame:
    """One expectation and maximisation.

    Gives the next parameters, log_likelihood of the models given, the one they
    carried as `last`, and the number of points.
    """
    named = models.select(
        *group, "covariance", "k", "start", "weights", "means", "covariances", F.col("log_likelihood").alias("last")
    )
    outcome = "covariance string, k int, start int, last double, sums array<double>"
    partial = B.per_block(blocks, counts, named, group, _expect, outcome, broadcast)
    summed = partial.groupBy(*group, "covariance", "k", "start").agg(
        F.first("last").alias("last"), B.sum_arrays("sums").alias("sums")
    )
    schema = f"{_keyed(blocks, group)}, covariance string, k int, start int, last double, {PARAMETERS}, log_likelihood double, points double"
    return summed.mapInArrow(_maximise, schema)


def _keyed(blocks: DataFrame, group: Sequence[str]) -> str:
    types = dict(blocks.dtypes)
    return ", ".join(f"`{g}` {types[g]}" for g in group)


def assign(points: DataFrame, models: DataFrame, group: Sequence[str], block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """group, usage_id, k, covariance, label, prob: probabilities of the components."""
    group = list(group)
    counts = cut_lineage(B.block_counts(points, group, block_rows))
    blocks = B.with_blocks(points.select(*group, "usage_id", "vector"), counts, group, "usage_id")
    types = dict(points.dtypes)
    schema = f"usage_id {types['usage_id']}, covariance string, k int, label int, prob array<double>"
    named = models.select(*group, "covariance", "k", F.lit(0).alias("start"), "weights", "means", "covariances")
    named = cut_lineage(named)
    broadcast = B.fits_broadcast(named)
    labels = cut_lineage(B.per_block(blocks, counts, named, group, _predict, schema, broadcast))
    blocks.unpersist()
    return labels


def best_models(fitted: DataFrame, group: Sequence[str], criterion: str) -> DataFrame:
    """The model of lowest aic or bic per group; of equals the one tried first."""
    if criterion not in ("aic", "bic"):
        raise ValueError(f"models are compared by aic or bic, not by {criterion!r}")
    turn = F.array_position(F.array(*map(F.lit, COVARIANCE_TYPES)), F.col("covariance"))
    row = F.struct(*[c for c in fitted.columns if c not in group])
    return fitted.groupBy(*group).agg(F.min_by(row, F.struct(criterion, turn, "k")).alias("_m")).select(
        *group, "_m.*"
    )


def _read_models(table):
    import numpy as np

    k, start = table.column("k").to_pylist(), table.column("start").to_pylist()
    for i, kind in enumerate(table.column("covariance").to_pylist()):
        weights, means, flat = (np.asarray(table.column(c)[i].values) for c in ("weights", "means", "covariances"))
        yield kind, k[i], start[i], weights, means.reshape(k[i], -1), flat


def _log_densities(x, kind, weights, means, flat):
    """Points x components: log of weight times density."""
    import numpy as np

    k, d = means.shape
    out = np.empty((len(x), k))
    for j in range(k):
        centred = x - means[j]
        if kind in ("full", "tied"):
            covariance = flat.reshape(-1, d, d)[j if kind == "full" else 0]
            lower = np.linalg.cholesky(covariance)
            scaled = np.linalg.solve(lower, centred.T)
            log_det = 2 * np.log(np.diag(lower)).sum()
            square = (scaled**2).sum(axis=0)
        else:
            variance = flat[j * d : (j + 1) * d] if kind == "diag" else np.full(d, flat[j])
            square = (centred**2 / variance).sum(axis=1)
            log_det = np.log(variance).sum()
        out[:, j] = np.log(weights[j]) - 0.5 * (d * np.log(2 * np.pi) + log_det + square)
    return out


def _responsibilities(x, kind, weights, means, flat):
    import numpy as np

    if not len(weights):
        gaps = ((x**2).sum(axis=1)[:, None] + (means**2).sum(axis=1)[None, :]) - 2 * x @ means.T
        return np.eye(len(means))[gaps.argmin(axis=1)], NO_LIKELIHOOD
    logs = _log_densities(x, kind, weights, means, flat)
    top = logs.max(axis=1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - whole[:, None]), whole.sum()


def _pairs(x, out):
    """Products of the rows of x, each with itself and the later ones, as np.triu_indices has them."""
    import numpy as np

    at, d = 0, len(x)
    for i in range(d):
        np.multiply(x[i], x[i:], out=out[at : at + d - i])
        at += d - i
    return out


def _symmetric(packed, d):
    import numpy as np

    row, column = np.triu_indices(d)
    out = np.empty((len(packed), d, d))
    out[:, row, column] = out[:, column, row] = packed
    return out


def _coefficients(kind, weights, means, flat):
    """Of the log of weight times density: constant, factors of x, of its squares or pairs, the largest row sum of each
    precision, the inverse factors of covariances, and for tied the precision, whose square form is the same for
    all components and left out.
    """
    import numpy as np

    k, d = means.shape
    precision = inverse = None
    if kind in ("full", "tied"):
        lower = np.linalg.cholesky(flat.reshape(-1, d, d))
        inverse = np.linalg.inv(lower)
        precision = inverse.transpose(0, 2, 1) @ inverse
        log_det = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        of_x = (np.broadcast_to(precision, (k, d, d)) @ means[:, :, None])[:, :, 0]
        most = np.broadcast_to(np.abs(precision).sum(axis=2).max(axis=1), k)
        row, column = np.triu_indices(d)
        of_second = precision[:, row, column] * np.where(row == column, -0.5, -1.0) if kind == "full" else None
    else:
        variance = flat.reshape(k, d) if kind == "diag" else np.repeat(flat[:, None], d, axis=1)
        of_x, of_second, most = means / variance, -0.5 / variance, (1 / variance).max(axis=1)
        log_det = np.log(variance).sum(axis=1)
    square = (of_x * means).sum(axis=1)
    whole = np.log(weights) - 0.5 * (d * np.log(2 * np.pi) + log_det)
    return whole, whole - 0.5 * square, of_x, of_second, most, inverse, precision


def _exactly(turned, mean, constant, root):
    """Log of weight times density of a component from differences; root: of the precision, a matrix or its diagonal."""
    centred = turned - mean[:, None]
    scaled = root @ centred if root.ndim == 2 else root[:, None] * centred
    return constant - 0.5 * (scaled**2).sum(axis=0)


def _totals(x, models, moments=True):
    """Of each model (kind, weights, means, covariances): log-likelihood, shares, first and second moments; without moments, these are 0.

    Second moments are packed ones for full and tied, squares for others. Models without weights
    give each point to the nearest mean.
    """
    order = sorted(range(len(models)), key=lambda i: ("full", "diag", "spherical", "tied").index(models[i][0]))
    found, d = {}, x.shape[1]
    while order:
        some, room = [], STATE_BYTES // 8
        while order and (not some or room > 0):
            some.append(order.pop(0))
            kind, _, means, _ = models[some[-1]]
            room -= len(means) * d * ((d + 1) // 2 if kind == "full" else 1)
        found |= dict(zip(some, _some_totals(x, [models[i] for i in some], moments)))
    return [found[i] for i in range(len(models))]


def _some_totals(x, models, moments):
    """Totals of models that are sorted by kind.

    Log densities of all components are sums of a point's values, squares and pairs times factors, and moments
    are sums of these times shares, so both are matrix products over the components of all models.
    Components whose precision is too large for that are taken one by one, from differences.
    """
    import numpy as np

    n, d = x.shape
    p = d * (d + 1) // 2
    sizes = [len(means) for _, _, means, _ in models]
    ends = np.cumsum([0, *sizes])
    c = ends[-1]
    full, plain = (sum(k for k, m in zip(sizes, models) if m[0] in kinds) for kinds in (("full",), ("diag", "spherical")))
    constant, of_x = np.zeros(c), np.zeros((c, d))
    of_pairs, of_squares = np.zeros((full, p)), np.zeros((plain, d))
    radius = max(np.einsum("ij,ij->i", x, x).max(initial=0.0), max((m[2] ** 2).sum(axis=1).max() for m in models))
    scatter = x.T @ x if models[-1][0] == "tied" else None
    likelihood, fresh, direct = np.zeros(len(models)), [], []
    for i, model in enumerate(models):
        kind, weights, means, _ = model
        low, high = ends[i], ends[i + 1]
        if not len(weights):
            fresh.append(i)
            continue
        whole, constant[low:high], of_x[low:high], of_second, most, inverse, precision = _coefficients(*model)
        if kind == "full":
            of_pairs[low:high] = of_second
        elif kind != "tied":
            of_squares[low - full : high - full] = of_second
        rough = ~(most * radius * np.finfo(float).eps <= ROUNDING)
        for j in np.flatnonzero(rough):
            root = np.sqrt(-2 * of_second[j]) if inverse is None else inverse[j if kind == "full" else 0]
            direct.append((low + j, means[j], whole[j], root))
        if kind == "tied" and not rough.any():
            likelihood[i] = -0.5 * (precision[0] * scatter).sum()
    count, first = np.zeros(c), np.zeros((c, d))
    pair_sums, square_sums = np.zeros((full, p)), np.zeros((plain, d))
    rows = min(512, max(64, (1 << 20) // p))
    buffer = np.empty((p, min(rows, n))) if full else None
    for at in range(0, n, rows):
        part = x[at : at + rows]
        turned = np.ascontiguousarray(part.T)
        share = of_x @ turned
        share += constant[:, None]
        if full:
            pairs = _pairs(turned, buffer[:, : len(part)])
            if len(fresh) < len(models):
                share[:full] += of_pairs @ pairs
        if plain:
            squares = turned**2
            share[full : full + plain] += of_squares @ squares
        for j, *component in direct:
            share[j] = _exactly(turned, *component)
        top = np.maximum.reduceat(share, ends[:-1], axis=0)
        share -= np.repeat(top, sizes, axis=0)
        np.exp(share, out=share)
        total = np.add.reduceat(share, ends[:-1], axis=0)
        share /= np.repeat(total, sizes, axis=0)
        likelihood += (top + np.log(total)).sum(axis=1)
        for i in fresh:
            means = models[i][2]
            gaps = ((part**2).sum(axis=1)[:, None] + (means**2).sum(axis=1)[None, :]) - 2 * part @ means.T
            share[ends[i] : ends[i + 1]] = np.eye(len(means))[gaps.argmin(axis=1)].T
        if not moments:
            continue
        count += share.sum(axis=1)
        first += share @ part
        if full:
            pair_sums += share[:full] @ pairs.T
        if plain:
            square_sums += share[full : full + plain] @ squares.T
    likelihood[fresh] = NO_LIKELIHOOD
    found = []
    for i, (kind, _, _, _) in enumerate(models):
        low, high = ends[i], ends[i + 1]
        if kind == "full":
            second = pair_sums[low:high]
        elif kind == "tied":
            second = scatter[np.triu_indices(d)]
        else:
            second = square_sums[low - full : high - full]
        found.append(np.concatenate([[likelihood[i]], count[low:high], first[low:high].ravel(), second.ravel()]))
    return found


def _next(kind, k, sums):
    """Weights, means and covariances of the totals of a model."""
    import numpy as np

    rest = sums[1 + k :]
    # Length left: k*d first moments and the second moments of the type.
    per = {"diag": 2 * k, "spherical": 2 * k}.get(kind)
    if per:
        d = len(rest) // per
    else:
        blocks = k if kind == "full" else 1
        linear = 2 * k + blocks
        d = int(round((-linear + (linear**2 + 8 * blocks * len(rest)) ** 0.5) / (2 * blocks)))
    n = sums[1 : 1 + k] + 10 * np.finfo(float).eps
    centre = rest[: k * d].reshape(k, d) / n[:, None]
    second = rest[k * d :]
    if kind == "full":
        square = _symmetric(second.reshape(k, -1) / n[:, None], d) - centre[:, :, None] * centre[:, None, :]
        spread = square + RIDGE * np.eye(d)
    elif kind == "tied":
        spread = (_symmetric(second[None, :], d)[0] - (n[:, None] * centre).T @ centre) / n.sum() + RIDGE * np.eye(d)
    else:
        spread = second.reshape(k, d) / n[:, None] - centre**2 + RIDGE
        if kind == "spherical":
            spread = spread.mean(axis=1)
    return n / n.sum(), centre, np.asarray(spread).ravel()


def _all_steps(types, max_iter, tol):
    """Clusters and all steps of the mixtures of points that a task holds."""

    def run(points, models):
        import pyarrow as pa

        x, rows = matrix(points, "vector"), []
        clusters = [(start, k, centroids) for start, k, centroids, *_ in settled(x, models)]
        waiting = [(kind, k, start, centroids) for kind in types for start, k, centroids in clusters]
        while waiting:
            some, room = [], STATE_BYTES // 8
            while waiting and (not some or room > 0):
                some.append(waiting.pop(0))
                room -= some[-1][1] * x.shape[1] * (x.shape[1] if some[-1][0] == "full" else 1)
            ended = _settle_mixtures(x, [(kind, centroids) for kind, _, _, centroids in some], max_iter, tol)
            rows += [(kind, k, start, *end) for (kind, k, start, _), end in zip(some, ended)]
        kind, k, start, weights, means, covariances, likelihood, converged = zip(*rows)
        many = pa.list_(pa.float64())
        return {
            "covariance": pa.array(kind),
            "k": pa.array(k, "int32"),
            "start": pa.array(start, "int32"),
            "weights": pa.array(weights, many),
            "means": pa.array([m.ravel() for m in means], many),
            "covariances": pa.array(covariances, many),
            "log_likelihood": pa.array(likelihood, "float64"),
            "converged": pa.array(converged),
        }

    return run


def _settle_mixtures(x, begun, max_iter, tol):
    """weights, means, covariances, log-likelihood, whether converged, of models given by kind and centroids.

    The models take their steps side by side, each until its own end.
    """
    import numpy as np

    # The first pass turns clusters into responsibilities of 0 and 1.
    models = [(kind, np.empty(0), centroids, np.empty(0)) for kind, centroids in begun]
    last, converged, moving = [NO_LIKELIHOOD] * len(models), [False] * len(models), list(range(len(models)))
    for turn in range(max_iter + 1):
        for i, sums in zip(moving, _totals(x, [models[i] for i in moving])):
            kind, _, means, _ = models[i]
            k = len(means)
            gain, last[i] = (sums[0] - last[i]) / sums[1 : 1 + k].sum(), sums[0]
            # A model whose likelihood is no number has come to its end, too.
            converged[i] = bool(turn and (abs(gain) < tol or np.isnan(gain)))
            models[i] = (kind, *_next(kind, k, sums))
        moving = [i for i in moving if not converged[i]]
        if not moving:
            break
    # One more pass scores the final parameters.
    scored = [sums[0] for sums in _totals(x, models, moments=False)]
    return [(*model[1:], score, end) for model, score, end in zip(models, scored, converged)]


def _expect(points, models):
    import pyarrow as pa

    held = list(_read_models(models))
    sums = _totals(matrix(points, "vector"), [(kind, weights, means, flat) for kind, _, _, weights, means, flat in held])
    kind, k, start, *_ = zip(*held)
    return {
        "covariance": pa.array(kind),
        "k": pa.array(k, "int32"),
        "start": pa.array(start, "int32"),
        "last": models.column("last").combine_chunks(),
        "sums": pa.array(sums, pa.list_(pa.float64())),
    }


def _maximise(batches):
    import numpy as np
    import pyarrow as pa

    many = pa.list_(pa.float64())
    for batch in batches:
        table = pa.Table.from_batches([batch])
        weights, means, covariances, scores, points = [], [], [], [], []
        sizes = table.column("k").to_pylist()
        for i, kind in enumerate(table.column("covariance").to_pylist()):
            k, sums = sizes[i], np.asarray(table.column("sums")[i].values)
            weight, centre, spread = _next(kind, k, sums)
            weights.append(weight)
            means.append(centre.ravel())
            covariances.append(spread)
            scores.append(sums[0])
            points.append(sums[1 : 1 + k].sum())
        kept = [c for c in table.column_names if c != "sums"]
        out = {
            "weights": pa.array(weights, many),
            "means": pa.array(means, many),
            "covariances": pa.array(covariances, many),
            "log_likelihood": pa.array(scores, "float64"),
            "points": pa.array(points, "float64"),
        }
        yield from pa.table({**{c: table.column(c) for c in kept}, **out}).to_batches()


def _predict(points, models):
    import numpy as np
    import pyarrow as pa

    x = matrix(points, "vector")
    parts = []
    for kind, k, _, weights, means, flat in _read_models(models):
        share, _ = _responsibilities(x, kind, weights, means, flat)
        parts.append(
            pa.table(
                {
                    "usage_id": points.column("usage_id"),
                    "covariance": pa.array([kind] * len(x)),
                    "k": pa.array([k] * len(x), "int32"),
                    "label": pa.array(share.argmax(axis=1).astype("int32")),
                    "prob": lists(share),
                }
            )
        )
    out = pa.concat_tables(parts)
    return {c: out.column(c).combine_chunks() for c in out.column_names}
