"""Usage vectors to usage types: standardise, sweep k, keep the best clustering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.functions.vectors import finite
from wordtide.operators import blocks, kmeans, mixture, scores, vectors
from wordtide.operators.usage import nearest_centroid, nearest_members, prototypes
from wordtide.session import cut_lineage

K_RANGE = tuple(range(2, 11))
SILHOUETTE = "silhouette"
# Names of the criterion.
CALINSKI = ("calinski", "harabasz", "calinski-harabasz")
# A measure of its own, linear in the usages of a word.
SQUARED = "squared-silhouette"

MODEL_COLUMNS = ["word", "method", "k", "covariance", "criterion", "score", "converged", "weights", "means", "covariances"]


def kmeans_scores(points: DataFrame, labels: DataFrame, k_range: Sequence[int], criterion: str) -> DataFrame:
    """word, k, score of every fitted k."""
    if criterion not in (SILHOUETTE, SQUARED, *CALINSKI):
        raise ValueError(f"k-means is scored by silhouette, {SQUARED} or calinski, not by {criterion!r}")
    sizes = sorted(int(k) for k in k_range)
    if criterion != SILHOUETTE:
        labelled = points.join(labels.select("word", "usage_id", "k", "label"), ["word", "usage_id"])
        measure = scores.squared_silhouette if criterion == SQUARED else scores.calinski_harabasz
        return measure(labelled, ["word", "k"])
    wide = labels.groupBy("word", "usage_id").agg(
        F.array(*[F.max(F.when(F.col("k") == k, F.col("label"))) for k in sizes]).alias("labels")
    )
    scored = scores.silhouette(points.join(wide, ["word", "usage_id"]), ["word"], sizes)
    return scored.select("word", F.get(F.lit(sizes), F.col("model")).alias("k"), "score")


def best_k(scored: DataFrame) -> DataFrame:
    """word, k, score of the highest score above -1; of equal scores the smaller k."""
    return (
        scored.where(F.col("score") > -1)
        .groupBy("word")
        .agg(F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("best"))
        .select("word", "best.*")
    )


def best_kmeans(
    points: DataFrame, k_range: Sequence[int] = K_RANGE, criterion: str = SILHOUETTE, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels and centroids of the best k of each word, and all scores."""
    centroids, labels = kmeans.fit(points, ["word"], k_range, seed=seed)
    scored = cut_lineage(kmeans_scores(points, labels, k_range, criterion))
    best = best_k(scored).select("word", "k")
    chosen = labels.join(best, ["word", "k"], "left_semi")
    return chosen, centroids.join(best, ["word", "k"], "left_semi"), scored


@dataclass
class Clusterings:
    """A fit of all words as tables; `sources.models` writes and reads them.

    scaling: word, mean, deviation. models: word, method, k, covariance, criterion, score,
    converged, weights, means, covariances (flat arrays; k-means has only means).
    scores: word, k, covariance, score of everything that was tried. labels: word, usage_id, k, label.
    """

    scaling: DataFrame
    models: DataFrame
    scores: DataFrame
    labels: DataFrame


def fit_clusterings(
    usages: DataFrame,
    method: str = "kmeans",
    k_range: Sequence[int] = K_RANGE,
    criterion: str | None = None,
    seed: int = 42,
    **options,
) -> Clusterings:
    """Standardise the usages of each word and keep the best model, with all that predicting takes.

    Usages: word, usage_id, vector. All words are fitted in the same jobs. The criterion is
    silhouette for kmeans and bic for gmm unless given. Usages without a word, or whose vector is
    null, empty or holds null, NaN or infinite entries, take no part in scaling and fit. Words with
    too few usages for a model have a scaling but no model and no labels.
    """
    if method not in ("kmeans", "gmm"):
        raise ValueError(f"usages are clustered by kmeans or gmm, not by {method!r}")
    if method == "gmm" and criterion not in (None, "aic", "bic"):
        raise ValueError(f"mixtures are scored by aic or bic, not by {criterion!r}")
    criterion = criterion or (SILHOUETTE if method == "kmeans" else "bic")
    sound = usages.where(F.col("word").isNotNull() & finite(F.col("vector"))).select("word", "usage_id", "vector")
    scaling = cut_lineage(vectors.moments(sound, ["word"]), "scaling")
    points = cut_lineage(scaled(sound, scaling), "points")
    none = F.lit(None).cast("array<double>")
    if method == "kmeans":
        labels, centroids, scored = best_kmeans(points, k_range, criterion, seed)
        state = kmeans.packed(centroids.withColumn("start", F.lit(0)), ["word"]).drop("start")
        ended = centroids.groupBy("word").agg(F.bool_and("converged").alias("converged"))
        parameters = state.join(ended, "word").join(scored, ["word", "k"]).select(
            "word", "k", F.lit("").alias("covariance"), "score", "converged", none.alias("weights"),
            F.col("centroids").alias("means"), none.alias("covariances"),
        )
        scores_ = scored.select("word", "k", F.lit("").alias("covariance"), "score")
    else:
        fitted = mixture.fit(points, ["word"], k_range, seed=seed, **options)
        chosen = cut_lineage(mixture.best_models(fitted, ["word"], criterion), "mixtures")
        labels = mixture.assign(points, chosen, ["word"])
        parameters = chosen.select(
            "word", "k", "covariance", F.col(criterion).alias("score"), "converged", "weights", "means", "covariances"
        )
        scores_ = fitted.select("word", "k", "covariance", F.col(criterion).alias("score"))
    named = {"method": F.lit(method), "criterion": F.lit(criterion)}
    models = parameters.withColumns(named).select(MODEL_COLUMNS)
    return Clusterings(scaling, models, scores_, labels.select("word", "usage_id", "k", "label"))


def scaled(usages: DataFrame, scaling: DataFrame) -> DataFrame:
    """Vectors in the space of a fit; usages of words without scaling, or of another length, go."""
    joined = blocks.attach_small(usages, scaling, ["word"], ["usage_id"]).where(F.size("vector") == F.size("mean"))
    return joined.withColumn("vector", vectors.in_units(F.col("vector"))).drop("mean", "deviation")


def predict(fitted: Clusterings, usages: DataFrame) -> DataFrame:
    """word, usage_id, k, label, distance, prob of every usage under the stored model of its word.

    Vectors are scaled as those of the fit were. k-means gives the distance to the nearest
    centroid, a mixture the probabilities of its components. Usages of words without a model, with
    a vector that is null, empty, not finite or of another length, or without a word, keep their
    rows with nulls. Usages without id are left out of the models and stay with nulls.
    """
    sound = usages.where(
        F.col("word").isNotNull() & F.col("usage_id").isNotNull() & finite(F.col("vector"))
    ).select("word", "usage_id", "vector")
    points = cut_lineage(scaled(sound, fitted.scaling), "points")
    parts = [
        _by_centroid(points, fitted.models.where("method = 'kmeans'")),
        _by_mixture(points, fitted.models.where("method = 'gmm'")),
    ]
    found = parts[0].unionByName(parts[1]).dropDuplicates(["word", "usage_id"])
    return usages.select("word", "usage_id").join(found, ["word", "usage_id"], "left")


def _by_centroid(points: DataFrame, models: DataFrame) -> DataFrame:
    size = (F.size("means") / F.col("k")).cast("int")
    rows = models.select("word", "k", "means", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cluster"))
    centroids = rows.select("word", "cluster", F.slice("means", F.col("cluster") * size + 1, size).alias("centroid"))
    near = nearest_centroid(points, centroids).withColumnRenamed("cluster", "label")
    return near.join(models.select("word", "k"), "word").select(
        "word", "usage_id", "k", "label", "distance", F.lit(None).cast("array<double>").alias("prob")
    )


def _by_mixture(points: DataFrame, models: DataFrame) -> DataFrame:
    named = models.select("word", "k", "covariance", "weights", "means", "covariances")
    met = points.join(named.select("word"), "word", "left_semi")
    found = mixture.assign(met, named, ["word"])
    return found.select("word", "usage_id", "k", "label", F.lit(None).cast("double").alias("distance"), "prob")


def cluster_usages(
    usages: DataFrame,
    method: str = "kmeans",
    k_range: Sequence[int] = K_RANGE,
    criterion: str | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """word, usage_id, k, label under the best model of each word, see `fit_clusterings`.

    Words with too few usages for a model, and usages that cannot take part, keep their rows,
    with null k and label.
    """
    found = fit_clusterings(usages, method, k_range, criterion, seed, **options).labels
    return usages.select("word", "usage_id").join(found, ["word", "usage_id"], "left")


def prototypes_of(
    fitted: Clusterings, usages: DataFrame, contexts: DataFrame, n: int = 5, farthest: bool = False, window: int = 10
) -> DataFrame:
    """word, cluster, rank, text: usages nearest to their centroid in the space of the fit, as text.

    contexts: usage_id, context (tokens), position. Members of mixtures have no distance and no prototypes.
    """
    assigned = predict(fitted, usages).where("distance is not null").withColumnRenamed("label", "cluster")
    members = cut_lineage(nearest_members(assigned, n=n, farthest=farthest), "members")
    return prototypes(members, contexts, window=window)
