"""Operators on usage vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.functions.vectors import sum_of_layers
from wordtide.operators import vectors as V
from wordtide.registry.common import DIMENSIONS, USAGES, exploded, rounded, usages, with_parts


def cosine_rank(spark, sf):
    points = usages(spark, sf)
    target = points.where("usage_id = 0").select("vector").first()["vector"]
    ranked = V.cosine_to_target(points, target).select("usage_id", rounded(F.col("cosine")).alias("cosine"))
    return ranked.orderBy(F.desc("cosine"), "usage_id")


def vector_pool(spark, sf):
    """Mean of the vectors of three neighbouring ids, taken as pieces of one usage."""
    pieces = usages(spark, sf).select(F.floor(F.col("usage_id") / 3).alias("usage"), F.lit(7).alias("layer"), "vector")
    return exploded(V.pool(pieces, ["usage", "layer"]), ["usage", "layer"], "vector")


def layer_sum(spark, sf):
    summed = usages(spark, sf).select("usage_id", sum_of_layers(F.col("vector"), 16).alias("vector"))
    return exploded(summed, ["usage_id"], "vector")


def standardize(spark, sf):
    points = usages(spark, sf).select("word", "usage_id", "vector")
    return exploded(V.standardize(points), ["word", "usage_id"], "vector")


def pca_2d(spark, sf):
    layout = V.project_2d(V.standardize(usages(spark, sf).select("word", "usage_id", "vector")), ["word"])
    return layout.select("word", "usage_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


QUERIES = {f.__name__: f for f in [cosine_rank, vector_pool, layer_sum, standardize, pca_2d]}

ORACLES = {
    "cosine_rank": with_parts(USAGES) + """
      SELECT usage_id, round(list_cosine_similarity(vector, (SELECT vector FROM u WHERE usage_id = 0)), 6) + 0.0::DOUBLE AS cosine
      FROM u ORDER BY cosine DESC, usage_id""",
    "vector_pool": with_parts(USAGES, DIMENSIONS) + """
      SELECT usage_id // 3 AS usage, 7 AS layer, dim, round(avg(x), 6) + 0.0::DOUBLE AS value FROM e GROUP BY ALL""",
    "layer_sum": with_parts(USAGES, DIMENSIONS) + """
      SELECT usage_id, CAST(dim % 16 AS INTEGER) AS dim, round(sum(x), 6) + 0.0::DOUBLE AS value FROM e WHERE dim >= 16 GROUP BY 1, 2""",
    "standardize": with_parts(USAGES, DIMENSIONS) + """
      SELECT word, usage_id, dim, round((x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1), 6) + 0.0::DOUBLE AS value
      FROM e WINDOW w AS (PARTITION BY word, dim)""",
}
