"""Per word and layer: sentences, tags, layout and clusters of sampled usages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.operators import kmeans, vectors
from wordtide.session import cut_lineage

LAYER = 7  # Fixed value: the layer shown.


def cluster_layers(points: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """word, layer, usage_id, cluster: k-means of every word and layer at once.

    Words with fewer than k usages have no model; their cluster is null.
    """
    keys = ["word", "layer", "usage_id"]
    _, labels = kmeans.fit(points, ["word", "layer"], [k], seed=seed, below=False)
    found = labels.select(*keys, F.col("label").alias("cluster"))
    return points.select(*keys).join(found, keys, "left")


def neighbour_bundle(points: DataFrame, sentences: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """word, layer, usage_id, sentence, pos, x, y, cluster.

    Points: word, layer, usage_id, vector. Sentences: word, usage_id, sentence, pos; a usage with
    several has a row for each, one without keeps its row with nulls.
    """
    points = cut_lineage(points)
    layout = vectors.project_2d(points, ["word", "layer"])
    clusters = cluster_layers(points, k, seed)
    keys = ["word", "layer", "usage_id"]
    return layout.join(clusters, keys).join(sentences, ["word", "usage_id"], "left").select(
        *keys, "sentence", "pos", "x", "y", "cluster"
    )


def layer_view(bundle: DataFrame, layer: int = LAYER) -> DataFrame:
    return bundle.where(F.col("layer") == layer)
