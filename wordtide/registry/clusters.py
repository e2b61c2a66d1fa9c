"""Clusterings: fits, scores, distributions, agreement, prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.periods import period
from wordtide.functions.vectors import norm
from wordtide.operators import blocks as B, hits as H, kmeans as K, mixture as M, scores as S, usage as U, vectors as V
from wordtide.plans import neighbours, usage_types
from wordtide.registry.common import (
    BINS, DIMENSIONS, TOKENS_OF, USAGES, WORDS, documents, exploded, rounded, table, usages, with_parts,
)
from wordtide.session import cut_lineage, new_path
from wordtide.sources import models, readers, writers

GROUP = ["word"]


def _dated(spark, sf):
    return usages(spark, sf).withColumn("period", period(F.col("year"))).dropna(subset=["period"])


def cluster_outer_join(spark, sf):
    """Stored cluster members against labelled documents, both sides kept."""
    path = new_path(spark, "clusters")
    # Member lists hold at most a hundred ids; a cluster has as many lists as it needs.
    members = usages(spark, sf).groupBy("label", F.floor(F.col("usage_id") / 100).alias("_part")).agg(
        F.collect_list(F.col("usage_id").cast("string")).alias("sentence_uids")
    )
    stored = members.select(
        F.lit(5).alias("k_clusters"), F.lit(7).alias("layer"), F.col("label").alias("cluster_id"), "sentence_uids"
    )
    writers.parquet_table(stored.unionByName(stored.withColumn("layer", F.lit(8))), path)
    chosen = U.labels_of_members(readers.stored_clusters(spark, path), 5, 7)
    occurrences = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("bnc_index"), F.col("quality").cast("string").alias("tag")
    )
    return U.join_clusters(occurrences, chosen)


def usage_distribution(spark, sf):
    return U.usage_distribution(_dated(spark, sf), ["word"], "label")


def usage_distribution_soft(spark, sf):
    """Squared and normalised vectors as memberships of as many clusters as they have entries."""
    squares = F.transform("vector", lambda x: x * x)
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    soft = _dated(spark, sf).select("period", F.transform(squares, lambda x: x / total).alias("prob"))
    return U.soft_usage_distribution(soft).select("cluster", "period", rounded(F.col("n")).alias("n"))


def usage_shares(spark, sf):
    shares = U.normalized(U.usage_distribution(_dated(spark, sf), ["word"], "label"), ["word"])
    return shares.withColumn("share", rounded(F.col("share")))


def _labelings(spark, sf):
    points = usages(spark, sf).select("usage_id", "label")
    return points.withColumns(
        {"by3": (F.col("usage_id") % 3).cast("int"), "by7": (F.col("usage_id") % 7).cast("int")}
    )


def clustering_intersection(spark, sf):
    return U.clustering_intersection(_labelings(spark, sf), ["label", "by3", "by7"])


def pair_agreement(spark, sf):
    agreed = U.pair_agreement(_labelings(spark, sf), ["label", "by3", "by7"])
    return agreed.select(rounded(F.col("agreement"), 9).alias("agreement"))


def silhouette(spark, sf):
    points = usages(spark, sf).select("word", "usage_id", "vector", F.array("label").alias("labels"))
    scored = S.silhouette(points, GROUP, [10])
    return scored.select("word", rounded(F.col("score")).alias("score"))


def silhouette_squared(spark, sf):
    scored = S.squared_silhouette(usages(spark, sf).select("word", "usage_id", "label", "vector"), GROUP)
    return scored.select("word", rounded(F.col("score")).alias("score"))


def calinski_harabasz(spark, sf):
    scored = S.calinski_harabasz(usages(spark, sf).select("word", "label", "vector"), GROUP)
    return scored.select("word", rounded(F.col("score")).alias("score"))


def _fixed_start(spark, sf):
    """Points in blocks and, per word, the first vector of each label as centroid."""
    points = usages(spark, sf)
    counts = cut_lineage(B.block_counts(points, GROUP))
    blocks = B.with_blocks(points.select("word", "usage_id", "vector"), counts, GROUP, "usage_id")
    first = points.groupBy("word", F.col("label").alias("cluster")).agg(F.min_by("vector", "usage_id").alias("centroid"))
    models = first.withColumns({"start": F.lit(0), "k": F.lit(10)})
    packed = cut_lineage(K.packed(models, GROUP))
    return blocks, counts, packed, B.fits_broadcast(packed)


def kmeans_assign(spark, sf):
    blocks, counts, models, small = _fixed_start(spark, sf)
    found = cut_lineage(K.assign(blocks, counts, models, GROUP, small))
    blocks.unpersist()
    return found.select("word", "usage_id", "label", rounded(F.col("distance")).alias("distance"))


def kmeans_update(spark, sf):
    blocks, counts, models, small = _fixed_start(spark, sf)
    moved = cut_lineage(K.step(blocks, counts, models, GROUP, small))
    blocks.unpersist()
    return exploded(K.unpacked(moved, GROUP), ["word", "cluster", "n"], "centroid")


def _standardized(spark, sf):
    return cut_lineage(V.standardize(usages(spark, sf).select("word", "usage_id", "vector")))


def kmeans_sweep(spark, sf):
    """Silhouette of k = 2 .. 10 per word, the best one marked."""
    _, _, scored = usage_types.best_kmeans(_standardized(spark, sf))
    best = usage_types.best_k(scored).select("word", F.col("k").alias("best_k"))
    return scored.join(best, "word").select("word", "k", rounded(F.col("score")).alias("score"), (F.col("k") == F.col("best_k")).alias("best"))


def usage_clusters(spark, sf):
    """Cluster of each usage under the best k of its word by Calinski-Harabasz."""
    points = usages(spark, sf).select("word", "usage_id", "vector")
    return usage_types.cluster_usages(points, "kmeans", criterion="calinski")


def clusterings_roundtrip(spark, sf):
    """Fitted, saved, read and predicted again: whether labels are those of the fit, distances as norms of the stored scaling."""
    points = usages(spark, sf).select("word", "usage_id", "vector")
    path = new_path(spark, "clusterings")
    fitted = usage_types.fit_clusterings(points, "kmeans", [2, 3, 4], criterion="calinski")
    models.save_clusterings(spark, fitted, path)
    stored = models.load_clusterings(spark, path)
    found = usage_types.predict(stored, points).withColumnRenamed("label", "_again")
    norms = usage_types.scaled(points, stored.scaling).select("word", "usage_id", rounded(norm(F.col("vector"))).alias("scaled_norm"))
    return (
        found.join(stored.labels, ["word", "usage_id", "k"])
        .join(norms, ["word", "usage_id"])
        .select("word", "usage_id", (F.col("label") == F.col("_again")).alias("same"), "scaled_norm")
    )


def gmm_sweep(spark, sf):
    """aic and bic of mixtures of every covariance type, the best ones marked."""
    fitted = M.fit(_standardized(spark, sf), GROUP, usage_types.K_RANGE)
    marks = {
        c: M.best_models(fitted, GROUP, c).select("word", "covariance", "k", F.lit(True).alias(f"best_{c}"))
        for c in ("aic", "bic")
    }
    keys = ["word", "covariance", "k"]
    joined = fitted.join(marks["aic"], keys, "left").join(marks["bic"], keys, "left")
    return joined.select(
        *keys,
        *[rounded(F.col(c), 3).alias(c) for c in ("log_likelihood", "aic", "bic")],
        *[F.coalesce(f"best_{c}", F.lit(False)).alias(f"best_{c}") for c in ("aic", "bic")],
    )


def _layers(spark, sf):
    """Four layers of 16 dimensions out of each vector."""
    points = usages(spark, sf)
    return points.select("word", "usage_id", F.explode(F.sequence(F.lit(5), F.lit(8))).alias("layer"), "vector").withColumn(
        "vector", F.slice("vector", (F.col("layer") - 5) * 16 + 1, F.lit(16))
    )


def kmeans_layers(spark, sf):
    return neighbours.cluster_layers(_layers(spark, sf), 5)


def neighbour_bundle(spark, sf):
    """Layer 7 of the bundle, written as one JSON folder per word and read back."""
    words = F.concat(F.lit("w"), F.col("corpus_id") % 5)
    # All sentences with a target word; usages of documents without one stay without a sentence.
    hits = H.collect_hits(documents(spark, sf), WORDS).select("corpus_id", "sentence").distinct()
    tokens = T.tokens(F.col("sentence"))
    shown = hits.select(
        words.alias("word"), F.col("corpus_id").alias("usage_id"), "sentence", T.tag_of_first(tokens, tokens, "the").alias("pos")
    )
    path = new_path(spark, "bundle")
    writers.json_by_word(neighbours.neighbour_bundle(_layers(spark, sf), shown), path)
    schema = "layer int, usage_id long, sentence string, pos string, x double, y double, cluster int, word string"
    return neighbours.layer_view(spark.read.schema(schema).json(path))


def prototypes(spark, sf):
    """Five members nearest to the mean of each label, by the middle of their document."""
    points = usages(spark, sf)
    centroids = V.pool(points, ["word", "label"]).select("word", F.col("label").alias("cluster"), F.col("vector").alias("centroid"))
    assigned = U.nearest_centroid(points.select("word", "usage_id", "vector"), centroids)
    members = cut_lineage(U.nearest_members(assigned))
    # Only the documents of the members are tokenised.
    texts = table(spark, sf, "documents").join(members, F.col("doc_id") == F.col("usage_id"), "left_semi")
    contexts = texts.select(F.col("doc_id").alias("usage_id"), T.tokens(F.col("text")).alias("context"))
    contexts = contexts.where(F.size("context") > 0).withColumn("position", F.floor(F.size("context") / 2).cast("int"))
    return U.prototypes(members, contexts)


QUERIES = {
    f.__name__: f
    for f in [
        cluster_outer_join, usage_distribution, usage_distribution_soft, usage_shares, clustering_intersection,
        pair_agreement, silhouette, silhouette_squared, calinski_harabasz, kmeans_assign, kmeans_update, kmeans_sweep, usage_clusters,
        gmm_sweep, clusterings_roundtrip, kmeans_layers, neighbour_bundle, prototypes,
    ]
}

_DATED = """d AS (
  SELECT u.*, period FROM u JOIN bins ON year > lo AND year <= hi)"""
_GRID = """g AS (
  SELECT word, label, period, coalesce(n, 0) AS n FROM (
    SELECT word, unnest(range(max(label) + 1)) AS label FROM d GROUP BY word)
  JOIN (SELECT DISTINCT word, period FROM d) USING (word)
  LEFT JOIN (SELECT word, label, period, count(*) AS n FROM d GROUP BY ALL) USING (word, label, period))"""
_LABELINGS = "l AS (SELECT vec_id AS usage_id, label, vec_id % 3 AS by3, vec_id % 7 AS by7 FROM embeddings)"
_STARTS = """c AS (
  SELECT e.word, e.label AS cluster, e.dim, e.x AS c FROM e
  JOIN (SELECT word, label, min(usage_id) AS usage_id FROM u GROUP BY word, label) f USING (word, label, usage_id)),
a AS (
  SELECT word, usage_id, arg_min(cluster, gap) AS label, sqrt(min(gap)) AS distance FROM (
    SELECT e.word, e.usage_id, c.cluster, sum((x - c) * (x - c)) AS gap
    FROM e JOIN c ON c.word = e.word AND c.dim = e.dim GROUP BY ALL)
  GROUP BY word, usage_id)"""

ORACLES = {
    "clusterings_roundtrip": with_parts(USAGES, DIMENSIONS) + """,
      z AS (SELECT word, usage_id, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS z FROM e
            WINDOW w AS (PARTITION BY word, dim))
      SELECT word, usage_id, true AS same, round(sqrt(sum(z * z)), 6) + 0.0::DOUBLE AS scaled_norm FROM z GROUP BY word, usage_id""",
    "cluster_outer_join": """
      SELECT coalesce(CAST(vec_id AS VARCHAR), CAST(doc_id AS VARCHAR)) AS bnc_index, CAST(quality AS VARCHAR) AS tag,
             CAST(label AS VARCHAR) AS cluster_id
      FROM embeddings FULL OUTER JOIN labels ON vec_id = doc_id""",
    "usage_distribution": with_parts(USAGES, BINS, _DATED, _GRID) + "SELECT word, CAST(label AS INTEGER) AS label, period, n FROM g",
    "usage_distribution_soft": with_parts(USAGES, BINS, _DATED) + """
      SELECT CAST(cluster AS INTEGER) AS cluster, period, round(sum(p), 6) + 0.0::DOUBLE AS n FROM (
        SELECT period, unnest(range(len(vector))) AS cluster,
               unnest([v * v / list_inner_product(vector, vector) FOR v IN vector]) AS p
        FROM d) GROUP BY 1, 2""",
    "usage_shares": with_parts(USAGES, BINS, _DATED, _GRID) + """
      SELECT word, CAST(label AS INTEGER) AS label, period, n,
             round(coalesce(n / nullif(sum(n) OVER (PARTITION BY word, period), 0), 0), 6) + 0.0::DOUBLE AS share FROM g""",
    "clustering_intersection": with_parts(_LABELINGS) + """
      SELECT usage_id, dense_rank() OVER (ORDER BY first) - 1 AS meta_label FROM (
        SELECT usage_id, min(usage_id) OVER (PARTITION BY label, by3, by7) AS first FROM l)""",
    "pair_agreement": with_parts(_LABELINGS) + """
      SELECT round(count(*) FILTER ((a.label = b.label AND a.by3 = b.by3 AND a.by7 = b.by7)
             OR (a.label <> b.label AND a.by3 <> b.by3 AND a.by7 <> b.by7)) / count(*), 9) + 0.0::DOUBLE AS agreement
      FROM l a JOIN l b ON a.usage_id <> b.usage_id""",
    "silhouette": with_parts(USAGES) + """,
      p AS (SELECT a.word, a.usage_id, a.label, b.label AS other, avg(list_distance(a.vector, b.vector)) AS m
            FROM u a JOIN u b ON a.word = b.word AND a.usage_id <> b.usage_id GROUP BY ALL),
      q AS (SELECT word, usage_id, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b
            FROM p GROUP BY word, usage_id)
      SELECT word, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) + 0.0::DOUBLE AS score FROM q GROUP BY word""",
    "silhouette_squared": with_parts(USAGES) + """,
      p AS (SELECT a.word, a.usage_id, a.label, b.label AS other, avg(list_distance(a.vector, b.vector) ** 2) AS m
            FROM u a JOIN u b ON a.word = b.word AND a.usage_id <> b.usage_id GROUP BY ALL),
      q AS (SELECT word, usage_id, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b
            FROM p GROUP BY word, usage_id)
      SELECT word, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) + 0.0::DOUBLE AS score FROM q GROUP BY word""",
    "calinski_harabasz": with_parts(USAGES, DIMENSIONS) + """,
      m AS (SELECT *, avg(x) OVER (PARTITION BY word, label, dim) AS c, avg(x) OVER (PARTITION BY word, dim) AS g FROM e),
      k AS (SELECT word, count(DISTINCT label) AS k, count(DISTINCT usage_id) AS n, sum((x - c) * (x - c)) AS w,
                   sum((c - g) * (c - g)) AS b FROM m GROUP BY word)
      SELECT word, round((b / (k - 1)) / (w / (n - k)), 6) + 0.0::DOUBLE AS score FROM k""",
    "kmeans_assign": with_parts(USAGES, DIMENSIONS, _STARTS)
    + "SELECT word, usage_id, label, round(distance, 6) + 0.0::DOUBLE AS distance FROM a",
    "kmeans_update": with_parts(USAGES, DIMENSIONS, _STARTS) + """
      SELECT e.word, a.label AS cluster, count(*) AS n, e.dim, round(avg(x), 6) + 0.0::DOUBLE AS value
      FROM e JOIN a ON a.word = e.word AND a.usage_id = e.usage_id GROUP BY e.word, a.label, e.dim""",
    "prototypes": with_parts(USAGES, DIMENSIONS) + f""",
      c AS (SELECT word, label AS cluster, dim, avg(x) AS c FROM e GROUP BY ALL),
      a AS (SELECT word, usage_id, arg_min(cluster, gap) AS cluster, min(gap) AS gap FROM (
              SELECT e.word, e.usage_id, c.cluster, sum((x - c) * (x - c)) AS gap
              FROM e JOIN c ON c.word = e.word AND c.dim = e.dim GROUP BY ALL) GROUP BY word, usage_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY word, cluster ORDER BY gap, usage_id) AS rank FROM a),
      k AS (SELECT doc_id, {TOKENS_OF.format('text')} AS context FROM documents),
      p AS (SELECT doc_id, context, len(context) // 2 AS position FROM k WHERE len(context) > 0)
      SELECT word, cluster, CAST(min(rank) AS INTEGER) AS rank,
        array_to_string([CASE WHEN i = position THEN '[[' || context[i + 1] || ']]' ELSE context[i + 1] END
                         FOR i IN range(greatest(position - 10, 0), least(position + 11, len(context)))], ' ') AS text
      FROM r JOIN p ON p.doc_id = r.usage_id WHERE rank <= 5 GROUP BY ALL""",
}
