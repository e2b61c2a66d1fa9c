import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.plans import corpus, neighbours, usage_types
from wordtide.plans.time_profile import attribute_profile, hits_over_time
from wordtide.sources import models


@pytest.fixture
def separated(spark):
    """Two words with three well separated groups of usages each."""
    rng = np.random.default_rng(3)
    rows = [(f"w{i % 2}", i, (rng.normal(size=3) + 20 * np.eye(3)[i % 3]).tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")


def groups(rows):
    return {(r["word"], r["label"], r["usage_id"] % 3) for r in rows}


@pytest.mark.parametrize("criterion", ["silhouette", "calinski"])
def test_best_k_finds_the_groups(separated, criterion):
    labels = usage_types.cluster_usages(separated, "kmeans", range(2, 6), criterion).collect()
    assert len(labels) == 90 and {r["k"] for r in labels} == {3}
    assert len(groups(labels)) == 6


def test_mixtures_find_the_groups(separated):
    labels = usage_types.cluster_usages(
        separated, "gmm", [2, 3], "bic", covariance_types="spherical", starts=2, max_iter=20
    ).collect()
    assert len(labels) == 90 and {r["k"] for r in labels} == {3} and len(groups(labels)) == 6


def test_neighbour_bundle_has_every_layer_and_usage(spark, separated):
    layered = separated.withColumn("layer", F.explode(F.array(F.lit(6), F.lit(7))))
    sentences = separated.select("word", "usage_id", F.lit("text").alias("sentence"), F.lit("N").alias("pos"))
    bundle = neighbours.neighbour_bundle(layered, sentences, k=3)
    assert bundle.count() == 180
    shown = neighbours.layer_view(bundle).collect()
    assert len(shown) == 90
    assert len({(r["word"], r["cluster"], r["usage_id"] % 3) for r in shown}) == 6


def test_bundle_keeps_usages_without_a_sentence(spark, separated):
    layered = separated.withColumn("layer", F.lit(7))
    sentences = spark.createDataFrame([("w0", 0, "one", "N"), ("w0", 0, "two", "X")], "word string, usage_id long, sentence string, pos string")
    bundle = neighbours.neighbour_bundle(layered, sentences, k=3).collect()
    assert len(bundle) == 91 and sorted(r["sentence"] for r in bundle if r["sentence"]) == ["one", "two"]


def test_metadata_does_not_move_texts(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "textID long, doc_text string")
    joined = corpus.attach_metadata(documents, spark.createDataFrame([(1, 1999)], "textID long, year long"))
    assert sorted((r["textID"], r["year"]) for r in joined.collect()) == [(1, 1999), (2, None)]
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_time_profile(spark):
    papers = spark.createDataFrame(
        [(1, "A model. The model", 1955), (2, "No hit", 1955), (3, "model", 2021), (4, "model", None)],
        "id long, body string, year int",
    )
    table = hits_over_time(papers, ["model", "absent"], "id", "body", F.col("year"))
    rows = {(r["word"], r["period"]): r["n"] for r in table.collect()}
    assert len(rows) == 24 and rows.pop(("model", "(1950, 1960]")) == 2 and set(rows.values()) == {0}


def test_attribute_profile(spark):
    hits = spark.createDataFrame([(i, 2000 + i % 2) for i in range(8)], "hit_id long, year int")
    tags = spark.createDataFrame([(i, "NOUN" if i < 4 else "VERB") for i in range(7)], "hit_id long, pos string")
    rows = attribute_profile(hits, tags, ["hit_id"], "year", "pos").collect()
    shares = {(r["year"], r["pos"]): (r["n"], r["total"], r["proportion"]) for r in rows}
    assert shares[(2001, "VERB")] == (1, 4, 0.25) and shares[(2000, "NOUN")] == (2, 4, 0.5)


def broken(spark, separated):
    """The separated usages and some whose vectors cannot take part."""
    nan, inf = float("nan"), float("inf")
    rows = [("w0", 900, None), ("w0", 901, [nan, 0.0, 0.0]), ("w1", 902, [0.0, inf, 0.0]), ("w1", 903, [None, 1.0, 1.0]), ("w0", 904, [])]
    rows += [("lone", 905, [1.0, 2.0, 3.0]), (None, 906, [1.0, 2.0, 3.0])]
    return separated.unionByName(spark.createDataFrame(rows, separated.schema))


def labels_of(rows):
    return {r["usage_id"]: (r["word"], r["k"], r["label"]) for r in rows.collect()}


@pytest.mark.parametrize("method,options", [("kmeans", {"criterion": "calinski"}), ("gmm", {"covariance_types": ["diag", "tied"], "starts": 2, "max_iter": 20})])
def test_stored_models_label_as_the_fit_did(spark, separated, tmp_path, method, options):
    usages = broken(spark, separated)
    fitted = usage_types.fit_clusterings(usages, method, [2, 3], **options)
    path = str(tmp_path / "store")
    assert models.save_clusterings(spark, fitted, path) == 1
    stored = models.load_clusterings(spark, path)
    got = labels_of(usage_types.predict(stored, usages))
    assert set(got) == set(range(90)) | set(range(900, 907))
    assert {u: got[u] for u in range(90)} == labels_of(fitted.labels)
    assert {v[0]: v[1] for u, v in got.items() if u < 90} == {"w0": 3, "w1": 3}
    assert all(got[u][1:] == (None, None) for u in range(900, 907))
    model = {r["word"]: r for r in stored.models.collect()}
    assert set(model) == {"w0", "w1"} and all(m["converged"] is not None and len(m["means"]) == 9 for m in model.values())
    tried = {(r["word"], r["k"], r["covariance"]): r["score"] for r in stored.scores.collect()}
    for word, m in model.items():
        best = max if method == "kmeans" else min
        assert m["score"] == best(s for (w, _, _), s in tried.items() if w == word)


def test_new_usages_get_the_label_of_their_neighbours(spark, separated):
    fitted = usage_types.fit_clusterings(separated.where("usage_id < 60"), "kmeans", [3], "calinski")
    got = labels_of(usage_types.predict(fitted, separated.unionByName(spark.createDataFrame([("w0", 95, [1.0])], separated.schema))))
    assert got.pop(95) == ("w0", None, None)
    assert len({(w, label, u % 3) for u, (w, _, label) in got.items()}) == 6


def test_versions_of_a_store(spark, separated, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        models.load_clusterings(spark, path)
    for k in (2, 3):
        models.save_clusterings(spark, usage_types.fit_clusterings(separated, "kmeans", [k], "calinski"), path)
    assert {r["k"] for r in models.load_clusterings(spark, path).models.collect()} == {3}
    assert {r["k"] for r in models.load_clusterings(spark, path, 1).models.collect()} == {2}
    # Tables without their row, as a run leaves them that died, are not seen.
    models.load_clusterings(spark, path).models.write.parquet(f"{path}/data/99999999999999999999-x/models")
    assert [r["version"] for r in models.versions(spark, path).orderBy("version").collect()] == [1, 2]
    with pytest.raises(ValueError):
        models.load_clusterings(spark, path, 3)


def test_prototypes_come_from_the_space_of_the_fit(spark):
    """One dimension is a thousand times wider: unscaled distances would follow it alone."""
    rows = [("w", i, [1000.0 * (i % 5), float(i >= 10)]) for i in range(20)]
    usages = spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")
    fitted = usage_types.fit_clusterings(usages, "kmeans", [2], "calinski")
    near = usage_types.predict(fitted, usages).groupBy("label").agg(F.min_by("usage_id", F.struct("distance", "usage_id")).alias("u")).collect()
    contexts = usages.select("usage_id", F.array(F.col("usage_id").cast("string")).alias("context"), F.lit(0).alias("position"))
    shown = usage_types.prototypes_of(fitted, usages, contexts, n=1).collect()
    assert {(r["cluster"], r["text"]) for r in shown} == {(r["label"], f"[[{r['u']}]]") for r in near}


def test_an_empty_table_of_usages(spark, separated):
    fitted = usage_types.fit_clusterings(separated.limit(0), "kmeans", [2], "calinski")
    assert usage_types.predict(fitted, separated).where("label is not null").count() == 0
