import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.operators import blocks as B, colloc, mixture as M, kmeans as K, pairs as A, profile as P
from wordtide.operators import ranking as R, sampling as S, scores, usage as U, vectors as V
from wordtide.plans import usage_types
from wordtide.plans.neighbours import cluster_layers
from wordtide.plans.usage_types import cluster_usages
from wordtide.session import cut_lineage


# Ranks and samples


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_rank_by_hash_is_exact_per_group(spark):
    rows = [(i % 3 if i % 4 else 0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, id long").withColumn("h", R.hash_order("id"))
    got = {(r["g"], r["id"]): r["rank"] for r in R.rank_by_hash(df, ["g"], "h", ["id"]).collect()}
    for g in range(3):
        ordered = sorted((i for k, i in rows if k == g), key=lambda i: md5(f"42-{i}"))
        assert [got[(g, i)] for i in ordered] == list(range(len(ordered)))


def test_rank_by_number(spark):
    ids = [3, 1000, 7, -5, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["rank"] for r in R.rank_by_number(df, "id").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(5))


def test_text_offset_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 4)
    rows = [(d, s, (d * 7 + s * 3) % 5) for d in (5, 2, 11) for s in range(10)]
    df = spark.createDataFrame(rows, "doc long, row long, w long")
    got = {(r["doc"], r["row"]): r["at"] for r in R.text_offset(df, "doc", "row", F.col("w"), "at").collect()}
    total = 0
    for d, s, w in sorted(rows):
        assert got[(d, s)] == total
        total += w


def test_top_per_group_equals_a_plain_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", R.hash_order("id").alias("h"))
    got = R.top_per_group(df, ["g"], [F.col("h")], 7, ["id"])
    for g in range(3):
        ids = sorted((i for i in range(1000) if i % 3 == g), key=lambda i: md5(f"42-{i}"))[:7]
        assert [r["id"] for r in got.where(F.col("g") == g).orderBy("rank").collect()] == ids


def test_group_sample_is_at_most_n_and_skips_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "g string, id long")
    assert Counter(r["g"] for r in S.sample_per_group(df, ["g"], 2, ["id"]).collect()) == {"a": 2, "b": 1}


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(300).withColumn("g", F.col("id") % 2)
    one = {r["id"] for r in S.sample_per_group(df.repartition(1), ["g"], 9, ["id"]).collect()}
    assert one == {r["id"] for r in S.sample_per_group(df.repartition(8), ["g"], 9, ["id"]).collect()}


def test_draws_with_replacement(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWS_PER_TASK_ROW", 3)
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 100)], "g string, id long")
    assert Counter(r["g"] for r in S.draw_with_replacement(df, "g", "id", n=10).collect()) == {"a": 10, "b": 10}
    by_share = S.draw_with_replacement(df, "g", "id", fraction=0.5).collect()
    # Half of 25 and half of 1, rounded half to even.
    assert Counter(r["g"] for r in by_share) == {"a": 12}
    with pytest.raises(ValueError):
        S.draw_with_replacement(df, "g", "id")


def test_gate(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(10)], "w string, id long")
    assert Counter(r["w"] for r in S.gated_sample(df, "w", ["id"], n=20, more_than=10).collect()) == {"a": 20}


# Shares


def test_shares_round_half_to_even(spark):
    values = [0.125, 0.375, 0.625, 0.015, 0.005, 0.575]
    df = spark.createDataFrame([(v, 1.0) for v in values], "n double, total double")
    got = [r["proportion"] for r in P.shares(df).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_totals_count_rows_without_the_attribute(spark):
    df = spark.createDataFrame([(1, "N"), (1, None), (1, "V"), (None, "N")], "y int, pos string")
    rows = {r["pos"]: (r["n"], r["total"]) for r in P.attribute_counts(df, "y", "pos").collect()}
    assert rows == {"N": (1, 3), "V": (1, 3)}


def test_binned_counts_fill_every_cell(spark):
    df = spark.createDataFrame([("(0, 1]", "N"), ("(0, 1]", "N"), (None, "V")], "p string, pos string")
    counts = P.binned_attribute_counts(df, "p", "pos", [0, 1, 2])
    rows = {(r["p"], r["pos"]): (r["n"], r["total"]) for r in counts.collect()}
    assert rows == {("(0, 1]", "N"): (2, 2), ("(0, 1]", "V"): (0, 2), ("(1, 2]", "N"): (0, 0), ("(1, 2]", "V"): (0, 0)}
    pivot = P.pivot_shares(P.shares(counts), "p", "pos", ["N", "V"], binned=True)
    assert {tuple(r) for r in pivot.collect()} == {("(0, 1]", 1.0, 0.0), ("(1, 2]", 0.0, 0.0)}


# N-grams


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("n", [2, 3])
def test_stream_ngrams_equal_brute_force(spark, monkeypatch, across, n):
    monkeypatch.setattr(colloc, "RANK_ROWS", 2)
    docs = {2: ["a b", "c", "a b"], 1: ["x a b c d e f g", "a"], 9: ["b"]}
    rows = [(d, i, s) for d, parts in docs.items() for i, s in enumerate(parts)]
    df = spark.createDataFrame(rows, "corpus_id long, sent_idx long, sentence string")
    runs = [[t for s in docs[d] for t in s.split()] for d in sorted(docs)]
    if across:
        runs = [[t for run in runs for t in run]]
    want = Counter()
    for run in runs:
        for i in range(len(run)):
            want[tuple(run[i + j] if i + j < len(run) else None for j in range(n))] += 1
    counts = colloc.ngram_counts(colloc.ngrams_of_stream(df, n, across_docs=across))
    assert {tuple(r)[:-1]: r["n"] for r in counts.collect()} == dict(want)


# Clusterings


def points(spark, n=60, d=4, words=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 4 * (np.arange(n) % 3)[:, None]
    rows = [(f"w{i % words}", i, x[i].tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")


def test_standardize_uses_the_population_deviation(spark):
    x, df = points(spark, words=1)
    df = df.withColumn("vector", F.concat("vector", F.array(F.lit(5.0))))
    got = {r["usage_id"]: r["vector"] for r in V.standardize(df).collect()}
    want = (x - x.mean(0)) / x.std(0)
    for i in range(len(x)):
        assert np.allclose(got[i][:-1], want[i]) and got[i][-1] == 0


def test_kmeans_does_not_depend_on_blocks(spark):
    _, df = points(spark)
    results = []
    for rows in (1000, 7):
        centroids, labels = K.fit(df, ["word"], [2, 3], block_rows=rows)
        assert centroids.groupBy("word", "k").agg(F.sum("n")).select("sum(n)").distinct().collect()[0][0] == 30
        results.append({(r["word"], r["k"], r["usage_id"]): r["label"] for r in labels.collect()})
    assert results[0] == results[1]
    # Three well separated groups are found.
    parts = {r: results[0][("w0", 3, r)] for r in range(0, 60, 2)}
    assert len({(i % 3, label) for i, label in parts.items()}) == 3


def test_kmeans_cost_does_not_rise(spark):
    _, df = points(spark, words=1)
    counts = cut_lineage(B.block_counts(df, ["word"]))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    models, costs = cut_lineage(K.start_centroids(blocks, counts, ["word"], [4])), []
    for _ in range(5):
        models = cut_lineage(K.step(blocks, counts, models, ["word"], True))
        costs.append(models.first()["cost"])
    blocks.unpersist()
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def test_small_words_get_only_k_below_their_size(spark):
    df = spark.createDataFrame([("w", i, [float(i)]) for i in range(3)], "word string, usage_id long, vector array<double>")
    centroids, _ = K.fit(df, ["word"], [2, 3, 4])
    assert {r["k"] for r in centroids.collect()} == {2}


def plain_seeds(ids, x, k, most, start=0, seed=42):
    """Candidates by oversampling, then k of them by weight, all in one place."""
    race = lambda draw, i: -math.log((int(md5(f"{seed}-{start}-{draw}-{i}")[:13], 16) + 1) / (16.0**13 + 1))
    gaps_to = lambda rows, taken: np.array([min(((x[r] - x[t]) ** 2).sum() for t in taken) for r in rows])
    every = range(len(x))
    taken = [min(every, key=lambda r: race(0, ids[r]))]
    for turn in (1, 2):
        gaps = gaps_to(every, taken)
        open_ = sorted((race(turn, ids[r]) / gaps[r], ids[r], r) for r in every if gaps[r] > 0)
        taken += [r for _, _, r in open_[: K.EXTRA * most]]
    nearest = [min(range(len(taken)), key=lambda t: (((x[r] - x[taken[t]]) ** 2).sum(), t)) for r in every]
    weights, picked = Counter(nearest), []
    for place in range(k):
        gaps = gaps_to(taken, [taken[p] for p in picked]) if picked else np.ones(len(taken))
        scores = [race(f"seed{place}", ids[t]) / (weights[j] * gaps[j]) if weights[j] * gaps[j] > 0 else math.inf for j, t in enumerate(taken)]
        picked.append(int(np.argmin(scores)))
    return x[[taken[p] for p in picked]]


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_seeds_are_drawn_over_all_points(spark, block_rows):
    x, df = points(spark, n=50, d=3, words=1)
    counts = cut_lineage(B.block_counts(df, ["word"], block_rows))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    got = {(r["start"], r["k"]): np.array(r["centroids"]).reshape(-1, 3)
           for r in K.start_centroids(blocks, counts, ["word"], [2, 6], starts=2).collect()}
    blocks.unpersist()
    ids = [r["usage_id"] for r in df.orderBy("usage_id").collect()]
    rows = np.array([r["vector"] for r in df.orderBy("usage_id").collect()])
    for (start, k), centroids in got.items():
        assert np.allclose(centroids, plain_seeds(ids, rows, k, 6, start))
    assert set(got) == {(s, k) for s in (0, 1) for k in (2, 6)}


def test_seeds_of_equal_points_are_repeated(spark):
    df = spark.createDataFrame([("w", i, [1.0, 2.0]) for i in range(6)], "word string, usage_id long, vector array<double>")
    counts = cut_lineage(B.block_counts(df, ["word"]))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    got = {r["k"]: r["centroids"] for r in K.start_centroids(blocks, counts, ["word"], [2, 4, 9]).collect()}
    blocks.unpersist()
    assert got == {2: [1.0, 2.0] * 2, 4: [1.0, 2.0] * 4}


def test_steps_inside_a_block_equal_steps_over_blocks(spark):
    _, df = points(spark)
    whole = {(r["word"], r["k"], r["usage_id"]): r["label"] for r in K.fit(df, ["word"], [2, 4])[1].collect()}
    parts = {(r["word"], r["k"], r["usage_id"]): r["label"] for r in K.fit(df, ["word"], [2, 4], block_rows=7)[1].collect()}
    assert whole == parts


def test_seeding_takes_as_many_passes_for_any_k(spark, monkeypatch):
    _, df = points(spark, words=1)
    counts = cut_lineage(B.block_counts(df, ["word"]))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    passes, whole = [], B.per_block
    monkeypatch.setattr(B, "per_block", lambda *a, **k: passes.append(1) or whole(*a, **k))
    for k in ([2], [2, 3, 4, 5, 6, 7, 8, 9, 10]):
        K.start_centroids(blocks, counts, ["word"], k).collect()
    blocks.unpersist()
    assert len(passes) == 2 * (K.ROUNDS + 1)


def test_more_seeds_than_five_hundred(spark):
    df = spark.createDataFrame(
        [("w", i, [float(i), float(i * i % 97)]) for i in range(640)], "word string, usage_id long, vector array<double>"
    )
    counts = cut_lineage(B.block_counts(df, ["word"], 100))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    first = K.start_centroids(blocks, counts, ["word"], [12]).first()
    blocks.unpersist()
    assert len({tuple(c) for c in np.array(first["centroids"]).reshape(-1, 2).tolist()}) == 12


def test_fixed_k_keeps_every_word(spark):
    rows = [("five", i, [float(i), 0.0]) for i in range(5)] + [("two", i, [float(i), 1.0]) for i in range(2)]
    df = spark.createDataFrame([(w, 7, i, v) for w, i, v in rows], "word string, layer int, usage_id long, vector array<double>")
    got = {(r["word"], r["usage_id"]): r["cluster"] for r in cluster_layers(df, 5).collect()}
    assert len(got) == 7 and len({got["five", i] for i in range(5)}) == 5
    assert got["two", 0] is None and got["two", 1] is None
    found = cluster_usages(df.drop("layer"), criterion="calinski").where("word = 'two'").collect()
    assert len(found) == 2 and all(r["label"] is None for r in found)


def test_fits_tell_whether_they_converged(spark):
    _, df = points(spark, words=1)
    done, _ = K.fit(df, ["word"], [3])
    cut, _ = K.fit(df, ["word"], [3], max_iter=1, tol=0.0)
    assert {r["converged"] for r in done.collect()} == {True}
    assert {r["converged"] for r in cut.collect()} == {False}


def test_small_models_are_not_exchanged(spark):
    _, df = points(spark)
    counts = cut_lineage(B.block_counts(df, ["word"]))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    models = cut_lineage(K.start_centroids(blocks, counts, ["word"], [3]))
    plan = K.step(blocks, counts, models, ["word"], True)._jdf.queryExecution().executedPlan().toString()
    blocks.unpersist()
    head = plan.split("InMemoryTableScan")[0]
    assert "MapInArrow" in head and "CoGroup" not in plan
    assert head.count("Exchange hashpartitioning") == 1


def silhouette_of(x, labels):
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i][own].sum() / (own.sum() - 1)
        b = min(gaps[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_silhouette_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(scores, "PAIR_ROWS", 4)
    x, df = points(spark, n=50, words=1)
    a, b = np.arange(50) % 3, np.where(np.arange(50) == 0, 1, 0)
    labels = spark.createDataFrame([(i, [int(a[i]), int(b[i])]) for i in range(50)], "usage_id long, labels array<int>")
    scored = scores.silhouette(df.join(labels, "usage_id"), ["word"], [3, 2], block_rows)
    got = {r["model"]: r["score"] for r in scored.collect()}
    assert np.isclose(got[0], silhouette_of(x, a)) and np.isclose(got[1], silhouette_of(x, b))


def test_best_k_prefers_the_smaller_of_equals(spark):
    df = spark.createDataFrame([("w", 2, 0.5), ("w", 3, 0.5), ("w", 4, 0.1)], "word string, k int, score double")
    assert usage_types.best_k(df).first()["k"] == 2


def test_method_and_criterion_are_checked(spark):
    _, df = points(spark)
    for method, criterion in [("dbscan", None), ("gmm", "silhouette"), ("kmeans", "bic")]:
        with pytest.raises(ValueError, match=" by "):
            usage_types.cluster_usages(df, method, [2], criterion)


def em(x, labels, kind, steps):
    """Plain expectation maximisation from one-hot labels; log-likelihood after `steps`."""
    n, d = x.shape
    k = labels.max() + 1
    resp = np.eye(k)[labels]
    for _ in range(steps):
        size = resp.sum(0)
        mean = resp.T @ x / size[:, None]
        cov = np.stack([(resp[:, [j]] * (x - mean[j])).T @ (x - mean[j]) / size[j] for j in range(k)])
        if kind == "tied":
            cov = np.repeat(np.einsum("j,jab->ab", size / n, cov)[None], k, 0)
        if kind in ("diag", "spherical"):
            cov = np.stack([np.diag(np.diag(c)) for c in cov])
        if kind == "spherical":
            cov = np.stack([np.eye(d) * np.trace(c) / d for c in cov])
        cov = cov + 1e-6 * np.eye(d)
        logs = np.stack(
            [
                np.log(size[j] / n)
                - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov[j])[1]
                         + np.einsum("ia,ab,ib->i", x - mean[j], np.linalg.inv(cov[j]), x - mean[j]))
                for j in range(k)
            ],
            1,
        )
        whole = np.logaddexp.reduce(logs, axis=1)
        resp = np.exp(logs - whole[:, None])
    return whole.sum()


@pytest.mark.parametrize("block_rows", [1000, 11])
def test_mixture_steps_equal_plain_em(spark, block_rows):
    x, df = points(spark, n=60, d=3, words=1)
    labels = np.arange(60) % 2
    centres = np.stack([x[labels == j].mean(0) for j in range(2)])
    labels = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(1)
    counts = cut_lineage(B.block_counts(df, ["word"], block_rows))
    blocks = B.with_blocks(df, counts, ["word"], "usage_id")
    schema = f"word string, covariance string, k int, start int, {M.PARAMETERS}, log_likelihood double"
    start = [("w0", kind, 2, 0, [], centres.ravel().tolist(), [], M.NO_LIKELIHOOD) for kind in M.COVARIANCE_TYPES]
    models = cut_lineage(spark.createDataFrame(start, schema))
    for steps in range(4):
        models = cut_lineage(M.step(blocks, counts, models, ["word"], True))
        if steps:
            got = {r["covariance"]: r["log_likelihood"] for r in models.collect()}
            for kind in M.COVARIANCE_TYPES:
                assert np.isclose(got[kind], em(x, labels, kind, steps)), (kind, steps)
    blocks.unpersist()


def test_mixture_fit_and_criteria(spark):
    x, df = points(spark, n=60, d=2, words=1)
    fitted = cut_lineage(M.fit(df, ["word"], [2, 3], ["diag", "full"], starts=2, max_iter=15))
    rows = {(r["covariance"], r["k"]): r for r in fitted.collect()}
    assert set(rows) == {(c, k) for c in ("diag", "full") for k in (2, 3)}
    for (kind, k), r in rows.items():
        free = k * 2 + k - 1 + (2 * k if kind == "diag" else 3 * k)
        assert np.isclose(r["aic"], 2 * free - 2 * r["log_likelihood"])
        assert np.isclose(r["bic"], np.log(60) * free - 2 * r["log_likelihood"])
    best = M.best_models(fitted, ["word"], "bic").first()
    assert best["bic"] == min(r["bic"] for r in rows.values())
    probs = M.assign(df, M.best_models(fitted, ["word"], "bic"), ["word"]).collect()
    assert len(probs) == 60 and all(np.isclose(sum(r["prob"]), 1) for r in probs)


def mixture_rows(fitted):
    return {(r["word"], r["covariance"], r["k"]): r for r in fitted.collect()}


def test_mixture_steps_in_tasks_need_no_jobs_of_their_own(spark):
    _, df = points(spark, n=60, d=3, words=2)
    jobs, sc = {}, spark.sparkContext
    try:
        for steps in (2, 14):
            sc.setJobGroup(f"mixture-{steps}", "steps")
            rows = mixture_rows(M.fit(df, ["word"], [2, 3], starts=2, max_iter=steps, tol=0.0, block_rows=20))
            assert len(rows) == 16 and not any(r["converged"] for r in rows.values())
            jobs[steps] = len(sc.statusTracker().getJobIdsForGroup(f"mixture-{steps}"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[14] - jobs[2]) < 6


def test_mixture_of_large_words_equals_that_of_words_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # Some words have a few points, so that their covariances are singular.
    sizes = {"w0": 90, "w1": 40, "w2": 7, "w3": 2}
    rows = [(w, 100 * i + j, (rng.normal(size=4) + 6 * (j % 2)).tolist()) for i, (w, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")
    args = (["word"], [2, 3])
    whole = mixture_rows(M.fit(df, *args, starts=1, max_iter=40, block_rows=15))
    assert {w for w, _, _ in whole} == {"w0", "w1", "w2"} and len(whole) == 24
    # One word is held by tasks, the others take steps over their blocks, a part of the models at a time.
    monkeypatch.setattr(M, "TASK_BYTES", 7 * 4 * 8)
    monkeypatch.setattr(M, "STATE_BYTES", 4000)
    parted = mixture_rows(M.fit(df, *args, starts=1, max_iter=40, block_rows=15))
    assert set(parted) == set(whole)
    for key, r in whole.items():
        assert parted[key]["converged"] == r["converged"]
        for c in ("weights", "means", "covariances", "log_likelihood", "aic", "bic"):
            assert np.allclose(parted[key][c], r[c], rtol=1e-6, atol=1e-8), (key, c)


@pytest.mark.parametrize("rounding", [0.0, 1e-9, 1.0])
def test_mixture_totals_equal_those_of_plain_responsibilities(monkeypatch, rounding):
    monkeypatch.setattr(M, "ROUNDING", rounding)
    monkeypatch.setattr(M, "STATE_BYTES", 800)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1300, 5)) + np.arange(5)
    models = [(kind, np.empty(0), x[rng.choice(1300, k, False)], np.empty(0)) for k in (2, 4) for kind in M.COVARIANCE_TYPES]
    upper = np.triu_indices(5)
    for _ in range(4):
        found, moved = M._totals(x, models), []
        for (kind, weights, means, flat), sums in zip(models, found):
            share, likelihood = M._responsibilities(x, kind, weights, means, flat)
            squares = x[:, upper[0]] * x[:, upper[1]]
            second = {"full": share.T @ squares, "tied": squares.sum(axis=0)}.get(kind, share.T @ x**2)
            plain = np.concatenate([[likelihood], share.sum(axis=0), (share.T @ x).ravel(), second.ravel()])
            assert np.allclose(sums, plain, rtol=1e-9, atol=1e-9), kind
            moved.append((kind, *M._next(kind, len(means), sums)))
        scores = [sums[0] for sums in M._totals(x, models, moments=False)]
        assert np.allclose(scores, [sums[0] for sums in found])
        models = moved


def test_projection_equals_principal_components(spark):
    x, df = points(spark, n=40, words=1)
    got = {r["usage_id"]: (r["x"], r["y"]) for r in V.project_2d(df, ["word"], block_rows=9).collect()}
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose([got[i] for i in range(40)], centred @ axes.T)


def test_agreement_and_intersection_equal_brute_force(spark):
    rows = [(i, i % 2, i % 3, (i * i) % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "usage_id long, a int, b int, c int")
    labels = [r[1:] for r in rows]
    pairs = [(p, q) for i, p in enumerate(labels) for j, q in enumerate(labels) if i != j]
    agree = sum(all(u == v for u, v in zip(p, q)) or all(u != v for u, v in zip(p, q)) for p, q in pairs)
    assert np.isclose(U.pair_agreement(df, ["a", "b", "c"]).first()[0], agree / len(pairs))
    meta = {r["usage_id"]: r["meta_label"] for r in U.clustering_intersection(df, ["a", "b", "c"]).collect()}
    seen = {}
    for i, label in enumerate(labels):
        assert meta[i] == seen.setdefault(label, len(seen))


def test_distribution_fills_empty_clusters(spark):
    df = spark.createDataFrame([(0, "a"), (2, "a"), (2, "b")], "cluster int, period string")
    table = U.usage_distribution(df)
    assert {(r[0], r[1]): r["n"] for r in table.collect()} == {
        (0, "a"): 1, (1, "a"): 0, (2, "a"): 1, (0, "b"): 0, (1, "b"): 0, (2, "b"): 1,
    }
    shares = U.normalized(table).groupBy("period").agg(F.sum("share").alias("s")).collect()
    assert all(np.isclose(r["s"], 1) for r in shares)


def test_prototypes_nearest_or_farthest(spark):
    rows = [("w", 0, i, float(i)) for i in range(6)]
    assigned = spark.createDataFrame(rows, "word string, cluster int, usage_id long, distance double")
    contexts = spark.createDataFrame([(i, ["a", f"t{i // 2}", "z"], 1) for i in range(6)], "usage_id long, context array<string>, position int")
    near = U.prototypes(U.nearest_members(assigned, n=3), contexts).orderBy("rank").collect()
    assert [(r["rank"], r["text"]) for r in near] == [(1, "a [[t0]] z"), (3, "a [[t1]] z")]
    far = U.prototypes(U.nearest_members(assigned, n=2, farthest=True), contexts).collect()
    assert [(r["rank"], r["text"]) for r in far] == [(1, "a [[t2]] z")]


# Annotation


def snippets(spark, cells):
    rows = [("w", c, p, f"{c}{p}{t}", t) for (c, p), texts in cells.items() for t in texts]
    return spark.createDataFrame(rows, "word string, cluster int, period string, snippet_id string, text string")


def sampled(spark, cells, periods):
    rows = A.sample_snippets(snippets(spark, cells), periods).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(rows)))
    assert len({r["text"] for r in rows}) == len(rows)
    return {(r["cluster"], r["period"]): r["text"] for r in rows}


def test_sample_fills_cells_from_cluster_then_from_word(spark):
    cells = {(0, "p"): ["a", "b"], (0, "z"): ["c"], (1, "q"): ["d", "e", "f"]}
    got = sampled(spark, cells, ["p", "q", "r"])
    assert set(got) == {(c, p) for c in (0, 1) for p in "pqr"}
    assert got[(0, "p")] in "ab" and {got[(0, p)] for p in "pqr"} == set("abc")
    assert {got[(1, p)] for p in "pqr"} == set("def")
    short = {(0, "p"): ["a"], (1, "q"): ["b", "c", "d", "e"]}
    got = sampled(spark, short, ["p", "q", "r"])
    assert got[(0, "p")] == "a" and len(got) == 5 and set(got.values()) == set("abcde")


def test_sample_leaves_cells_out_when_texts_run_out(spark):
    got = sampled(spark, {(0, "p"): ["a"], (1, "p"): ["a", "b"]}, ["p", "q"])
    assert set(got.values()) == {"a", "b"} and len(got) == 2


def in_turn(cells, periods, seed):
    """The sample by choosing cell after cell: own texts, then the cluster's, then the word's."""
    named = [(c, p, t, f"{c}{p}{t}") for (c, p), texts in cells.items() for t in texts]
    rows = [(c, p, t, (md5(f"{seed}-{sid}"), sid)) for c, p, t, sid in named]
    clusters = sorted({c for c, _ in cells})

    def first(found):
        best = {}
        for text, k in found:
            best[text] = min(k, best.get(text, k))
        return sorted(best, key=best.get)

    own = {(c, p): first((t, k) for rc, rp, t, k in rows if (rc, rp) == (c, p)) for c in clusters for p in periods}
    turn = sorted(own, key=lambda x: (len(own[x]), md5(f"{seed}-w-{x[0]}-{x[1]}"), x))
    got = {}
    for wanted in (own.get, lambda x: first((t, k) for c, _, t, k in rows if c == x[0]), lambda x: first((t, k) for *_, t, k in rows)):
        for cell in turn:
            free = [t for t in wanted(cell) if t not in got.values()]
            if cell not in got and free:
                got[cell] = free[0]
    return got


@pytest.mark.parametrize("n", [1, 37, 140, 399, 400, 1000])
def test_large_cuts_equal_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(R, "FEW", 20)
    draw = random.Random(n)
    rows = [(draw.choice([None, "a", "b", "é"]), draw.choice([None, 1.5, float("nan"), -2.0]), i // 2, "x" * i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, d double, i long, body string").repartition(7)
    got = R.first_rows(df, n, ["s", "d", "i"])
    keys = lambda frame: sorted(str((r["s"], r["d"], r["i"])) for r in frame.collect())
    assert keys(got) == keys(df.orderBy("s", "d", "i").limit(n))
    assert got.count() == min(n, 400)


def test_large_samples_are_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW", 20)
    df = spark.range(500).select("id", F.repeat(F.lit("x"), 10).alias("body"))
    got = S.sample_n(df, 100, ["id"])
    assert "Sort" not in got._jdf.queryExecution().toString().split("Physical Plan")[1]
    expected = sorted(range(500), key=lambda i: md5(f"42-{i}"))[:100]
    assert sorted(r["id"] for r in got.collect()) == sorted(expected)


def test_squared_silhouette_equals_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(f"w{i % 2}", i, int(rng.integers(0, 4)) if i < 56 else None, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [("w1", 70, 9, [0.0, 1.0, 2.0]), ("one", 80, 0, [1.0, 1.0, 1.0]), ("one", 81, 0, [1.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "word string, usage_id long, label int, vector array<double>")
    got = {r["word"]: r["score"] for r in scores.squared_silhouette(df, ["word"]).collect()}
    for word in ("w0", "w1", "one"):
        points = [(label, np.array(v)) for w, _, label, v in rows if w == word and label is not None]
        values = []
        for i, (label, v) in enumerate(points):
            gaps = {}
            for j, (other, u) in enumerate(points):
                if i != j:
                    gaps.setdefault(other, []).append(((u - v) ** 2).sum())
            a, others = gaps.pop(label, None), [np.mean(g) for g in gaps.values()]
            values.append((min(others) - np.mean(a)) / max(min(others), np.mean(a)) if a and others else 0.0)
        assert got[word] == pytest.approx(np.mean(values))
    wide = spark.createDataFrame([("w", i, i % 2, [100.0 * (i % 2) + i / 50]) for i in range(20)], df.schema)
    labels = cluster_usages(wide.select("word", "usage_id", "vector"), "kmeans", [2, 3], usage_types.SQUARED).collect()
    assert {r["k"] for r in labels} == {2}


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_ngrams_cross_rows_blocks_and_documents(spark, monkeypatch, n, across):
    monkeypatch.setattr(colloc, "RANK_ROWS", 3)
    draw = random.Random(n)
    rows = [(d, r, " ".join(draw.choice("abcde") for _ in range(draw.choice([0, 1, 1, 2, 7])))) for d in (1, 2, 4, 9, 11) for r in range(draw.choice([1, 2, 11]))]
    df = spark.createDataFrame(rows, "corpus_id long, sent_idx long, sentence string")
    docs = {}
    for d, _, text in sorted(rows):
        docs.setdefault(0 if across else d, []).extend(text.split())
    want = Counter(tuple(run[i + j] if i + j < len(run) else None for j in range(n)) for run in docs.values() for i in range(len(run)))
    got = Counter(tuple(r) for r in colloc.ngrams_of_stream(df, n, across_docs=across).collect())
    assert got == want


def test_likelihood_reads_the_bigrams_once(spark, monkeypatch):
    seen = []
    whole = colloc.cut_lineage
    monkeypatch.setattr(colloc, "cut_lineage", lambda df, name="step": seen.append(name) or whole(df, name))
    texts = spark.createDataFrame([("a b a b a b c. a b",), ("b a",)], "text string")
    bigrams = colloc.ngrams_of_texts(texts, 2)
    plain = {(r["w1"], r["w2"]): (r["n"], r["llr"]) for r in colloc.likelihood_ratio(bigrams, 1).collect()}
    only = {(r["w1"], r["w2"]): (r["n"], r["llr"]) for r in colloc.likelihood_ratio(bigrams, 1, colloc.without(["c"])).collect()}
    assert only == {k: v for k, v in plain.items() if "c" in k} and len(only) == 2
    assert plain[("a", "b")][0] == 4 and seen == ["bigrams", "unigrams"] * 2
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    assert {(r["w1"], r["w2"]): (r["n"], r["llr"]) for r in colloc.likelihood_ratio(bigrams, 1).collect()} == plain


def test_sample_takes_own_texts_first_whatever_the_seed(spark):
    cells = {(0, "p1"): ["t", "v", "u"], (1, "p1"): ["t"]}
    for seed in range(10):
        rows = A.sample_snippets(snippets(spark, cells), ["p1"], seed).collect()
        got = {(r["cluster"], r["period"]): r["text"] for r in rows}
        assert got[(1, "p1")] == "t" and got[(0, "p1")] in ("u", "v")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_sample_by_claims_equals_choosing_in_turn(spark, seed):
    draw = random.Random(seed)
    texts = [f"t{i}" for i in range(draw.choice([6, 14, 40]))]
    cells = {(c, p): draw.sample(texts, draw.randint(0, 5)) for c in range(5) for p in "pqrz"}
    cells = {k: v for k, v in cells.items() if v}
    rows = A.sample_snippets(snippets(spark, cells), ["p", "q", "r", "s"], seed).collect()
    assert {(r["cluster"], r["period"]): r["text"] for r in rows} == in_turn(cells, ["p", "q", "r", "s"], seed)


def test_sample_with_a_cluster_known_only_by_shared_texts(spark):
    got = sampled(spark, {(0, "p"): ["a", "b", "c"], (1, "p"): ["a"], (2, "q"): ["b"]}, ["p"])
    assert len(got) == 3


def pairs_of(rows):
    return {(r["id_a"], r["id_b"]) for r in rows}


def test_usage_pairs_are_all_unordered_pairs(spark):
    rows = [("w", i, i % 2, "p", f"t{i}") for i in range(7)] + [("v", i, 0, "p", f"s{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "word string, id int, cluster int, period string, text string")
    got = A.usage_pairs(df).collect()
    assert len(got) == 21 + 1
    assert pairs_of(r for r in got if r["lemma"] == "w") == {(i, j) for i in range(7) for j in range(i + 1, 7)}


def test_control_pairs(spark):
    df = spark.createDataFrame([("w", 0, 1, "p", "a b c d [[w]] e f g h")], "word string, id int, cluster int, period string, text string")
    rows = A.control_pairs(df, pairs_per_usage=3).collect()
    assert len(rows) == 3
    for r in rows:
        full, cut = sorted((r["a"], r["b"]), key=len, reverse=True)
        assert full == "a b c d [[w]] e f g h" and cut in full and "[[w]]" in cut
    same = A.control_pairs(df, shift=False).collect()
    assert len(same) == 1 and same[0]["a"] == same[0]["b"]
    for options in ({"pairs_per_usage": 2, "shift": False}, {"pairs_per_usage": 11}):
        with pytest.raises(ValueError):
            A.control_pairs(df, **options)


def test_excluded_words_give_no_snippets(spark):
    rows = [("mean", 0, 1, "i", ["a", "b"], 0), ("word", 0, 1, "j", ["a", "b"], 1)]
    df = spark.createDataFrame(rows, "word string, cluster int, period int, usage_id string, context array<string>, position int")
    got = A.prepare_snippets(df, labels={1: "1910s"}, excluded=A.EXCLUDED_WORDS).collect()
    assert [tuple(r) for r in got] == [("word", 0, "1910s", "j", "a [[b]]")]


def test_full_outer_join_keeps_both_sides(spark):
    clusters = spark.createDataFrame([(5, 7, 1, ["a", "z"]), (5, 8, 2, ["a"]), (4, 7, 3, ["a"])], "k_clusters int, layer int, cluster_id int, sentence_uids array<string>")
    occurrences = spark.createDataFrame([("a", "s"), ("b", "t")], "bnc_index string, sentence string")
    got = U.join_clusters(occurrences, U.labels_of_members(clusters, 5, 7)).collect()
    assert {tuple(r) for r in got} == {("a", "s", "1"), ("b", "t", None), ("z", None, "1")}


def test_joins_and_blocks_beyond_the_broadcast_size(spark, monkeypatch):
    _, df = points(spark)
    small = {r["usage_id"]: r["vector"] for r in V.standardize(df).collect()}
    _, labels = K.fit(df, ["word"], [3], block_rows=7)
    want = {(r["word"], r["usage_id"]): r["label"] for r in labels.collect()}
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    salted = {r["usage_id"]: r["vector"] for r in V.standardize(df).collect()}
    assert salted == small
    _, labels = K.fit(df, ["word"], [3], block_rows=7)
    assert {(r["word"], r["usage_id"]): r["label"] for r in labels.collect()} == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sample_looks_up_ids_before_texts_are_made_and_ends_with_the_last_cell(spark, monkeypatch):
    steps = {}

    def noted(df, name="step"):
        steps.setdefault(name, []).append(_plan(df))
        return cut_lineage(df, name)

    monkeypatch.setattr(A, "cut_lineage", noted)
    rows = [("w", c, p, f"{c}{p}{i}", ["a", f"t{c}{p}{i}", "b", "."], 1) for c in (0, 1) for p in ("p", "q") for i in range(3)]
    made = spark.createDataFrame(rows, "word string, cluster int, period string, usage_id string, context array<string>, position int")
    sampled = A.sample_snippets(A.prepare_snippets(made), ["p", "q"])
    assert sampled.count() == 4
    # Every cell has texts of its own: the cluster's and the word's are not offered any more.
    assert len(steps["offered"]) == 1
    assert "IN (" in steps["shown"][0] or "INSET" in steps["shown"][0]


def test_snippets_search_for_markup_before_they_replace_it(spark):
    texts = [
        ["x", "##y", "hit", "[PAD]", "z", "."], ["<", "p", ">", "hit", "&", "lt", ";", "."], ["/", "/", "hit", "a", "[UNK]", "##b"],
        ["&", "gt", ";", "hit", "c"],
    ]
    rows = [(i, t, t.index("hit")) for i, t in enumerate(texts)]
    made = A.with_snippets(spark.createDataFrame(rows, "id int, context array<string>, position int"))
    assert "regexp_replace" not in _plan(made)
    assert [r["text"] for r in made.orderBy("id").select("text").collect()] == [
        "xy [[hit]] z .", " [[hit]] < .", " [[hit]] a b", "> [[hit]] c",
    ]


def test_partitions_of_blocks_follow_the_cores(spark):
    rows = [("w", i, [float(i), 1.0]) for i in range(400)]
    points = spark.createDataFrame(rows, "word string, usage_id long, vector array<double>")
    counts = cut_lineage(B.block_counts(points, ["word"], 2))
    blocks = B.with_blocks(points, counts, ["word"], "usage_id")
    assert blocks.rdd.getNumPartitions() <= B.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert blocks.count() == 400 and blocks.select("block").distinct().count() > 100
    blocks.unpersist()


def test_only_hot_keys_are_copied_for_a_join(spark, monkeypatch):
    monkeypatch.setattr(B, "HOT_ROWS", 50)
    big = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "key string, id int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("other", 4)] + [(f"k{i}", i) for i in range(40)], "key string, v int")
    salted, copied = B.salted_sides(big, small, ["key"], ["id"])
    assert copied.count() == 42 + 2 * B.JOIN_SALTS
    assert salted.where("key = 'hot'").select("_salt").distinct().count() > 10
    got = B.join_small(big, small, ["key"], ["id"], False)
    assert got.columns == ["key", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.join_small(big, small, ["key"], ["id"], True).collect()))


def test_likelihood_is_the_same_without_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([("a b a c a b",), ("a d b",), (None,), ("",)], "text string")
    bigrams = colloc.ngrams_of_texts(texts, 2)
    plain = sorted(map(tuple, colloc.likelihood_ratio(bigrams, 1).collect()))
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(B, "HOT_ROWS", 2)
    assert sorted(map(tuple, colloc.likelihood_ratio(bigrams, 1).collect())) == plain


def test_slices_of_ngrams_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(colloc, "SLICE_CHARS", 100)
    rows = [(i % 7 or None, "a b c d e " * 10) for i in range(40)] + [(8, None), (None, "")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    slices = colloc.in_slices(texts, ["doc_id", "text"])
    assert slices.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, slices.collect()), key=str) == sorted(rows, key=str)
    got, want = (colloc.ngram_counts(colloc.ngrams_of_texts(t, 3)).collect() for t in (slices, texts))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert colloc.in_slices(texts.where("false"), ["doc_id"]).count() == 0
