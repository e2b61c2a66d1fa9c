"""What the Voronoi join sends."""

import numpy as np

from wordtide.llm import voronoi


def clustered(spark, n, groups=8):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, 6)) * 1000
    rows = [(i, (centres[i % groups] + rng.normal(size=6)).round().tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<double>"), np.array([r[1] for r in rows])


def test_blocks_go_only_to_slices_of_queries_that_reach_their_cell(spark, monkeypatch):
    data, x = clustered(spark, 4000)
    asked = data.where("id % 10 = 0")
    sent, whole = [], voronoi._cut
    monkeypatch.setattr(voronoi, "_cut", lambda *a: sent.append((a, whole(*a))) or sent[-1][1])
    found = voronoi.top_k(data, asked, 5, cells=8, block_rows=200, slice_rows=10).collect()
    (placed, _, slices), cut = sent[0]
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    assert cut.count() == sum(n * slices[c] for c, n in sizes.items())
    # 400 queries are 40 slices; a cell is reached by those of few groups.
    assert cut.count() < 4000 * 40 / 2
    for query in (0, 10, 3990):
        scores = x @ x[query]
        scores[query] = -np.inf
        want = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:5]
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])] == want


def test_a_single_slice_moves_the_data_once_at_most(spark, monkeypatch):
    data, _ = clustered(spark, 1000)
    sent, whole = [], voronoi._cut
    monkeypatch.setattr(voronoi, "_cut", lambda *a: sent.append(whole(*a)) or sent[-1])
    assert voronoi.top_k(data, data.where("id < 20"), 3).count() == 60
    assert sent[0].count() <= 1000
