"""The llm operators against plain versions and on their edge cases."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordtide.llm import (
    chat,
    labelled,
    minhash,
    nndescent,
    packing,
    pieces,
    quality,
    queries,
    secrets,
    shingles,
    toxicity,
    voronoi,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def docs_of(spark, texts, start=1):
    rows = [(start + i, t, None, "n", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, tiny, duck):
    expected = duck.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, tiny).select(*expected.columns)
    assert sorted(rows_of(got), key=str) == sorted(expected.fetchall(), key=str)


# 10: archives


def test_archives_keep_any_payload_and_segment_large_ones(spark, tmp_path):
    end = "x" * 99 + "\r\n"
    same = "é" * 60
    htmls = [None, "", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9, end, "\r\n\r\n" * 40, same, same, "z" * 1000, "short", "short"]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: 1", h, 5) for i, h in enumerate(htmls)]
    rows += [(None, "u", same, 5), (5, "u", same, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int")
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path, chunk_bytes=64)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    for r in records:
        page = re.search(r"page:(\w+)", r["record_id"])[1]
        data = (same if page == "null" else htmls[int(page)] or "").encode()
        assert r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert r["payload_bytes"] == len(data)
        assert r["stated_digest"] == "sha256:" + r["payload_digest"]
        assert r["type"] == ("revisit" if page == "6" else "response")
        assert r["refers_to"] == ("<urn:page:5>" if page == "6" else None)
        if page == "7":
            assert r["chunks"] == 16
    chunks = warc.read_chunks(spark, path).where("record_id = '<urn:page:7>'").orderBy("chunk").collect()
    assert [c["chunk"] for c in chunks] == list(range(16)) and max(len(c["data"]) for c in chunks) <= 64
    assert b"".join(bytes(c["data"]) for c in chunks) == b"z" * 1000
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_a_record_is_not_cut_between_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 2, raising=False)
    limit = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(limit, 2)
    try:
        htmls = {i: chr(97 + i) * (64 * (i + 3) + 1) for i in range(6)}
        rows = [(i, f"http://h/{i}", h) for i, h in htmls.items()]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        path = str(tmp_path / "archive")
        warc.write_archives(pages, path, chunk_bytes=64)
    finally:
        spark.conf.unset(limit)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    for r in records:
        data = htmls[int(re.search(r"page:(\d+)", r["record_id"])[1])].encode()
        assert r["payload_bytes"] == len(data) and r["chunks"] == -(-len(data) // 64)
        assert r["payload_digest"] == hashlib.sha256(data).hexdigest()


def test_a_continuation_without_its_record_is_an_error(spark):
    import pyarrow as pa

    def archive(file, *records):
        heads = [b"".join(b"%s: %s\r\n" % h for h in fields) for fields in records]
        pieces = [p for h in heads for p in (b"WARC/1.1\r\n" + h + b"Content-Length: 1", b"x")]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(pieces)), pa.array(pieces)], ["file", "piece"])

    first = ((b"WARC-Type", b"response"), (b"WARC-Record-ID", b"<a>"))
    more = ((b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<a#1>"), (b"WARC-Segment-Origin-ID", b"<a>"))
    stray = (*more[:2], (b"WARC-Segment-Origin-ID", b"<b>"))
    whole = [archive("f", first, more)]
    assert [b.column("payload_bytes").to_pylist() for b in warc._to_records(whole)] == [[2]]
    for batches in ([archive("f", first, stray)], [archive("f", first), archive("g", more)]):
        for reader in (warc._to_records, warc._to_chunks):
            with pytest.raises(ValueError, match="does not follow"):
                list(reader(batches))


# 8: chats


def test_layouts_become_the_same_turns(spark):
    records = [
        (1, '{"prompt": "hi", "completion": "yo"}'),
        (2, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}'),
        (3, '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}'),
        (4, '{"instruction": "hi", "output": "yo"}'),
        (5, '{"odd": 1.5}'),
        (6, "no json"),
        (7, None),
        (8, '{"instruction": "be", "input": null, "output": "yo"}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    turns = collections.defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "position").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    both = [("user", "hi"), ("assistant", "yo")]
    assert [turns[i] for i in (1, 2, 3, 4)] == [both] * 4
    assert [turns[i] for i in (5, 6, 7)] == [[(None, None)]] * 3
    assert turns[8] == [("system", "be"), ("assistant", "yo")]
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(out) == {1, 2, 3, 4, 8} and out[1]["loss_chars"] == 2


LAYOUT_CASES = [
    ('{"messages": [{"role": "user", "content": "hi", "name": "z"}, {"role": "assistant", "content": "yo"}], "id": 7}', "messages"),
    ('{"source": "w", "prompt": "hi", "completion": "yo", "score": [1, 2], "meta": {"a": {"b": null}}}', "prompt"),
    (
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "image"}, "i"]},'
        ' {"role": "assistant", "content": ["yo"]}]}',
        "messages_of_parts",
    ),
    ('{"messages": [{"role": "user", "content": ["hi"]}, {"role": "assistant", "content": "yo"}], "prompt": "x"}', "messages"),
    (
        '{"prompt": [{"role": "user", "content": "hi"}], "completion": [{"role": "assistant", "content": "yo"}]}',
        "prompt_messages",
    ),
    ('{"messages": [], "id": 1}', chat.NO_TURNS),
    ('{"prompt": null, "completion": null}', chat.NO_TURNS),
    ('{"prompt": ["a", "b"], "completion": "yo"}', chat.NO_LAYOUT),
    ('{"messages": ["a"], "message.content": "b", "message": 1}', chat.NO_LAYOUT),
    ('{"messages": {}}', chat.NO_LAYOUT),
    ("{}", chat.NO_LAYOUT),
    ("[1]", chat.NO_LAYOUT),
    ("", chat.NO_JSON),
    (None, chat.NO_JSON),
]


def test_further_fields_do_not_hide_a_layout(spark):
    rows = [(i, r) for i, (r, _) in enumerate(LAYOUT_CASES)]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("layout", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append((r["role"], r["text"], r["layout"], r["unmatched"]))
    for i, (_, expected) in enumerate(LAYOUT_CASES):
        if expected in (chat.NO_JSON, chat.NO_LAYOUT, chat.NO_TURNS):
            assert [x[:2] + x[3:] for x in got[i]] == [(None, None, expected)]
        else:
            assert got[i] == [("user", "hi", expected, None), ("assistant", "yo", expected, None)]
    lost = {r["conv_id"]: r["unmatched"] for r in chat.unmatched(df).collect()}
    formatted = {r["conv_id"] for r in chat.format_chats(df).collect()}
    assert set(lost) | formatted == set(range(len(LAYOUT_CASES))) and not set(lost) & formatted
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_an_item_that_is_no_object_is_a_turn_without_role(spark):
    record = '{"messages": ["hi", {"role": "gpt", "content": {"a": 1}}, {"role": null, "content": null}, null]}'
    df = spark.createDataFrame([(1, record)], "conv_id long, record string")
    turns = [(r["role"], r["text"]) for r in chat.canonical_turns(df).orderBy("position").collect()]
    assert turns == [("", "hi"), ("assistant", '{"a":1}'), ("", ""), ("", "")]


def test_paths_tell_names_from_nesting(spark):
    record = '{"a": 1, "b.c": 1, "d": {"e": [1], "f": {}}, "g": [{"h": 1}, 2], "i": [], "j[]": null}'
    df = spark.createDataFrame([(record,)], "record string")
    paths = df.select(chat.paths_of(F.try_parse_json("record"))).first()[0]
    assert paths == ["a", "b\\.c", "d.e[]", "d.f", "g[]", "g[].h", "i[0]", "j\\[]"]


def test_escapes_are_reversible(spark):
    hard = ["", "\\", "### ### x", "</turn>", "<\\/turn>", "\\### Assistant: </turn> ok", "#\\## ", "a\nb\\\n", "é🙂" * 3000]
    rows = [(i // 3 if i else None, i, "assistant" if i % 2 else "us:er:\n\\", t) for i, t in enumerate(hard)]
    rows += [(9, None, None, "x"), (9, None, None, "x")]
    fields = "conv_id long, position long, role string, text string"
    turns = spark.createDataFrame([(c, p, r or "", t) for c, p, r, t in rows], fields)
    pieces_ = chat.formatted(turns)
    got = {r["conv_id"]: r for r in chat.read_back(pieces_).collect()}
    by = collections.defaultdict(list)
    for conv, position, role, text in rows:
        by[conv].append((-1 if position is None else position, role or "", text))
    for conv, own in by.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own).encode()
        learned = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(learned))
    assert chat.read_back(pieces_.limit(0)).count() == 0


# 5 and 6: vectors


def exact(rows, queries_, k):
    out = {}
    for q, x in queries_:
        best = collections.defaultdict(lambda: -math.inf)
        for i, y in rows:
            if i != q:
                best[i] = max(best[i], sum(a * b for a, b in zip(x, y)))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [(i, -s) for s, i in own] for q, own in out.items()}


@pytest.mark.parametrize("cells,block", [(1, 4), (5, 7), (40, 3)])
def test_voronoi_join_is_exact(spark, cells, block):
    draw = random.Random(cells)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(4)]) for i in range(120)]
    rows += rows[:5] + [(500, [1.0] * 4), (501, [1.0, 1.0]), (500, [2.0] * 4), (502, [])]
    data = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = data.where("id % 10 = 0")
    got = voronoi.top_k(data, asked, 5, cells=cells, sample=30, block_rows=block, slice_rows=4).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["id"], r["score"]))
    plain = [(q, x) for q, x in rows if q % 10 == 0]
    want = {}
    for q in {q for q, _ in plain}:
        merged = collections.defaultdict(lambda: -math.inf)
        for x in (x for i, x in plain if i == q):
            for i, s in exact(rows, [(q, x)], 10**6)[q]:
                merged[i] = max(merged[i], s)
        want[q] = [(i, s) for s, i in sorted((-s, i) for i, s in merged.items())[:5]]
        want[q] = [(i, -s) for i, s in want[q]]
    assert dict(found) == want
    assert voronoi.top_k(data.limit(0), asked, 5).count() == 0
    assert voronoi.top_k(data, asked.limit(0), 5).count() == 0


def test_vectors_with_holes_take_no_part(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 0.5]),
            (6, [0.0, 0.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = voronoi.scaled(data, "vec_id", "embedding")
    assert {r["id"] for r in scaled.collect()} == {5, 6, 7}
    near = nndescent.search(data, data, 3, "vec_id", "embedding").collect()
    assert {(r["query_id"], r["id"]) for r in near} == {(5, 7), (7, 5)}


def test_nn_descent_finds_and_scores(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(900, 16))
    vectors[300:330] = vectors[300]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    data = spark.createDataFrame(rows + rows[:3], "id long, vector array<double>")
    got = nndescent.search(data, data.where("id % 20 = 0"), 10, list_size=12, reverse=12, pool=60).collect()
    found = collections.defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["id"], r["score"])
    hits = 0
    for q in range(0, 900, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(scores, 9)))[:10]
        own = [found[q][r] for r in range(1, 11)]
        assert all(abs(s - scores[i]) < 1e-9 for i, s in own)
        hits += len({i for i, _ in own} & set(best.tolist()))
        if q == 300:
            assert {i for i, _ in own} == set(best.tolist())
    assert hits / (45 * 10) >= 0.9
    assert nndescent.search(data.limit(0), data, 5).count() == 0


def unit_vectors(spark, n, size):
    vectors = np.random.default_rng(7).normal(size=(n, size))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")


def test_the_pool_grows_to_the_recall(spark):
    vectors, data = unit_vectors(spark, 3000, 48)
    got = nndescent.search(data, data.where("id % 30 = 0"), 10, list_size=8, reverse=8, pool=16).collect()
    scores = vectors[::30] @ vectors.T
    scores[np.arange(100), np.arange(0, 3000, 30)] = -9
    best = np.argsort(-scores, axis=1)[:, :10]
    hits = sum(r["id"] in best[r["query_id"] // 30] for r in got)
    assert len(got) == 1000 and hits >= 950


def test_the_whole_pool_is_scored_by_the_original_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = np.ones(16) + 1e-5 * draw.normal(size=(200, 16))  # equal as bytes
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    nodes = rows.selectExpr("id as node", "vector", "1L as copies")
    pool = spark.createDataFrame([(0, i, 1.0) for i in range(1, 200)], "node long, other long, near double")
    named, asked = rows.selectExpr("id", "id as node", "1L as copies"), rows.where("id = 0").selectExpr("id as query_id", "id as node")
    got = nndescent._exact(pool, nodes, named, asked, rows, 5, 16).orderBy("rank").collect()
    assert [r["id"] for r in got] == (1 + np.argsort(-(vectors[1:] @ vectors[0]))[:5]).tolist()


def test_lists_that_have_not_settled_still_give_the_asked_recall(spark):
    vectors, data = unit_vectors(spark, 3000, 48)
    found = nndescent.search(data, data.where("id % 300 = 0"), 10, list_size=8, reverse=8, rounds=1).collect()
    hits = 0
    for q in range(0, 3000, 300):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:10].tolist()) & {r["id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * 100


# 1: near duplicates


def shingle_set(text, words):
    own = [w.decode() for w in (text or "").encode().lower().split()]
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1)))


def plain_components(texts, words, percent):
    sets = {i: shingle_set(t, words) for i, t in texts}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return sets, label


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, words, percent):
    draw = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "é É", "É é"]
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([8, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 30))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy).upper() if draw.random() < 0.3 else "\t".join(copy))
    pairs = list(enumerate(texts, 1))
    frame = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame, words=words, percent=percent).collect()}
    sets, label = plain_components(pairs, words, percent)
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (label[i] == i) for i in sets)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", 1), (4, "a b c d", 1), (4, "a b c d", 1), (9, "A B c d", 1), (None, "x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(rows_of(minhash.near_duplicates(df)), key=str)
    want = [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 1, None, False), (None, 2, 4, False)]
    assert got == sorted(want, key=str)


def test_chunks_guarantee_a_shared_key():
    draw = np.random.default_rng(3)
    errors = minhash.most_errors(85)
    edges = minhash.chunk_edges(minhash.PLACES, errors)
    assert errors // len(edges) <= 1 and edges[-1][1] == minhash.PLACES
    for _ in range(300):
        wrong = np.zeros(minhash.PLACES, dtype=bool)
        wrong[draw.choice(minhash.PLACES, errors, replace=False)] = True
        assert min(wrong[a:b].sum() for a, b in edges) <= 1


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97}é" for i in range(5000))
    whole = next(shingles.shingle_sets([text], 3))
    monkeypatch.setattr(shingles, "STEP_BYTES", 1000)
    assert (next(shingles.shingle_sets([text], 3)) == whole).all()
    assert len(whole) == len(shingle_set(text, 3))


# 2 and 4: classifiers


def labelled_texts(spark, toxic, low):
    draw = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    texts, labels = [], []
    for i in range(400):
        words = [draw.choice(vocabulary) for _ in range(30)]
        y = i % 8 == 0
        if y and toxic:
            words[draw.randrange(30)] = draw.choice(["vile", "vileness", "rotten"])
        text = " ".join(words)
        if y and low:
            text = " ".join(f"{w.upper()}!!" for w in words)
        texts.append(text)
        labels.append((i + 1, 0 if low and y else 1 if low else int(y), int(y)))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_texts(spark, True, False)
    got = toxicity.flagged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 60 and all(r["predicted"] == r["toxic"] for r in got)
    evidence = next(r["neighbours"] for r in got if r["toxic"])
    assert evidence[0]["label"] == 1 and evidence[0]["similarity"] > 0
    hidden = labels.withColumn("toxic", F.when(labelled.remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.flagged(docs, hidden).select("doc_id", "score").collect()
    plain = toxicity.flagged(docs, labels).select("doc_id", "score").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, plain))


def test_block_max_search_is_exact():
    draw = random.Random(2)
    idf = [draw.uniform(1, 5) for _ in range(30)]
    rows = []
    for i in range(500):
        terms = sorted(draw.sample(range(30), draw.randint(0, 5)))
        rows.append((i, draw.randint(0, 1), terms, [draw.randint(1, 3) for _ in terms]))
    index = toxicity.Index(rows, idf)
    vectors = [dict(zip(t, toxicity.weights(t, u, idf))) for _, _, t, u in rows]
    for i, _, terms, uses in rows[:80]:
        own = dict(zip(terms, toxicity.weights(terms, uses, idf)))
        scores = [(round(sum(w * v.get(t, 0) for t, w in own.items()), 9), -j) for j, v in enumerate(vectors)]
        want = [(s, -j) for s, j in sorted((x for x in scores if x[0] > 0 and -x[1] != i), reverse=True)[:10]]
        assert [(round(s, 8), j) for j, s, _ in index.nearest(terms, uses, 10, i)] == [(round(s, 8), j) for s, j in want]


def test_calibration_never_falls():
    draw = random.Random(0)
    bins = {b: (n := draw.randint(0, 9), draw.randint(0, n)) for b in range(-1, toxicity.BINS)}
    levels = toxicity.calibration(bins, 0.1)[1:]
    assert levels == sorted(levels) and 0 <= levels[0] and levels[-1] <= 1


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_texts(spark, False, True)
    got = quality.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80 and all(r["predicted"] == r["quality"] for r in got)


def test_quality_vote_is_that_of_all_products():
    draw = np.random.default_rng(0)
    counts = draw.poisson(0.5, size=(80, quality.FEATURES)).astype("float32")
    model = quality.fit([(c.tobytes(), int(i % 3 == 0)) for i, c in enumerate(counts)], {quality.FEATURES: 80}, 20)
    own = draw.poisson(0.5, size=(9, quality.FEATURES)).astype("float64")
    got = quality.vote(model, own, 7)
    latent = quality.unit(quality.weighted(own, model["idf"]) @ model["axes"])
    for row, score in zip(latent, got):
        near = sorted(((row @ v, y) for v, y in zip(model["vectors"], model["labels"])), reverse=True)[:7]
        weight = [max(c, 0) ** quality.POWER for c, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)) < 1e-9


@pytest.mark.parametrize("run", [toxicity.flagged, quality.judged])
def test_classifiers_on_odd_rows(spark, run):
    docs, labels = labelled_texts(spark, True, True)
    odd = spark.createDataFrame(
        [(None, "x", None, "a", 1), (9001, None, "", None, None), (9002, "", None, None, 0), (1, "again é", "l", "s", 1)]
        + [(9003, "long " * 60_000, None, None, 0)], DOCS,
    )
    noise = spark.createDataFrame([(None, 1, 1), (9002, None, None), (9001, 1, 1), (9999, 0, 0)], labels.schema)
    got = run(docs.unionByName(odd), labels.unionByName(noise)).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert run(docs.limit(0), labels).count() == 0
    alone = run(docs.limit(5), labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.0 if run is toxicity.flagged else 0.5}


# 3: secrets


def plain_base(text):
    pattern = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(1)
    parts = ["password", "Token", "api_key", "apikey", "ſecret", "secret", "=", ": ", ":", '"', "'", " ", "abc", "abcdef12", "é",
             "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "x=y"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def test_lexer_follows_constants(spark):
    text = 'raw = "q7!Zp-40xY"\ndb_pwd = raw\ncolor = "q7!Zp-41xY"\nclient_secret_file = "q7!Zp-42xY"\n'
    text += 'auth_token: "ab" + "Cd9$kk1z"\npassword = "hunter22"\nloop_secret = other\nother = loop_secret\n'
    got = {text[a:b] for a, b, *_ in secrets.literals(text)}
    assert "q7!Zp-40xY" in got and "Cd9$kk1z" in got
    assert not got & {"q7!Zp-41xY", "q7!Zp-42xY"}
    rows = secrets.findings(docs_of(spark, [text, None, ""])).collect()
    assert all(text[r["start"] : r["end"]] == r["value"] for r in rows)
    assert {"assign", "literal"} <= {r["kind"] for r in rows}


def test_scan_on_odd_rows_and_redaction(spark):
    long = "word: x " * 50_000 + "token=abcdef99"
    df = docs_of(spark, [None, "", "token = abcdef12 é", "plain", long]).union(docs_of(spark, ["plain"]))
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2]["base_sha256"] == empty and got[2]["spans"] == ""
    assert got[3]["spans"] == "assign:0:16" and got[5]["n_assign"] == 1
    texts = {r["text"] for r in secrets.redact(df).collect()}
    assert {None, "", "[SECRET] é", "plain"} <= texts and not any("abcdef" in (t or "") for t in texts)
    assert secrets.scan(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).count() == 0


# 7: pieces


ENTRIES = [("<unk>", 0.0, "other"), *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256))] + [
    ("▁", -2.0, "piece"), ("a", -2.5, "piece"), ("b", -2.5, "piece"), ("ab", -4.0, "piece"), ("▁a", -3.0, "piece"),
    ("▁ab", -5.5, "piece"), ("ba", -4.9, "piece"), ("aba", -6.0, "piece"), ("▁▁", -3.0, "piece"),
]


def best_score(vocab, scores, text):
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + vocab.longest) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
                single |= j == i + 1
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + vocab.unknown_score)
    return best[-1]


def test_long_chunks_take_the_same_paths(monkeypatch):
    draw = random.Random(3)
    whole = pieces.read_vocabulary()
    for vocab, letters in ((pieces.vocabulary(ENTRIES), "abc é▁"), (whole, "etaoinshr é▁🙂字 \\n0")):
        chunks = ["".join(draw.choices(letters, k=draw.randint(1, 400))) for _ in range(60)] + ["a" * 300, " " * 300]
        expected = pieces._viterbi_block(vocab, chunks, np)
        for cut in (1, 7, 100):
            monkeypatch.setattr(pieces, "LONG_CHUNK", cut)
            assert pieces.viterbi(vocab, chunks) == expected


def test_a_long_chunk_is_encoded_in_linear_time(spark):
    word = "".join(random.Random(4).choices("etaoinshrdlu", k=1000))
    df = docs_of(spark, [word * 400, word * 100, word])
    got = {r["doc_id"]: r for r in pieces.roundtrip(df).collect()}
    assert all(r["restored"] for r in got.values())
    assert 399 < got[1]["n_tokens"] / got[3]["n_tokens"] < 401


def test_viterbi_finds_the_best_path():
    vocab = pieces.vocabulary(ENTRIES)
    scores = {p.replace("▁", " "): s for p, s, kind in ENTRIES if kind == "piece"}
    draw = random.Random(4)
    for _ in range(400):
        text = " " + "".join(draw.choice("aab bxé▁\n") for _ in range(draw.randint(0, 20)))
        found = pieces.chunk_pattern(vocab).findall(text)
        assert "".join(found) == text
        ids = np.frombuffer(b"".join(pieces.viterbi(vocab, found)), dtype="<i4").tolist()
        assert b"".join(vocab.pieces[i] for i in ids).decode() == text
        total, at = 0.0, 0
        for i in ids:
            piece = vocab.pieces[i].decode("utf-8", "replace")
            if ENTRIES[i][2] == "piece":
                total += scores[piece]
        unknown = sum(c in "xé▁\n" for c in text)
        assert abs(total + unknown * vocab.unknown_score - best_score(vocab, scores, text)) < 1e-9
        del at


def test_encoding_restores_texts(spark):
    texts = [None, "", " ", "The  quick\n\nbrown\tfox ", "▁mark", "日本語 🙂 ünï", "a" * 3000, "the of " * 9000]
    df = docs_of(spark, texts).withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df)).collect()}
    assert [got[i + 1]["decoded"] for i in range(len(texts))] == texts
    assert got[1]["ids"] is None and got[2]["ids"] == [] and got[3]["source"] == "n"
    assert all(r["restored"] for r in pieces.roundtrip(df).collect())
    assert pieces.roundtrip(df.limit(0)).count() == 0


# 9: packing


def plain_waste(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_waste_least():
    from itertools import combinations

    draw = random.Random(6)
    for _ in range(40):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 30))]
        counts = collections.Counter(lengths)
        got = packing.boundaries(list(counts), list(counts.values()), 3)
        most = max(lengths)
        options = [c for n in range(3) for c in combinations(sorted(set(lengths) - {most}), n)]
        assert plain_waste(lengths, got) == min(plain_waste(lengths, [*c, most]) for c in options)
        assert len(got) <= 3


def test_batches_hold_all_tokens_within_the_budget(spark):
    draw = random.Random(8)
    texts = [" ".join("w" * 1 for _ in range(draw.choice([0, 3, 17, 90, 250]))) for _ in range(120)] + [None, "  "]
    df = docs_of(spark, texts).union(docs_of(spark, ["again"]))
    got = packing.pack(df, buckets=4, max_length=100, batch_tokens=400).collect()
    seen = collections.Counter()
    batches = collections.defaultdict(list)
    for r in got:
        seen[r["doc_id"]] += r["length"]
        assert r["length"] <= 100
        if r["length"]:
            assert r["padding"] == r["bucket"] - r["length"] >= 0
            batches[r["bucket"], r["batch"]].append(r)
        else:
            assert r["bucket"] is None and r["batch"] is None
    for i, text in enumerate(texts, 1):
        assert seen[i] == len((text or "").split()) + (i == 1)
    last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
    for (bucket, n), own in batches.items():
        room = max(1, 400 // bucket)
        assert len(own) <= room and (n == last[bucket] or len(own) == room)
    assert packing.pack(df.limit(0)).count() == 0


# The pipeline


def test_pipeline_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, tiny)
        assert docs.columns == columns and docs.schema == before.schema, name
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, docs))
        assert set(new) <= set(old)
        if name == "near duplicates":
            _, label = plain_components(sorted(old.items()), 5, 80)
            assert set(new) == {i for i in old if label[i] == i}
        if name == "secrets":
            assert set(new) == set(old)
            assert not any(plain_base(t) for t in new.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.pack(spark, docs, tiny).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert dict(tokens) == {i: len(t.split()) for i, t in new.items()}


def test_pipeline_on_odd_documents(spark, tiny):
    rows = [(None, None, None, None, None), (1, "", "l", "s", 0), (1, "", "l", "s", 0), (2, None, None, None, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    for frame, left in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, tiny)
            assert frame.columns == docs.columns
        assert frame.count() == left
