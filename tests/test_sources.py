import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators import blocks as B, hits as H
from wordtide.plans import corpus
from wordtide.session import new_path
from wordtide.sources import readers, writers
from wordtide.streaming.ingest import append_new_files

META = (
    "header\nof three\nlines\n"
    "1\t10\t1999\tACAD\t101\tNature\tA \\u00e9t\\xe9\tpress\n"
    "x2\t5\t2000\tFIC\t1\tBook\tB\tpress\n"
    "4122123\t12d\t\tNEWS\t1e3\tPaper\tC\tpress\n"
)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "texts" / "news"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("junk @@0000001 One. Two @ @ @ @ @ @ @ @ @ @ .\n@@4122123")
    (folder / "b.txt").write_text("@@0000007 Seven!")
    (tmp_path / "meta.txt").write_text(META)
    return tmp_path


def test_metadata(spark, raw):
    rows = {r["textID"]: r for r in readers.corpus_metadata(spark, str(raw / "meta.txt")).collect()}
    assert set(rows) == {1, 4122123}
    assert rows[1]["title"] == "A été" and rows[1]["year"] == 1999
    assert rows[4122123]["#words"] is None and rows[4122123]["year"] is None and rows[4122123]["subgen"] == 1000


EXPECTED = {(1, "One.", 1999), (4122123, "", None), (7, "Seven!", None)}


def test_clean_corpus(spark, raw):
    out = new_path(spark, "test-clean")
    corpus.run(spark, str(raw / "texts"), str(raw / "meta.txt"), out)
    table = readers.clean_corpus(spark, out)
    assert table.columns == list(writers.CLEAN_SCHEMA)
    assert {(r["textID"], r["doc_text"], r["year"]) for r in table.collect()} == EXPECTED
    counts = corpus.documents_per_file(readers.corpus_files(spark, str(raw / "texts")))
    assert sorted(r["n_docs"] for r in counts.collect()) == [1, 2]


def test_incremental_ingest_appends_once(spark, raw):
    out, progress = new_path(spark, "test-stream"), new_path(spark, "test-progress")
    metadata = readers.corpus_metadata(spark, str(raw / "meta.txt"))
    for _ in range(2):
        append_new_files(spark, str(raw / "texts"), metadata, out, progress).awaitTermination()
    rows = readers.table(spark, out)
    assert {(r["textID"], r["doc_text"], r["year"]) for r in rows.collect()} == EXPECTED
    (raw / "texts" / "news" / "c.txt").write_text("@@0000008 Eight.")
    append_new_files(spark, str(raw / "texts"), metadata, out, progress).awaitTermination()
    assert readers.table(spark, out).count() == 4


def test_hits_are_exact_and_survive_csv(spark):
    docs = spark.createDataFrame([(1, 'A "model", Model; model\nmodels. the model.'), (2, None), (3, "")], "doc_id long, text string")
    hits = H.collect_hits(docs, ["model"])
    rows = sorted((r["sent_idx"], r["start_idx"], r["end_idx"]) for r in hits.collect())
    assert rows == [(0, 2, 3), (0, 7, 8), (1, 1, 2)]
    path = new_path(spark, "test-hits")
    writers.hits_by_word(hits, path)
    back = readers.token_hits(spark, path, ["model"])
    key = lambda r: (r["corpus_id"], r["sentence"], r["start_idx"], r["end_idx"], r["word"])
    assert sorted(map(key, back.collect())) == sorted(map(key, hits.collect()))
    assert readers.token_hits(spark, path, ["absent"]).count() == 0


def test_targets_from_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b. c a")], "doc_id long, text string")
    targets = spark.createDataFrame([("a",), ("a",), ("c",)], "word string")
    expected = sorted(map(tuple, H.collect_hits(docs, ["a", "c"]).collect()))
    assert sorted(map(tuple, H.collect_hits(docs, targets).collect())) == expected
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, H.collect_hits(docs, targets).collect())) == expected
    assert H.collect_hits(docs, []).count() == 0 and H.hit_contexts(docs, []).count() == 0


def test_contexts_are_short_at_document_edges_only(spark):
    text = "a. " * 15 + "the b c d. " + "e f. g. " * 9
    docs = spark.createDataFrame([(1, text), (2, "the end"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["corpus_id"]: r for r in H.hit_contexts(docs, ["the"]).collect()}
    tokens = [t for t in text.replace(".", " .").split()]
    at = tokens.index("the")
    assert set(got) == {1, 2} and got[2]["context"] == ["the", "end"]
    assert got[1]["context"] == tokens[at - 10 : at + 5 + 10] and got[1]["position"] == 10


def test_feature_vectors_read_what_was_written(spark):
    rows = [(1, '"', 0.5), (2, 'say "hi", you', 1.0), (3, "a\nb", None), (4, None, 2.0), (5, " x\\", 3.0), (6, "", None), (7, " pad ", 0.0)]
    schema = "id long, text string, f double"
    path = new_path(spark, "test-features")
    writers.csv_table(spark.createDataFrame(rows, schema), path)
    assert sorted(map(tuple, readers.feature_vectors(spark, path, schema).collect())) == rows


def test_article_limits_need_an_order(spark):
    spark.range(5).withColumnRenamed("id", "ID").createOrReplaceTempView("test_articles")
    assert readers.articles(spark, "test_articles").count() == 5
    assert [r["id"] for r in readers.articles(spark, "test_articles", 2, ["id"]).collect()] == [0, 1]
    with pytest.raises(ValueError):
        readers.articles(spark, "test_articles", 2)


def test_hits_without_paper_keep_null_years(spark):
    hits = spark.createDataFrame([(1, "w"), (9, "w")], "corpus_id long, word string")
    papers = spark.createDataFrame([(1, 1999)], "id long, y int")
    dated = H.attach_year(hits, papers, "id", F.col("y"))
    assert sorted((r["corpus_id"], r["year"]) for r in dated.collect()) == [(1, 1999), (9, None)]


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.json"
    path.write_text(json.dumps(["fact", "true"]))
    assert [tuple(r) for r in readers.word_list(spark, str(path)).collect()] == [(0, "fact"), (1, "true")]


def test_pair_sheet_refuses_mixed_lemmas(spark):
    row = {c: "x" for c in writers.PAIR_COLUMNS} | {"lemma_a": "x", "lemma_b": "y"}
    with pytest.raises(Exception, match="two lemmas"):
        writers.pair_sheet(spark.createDataFrame([row]), new_path(spark, "test-pairs"))


def test_compute_once_runs_once(spark):
    calls, path = [], new_path(spark, "test-once")

    def compute():
        calls.append(1)
        return spark.range(3)

    assert writers.compute_once(spark, path, compute).count() == 3
    assert writers.compute_once(spark, path, compute).count() == 3
    assert len(calls) == 1


def plain_documents(texts):
    return sorted(
        (name, int(body[:7]), body[7:].strip())
        for name, text in texts.items()
        for body in re.split(r"@@(?=\d{7})", text)[1:]
    )


def records_of(spark, folder):
    rows = readers.corpus_records(spark, str(folder)).select("path", T.document(F.col("value")).alias("d")).collect()
    return sorted((r["path"].rsplit("/", 1)[1], r["d"]["text_id"], r["d"]["doc_text"]) for r in rows)


def test_records_of_a_large_file_are_read_by_many_tasks(spark, tmp_path):
    draw = random.Random(1)
    text = "preamble " + "".join(f"@@{i:07d} " + "Some words here. " * draw.randint(0, 60) for i in range(1500))
    (tmp_path / "large.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7777")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert records_of(spark, tmp_path) == plain_documents({"large.txt": text})
        tasks = readers.corpus_records(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().count()
        assert tasks > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("split,run", [("16", ""), ("131072", "@"), ("131072", "@@@")])
def test_markers_inside_texts_go_back_to_their_document(spark, tmp_path, split, run):
    """Runs of the marker's character are only ambiguous where a split cuts through them."""
    texts = {
        "a.txt": f"1234567 not a document @@x @@0000001 One @@ two@@three. {run}@@0000002 Two.@@{run} @@0000003",
        "b.txt": "@@0000004@@0000005 é @@12 short ids stay @@123456\n@@0000006 end",
        "c.txt": "",
        "d.txt": "only a preamble @@ with a mark",
        "e.txt": "@@0000007 Seven.",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "16" else "4194304")
    try:
        assert records_of(spark, tmp_path) == plain_documents(texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_second_run_replaces_its_files_and_keeps_others(spark, raw):
    out = new_path(spark, "test-append")
    run = lambda folder: corpus.run(spark, str(folder), str(raw / "meta.txt"), out)
    shown = lambda: sorted((r["textID"], r["doc_text"]) for r in readers.clean_corpus(spark, out).collect())
    run(raw / "texts")
    first = shown()
    run(raw / "texts")
    assert shown() == first == [(1, "One."), (7, "Seven!"), (4122123, "")]
    more = raw / "more"
    more.mkdir()
    (more / "b.txt").write_text("@@0000009 Same name, other folder.")
    run(more)
    assert shown() == sorted([*first, (9, "Same name, other folder.")])
    (raw / "texts" / "news" / "b.txt").write_text("@@0000008 Changed.")
    run(raw / "texts")
    assert [t for t, _ in shown()] == [1, 8, 9, 4122123]


def test_pair_sheets_keep_blanks_and_empty_texts(spark):
    row = {c: "x" for c in writers.PAIR_COLUMNS} | {"id_a": 1, "id_b": 2, "cluster_a": 0, "cluster_b": 1}
    rows = [row | {"lemma_a": "x", "lemma_b": "x", "a": a, "b": b} for a, b in [(" pad ", ""), ('"q"', "tab\there"), ("", "  ")]]
    path = new_path(spark, "test-sheet")
    writers.pair_sheet(spark.createDataFrame(rows), path)
    got = sorted((r["a"], r["b"]) for r in readers.pair_sheet(spark, path).collect())
    assert got == sorted([(" pad ", ""), ('"q"', "tab here"), ("", "  ")])


def test_compute_once_reads_what_was_published_first(spark):
    path = new_path(spark, "test-race")

    def slower():
        writers.compute_once(spark, path, lambda: spark.range(5))  # another run is done in between
        return spark.range(9)

    assert writers.compute_once(spark, path, slower).count() == 5
    assert writers.compute_once(spark, path, lambda: spark.range(7)).count() == 5
    # A run that died left data without a row.
    left = new_path(spark, "test-left")
    spark.range(3).write.parquet(f"{left}/data/0-x")
    assert writers.compute_once(spark, left, lambda: spark.range(4)).count() == 4


def test_json_of_one_word_is_dealt_to_several_tasks(spark, tmp_path):
    path = str(tmp_path / "json")
    df = spark.range(500).selectExpr("'the' AS word", "id", "array(id) AS ids", "map('k', id) AS named")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.json_by_word(df, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "json" / "word=the").glob("*.json"))) > 1
    back = spark.read.schema("id long, ids array<long>, word string").json(path)
    assert sorted((r["word"], r["id"], r["ids"]) for r in back.collect()) == [("the", i, [i]) for i in range(500)]
