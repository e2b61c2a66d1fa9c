import re

import pytest
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.functions.periods import decade, lenient_number, period, to_year
from wordtide.operators.pairs import with_snippets


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_documents_are_split_at_markers(spark):
    raw = "preamble @@0000001 One.\n@@4122123@@4122124 Two @ three. "
    docs = one(spark, T.split_documents(F.col("v")), v=raw)
    assert [tuple(d) for d in docs] == [(1, "One."), (4122123, ""), (4122124, "Two @ three.")]


def test_redacted_sentences_are_dropped(spark):
    ten, nine = " ".join("@" * 10), " ".join("@" * 9)
    text = f"One two. Three {ten} four. Five!"
    assert one(spark, T.drop_redacted_sentences(F.col("v")), v=text) == "One two. Five!"
    text = f"Three {nine} four.\nFive! "
    assert one(spark, T.drop_redacted_sentences(F.col("v")), v=text) == f"Three {nine} four. Five!"


@pytest.mark.parametrize("text", ["", "a", "...a. b?! c", "no end", "\n\n. "])
def test_sentences_give_the_text_back(spark, text):
    assert "".join(one(spark, T.sentences(F.col("v")), v=text)) == text


def test_abbreviations_do_not_end_sentences(spark):
    text = "Dr. Smith i.e. he left. Was it?\nYes. U.S. law."
    parts = one(spark, T.abbreviation_aware_sentences(F.col("v")), v=text)
    assert parts == ["Dr. Smith i.e. he left.", "Was it?", "Yes.", "U.S. law."]


def test_abbreviation_split_on_whole_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(
        "text", T.abbreviation_aware_sentences(F.col("text")).alias("parts")
    )
    pattern = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")
    for text, parts in docs.collect():
        assert parts == [p for p in pattern.split(text.replace("\n", " ")) if len(p) < 150]


def test_length_limit_is_exclusive(spark):
    long, short = "a" * 149 + ".", "b" * 148 + "."
    assert one(spark, T.abbreviation_aware_sentences(F.col("v")), v=f"{long} {short}") == [short]


def test_first_position_and_tag(spark):
    words = F.split("v", " ")
    assert one(spark, T.first_position(words, "b"), v="a b b") == 1
    assert one(spark, T.first_position(words, "z"), v="a b b") is None
    tags = F.split(F.lit("D N V"), " ")
    assert one(spark, T.tag_of_first(words, tags, "b"), v="a b b") == "N"
    assert one(spark, T.tag_of_first(words, tags, "z"), v="a b b") == "X"


def test_wrap(spark):
    import textwrap

    text = "one two three four five six seven eight nine ten eleven twelve " * 3
    wrapped = one(spark, T.wrap(F.col("v")), v=text)
    assert wrapped.split("<br>") == textwrap.wrap(text, 50)


def brute_bounds(tokens, at):
    start = at
    while len(tokens) > start >= 0 and tokens[start] not in ".!?":
        start -= 1
    end = at
    while end < len(tokens) and tokens[end] not in ".!?":
        end += 1
    return start + 1, end


@pytest.mark.parametrize("text", ["a b . c d ! e f", ". . a", "a b", "a . . b ? ?"])
def test_sentence_bounds(spark, text):
    tokens = text.split(" ")
    rows = spark.range(len(tokens)).select(
        F.col("id"),
        T.sentence_start(F.split(F.lit(text), " "), F.col("id").cast("int")).alias("s"),
        T.sentence_end(F.split(F.lit(text), " "), F.col("id").cast("int")).alias("e"),
    )
    for at, start, end in rows.collect():
        assert (start, end) == brute_bounds(tokens, at)


def snippets(spark, tokens, position, **options):
    rows = spark.createDataFrame([(tokens, position)], "context array<string>, position int")
    return [r["text"] for r in with_snippets(rows, **options).collect()]


def test_snippet_keeps_three_sentences_and_marks_the_target(spark):
    tokens = "z . a b . the cat sat . c d . e".split()
    assert snippets(spark, tokens, 6) == ["a b . the [[cat]] sat . c d ."]


def test_snippet_rejoins_pieces_and_drops_padding(spark):
    tokens = ["un", "##like", "##ly", "cat", "[PAD]", "x", "[UNK]"]
    assert snippets(spark, tokens, 3) == ["unlikely [[cat]] x"]


def test_snippet_of_a_word_part(spark):
    tokens = ["a", "wire", "##less", "end"]
    assert snippets(spark, tokens, 1) == []
    assert snippets(spark, tokens, 1, affixation=True) == ["a [[wire]]less end"]
    assert snippets(spark, ["a", "end"], 1) == ["a [[end]]"]


def test_snippet_markup(spark):
    tokens = "< p > a / / b & lt ; c".split()
    # The blank that followed the markup stays: the text is stripped before.
    assert snippets(spark, tokens, 3) == [" [[a]] b < c"]


def test_snippet_minimum_context(spark):
    tokens = "a b c d e".split()
    assert snippets(spark, tokens, 2, min_context=2) == ["a b [[c]] d e"]
    assert snippets(spark, tokens, 1, min_context=2) == []
    assert snippets(spark, tokens, 3, min_context=2) == []


def test_context_window_is_clamped(spark):
    words = F.split("v", " ")
    assert one(spark, T.context_window(words, F.lit(1), 2), v="a b c d e") == "a [[b]] c d"
    assert one(spark, T.context_window(words, F.lit(4), 1), v="a b c d e") == "d [[e]]"


def test_trim_stops_at_the_target(spark):
    cut = lambda n, start: T.trim_around_target(F.col("v"), F.lit(n), F.lit(start))
    text = "a b [[c]] d e f"
    assert one(spark, cut(1, True), v=text) == "b [[c]] d e f"
    assert one(spark, cut(9, True), v=text) == "[[c]] d e f"
    assert one(spark, cut(2, False), v=text) == "a b [[c]] d"
    assert one(spark, cut(9, False), v=text) == "a b [[c]]"
    assert one(spark, cut(0, False), v=text) == text


def test_period_edges(spark):
    years = [1950, 1951, 1960, 1961, 2005, 2020, 2021, None]
    rows = spark.createDataFrame([(y,) for y in years], "y int").select(period(F.col("y")).alias("p"))
    assert [r["p"] for r in rows.collect()] == [
        None, "(1950, 1960]", "(1950, 1960]", "(1960, 1970]", "(2000, 2005]", "(2018, 2020]", None, None,
    ]


@pytest.mark.parametrize(
    "text, value",
    [("12", 12.0), (" 1e3 ", 1000.0), ("12d", None), ("", None), ("-3.5", -3.5), ("NaN", None), ("0x1A", None)],
)
def test_lenient_number(spark, text, value):
    assert one(spark, lenient_number(F.col("v")), v=text) == value


def test_years(spark):
    assert one(spark, to_year(F.col("v")), v="1999") == 1999
    assert one(spark, to_year(F.col("v")), v="n/a") is None
    assert one(spark, decade(F.col("v")), v=1989) == 1980
