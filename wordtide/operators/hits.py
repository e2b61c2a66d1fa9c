"""Occurrences of target words, with sentence, position and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators.blocks import attach_small

WINDOW = 10


def collect_hits(
    docs: DataFrame,
    targets: Sequence[str] | DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per exact, case-sensitive occurrence of a target token.

    Columns: corpus_id, sent_idx, sentence, word, start_idx, end_idx. Narrow for a
    word list: sentences are split, searched and exploded inside the scan stage. A
    table of targets is measured and broadcast; beyond that size hits are salted.
    """
    sentences = sentence_table(docs, id_col, text_col)
    if isinstance(targets, DataFrame):
        found = _exploded(sentences, T.tokens(F.col("sentence")), "start_idx", "word")
        wanted = targets.select("word").where("word is not null").distinct()
        found = attach_small(found, wanted, ["word"], ["corpus_id", "sent_idx"])
    else:
        words = list(targets)
        mentioned = sentences.where(_mentions(F.col("sentence"), words))
        found = _exploded(mentioned, T.tokens(F.col("sentence")), "start_idx", "word")
        found = found.where(F.col("word").isin(words))
    return found.select(
        "corpus_id",
        "sent_idx",
        T.strip(F.col("sentence")).alias("sentence"),
        "word",
        "start_idx",
        (F.col("start_idx") + 1).alias("end_idx"),
    )


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """corpus_id, sent_idx, sentence."""
    texts = docs.select(F.col(id_col).alias("corpus_id"), F.col(text_col).alias("_text"))
    return _exploded(texts, T.sentences(F.col("_text")), "sent_idx", "sentence").drop("_text")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """corpus_id, sent_idx, pos, token."""
    sentences = sentence_table(docs, id_col, text_col)
    return _exploded(sentences, T.tokens(F.col("sentence")), "pos", "token").drop("sentence")


def hit_contexts(
    docs: DataFrame,
    targets: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Hits with the tokens of their sentence, of its two neighbours, and `window` tokens on each side at least.

    A side is shorter only at an edge of the document. Columns: corpus_id, sent_idx,
    start_idx, word, context, position (in context).
    """
    texts = docs.select(F.col(id_col).alias("corpus_id"), T.sentences(F.col(text_col)).alias("_all"))
    # Tokenised once per document, as a column of its own behind an explode of one row.
    split = F.array(F.transform("_all", lambda s: F.struct(s.alias("sentence"), T.tokens(s).alias("words"))))
    parts = texts.select("corpus_id", F.explode_outer(split).alias("all"))
    # Rows carry what surrounds their sentence, not the whole document; every
    # sentence has a token, so `window` sentences have enough of them.
    count = F.size("all")
    mentioned = F.filter(
        F.sequence(F.lit(0), count - 1), lambda i: _mentions(F.get("all", i)["sentence"], list(targets))
    )
    flat = lambda start, n: F.flatten(F.transform(F.slice("all", start, n), lambda s: s["words"]))

    def around(i):
        low = F.greatest(i - window, F.lit(0))
        earlier, later = F.get("all", i - 1)["words"], F.get("all", i + 1)["words"]
        # A neighbour of `window` tokens or more is the whole side; short ones are filled up from further on.
        last = F.reverse(F.slice(F.reverse(flat(low + 1, i - low)), F.lit(1), F.lit(window)))
        return F.struct(
            i.alias("sent_idx"),
            F.get("all", i)["words"].alias("words"),
            F.when(F.size(earlier) >= window, earlier).otherwise(last).alias("before"),
            F.when(F.size(later) >= window, later).otherwise(F.slice(flat(i + 2, F.lit(window)), F.lit(1), F.lit(window))).alias("after"),
        )

    own = parts.where(count > 0).select("corpus_id", F.explode(F.transform(mentioned, around)).alias("t"))
    windows = own.select("corpus_id", "t.sent_idx", "t.words", "t.before", "t.after")
    found = _exploded(windows, F.col("words"), "start_idx", "word")
    return found.where(F.col("word").isin(list(targets))).select(
        "corpus_id",
        "sent_idx",
        "start_idx",
        "word",
        F.concat("before", "words", "after").alias("context"),
        (F.size("before") + F.col("start_idx")).alias("position"),
    )


def _exploded(df: DataFrame, array: Column, position: str, element: str) -> DataFrame:
    """posexplode without the non-empty filter Spark puts before it, which would
    run the array's regular expression a second and a third time."""
    return df.select("*", F.posexplode_outer(array).alias(position, element)).where(F.col(element).isNotNull())


def attach_year(hits: DataFrame, papers: DataFrame, id_col: str, year: Column) -> DataFrame:
    """Left join on the paper id; only id and year of the papers are read.

    Hits without a paper keep a null year.
    """
    years = papers.select(F.col(id_col).alias("corpus_id"), year.alias("year"))
    return hits.join(years, "corpus_id", "left")


def annotate(hits: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table of per-hit attributes on explicit keys."""
    return hits.join(annotations, list(keys), "left")


def count_by_year(hits: DataFrame, papers: DataFrame, id_col: str, year: Column) -> DataFrame:
    """word, year, n. Hits are counted per paper before the join."""
    per_paper = hits.groupBy("word", "corpus_id").agg(F.count("*").alias("n"))
    dated = attach_year(per_paper, papers, id_col, year)
    return dated.groupBy("word", "year").agg(F.sum("n").alias("n"))


def _mentions(sentence: Column, words: Sequence[str]) -> Column:
    """Cheap test before tokenising: the text contains one of the words."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(sentence, F.lit(word))
    return test
