"""Adjacent n-grams and their likelihood ratio."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators.blocks import fits_broadcast, join_small
from wordtide.operators.ranking import BLOCK_ROWS as RANK_ROWS
from wordtide.operators.ranking import sum_before
from wordtide.session import cut_lineage

# Text of a slice, about; a slice's n-grams are counted in the memory of a task.
SLICE_CHARS = 1 << 24
TINY = 1e-20  # Fixed value: guards the logarithms of the likelihood ratio.


def in_slices(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """The rows hashed by their keys into slices of about SLICE_CHARS characters.

    Most n-grams are rare, so a task that counts its own first holds nearly all of them: beyond its
    memory they are sorted on disk. Slices follow the size of the texts, not the splits of the scan.
    """
    chars = texts.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    slices = max(-(-chars // SLICE_CHARS), texts.sparkSession.sparkContext.defaultParallelism)
    return texts.repartition(slices, *keys)


def ngrams_of_texts(texts: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """One row per token with its n-1 followers in the same row's text: w1 .. wn.

    Followers past the end are null, so counting w1 counts every token. Narrow:
    the n-grams are made inside the row.
    """
    words = texts.select(T.tokens(F.col(text_col)).alias("words"))
    slots = [F.col("words"), *[F.slice("words", i + 1, F.size("words")) for i in range(1, n)]]
    names = [f"w{i + 1}" for i in range(n)]
    zipped = F.arrays_zip(*[s.alias(name) for s, name in zip(slots, names)])
    return words.select(F.inline(zipped).alias(*names))


def ngrams_of_stream(
    sentences: DataFrame, n: int, doc: str = "corpus_id", row: str = "sent_idx", across_docs: bool = False
) -> DataFrame:
    """The same over the sentences of a document read as one run of tokens, or,
    with `across_docs`, over all documents in the order of their ids.

    n-grams that end in their own row are made there and do not move. The last n-1 tokens of
    a row need the first ones of the rows behind it: only these border tokens are shuffled. Rows
    are followed inside blocks of a document; a block's last rows look up the first tokens of the
    blocks behind by their number, so no long document meets in one task.
    """
    reach = n - 1
    words = sentences.select(doc, row, T.tokens(F.col("sentence")).alias("words")).where(F.size("words") > 0)
    names = [f"w{i + 1}" for i in range(n)]
    inside = F.greatest(F.size("words") - reach, F.lit(0))
    slots = [F.slice("words", i + 1, inside).alias(name) for i, name in enumerate(names)]
    inner = words.select(F.inline(F.arrays_zip(*slots)).alias(*names))
    if not reach:
        return inner
    from_end = F.greatest(F.size("words") - reach, F.lit(0)) + 1
    borders = words.select(
        doc, row, F.slice("words", 1, reach).alias("head"), F.slice("words", from_end, F.lit(reach)).alias("tail")
    ).withColumn("_block", F.floor(F.col(row) / RANK_ROWS))
    behind = [doc, "_block"]
    w = W.partitionBy(*behind).orderBy(row)
    later = F.flatten(F.array(*[F.coalesce(F.lead("head", i).over(w), F.array().cast("array<string>")) for i in range(1, n)]))
    placed = borders.select(*behind, row, "head", "tail", F.slice(later, 1, reach).alias("next"))
    placed = cut_lineage(placed, "borders")
    # A block begins with the head of its first row and what follows it.
    first = F.min_by(F.slice(F.concat("head", "next"), 1, reach), row)
    numbered = _numbered_blocks(placed.groupBy(*behind).agg(first.alias("head")), doc)
    following = numbered
    for i in range(1, n):
        other = numbered.select((F.col("number") - i).alias("number"), F.col("head").alias(f"_h{i}"), F.col(doc).alias(f"_d{i}"))
        following = following.join(other, "number", "left")
    same = lambda i: F.lit(True) if across_docs else F.col(f"_d{i}") == F.col(doc)
    none = F.array().cast("array<string>")
    heads = [F.when(same(i), F.coalesce(f"_h{i}", none)).otherwise(none) for i in range(1, n)]
    following = following.select(*behind, F.flatten(F.array(*heads)).alias("_behind"))
    short = F.size("next") < reach
    whole = F.slice(F.concat("tail", "next", "_behind"), 1, F.size("tail") + reach)
    # Rows that find all they need in their block do not look further.
    ends = placed.where(short).join(following, behind).select(whole.alias("run"), F.size("tail").alias("own"))
    rest = placed.where(~short).select(F.concat("tail", "next").alias("run"), F.size("tail").alias("own"))
    tails = ends.unionByName(rest).select("run", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("_i"))
    outer = tails.select(*[F.get("run", F.col("_i") + i).alias(name) for i, name in enumerate(names)])
    return inner.unionByName(outer)


def _numbered_blocks(blocks: DataFrame, doc: str) -> DataFrame:
    """Adds `number`, the place of each block in the order of documents and blocks, without gaps."""
    blocks = cut_lineage(blocks, "blocks")
    sizes = cut_lineage(blocks.groupBy(doc).agg(F.count("*").alias("_n")), "sizes")
    starts = sum_before(sizes, doc, F.col("_n"), "_start").select(doc, "_start")
    at = F.row_number().over(W.partitionBy(doc).orderBy("_block"))
    numbered = blocks.withColumn("_at", at).join(starts, doc).withColumn("number", F.col("_start") + F.col("_at"))
    return cut_lineage(numbered.drop("_start", "_at"), "numbered")


def ngram_counts(ngrams: DataFrame) -> DataFrame:
    """n per tuple of words, the incomplete ones at the ends included."""
    return ngrams.groupBy(*ngrams.columns).agg(F.count("*").alias("n"))


def frequent(
    counts: DataFrame, min_count: int = 3, remove: Callable[..., Column] | None = None
) -> DataFrame:
    """Complete n-grams seen at least min_count times; `remove` gets the word
    columns and says which n-grams to leave out."""
    words = [c for c in counts.columns if c != "n"]
    kept = counts.where(F.col("n") >= min_count).dropna(subset=words)
    return kept if remove is None else kept.where(~remove(*map(F.col, words)))


def without(targets: Sequence[str]) -> Callable[..., Column]:
    """Filter that removes n-grams with none of the targets in them."""

    def remove(*words: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | word.isin(list(targets))
        return ~found

    return remove


def likelihood_ratio(
    bigrams: DataFrame, min_count: int = 3, remove: Callable[..., Column] | None = None
) -> DataFrame:
    """w1, w2, n, llr of the frequent bigrams; margins come from all tokens.

    Input are the bigrams themselves, one row per token, read once: those that `remove` takes out
    are counted by their first word only. Word counts and the total come from these counts, and
    are sent to the pairs by measured size, so a frequent word does not gather its pairs.
    """
    kept = F.lit(True) if remove is None else ~F.coalesce(remove(F.col("w1"), F.col("w2")), F.lit(True))
    kept = kept & F.col("w1").isNotNull() & F.col("w2").isNotNull()
    counted = bigrams.select("w1", F.when(kept, F.col("w2")).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("n"))
    counts = cut_lineage(counted, "bigrams")
    unigrams = cut_lineage(counts.groupBy("w1").agg(F.sum("n").alias("_count")), "unigrams")
    total = unigrams.agg(F.sum("_count").alias("_all"))
    pairs = counts.where((F.col("n") >= min_count) & F.col("w2").isNotNull())
    fits = fits_broadcast(unigrams)
    first = unigrams.select("w1", F.col("_count").alias("_n1"))
    second = unigrams.select(F.col("w1").alias("w2"), F.col("_count").alias("_n2"))
    # `total` is a single row.
    table = join_small(join_small(pairs, first, ["w1"], ["w2"], fits), second, ["w2"], ["w1"], fits).join(F.broadcast(total))
    a = F.col("n").cast("double")
    b, c = F.col("_n2") - a, F.col("_n1") - a
    d = F.col("_all") - F.col("_n1") - F.col("_n2") + a
    n = F.col("_all").cast("double")

    def term(observed: Column, row: Column, column: Column) -> Column:
        expected = row * column / n
        return observed * F.log(observed / (expected + TINY) + TINY)

    score = 2 * (
        term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d)
    )
    return table.select("w1", "w2", "n", score.alias("llr"))


def best(scored: DataFrame, n: int = 40) -> DataFrame:
    return scored.orderBy(F.desc("llr"), "w1", "w2").limit(n)
