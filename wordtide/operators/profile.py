"""Counts, shares and pivots of attributes by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions.periods import PERIOD_BOUNDS, period, period_table
from wordtide.operators.ranking import text_offset
from wordtide.session import cut_lineage


def hits_per_period(
    yearly: DataFrame, words: Sequence[str], bounds: Sequence[int] = PERIOD_BOUNDS
) -> DataFrame:
    """word, period, n from word, year, n; bins without hits show 0."""
    spark = yearly.sparkSession
    counts = (
        yearly.withColumn("period", period(F.col("year"), bounds))
        .dropna(subset=["period"])
        .groupBy("word", "period")
        .agg(F.sum("n").alias("n"))
    )
    grid = period_table(spark, bounds).select(
        "period", F.explode(F.array(*[F.lit(w) for w in words])).alias("word")
    )
    filled = grid.join(counts, ["word", "period"], "left")
    return filled.select("word", "period", F.coalesce("n", F.lit(0)).alias("n"))


def attribute_counts(df: DataFrame, time: str, attribute: str) -> DataFrame:
    """time, attribute, n, total. A total also counts rows without the attribute."""
    counts = df.where(F.col(time).isNotNull()).groupBy(time, attribute).agg(F.count("*").alias("n"))
    # The window runs over counts, one row per attribute value, not over the data.
    total = F.sum("n").over(W.partitionBy(time))
    return counts.withColumn("total", total).where(F.col(attribute).isNotNull())


def binned_attribute_counts(
    df: DataFrame, time: str, attribute: str, bounds: Sequence[int] = PERIOD_BOUNDS
) -> DataFrame:
    """As `attribute_counts` for binned periods: every pair of bin and value, 0 if absent."""
    # Counts are few and used three times below: compute them once.
    counted = cut_lineage(df.groupBy(time, attribute).agg(F.count("*").alias("n")))
    totals = counted.where(F.col(time).isNotNull()).groupBy(time).agg(F.sum("n").alias("total"))
    labels = period_table(df.sparkSession, bounds).select(F.col("period").alias(time))
    values = counted.select(attribute).dropna().distinct()
    all_labels = F.array(*[F.lit(f"({lo}, {hi}]") for lo, hi in zip(bounds, bounds[1:])])
    grid = values.select(F.explode(all_labels).alias(time), attribute)
    return (
        grid.join(counted, [time, attribute], "left")
        .join(labels.join(totals, time, "left"), time)
        .select(time, attribute, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
    )


def shares(counts: DataFrame, places: int = 2) -> DataFrame:
    """Adds proportion = n / total, rounded half to even; null for an empty period."""
    scale = 10.0**places
    return counts.withColumn("proportion", F.rint(F.try_divide("n", "total") * scale) / scale)


def pivot_shares(
    counted: DataFrame, time: str, attribute: str, values: Sequence[str] | None = None, binned: bool = False
) -> DataFrame:
    """One row per period, one column per value. Gaps are null for years, 0 for bins."""
    table = counted.groupBy(time).pivot(attribute, list(values) if values else None).sum("proportion")
    return table.fillna(0.0) if binned else table


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def year_range(df: DataFrame, year: str = "year") -> DataFrame:
    return df.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.count("*").alias("n_rows"))


def year_histogram(df: DataFrame, year: str = "year", bins: int = 10) -> DataFrame:
    """bin, lo, hi, n of every bin over equal widths, empty ones too; the last bin includes the maximum.

    No years give no bins; a single year fills the last bin of width 0.
    """
    counts = df.where(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"))
    # From here on one row per year: bounded by the years, not by the papers.
    everything = W.partitionBy()
    lo, hi = F.min(year).over(everything), F.max(year).over(everything)
    width = (hi - lo) / bins
    placed = counts.select(
        F.least(F.coalesce(F.floor(F.try_divide(F.col(year) - lo, width)), F.lit(bins - 1)), F.lit(bins - 1)).alias("bin"),
        lo.alias("_lo"),
        width.alias("_width"),
        "n",
    )
    # One row with the count of each bin, then a row per bin.
    counted = placed.groupBy("_lo", "_width").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) for b in range(bins)]).alias("_n")
    )
    each = counted.select("_lo", "_width", F.posexplode("_n").alias("_b", "n"))
    edge = F.col("_lo") + F.col("_b") * F.col("_width")
    return each.select(F.col("_b").cast("long").alias("bin"), edge.alias("lo"), (edge + F.col("_width")).alias("hi"), "n")


def joined_text_offsets(sentences: DataFrame, doc: str = "corpus_id", row: str = "sent_idx") -> DataFrame:
    """Where each sentence starts in the text of all sentences joined by blanks.

    Stands in for that text itself, which would be one string for the corpus.
    """
    return text_offset(sentences, doc, row, F.length("sentence") + 1, "char_start")
