"""Publication years and the periods they fall in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Right-closed period bounds.
PERIOD_BOUNDS = [1950, 1960, 1970, 1980, 1990, 2000, 2005, 2010, 2012, 2014, 2016, 2018, 2020]


def to_year(text: Column) -> Column:
    """Year as an integer; null where the text is none."""
    return text.try_cast("int")


def lenient_number(text: Column) -> Column:
    """Number as double, null for anything that is not plainly one ('12d' is not)."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\f\v"))
    looks_numeric = trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(looks_numeric, trimmed.try_cast("double"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def _labels(bounds: Sequence[int]) -> list[tuple[int, int, str]]:
    return [(lo, hi, f"({lo}, {hi}]") for lo, hi in zip(bounds, bounds[1:])]


def period(year: Column, bounds: Sequence[int] = PERIOD_BOUNDS) -> Column:
    """Label of the right-closed bin of a year; null outside all bins."""
    label = F.lit(None).cast("string")
    for lo, hi, text in reversed(_labels(bounds)):
        label = F.when((year > lo) & (year <= hi), F.lit(text)).otherwise(label)
    return label


def period_table(spark: SparkSession, bounds: Sequence[int] = PERIOD_BOUNDS) -> DataFrame:
    """One row per bin: lo, hi, period. As small as the list it comes from."""
    return spark.createDataFrame(_labels(bounds), "lo int, hi int, period string")
