"""A store of fitted clusterings: a version holds the tables of a fit, see `versions`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordtide.plans.usage_types import Clusterings
from wordtide.sources.versions import folder, new_name, publish, versions

TABLES = ["scaling", "models", "scores", "labels"]


def save_clusterings(spark: SparkSession, fitted: Clusterings, path: str) -> int:
    """Writes the tables of a fit as a new version and returns its number, from 1."""
    name = new_name()
    for table in TABLES:
        getattr(fitted, table).write.parquet(f"{folder(path, name)}/{table}")
    return publish(spark, path, name)


def load_clusterings(spark: SparkSession, path: str, version: int | None = None) -> Clusterings:
    """The latest version, or the one asked for; an unknown one is an error.

    Of two versions that were numbered alike the one with the later name counts.
    """
    known = versions(spark, path)
    asked = known if version is None else known.where(F.col("version") == version)
    found = asked.orderBy(F.desc("version"), F.desc("name")).first()
    if found is None:
        raise ValueError(f"There is no version {version or ''} of a clustering in {path}.")
    return Clusterings(*[spark.read.parquet(f"{folder(path, found['name'])}/{table}") for table in TABLES])
