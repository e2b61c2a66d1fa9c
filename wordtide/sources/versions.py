"""Results that are written aside and made visible by a single row.

Data goes to a folder of its own first. Then one row goes to a table of versions, as one small file
that Spark's writer moves into place at its end; readers only see what has a row. A run that dies
before leaves files that no reader looks at.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version long, name string, written_ms long"


def new_name() -> str:
    """Name of a version's folder; later ones sort behind earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def folder(path: str, name: str) -> str:
    return f"{path}/data/{name}"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, name, written_ms of every version; none for a path without any."""
    # A missing folder is an error in Spark, so the first look makes an empty table.
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(f"{path}/versions")
    return spark.read.schema(SCHEMA).parquet(f"{path}/versions")


def publish(spark: SparkSession, path: str, name: str) -> int:
    """Gives a written folder its row and returns its number, from 1.

    Two writers at once may get the same number; names tell them apart.
    """
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.range(1).select(
        F.lit(number).cast("long").alias("version"), F.lit(name).alias("name"), F.lit(time.time_ns() // 10**6).alias("written_ms")
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return number
