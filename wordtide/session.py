"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "wordtide.local.folder"


def local_session(cores: int | str = "*", name: str = "wordtide") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    partitions = 8 if cores == "*" else max(int(cores), 1)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: the session's spark.checkpoint.dir.

    Only a local session may go without the setting; it gets a folder of its own, which is
    kept under a key of this library, as the setting itself is fixed once Spark runs.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    spark.conf.set(LOCAL_FOLDER, tempfile.mkdtemp(prefix="run-"))
    return spark.conf.get(LOCAL_FOLDER)


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows to a table in the shared folder and read it from there.

    Later plans start at the table: it survives the loss of executors, is
    computed once, and has a known size.
    """
    return read_steps(df, [write_step(df, name)])


def write_step(df: DataFrame, name: str = "step") -> str:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_steps(like: DataFrame, paths: list[str]) -> DataFrame:
    """Rows of several tables written by the steps of a loop, in a single scan."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)
