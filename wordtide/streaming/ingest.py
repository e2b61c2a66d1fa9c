"""The clean corpus, file by file as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordtide.plans.corpus import clean_corpus
from wordtide.sources.writers import CLEAN_SCHEMA


def append_new_files(
    spark: SparkSession, texts: str, metadata: DataFrame, out: str, progress: str
) -> StreamingQuery:
    """Clean all files not seen before and append them to the Parquet table at out.

    The file sink commits each batch once, so a run that was cut off leaves no
    duplicates. `progress` is the folder of the query's checkpoint.
    """
    files = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .load(texts)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    rows = clean_corpus(files, metadata)
    typed = rows.select([F.col(f"`{c}`").cast(t).alias(c) for c, t in CLEAN_SCHEMA.items()])
    return (
        typed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
