"""Raw corpus files to the clean corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators.blocks import fits_broadcast
from wordtide.session import cut_lineage
from wordtide.sources import readers, writers


def split_files(files: DataFrame) -> DataFrame:
    """path, textID, doc_text: the documents of each file, redacted sentences dropped."""
    return _cleaned(files.select("path", F.explode(T.split_documents(F.col("value"))).alias("doc")))


def split_records(records: DataFrame) -> DataFrame:
    """The same from `readers.corpus_records`, a row per document."""
    return _cleaned(records.select("path", T.document(F.col("value")).alias("doc")))


def _cleaned(parts: DataFrame) -> DataFrame:
    return parts.select(
        "path",
        F.col("doc.text_id").alias("textID"),
        T.drop_redacted_sentences(F.col("doc.doc_text")).alias("doc_text"),
    )


def attach_metadata(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on textID; documents without metadata keep nulls.

    Metadata is written and measured first: sent to the documents if it is small, so that no text
    is moved, and joined by id otherwise.
    """
    metadata = cut_lineage(metadata, "metadata")
    return documents.join(F.broadcast(metadata) if fits_broadcast(metadata) else metadata, "textID", "left")


def clean_corpus(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return attach_metadata(split_files(files), metadata)


def run(spark: SparkSession, texts: str, metadata: str, out: str) -> None:
    """Cleans all files below `texts` and replaces what the table had of them; other files' rows stay."""
    documents = split_records(readers.corpus_records(spark, texts))
    writers.append_clean_corpus(attach_metadata(documents, readers.corpus_metadata(spark, metadata)), out)


def documents_per_file(files: DataFrame) -> DataFrame:
    return files.select("path", F.size(T.split_documents(F.col("value"))).alias("n_docs"))
