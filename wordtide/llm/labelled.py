"""A bounded sample of labelled texts to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.session import cut_lineage


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """doc_id, text, y of at most `bound` different texts that have a label and may be learnt from.

    A text that many documents share counts once, with the label of its smallest id; rows
    without label, id or text are not used. The bound picks the first by a hash of the text.
    """
    known = (
        labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_h"))
    firsts = (
        keyed.join(known, "doc_id")
        .groupBy("_h")
        .agg(F.min(F.struct("doc_id", "y")).alias("_f"))
        .orderBy("_h")
        .limit(bound)
        .select("_f.doc_id", "_f.y")
    )
    # At most `bound` ids: fit for a broadcast at any size of the tables.
    chosen = F.broadcast(cut_lineage(firsts, "labelled"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    return cut_lineage(texts.dropDuplicates(["doc_id"]), "examples")
