"""Packing by optimal length buckets.

The histogram of sequence lengths over the whole table goes to a dynamic programme that
picks the bucket boundaries with the least padding. Inside a bucket, sequences padded to
its boundary fill batches up to a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.operators.ranking import hash_order, rank_by_hash
from wordtide.session import cut_lineage

BUCKETS = 16
MAX_LENGTH = 2048
BATCH_TOKENS = 32768


def words(text: Column) -> Column:
    """Number of words between white space: the default length of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def sequences(docs: DataFrame, id_col: str, length: Column, max_length: int = MAX_LENGTH) -> DataFrame:
    """Rows id, part, start, length: every document cut into parts of max_length tokens at most.

    A document without tokens is one part of length 0.
    """
    last = F.greatest(F.ceil(F.col("_n") / max_length).cast("long"), F.lit(1)) - 1
    parts = docs.select(F.col(id_col).alias("id"), length.alias("_n")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    start = F.col("part") * max_length
    return parts.select("id", "part", start.alias("start"), F.least(F.col("_n") - start, F.lit(max_length)).alias("length"))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most so many bucket boundaries with the least total padding; exact.

    With b buckets ending at length j, the best last bucket starts after some i:
    waste(b, j) = min over i of waste(b - 1, i) + j * n(i, j] - tokens(i, j]. The fewest
    buckets with the least padding are taken, then the smallest boundaries.
    """
    import numpy as np

    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype="float64")[order]
    seen = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype="float64")[order])])
    tokens = np.concatenate([[0.0], np.cumsum(size * np.asarray(counts, dtype="float64")[order])])
    n = len(size)
    if not n:
        return []
    waste = np.full(n + 1, np.inf)
    waste[0] = 0
    totals, steps = [], []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype="int64")
        for j in range(1, n + 1):
            each = waste[:j] + size[j - 1] * (seen[j] - seen[:j]) - (tokens[j] - tokens[:j])
            came[j] = each.argmin()
            now[j] = each[came[j]]
        waste = now
        totals.append(now[n])
        steps.append(came)
    b, at, found = int(np.argmin(totals)), n, []
    while at:
        found.append(int(size[at - 1]))
        at, b = int(steps[b][at]), b - 1
    return found[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    buckets: int = BUCKETS,
    max_length: int = MAX_LENGTH,
    batch_tokens: int = BATCH_TOKENS,
    seed: int = 42,
) -> DataFrame:
    """id, part, start, length, bucket, batch, padding: which batch each part of a document goes to.

    bucket is the padded length; a batch is named by bucket and a number from 0, holds
    max(1, batch_tokens // bucket) sequences, and only a bucket's last batch may hold fewer. Rows
    go to batches in hash order of id and part. The histogram has max_length rows at most. Parts
    without tokens (empty or null texts) have null bucket, batch and padding. Repeated rows are
    packed each for itself; null ids are packed like others; an empty table gives no rows.
    """
    found = cut_lineage(sequences(docs, id_col, words(F.col("text")) if length is None else length, max_length))
    histogram = found.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()
    ends = boundaries([r["length"] for r in histogram], [r["n"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("length") <= end, F.lit(end).cast("long")).otherwise(bucket)
    placed = found.withColumn("bucket", F.when(F.col("length") > 0, bucket)).withColumn(
        "_hash", hash_order("id", "part", seed=seed)
    )
    ranked = rank_by_hash(placed.where("bucket is not null"), ["bucket"], "_hash", ["id", "part"], "_rank")
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket")), F.lit(1))
    batched = ranked.select(
        F.col("id").alias(id_col), "part", "start", "length", "bucket",
        F.floor(F.col("_rank") / room).cast("long").alias("batch"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )
    none = [F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "padding")]
    empty = placed.where("bucket is null").select(F.col("id").alias(id_col), "part", "start", "length", *none)
    return batched.unionByName(empty)
