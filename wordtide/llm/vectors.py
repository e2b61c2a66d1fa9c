"""Vector columns in tasks: which take part, as matrices, and the best of a block."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def finite(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite numbers."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(plain, F.lit(False))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part; rows without id do not."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return kept.where(F.col("id").isNotNull() & finite(F.col("vector")))


def dimensions(df: DataFrame) -> int:
    """Length of the longest vector; shorter ones count as followed by zeros."""
    return df.agg(F.max(F.size("vector"))).first()[0] or 0


def padded(column, size: int):
    """Arrow list column as a matrix with `size` columns."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values, lengths = np.asarray(column.flatten(), dtype="float64"), np.asarray(column.value_lengths())
    if len(lengths) * size == len(values) and (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    starts = np.cumsum(lengths) - lengths
    for row, (start, n) in enumerate(zip(starts, lengths)):
        out[row, :n] = values[start : start + n]
    return out


def centres(vectors, n: int, rounds: int = 8, seed: int = 42):
    """n centres of a bounded sample by Lloyd's rounds, from evenly drawn rows."""
    import numpy as np

    n = min(n, len(vectors))
    found = vectors[np.random.default_rng(seed).permutation(len(vectors))[:n]].astype("float64")
    for _ in range(rounds):
        label = nearest(vectors, found)[0]
        size = np.bincount(label, minlength=n)
        total = np.zeros_like(found)
        np.add.at(total, label, vectors)
        found[size > 0] = total[size > 0] / size[size > 0, None]
    return found


def nearest(vectors, found):
    """Index of and distance to the nearest centre; the first of equals."""
    import numpy as np

    gap = (vectors**2).sum(1)[:, None] + (found**2).sum(1)[None, :] - 2 * vectors @ found.T
    label = gap.argmin(1)
    # Once more from the difference: the bounds need exact distances.
    return label, np.sqrt(((vectors - found[label]) ** 2).sum(1))


def best_of_block(query_ids, queries, ids, vectors, k: int, step: int = 256):
    """For each query its k largest inner products, ties to the smaller id, never its own id.

    Returns query id, id and score arrays. A repeated id counts once, by its best score.
    """
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.array([], "int64")
    repeated, ids = len(first) < len(ids), ids[first]
    found = []
    for at in range(0, len(query_ids) if len(ids) else 0, step):
        own = query_ids[at : at + step]
        scores = queries[at : at + step] @ vectors.T
        if repeated:
            scores = np.maximum.reduceat(scores, first, axis=1)
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        mine = np.flatnonzero(ids[place] == own)
        scores[mine, place[mine]] = -np.inf
        most = min(k, scores.shape[1])
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        score = scores[row, col]
        by = np.lexsort((ids[col], -score, row))
        row, col, score = row[by], col[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        found.append((own[row[keep]], ids[col[keep]], score[keep]))
    if not found:
        return np.array([], "int64"), np.array([], "int64"), np.array([], "float64")
    return tuple(np.concatenate(x) for x in zip(*found))
