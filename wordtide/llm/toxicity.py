"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings that examples of label 1 use clearly more often. The
labelled examples form an inverted index whose documents lie in blocks; each term keeps its
largest weight per block. A text's possible score in a block is bounded by these maxima, so
blocks are visited from the best bound down until none can hold a better neighbour: the
nearest examples are exact. Their votes, weighted by similarity, are calibrated on
leave-one-out votes of the examples, and come with the neighbours as evidence.
"""

from __future__ import annotations

from math import log
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.llm.labelled import labelled_sample, remainder
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXAMPLES = 20_000
TERMS = 4_096
LEAST_USES = 4
LEAST_LIFT = 2.0
NEIGHBOURS = 24
BLOCK = 64
PREFIXES = (4, 5, 6)
BINS = 50
CACHE = 300_000
THRESHOLD = 0.3

SCORES = "doc_id long, raw double, neighbours array<struct<doc_id: long, similarity: double, label: int>>"


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    learn: Column | None = None,
    examples: int = EXAMPLES,
    terms: int = TERMS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, score, neighbours for every row of docs (doc_id, text).

    `learn` is a condition on labels for the rows that may be learnt from. score estimates the
    chance of label 1; neighbours are the nearest examples, best first. Texts without any term
    (also empty and null ones) have no neighbours and get the rate of examples without terms.
    Equal neighbours: smaller doc_id first. Repeated rows and null ids are scored each. Without
    examples every score is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(rows, labels, label, learn, examples)
    vocabulary = _choose(sample, terms)
    counted = cut_lineage(
        rows.mapInArrow(_count_terms(vocabulary), "doc_id long, terms array<int>, uses array<int>"), "terms"
    )
    seen = counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # as many as terms at most
    total = max(counted.count(), 1)
    idf = _idf({r["t"]: r["count"] for r in seen}, total, len(vocabulary))
    train = counted.join(F.broadcast(sample.select("doc_id", "y")), "doc_id").dropDuplicates(["doc_id"])
    index = Index([tuple(r) for r in train.select("doc_id", "y", "terms", "uses").collect()], idf)
    votes = train.select("doc_id", "terms", "uses").mapInArrow(_vote(index, neighbours, True), SCORES)
    binned = (
        votes.join(F.broadcast(sample.select("doc_id", "y")), "doc_id")
        .groupBy(_bin("raw").alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
        .collect()
    )
    levels = calibration({r["bin"]: (r["n"], r["ones"]) for r in binned}, index.rate)
    found = counted.mapInArrow(_vote(index, neighbours, False), SCORES)
    of_bin = F.array(*[F.lit(float(x)) for x in levels])
    return found.select("doc_id", F.element_at(of_bin, _bin("raw") + 2).alias("score"), "neighbours")


def flagged(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours; labels of held-out ids are never read."""
    out = remainder("doc_id", modulus) == held
    found = score(docs, labels, learn=~out)
    return found.select(
        "doc_id",
        F.coalesce(out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "neighbours",
    )


def _bin(raw: str) -> Column:
    """-1 without votes, else 0 to BINS - 1."""
    place = F.least(F.floor(F.col(raw) * BINS), F.lit(BINS - 1))  # least() skips nulls
    return F.when(F.col(raw).isNull(), -1).otherwise(place).cast("int")


def calibration(bins: dict, rate: float) -> list:
    """Rate of ones for texts without votes, then for each bin of votes, never falling from bin to bin.

    Bins are smoothed by one example at the overall rate and pooled where they would fall.
    """
    alone, ones = bins.get(-1, (0, 0))
    pools = []
    for b in range(BINS):
        n, k = bins.get(b, (0, 0))
        # A bin that no example fell into counts like its own middle, weakly.
        pools.append([n + 0.1, k + 0.1 * (b + 0.5) / BINS, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            n, k, width = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + k, pools[-1][2] + width]
    levels = [k / n for n, k, width in pools for _ in range(width)]
    return [(ones + rate) / (alone + 1), *levels]


def _idf(seen, total, size):
    from math import log

    return [log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in range(size)]


def _choose(sample: DataFrame, most: int) -> list:
    """The terms that most clearly speak for label 1, at most so many, in a fixed order."""
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return []
    uses = (
        sample.select("y", "text").mapInArrow(_uses, "term string, a long, b long")
        .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_USES)
    )
    # Likelihood ratio against equal use in both labels; over so many terms one may reach 2 ln(terms) by chance.
    part = lambda k, n, rate: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(F.lit(0.0))
    rate = (F.col("a") + F.col("b")) / (ones + zeros)
    ratio = 2 * sum(
        part(k, F.lit(float(n)), r)
        for column, n in (("a", ones), ("b", zeros))
        for k, r in ((F.col(column), rate), (n - F.col(column), 1 - rate))
    )
    uses = cut_lineage(uses, "uses")
    least = 2 * log(max(uses.count(), 2))
    more = F.col("a") * zeros > F.col("b") * ones * LEAST_LIFT
    picked = uses.where(more).withColumn("ratio", ratio).where(F.col("ratio") >= least)
    return [r["term"] for r in picked.orderBy(F.desc("ratio"), "term").limit(most).select("term").collect()]


def terms_of(word: str) -> list:
    """A word and its beginnings; those end with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> list:
    import re

    return re.findall(r"[^\W_]+", text.lower())


def _uses(batches):
    """How many texts of each label use a term, summed up per task as far as memory allows."""
    from collections import Counter

    import pyarrow as pa

    def rows(held):
        terms = sorted(held[0].keys() | held[1].keys())
        columns = [pa.array(terms), *(pa.array([held[y][t] for t in terms], "int64") for y in (1, 0))]
        return pa.RecordBatch.from_arrays(columns, ["term", "a", "b"])

    held = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[y].update({t for w in set(words_of(text.as_py() or "")) for t in terms_of(w)})
            if len(held[0]) + len(held[1]) > CACHE:
                yield rows(held)
                held = (Counter(), Counter())
    if held[0] or held[1]:
        yield rows(held)


def _count_terms(vocabulary):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        place = {t: i for i, t in enumerate(vocabulary)}
        cache = {}
        for batch in batches:
            terms, uses = [], []
            for text in batch.column(1):
                own = Counter()
                for word in words_of(text.as_py() or ""):
                    hits = cache.get(word)
                    if hits is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        hits = cache[word] = tuple(place[t] for t in terms_of(word) if t in place)
                    for t in hits:
                        own[t] += 1
                terms.append(sorted(own))
                uses.append([own[t] for t in terms[-1]])
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, many), pa.array(uses, many)], ["doc_id", "terms", "uses"]
            )

    return run


def weights(terms, uses, idf):
    """Unit vector of a text: (1 + log uses) * idf."""
    from math import log, sqrt

    values = [(1 + log(n)) * idf[t] for t, n in zip(terms, uses)]
    norm = sqrt(sum(v * v for v in values))
    return [v / norm for v in values] if norm else []


class Index:
    """Block-max inverted index over (doc_id, y, terms, uses); bounded by the number of examples."""

    def __init__(self, rows, idf):
        import numpy as np

        self.idf = idf
        # Examples with the same leading terms lie together, so block maxima are tight.
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        self.rate = sum(r[1] for r in rows) / len(rows) if rows else 0.0
        self.ids = np.array([r[0] for r in rows], dtype="int64")
        self.labels = np.array([r[1] for r in rows], dtype="int64")
        blocks = -(-len(rows) // BLOCK)
        self.maxima = np.zeros((len(idf), blocks), dtype="float64")
        postings = [[] for _ in idf]
        for at, (_, _, terms, uses) in enumerate(rows):
            for t, w in zip(terms, weights(terms, uses, idf)):
                postings[t].append((at, w))
                self.maxima[t, at // BLOCK] = max(self.maxima[t, at // BLOCK], w)
        self.docs = [np.array([p[0] for p in own], dtype="int64") for own in postings]
        self.values = [np.array([p[1] for p in own]) for own in postings]
        self.blocks = [own // BLOCK for own in self.docs]

    def nearest(self, terms, uses, k, but=None):
        """(doc_id, cosine, label) of the k examples nearest to a text, those over 0, without the id `but`."""
        import numpy as np

        own = np.array(weights(terms, uses, self.idf))
        if not len(own):
            return []
        bound = own @ self.maxima[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, place = np.zeros(0), np.zeros(0, dtype="int64")
        at, step = 0, 8
        # Ever more blocks at a time, until the next bound is below the k-th best. The slack covers
        # rounding; equal scores must still be seen for ties.
        while at < len(order) and (len(best) < k or bound[order[at]] >= best[-1] - 1e-9):
            open_now = np.zeros(len(bound), dtype=bool)
            open_now[order[at : at + step]] = True
            hits = [open_now[self.blocks[t]] for t in terms]
            docs = np.concatenate([self.docs[t][h] for t, h in zip(terms, hits)])
            parts = np.concatenate([w * self.values[t][h] for w, t, h in zip(own, terms, hits)])
            scores = np.bincount(docs, weights=parts)
            found = np.flatnonzero(scores > 0)
            if but is not None:
                found = found[self.ids[found] != but]
            place = np.concatenate([place, found])
            best = np.concatenate([best, np.round(scores[found], 9)])
            first = np.lexsort((self.ids[place], -best))[:k]
            best, place = best[first], place[first]
            at, step = at + step, step * 4
        return list(zip(self.ids[place].tolist(), best.tolist(), self.labels[place].tolist()))


def _vote(index, k, left_out):
    def run(batches):
        import pyarrow as pa

        cache = {}
        shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            raw, near = [], []
            for doc, terms, uses in zip(*(c.to_pylist() for c in batch.columns)):
                key = (doc if left_out else None, tuple(terms), tuple(uses))
                found = cache.get(key)
                if found is None:
                    found = index.nearest(terms, uses, k, doc if left_out else None)
                    if len(cache) > 20_000:
                        cache.clear()
                    if not left_out:
                        cache[key] = found
                total = sum(s for _, s, _ in found)
                raw.append(sum(s for _, s, y in found if y) / total if total else None)
                near.append([{"doc_id": i, "similarity": s, "label": y} for i, s, y in found[:5]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, "float64"), pa.array(near, shape)], ["doc_id", "raw", "neighbours"]
            )

    return run
