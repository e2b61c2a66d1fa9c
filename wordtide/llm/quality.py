"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is described by how its characters and words are shaped: runs of three character
classes, lengths of words, repeats of words. TF-IDF over these, with document frequencies of
the whole table, is projected onto the leading singular vectors of a bounded labelled sample.
The labelled vectors are broadcast; each block of documents is multiplied with all of them, so
cosines are exact, and the labels of the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.llm.labelled import labelled_sample, remainder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXAMPLES = 4_096
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.5
STEP_BYTES = 1 << 20

# Classes of characters.
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, BANG, BAR, SYMBOL, OTHER = range(10)
CLASSES = 10
# Features besides the runs of three: words by length, words like one of the four before, all words.
LENGTHS = (1, 2, 3, 5, 8, 12, 16, 24)
LAGS = (1, 2, 3, 4)
FEATURES = CLASSES**3 + len(LENGTHS) + len(LAGS)


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    learn: Column | None = None,
    examples: int = EXAMPLES,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text): the estimated chance of label 1.

    `learn` is a condition on labels for the rows that may be learnt from. Empty and null texts
    resemble nothing and get the rate of the examples. Equal similarities: examples in the order
    of a fixed sort. Repeated rows and null ids are scored each. Without examples the score is 0.5.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(rows, labels, label, learn, examples)
    seen = rows.mapInArrow(_document_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequencies = {r["feature"]: r["n"] for r in seen.collect()}  # as many as features at most
    counts = sample.orderBy("doc_id").mapInArrow(_example_counts, "doc_id long, y int, counts binary").collect()
    model = fit([(r["counts"], r["y"]) for r in counts], frequencies, dimensions)
    return rows.mapInArrow(_score(model, neighbours), "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are never read."""
    out = remainder("doc_id", modulus) == held
    found = score(docs, labels, learn=~out)
    return found.select(
        "doc_id",
        F.coalesce(out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _class_table():
    import numpy as np

    table = np.full(256, OTHER, dtype="int64")
    for chars, kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT)):
        table[list(chars)] = kind
    table[[32, 9]], table[[10, 13]] = BLANK, LINE
    table[list(b".,;:?'\"()-")], table[ord("!")], table[ord("|")] = STOP, BANG, BAR
    table[list(b"#$%&*+/<=>@[\\]^_`{}~")] = SYMBOL
    table[0xC0:] = LOWER  # first bytes of longer characters
    return table


def count_features(data: bytes, table):
    """Feature counts of one piece of text, and its number of words."""
    import numpy as np

    part = np.frombuffer(data, dtype="uint8")
    lead = (part & 0xC0) != 0x80
    kinds = table[part]
    # Latin capitals with marks: C3 80 to C3 9E.
    upper = (part[:-1] == 0xC3) & (part[1:] < 0x9F)
    kinds[:-1][upper] = UPPER
    kinds = kinds[lead]
    runs = kinds[:-2] * CLASSES**2 + kinds[1:-1] * CLASSES + kinds[2:] if len(kinds) > 2 else kinds[:0]
    out = np.zeros(FEATURES)
    out[: CLASSES**3] = np.bincount(runs, minlength=CLASSES**3)
    inside = (kinds != BLANK) & (kinds != LINE)
    edges = np.flatnonzero(np.diff(inside.astype("int8"), prepend=0, append=0))
    sizes = edges[1::2] - edges[::2]
    if len(sizes):
        bins = np.searchsorted(LENGTHS, sizes, side="right") - 1
        out[CLASSES**3 : CLASSES**3 + len(LENGTHS)] = np.bincount(bins, minlength=len(LENGTHS))
        words = data.split()
        codes = {}
        order = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype="int64", count=len(words))
        for i, lag in enumerate(LAGS):
            out[CLASSES**3 + len(LENGTHS) + i] = (order[lag:] == order[:-lag]).sum()
    return out


def text_counts(text: str | None, table):
    """Counts of a whole text, taken piece by piece if it is long."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    out, at = np.zeros(FEATURES), 0
    while at < len(data):
        end = min(len(data), at + STEP_BYTES)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out += count_features(data[at:end], table)
        at = end
    return out


def _document_frequencies(batches):
    import numpy as np
    import pyarrow as pa

    table, total, size = _class_table(), np.zeros(FEATURES, dtype="int64"), 0
    for batch in batches:
        for text in batch.column(1):
            total += text_counts(text.as_py(), table) > 0
            size += 1
    # The number of texts goes by the name of a feature beyond the last.
    found = np.flatnonzero(total)
    features, n = np.append(found, FEATURES).astype("int32"), np.append(total[found], size)
    yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(n)], ["feature", "n"])


def _example_counts(batches):
    import pyarrow as pa

    table = _class_table()
    for batch in batches:
        ids, texts, ys = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text", "y"))
        counts = [text_counts(t.as_py(), table).astype("float32").tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, ys, pa.array(counts, pa.binary())], ["doc_id", "y", "counts"])


def weighted(counts, idf):
    """Rows of counts as TF-IDF with roots of relative counts, not yet of unit length."""
    import numpy as np

    total = counts[:, : CLASSES**3].sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)) * idf


def unit(rows):
    import numpy as np

    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit(rows: list, frequencies: dict, dimensions: int) -> dict:
    """idf, projection, and labelled latent vectors, from (counts, y) of the examples."""
    import numpy as np

    total = frequencies.get(FEATURES, 0)
    seen = np.array([frequencies.get(f, 0) for f in range(FEATURES)])
    idf = np.log((1 + total) / (1 + seen)) + 0.2
    labels = np.array([y for _, y in rows], dtype="float64")
    if not len(rows):
        return {"idf": idf, "axes": np.zeros((FEATURES, 1)), "vectors": np.zeros((0, 1)), "labels": labels, "rate": 0.5}
    counts = np.stack([np.frombuffer(c, dtype="float32") for c, _ in rows]).astype("float64")
    matrix = unit(weighted(counts, idf))
    # Right singular vectors from the small Gram matrix over the features.
    values, axes = np.linalg.eigh(matrix.T @ matrix)
    axes = axes[:, ::-1][:, : min(dimensions, int((values > 1e-9).sum()) or 1)]
    return {"idf": idf, "axes": axes, "vectors": unit(matrix @ axes), "labels": labels, "rate": labels.mean()}


def vote(model: dict, counts, k: int):
    """Scores of rows of counts by their k most similar examples."""
    import numpy as np

    own = unit(weighted(counts, model["idf"]) @ model["axes"])
    out = np.full(len(own), float(model["rate"]))
    k = min(k, len(model["labels"]))
    if not k:
        return out
    cosine = own @ model["vectors"].T
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 0) ** POWER
    total = weight.sum(axis=1)
    some = total > 0
    out[some] = (weight * model["labels"][best]).sum(axis=1)[some] / total[some]
    return out


def _score(model, k):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = _class_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = np.stack([text_counts(t.as_py(), table) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vote(model, counts, k))], ["doc_id", "score"])

    return run
