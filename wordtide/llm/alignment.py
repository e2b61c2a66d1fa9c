"""Alignment of the tokens that two tokenizers make of the same bytes.

Texts are encoded once and their ids written. `pandas.merge_asof` over a batch of documents,
keyed by document, finds the token of one side that covers each token start of the other. Of
two overlapping ranges the later start lies in the other range, so both directions together
give every overlap; a common start is found twice and counted once. Offsets where both sides
end a token cut the tokens into groups.

Texts of Latin script go through a faster encoder made from the same byte-level vocabulary: its
merges have the order of the ids, so a merge by least id is the merge by first rule, and on such
characters the split before the merges is the same. All others are encoded by the model itself.

How often a pair of ids is linked in the corpus is counted in tasks first and then by pair.
The commonest pairs, a bounded number, are sent to all tasks; links of other pairs, if there
are any, are looked up by a join.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Pairs that are sent to every task; others are joined.
SENT_PAIRS = 1 << 20
# What a task holds at once: bytes of text, tokens, pairs not yet handed on.
SLICE_BYTES = 1 << 18
SLICE_TOKENS = 150_000
HELD_PAIRS = 1 << 19

# The split of byte-level models before their merges, and characters that all libraries class alike.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMMON = "[\x00-\u024f\u2010-\u2027\u20ac]*"

TOKENS = 150_000
HELD_PAIRS = 1 << 19

# Both sets are Latin letters, visible characters in front of the blank, too.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
CUT = f"(?<=[!-~{LETTERS}])(?= [{LETTERS}])"

TOKENS = "row long, id long, a binary, b binary"


@dataclass
class Tokenizers:
    """Both models as they are in their files, and the bytes of each of their tokens by id."""

    byte_json: str
    piece_model: bytes
    a_bytes: list
    b_bytes: list
    ranked: bool  # the byte-level model merges by least id, after the usual split


@lru_cache(maxsize=2)
def read_tokenizers(byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> Tokenizers:
    """Read on the driver; the tasks get the content, not the paths."""
    import json

    import sentencepiece

    with open(byte_path, encoding="utf-8") as file:
        byte_json = file.read()
    with open(piece_path, "rb") as file:
        piece_model = file.read()
    content = json.loads(byte_json)
    ids = dict(content["model"]["vocab"]) | {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    special = {t["id"] for t in content.get("added_tokens", [])}
    values = _byte_characters()
    a_bytes = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        a_bytes[i] = token.encode() if i in special else bytes(values[c] for c in token)
    pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    b_bytes = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace(MARK, " ").encode())
    split, model = content.get("pre_tokenizer") or {}, content["model"]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    in_order = [model["vocab"].get(m) for m in merges] == list(range(256, 256 + len(merges)))
    plain = not content.get("normalizer") and not model.get("ignore_merges")
    return Tokenizers(byte_json, piece_model, a_bytes, b_bytes, bool(usual and in_order and plain))


def _byte_characters() -> dict:
    """Byte of each character of a byte-level vocabulary: printable ones are themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    byte_path: str = BYTE_MODEL,
    piece_path: str = PIECE_MODEL,
) -> DataFrame:
    """row, id, a, b: the ids of both encodings as 32-bit integers in binary, of every row.

    a encodes a blank and the text, b the text, whose model adds the blank. Strings of special
    tokens inside texts are plain text. Both are empty where the text is null or empty, is no
    UTF-8, or where the bytes of either side's tokens are not those of the blank and the text.
    `row` tells rows of the same id apart. The table is written: later steps read it more than once.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizers(byte_path, piece_path))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    return cut_lineage(rows.mapInArrow(_encode(spec), TOKENS), "tokens")


def overlaps(tokens: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """id, a_place, b_place, a_id, b_id, start, end: every link, places from 0, bytes of the common range.

    Offsets count from the blank before the text. A row per overlapping pair of occurrences;
    documents without tokens have none.
    """
    spec = read_tokenizers(byte_path, piece_path)
    schema = "id long, a_place long, b_place long, a_id int, b_id int, start long, end long"
    return tokens.mapInArrow(_overlaps(_lengths(spec)), schema)


def pair_counts(tokens: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """a_id, b_id, links: how many links of the corpus hold each pair of ids."""
    spec = read_tokenizers(byte_path, piece_path)
    width = len(spec.b_bytes)
    counted = tokens.mapInArrow(_pairs(_lengths(spec), width), "pair long, links long")
    counted = counted.groupBy("pair").agg(F.sum("links").alias("links"))
    return counted.select(
        F.expr(f"cast(pair div {width} as int)").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), "links"
    )


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    byte_path: str = BYTE_MODEL,
    piece_path: str = PIECE_MODEL,
    sent_pairs: int = SENT_PAIRS,
) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best counts the links whose pair is the commonest of its b id in the corpus, ties
    included; count_sum adds up the corpus counts of the links' pairs. The digest is over the
    groups, `a1,a2|b1;a3|b2`, and empty without tokens. Rows without tokens (see `encode`) have
    zeros. Repeated rows and repeated or null ids are rows of their own, all counted; other
    columns do not matter. An empty table gives no rows.
    """
    spec = read_tokenizers(byte_path, piece_path)
    tokens = encode(docs, id_col, text, byte_path, piece_path)
    counts = cut_lineage(pair_counts(tokens, byte_path, piece_path), "pairs")
    # One row per id of b: bounded by the vocabulary.
    most = F.broadcast(counts.groupBy("b_id").agg(F.max("links").alias("_most")))
    width = F.lit(len(spec.b_bytes)).cast("long")
    judged = counts.join(most, "b_id").select(
        (F.col("a_id") * width + F.col("b_id")).alias("pair"), "links", (F.col("links") == F.col("_most")).alias("best")
    )
    fits = counts.count() <= sent_pairs
    sent = judged if fits else judged.orderBy(F.desc("links"), "pair").limit(sent_pairs)
    known = docs.sparkSession.sparkContext.broadcast(_sorted(sent.toArrow()))
    schema = (
        "row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string, others array<struct<pair: long, n: long>>"
    )
    found = tokens.mapInArrow(_align(spec.a_bytes, spec.b_bytes, known), schema)
    found = found.withColumnRenamed("id", id_col)
    if fits:
        return found.drop("row", "others")
    found = cut_lineage(found, "aligned")
    others = found.select("row", F.inline("others"))
    added = others.join(judged, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("links")).alias("_sum")
    )
    joined = found.join(added, "row", "left")
    more = {"n_best": "_best", "count_sum": "_sum"}
    plus = {c: F.col(c) + F.coalesce(extra, F.lit(0)) for c, extra in more.items()}
    return joined.withColumns(plus).drop("row", "others", "_best", "_sum")


def _lengths(spec):
    import numpy as np

    return tuple(np.array([len(t) for t in side], dtype="int64") for side in (spec.a_bytes, spec.b_bytes))


def _sorted(table):
    """Arrays of pair, links and best, by pair."""
    import numpy as np

    pair, links, best = (np.asarray(table.column(c).to_numpy()) for c in ("pair", "links", "best"))
    order = np.argsort(pair)
    return pair[order], links[order], best[order]


class _Encoder:
    """Both encodings of texts."""

    def __init__(self, held):
        import re

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(held.byte_json)
        self.model.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=held.piece_model)
        self.bytes = held.a_bytes, held.b_bytes
        self.common, self.fast = re.compile(COMMON), None
        if held.ranked:
            special = {t.content.encode() for t in self.model.get_added_tokens_decoder().values()}
            ranks = {t: i for i, t in enumerate(held.a_bytes) if t and t not in special}
            self.fast = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def texts(self, texts):
        """Per text, none of them empty, the ids of both sides in binary; empty ones where the bytes differ."""
        import numpy as np

        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            whole = " " + text
            a = self.first(whole)
            data = whole.encode("utf-8", "replace")
            if all(b"".join([of[i] for i in ids]) == data for of, ids in zip(self.bytes, (a.tolist(), b))):
                out.append((a.tobytes(), np.array(b, dtype="uint32").tobytes()))
            else:
                out.append((b"", b""))
        return out

    def first(self, whole):
        import numpy as np

        if self.fast is not None and self.common.fullmatch(whole):
            return self.fast.encode_to_numpy(whole, disallowed_special=())
        return np.array(self.by_model(whole), dtype="uint32")

    def by_model(self, whole):
        return self.model.encode_batch_fast([whole], add_special_tokens=False)[0].ids


def _encode(spec):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = _Encoder(spec.value)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for low, high in _slices(size, SLICE_BYTES):
                part = batch.slice(low, high - low)
                texts = [t.as_py() for t in part.column(2)]
                whole = [t.decode("utf-8", "replace") if t else "" for t in texts]
                found = iter(encoder.texts([t for t in whole if t]))
                # A text that is no UTF-8 cannot be met by the tokens of its replacement.
                sides = [next(found) if t else (b"", b"") for t in whole]
                sides = [s if t and t == w.encode() else (b"", b"") for s, t, w in zip(sides, texts, whole)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(list(s), pa.binary()) for s in zip(*sides))],
                    ["row", "id", "a", "b"],
                )

    return run


def _slices(sizes, most):
    """Bounds of runs of rows whose sizes add up to `most` or little more; a row is never cut."""
    low, held = 0, 0
    for i, n in enumerate(sizes.tolist() if hasattr(sizes, "tolist") else sizes):
        if held and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if len(sizes) > low:
        yield low, len(sizes)


class _Slice:
    """Tokens of some documents with their byte ranges; document after document, so offsets only grow."""

    def __init__(self, part, lengths):
        import numpy as np

        self.ids, self.doc, self.start, self.end, self.counts = [], [], [], [], []
        for name, length in zip("ab", lengths):
            cells = part.column(part.schema.names.index(name)).to_pylist()
            ids = np.frombuffer(b"".join(cells), dtype="uint32").astype("int64")
            counts = np.array([len(c) // 4 for c in cells], dtype="int64")
            size = length[ids]
            end = np.cumsum(size)
            self.ids.append(ids)
            self.counts.append(counts)
            self.doc.append(np.repeat(np.arange(len(cells)), counts))
            self.end.append(end)
            self.start.append(end - size)

    def links(self):
        """Places in a and in b of all overlapping tokens."""
        import numpy as np
        import pandas as pd

        covers = []
        for one, two in ((0, 1), (1, 0)):
            starts = pd.DataFrame({"start": self.start[one], "doc": self.doc[one]})
            others = pd.DataFrame({"start": self.start[two], "doc": self.doc[two], "place": np.arange(len(self.ids[two]))})
            found = pd.merge_asof(starts, others, on="start", by="doc", direction="backward")
            covers.append(found["place"].to_numpy().astype("int64"))
        over_a, over_b = covers  # b's token over each start of a, a's token over each start of b
        later = np.flatnonzero(self.start[0][over_b] < self.start[1])
        return np.concatenate([np.arange(len(over_a)), over_b[later]]), np.concatenate([over_a, later])

    def groups(self):
        """Group of each token of a and b, whether it ends it, and the number of groups."""
        import numpy as np

        common = np.intersect1d(*self.end, assume_unique=True)
        group = [np.searchsorted(common, end) for end in self.end]
        last = [common[g] == end for g, end in zip(group, self.end)] if len(common) else [np.array([], bool)] * 2
        return group, last, len(common)


def _of_tokens(batches, lengths):
    """(rows, _Slice) of a bounded number of tokens, a document at least."""
    import pyarrow.compute as pc

    for batch in batches:
        names = batch.schema.names
        sizes = pc.add(*(pc.binary_length(batch.column(names.index(c))) for c in "ab")).to_numpy(zero_copy_only=False) // 4
        for low, high in _slices(sizes, SLICE_TOKENS):
            part = batch.slice(low, high - low)
            yield part, _Slice(part, lengths)


def _overlaps(lengths):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, held in _of_tokens(batches, lengths):
            a, b = held.links()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = [np.cumsum(c) - c for c in held.counts]
            doc = held.doc[0][a]
            base = held.start[0][first[0][doc]] if len(a) else a
            columns = [
                part.column(part.schema.names.index("id")).take(pa.array(doc)),
                pa.array(a - first[0][doc]),
                pa.array(b - first[1][doc]),
                pa.array(held.ids[0][a].astype("int32")),
                pa.array(held.ids[1][b].astype("int32")),
                pa.array(np.maximum(held.start[0][a], held.start[1][b]) - base),
                pa.array(np.minimum(held.end[0][a], held.end[1][b]) - base),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "a_place", "b_place", "a_id", "b_id", "start", "end"])

    return run


def _pairs(lengths, width):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, weight = [], 0

        def merged():
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(place, np.concatenate([n for _, n in held]), len(pairs)).astype("int64")

        def rows(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "links"])

        for _, tokens in _of_tokens(batches, lengths):
            a, b = tokens.links()
            found = np.unique(tokens.ids[0][a] * width + tokens.ids[1][b], return_counts=True)
            held.append(found)
            weight += len(found[0])
            if weight > HELD_PAIRS:
                held = [merged()]
                weight = len(held[0][0])
                if weight > HELD_PAIRS // 2:
                    yield rows(*held[0])
                    held, weight = [], 0
        if weight:
            yield rows(*merged())

    return run


def _align(a_bytes, b_bytes, known):
    import numpy as np

    lengths = tuple(np.array([len(t) for t in side], dtype="int64") for side in (a_bytes, b_bytes))
    n_a, width = len(a_bytes), len(b_bytes)

    def run(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        pairs, links, best = known.value
        # Every id as it stands inside a group, and as the last of its side there.
        kinds = [(n_a, ","), (n_a, "|"), (width, ","), (width, ";")]
        texts = pa.array([f"{i}{after}" for n, after in kinds for i in range(n)])

        def digests(held, group, last):
            (g_a, g_b), (l_a, l_b) = group, last
            codes = np.empty(len(g_a) + len(g_b), dtype="int64")
            codes[np.arange(len(g_a)) + np.searchsorted(g_b, g_a)] = held.ids[0] + np.where(l_a, n_a, 0)
            codes[np.arange(len(g_b)) + np.searchsorted(g_a, g_b, side="right")] = 2 * n_a + held.ids[1] + np.where(l_b, width, 0)
            ends = np.append(0, np.cumsum(held.counts[0] + held.counts[1]))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), texts.take(pa.array(codes))), "")
            return [hashlib.sha256(t[:-1].encode()).hexdigest() if t else "" for t in joined.to_pylist()]

        for part, held in _of_tokens(batches, lengths):
            rows = part.num_rows
            a, b = held.links()
            doc, pair = held.doc[0][a], held.ids[0][a] * width + held.ids[1][b]
            group, last, _ = held.groups()
            n_links = np.bincount(doc, minlength=rows)
            unique, place, times = np.unique(pair, return_inverse=True, return_counts=True)
            at = np.minimum(np.searchsorted(pairs, unique), max(len(pairs) - 1, 0))
            here = pairs[at] == unique if len(pairs) else np.zeros(len(unique), bool)
            count = np.where(here, links[at], 0) if len(pairs) else np.zeros(len(unique), "int64")
            top = here & best[at] if len(pairs) else here
            total = np.zeros(rows, dtype="int64")
            np.add.at(total, doc, count[place])
            missing = np.flatnonzero(~here[place])
            lists = np.zeros(rows + 1, dtype="int64")
            kept, n = np.array([], "int64"), np.array([], "int64")
            if len(missing):
                # Links by document and pair, for the join.
                key, n = np.unique(np.stack([doc[missing], pair[missing]]), axis=1, return_counts=True)
                kept = key[1]
                lists[1:] = np.cumsum(np.bincount(key[0], minlength=rows))
            others = pa.StructArray.from_arrays([pa.array(kept), pa.array(n.astype("int64"))], ["pair", "n"])
            names = part.schema.names
            columns = {
                "row": part.column(names.index("row")),
                "id": part.column(names.index("id")),
                "n_a": pa.array(held.counts[0]),
                "n_b": pa.array(held.counts[1]),
                "n_groups": pa.array(np.bincount(held.doc[0][last[0]], minlength=rows)),
                "n_links": pa.array(n_links),
                "n_best": pa.array(np.bincount(doc[top[place]], minlength=rows)),
                "count_sum": pa.array(total),
                "groups_sha256": pa.array(digests(held, group, last), "string"),
                "others": pa.ListArray.from_arrays(pa.array(lists, "int32"), others),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
