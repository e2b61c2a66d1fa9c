"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The driver reads the vocabulary of a given model, builds the trie, and sends it to the
tasks; its size is that of the vocabulary. In a task, texts fall into chunks that no piece
can cross; chunks that are new to the task are encoded together, a step of the Viterbi
recurrence at a time for all of them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the format: the mark of white space, and how far an unknown character lies below the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
# What a task holds at once: encoded chunks, cells of the recurrence, bytes of text.
CACHED_CHUNKS = 100_000
MATRIX_CELLS = 250_000
LONG_CHUNK = 4096
SLICE_BYTES = 1 << 20


@dataclass
class Vocabulary:
    """Pieces with log scores: normal ones in the trie, one id per byte for what they do not cover."""

    pieces: list  # bytes that each id stands for
    byte_ids: list
    dummy_prefix: bool
    unknown_score: float
    codes: dict  # character -> code from 1
    base: object = None  # double array: the child of state s by code c is base[s] + c, if check says so
    check: object = None
    ids: object = None  # id of the piece that ends at a state, or -1
    scores: object = None
    longest: int = 0
    splits: bool = True  # no piece has a mark after another character
    edges: dict | None = None  # the same as base and check, for long chunks


@lru_cache(maxsize=4)
def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a sentencepiece model file with byte pieces, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    prefix = model.encode("a", out_type=str)[0].startswith(MARK)
    entries = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) else "piece"
        entries.append((model.id_to_piece(i), model.get_score(i), kind))
    return vocabulary(entries, prefix)


def vocabulary(entries: list, dummy_prefix: bool = True) -> Vocabulary:
    """From (piece, log score, kind) in order of id; kind is piece, byte or other."""
    import numpy as np

    normal = [(p, s, i) for i, (p, s, kind) in enumerate(entries) if kind == "piece" and p]
    byte_ids = [0] * 256
    texts = []
    for i, (piece, _, kind) in enumerate(entries):
        if kind == "byte":
            value = int(piece[3:5], 16)  # <0xAB>
            byte_ids[value] = i
            texts.append(bytes([value]))
        else:
            texts.append(piece.replace(MARK, " ").encode() if kind == "piece" else b"")
    codes = {c: n for n, c in enumerate(sorted({c for p, _, _ in normal for c in p}), 1)}
    least = min((s for _, s, _ in normal), default=0.0)
    made = Vocabulary(texts, byte_ids, dummy_prefix, least - UNKNOWN_PENALTY, codes)
    made.longest = max((len(p) for p, _, _ in normal), default=0)
    made.splits = not any(a != MARK and b == MARK for p, _, _ in normal for a, b in zip(p, p[1:]))
    tree = [{}]
    ends = {}
    for piece, score, i in normal:
        node = 0
        for c in piece:
            node_next = tree[node].get(codes[c])
            if node_next is None:
                node_next = tree[node][codes[c]] = len(tree)
                tree.append({})
            node = node_next
        ends[node] = (i, score)
    made.base, made.check, state = _double_array(tree, len(codes))
    made.ids = np.full(len(made.base), -1, dtype="int32")
    made.scores = np.zeros(len(made.base))
    for node, (i, score) in ends.items():
        made.ids[state[node]], made.scores[state[node]] = i, score
    return made


def _double_array(tree, symbols):
    """base and check of a trie, and each node's state: children go to the first places that are free for all."""
    import numpy as np

    size = 3 * len(tree) + 2 * symbols + 2
    base, check = np.zeros(size, dtype="int64"), np.full(size, -1, dtype="int64")
    used = np.zeros(size, dtype=bool)
    used[0] = True
    state, order, low = {0: 0}, [0], 1
    for node in order:
        kids = np.asarray(sorted(tree[node]), dtype="int64")
        if not len(kids):
            continue
        at, window = -1, low
        while at < 0:
            while window + 4096 + 2 * symbols >= size:
                base, check = np.append(base, np.zeros(size, "int64")), np.append(check, np.full(size, -1))
                used = np.append(used, np.zeros(size, bool))
                size *= 2
            free = np.flatnonzero(~used[window : window + 4096]) + window - kids[0]
            free = free[free > 0]
            fits = free[~used[free[:, None] + kids[None, :]].any(axis=1)]
            at, window = int(fits[0]) if len(fits) else -1, window + 4096
        base[state[node]] = at
        check[at + kids], used[at + kids] = state[node], True
        while used[low]:
            low += 1
        for k in kids.tolist():
            state[tree[node][k]] = at + k
            order.append(tree[node][k])
    return base, check, state


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = MODEL) -> DataFrame:
    """Adds `ids` (array<int>) to the rows; an existing column of that name is replaced.

    Null texts have null ids, empty ones no ids. Characters without a piece become their UTF-8
    bytes, so does a mark that stands in the text itself, so decoding gives back every text.
    Equally good paths: the one whose last pieces are longest. All other columns stay.
    """
    docs = docs.drop(ids)
    out = StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType()))
    return docs.mapInArrow(_encode(read_vocabulary(path), text, ids), out)


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """Adds `text` decoded from ids; null ids give null. Bytes that are no UTF-8 become U+FFFD."""
    rows = rows.drop(text)
    vocab = read_vocabulary(path)
    out = StructType([*rows.schema.fields]).add(text, StringType())
    return rows.mapInArrow(_decode(vocab.pieces, vocab.dummy_prefix, ids, text), out)


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """id, n_tokens, n_byte_tokens, ids_xxhash64, restored: encode every text, decode it, compare."""
    vocab = read_vocabulary(path)
    low, high = min(vocab.byte_ids), max(vocab.byte_ids)
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    out = StructType([*rows.schema.fields]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    encoding, decoding = _encode(vocab, "text", "ids"), _decode(vocab.pieces, vocab.dummy_prefix, "ids", "decoded")
    # Both in one worker; as frames of their own they would take two for each task.
    found = rows.mapInArrow(_then(encoding, decoding), out)
    return found.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: (i >= low) & (i <= high))).cast("long").alias("n_byte_tokens"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )


def _then(first, second):
    return lambda batches: second(first(batches))


def chunk_pattern(vocab: Vocabulary):
    """Chunks that no piece crosses: a run of marks with what follows up to the next mark or line end."""
    import re

    if not vocab.splits:
        return re.compile(r".+", re.S)
    return re.compile(r"\n| *[^ \n]+| +" if "\n" not in vocab.codes else r" *[^ ]+| +")


def viterbi(vocab: Vocabulary, chunks: list) -> list:
    """Ids of each chunk (blanks stand for marks) as bytes of little-endian 32-bit integers.

    All chunks of a block take each step of the recurrence together; a chunk above LONG_CHUNK
    characters goes alone, in memory that follows its best paths, not its whole matrix.
    """
    import numpy as np

    out = [b""] * len(chunks)
    order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
    while order and len(chunks[order[-1]]) > LONG_CHUNK:
        i = order.pop()
        out[i] = _viterbi_long(vocab, chunks[i], np)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (len(chunks[order[end]]) + 1) <= MATRIX_CELLS:
            end += 1
        block = order[at:end]
        found = _viterbi_block(vocab, [chunks[i] for i in block], np)
        for i, ids in zip(block, found):
            out[i] = ids
        at = end
    return out


def _viterbi_long(vocab, chunk, np):
    """As `_viterbi_block` for one chunk of any length: plain steps, ids given out where all open paths agree.

    Only the last `longest` ends can be reached from later ones. Every so many characters the
    paths to these are followed back; where they meet, everything before is settled and dropped.
    """
    codes, mark = vocab.codes, vocab.codes.get(MARK, 0)
    longest = max(vocab.longest, 1)
    trie = _plain(vocab)
    out, floor = [], 0  # characters before floor are settled
    best, start, piece = [0.0], [0], [-1]  # of the ends floor, floor + 1, ...
    minus = float("-inf")
    # Scores of ends are compared among neighbours only, so they may stay sums from the chunk's start.
    size, next_cut = len(chunk), LONG_CHUNK

    def ids_between(end, begin):
        ids, at = [], end
        while at > begin:
            i = at - floor
            if piece[i] >= 0:
                ids.append(piece[i])
            else:
                text = chunk[start[i] : at].encode("utf-8", "surrogatepass")
                ids += [vocab.byte_ids[b] for b in reversed(text)]
            at = start[i]
        return ids[::-1]

    for s in range(size):
        here = best[s - floor]
        while len(best) <= min(s + longest, size) - floor:
            best.append(minus)
            start.append(s)
            piece.append(-1)
        state, single = 0, False
        for d in range(min(longest, size - s)):
            c = chunk[s + d]
            state = trie.get((state, mark if c == " " else 0 if c == MARK else codes.get(c, 0)))
            if state is None:
                break
            own = vocab.ids.item(state)
            if own >= 0:
                i, score = s + d + 1 - floor, here + vocab.scores.item(state)
                if score > best[i]:
                    best[i], start[i], piece[i] = score, s, own
                single = single or d == 0
        if not single:
            i, score = s + 1 - floor, here + vocab.unknown_score
            if score > best[i]:
                best[i], start[i], piece[i] = score, s, -1
        if s >= next_cut:
            # Ends that later steps can start from: those after s that a piece reaches already, and s + 1.
            open_ends = {e for e in range(s + 1, min(s + longest, size) + 1) if best[e - floor] > minus}
            while len(open_ends) > 1:
                last = max(open_ends)
                open_ends.remove(last)
                open_ends.add(max(start[last - floor], floor))
            meet = open_ends.pop()
            if meet > floor:
                out.append(np.asarray(ids_between(meet, floor), dtype="<i4").tobytes())
                best, start, piece = (x[meet - floor :] for x in (best, start, piece))
                floor = meet
            next_cut = s + LONG_CHUNK
    out.append(np.asarray(ids_between(size, floor), dtype="<i4").tobytes())
    return b"".join(out)


def _plain(vocab):
    """The double array as a dict (state, code) -> state, made once for each vocabulary of a worker."""
    import numpy as np

    if vocab.edges is None:
        to = np.flatnonzero(vocab.check >= 0)
        parents = vocab.check[to]
        codes = to - vocab.base[parents]
        vocab.edges = {(p, c): t for p, c, t in zip(parents.tolist(), codes.tolist(), to.tolist())}
    return vocab.edges


def _viterbi_block(vocab, chunks, np):
    codes, mark = vocab.codes, vocab.codes.get(MARK, 0)
    n, width = len(chunks), max(map(len, chunks))
    lengths = np.fromiter(map(len, chunks), dtype="int64", count=n)
    get = lambda c: mark if c == " " else 0 if c == MARK else codes.get(c, 0)
    seen = {}
    flat = np.fromiter(
        (seen[c] if c in seen else seen.setdefault(c, get(c)) for x in chunks for c in x), dtype="int64"
    )
    symbols = np.zeros((n, width), dtype="int64")
    symbols[np.arange(width)[None, :] < lengths[:, None]] = flat
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((n, width + 1), dtype="int32"), np.full((n, width + 1), -1, dtype="int32")
    for s in range(width):
        rows = np.flatnonzero(lengths > s)
        state = np.zeros(len(rows), dtype="int64")
        single = np.zeros(n, dtype=bool)
        here = rows
        for d in range(min(vocab.longest, width - s)):
            code = symbols[here, s + d]
            to = vocab.base[state] + code
            ok = (code > 0) & (lengths[here] > s + d) & (vocab.check[to] == state)
            here, state = here[ok], to[ok]
            if not len(here):
                break
            ends = vocab.ids[state] >= 0
            target, score = here[ends], best[here[ends], s] + vocab.scores[state[ends]]
            better = score > best[target, s + d + 1]
            target, picked = target[better], vocab.ids[state[ends]][better]
            best[target, s + d + 1], start[target, s + d + 1] = score[better], s
            piece[target, s + d + 1] = picked
            if d == 0:
                single[here[ends]] = True
        alone = rows[~single[rows]]
        score = best[alone, s] + vocab.unknown_score
        better = score > best[alone, s + 1]
        best[alone[better], s + 1], start[alone[better], s + 1] = score[better], s
        piece[alone[better], s + 1] = -1
    out = []
    starts, pieces = start.tolist(), piece.tolist()
    for i, chunk in enumerate(chunks):
        ids, at = [], len(chunk)
        own_start, own_piece = starts[i], pieces[i]
        while at:
            if own_piece[at] >= 0:
                ids.append(own_piece[at])
            else:
                ids += [vocab.byte_ids[b] for b in reversed(chunk[own_start[at]].encode("utf-8", "surrogatepass"))]
            at = own_start[at]
        out.append(np.asarray(ids[::-1], dtype="<i4").tobytes())
    return out


def _encode(vocab, text, ids):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = chunk_pattern(vocab).findall
        cache = {}
        for whole in batches:
            for batch in _slices(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                each = [find((" " if vocab.dummy_prefix else "") + t) if t else [] for t in texts]
                fresh = list({c for chunks in each for c in chunks if c not in cache})
                if len(cache) + len(fresh) > CACHED_CHUNKS:
                    cache = {}
                    fresh = list({c for chunks in each for c in chunks})
                cache.update(zip(fresh, viterbi(vocab, fresh)))
                joined = [b"".join(map(cache.__getitem__, chunks)) for chunks in each]
                for c in fresh:
                    if len(c) > LONG_CHUNK:
                        del cache[c]
                ends = np.cumsum([0, *(len(x) // 4 for x in joined)]).astype("int32")
                values = pa.array(np.frombuffer(b"".join(joined), dtype="<i4"))
                missing = pa.array([t is None for t in texts])
                column = pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return run


def _slices(batch, column, most=SLICE_BYTES):
    """The batch in parts whose texts have about so many bytes, a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total, low = np.cumsum(np.asarray(sizes, dtype="int64")), 0
    while low < batch.num_rows:
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _decode(pieces, dummy_prefix, ids, text):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        size = len(pieces)
        for batch in batches:
            out = []
            for value in batch.column(batch.schema.get_field_index(ids)):
                if not value.is_valid:
                    out.append(None)
                    continue
                own = np.asarray(value.values)
                if len(own) and (own.min() < 0 or own.max() >= size):
                    raise ValueError("an id is outside the vocabulary")
                data = b"".join(map(pieces.__getitem__, own.tolist()))
                if dummy_prefix and data[:1] == b" ":
                    data = data[1:]
                out.append(data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text]
            )

    return run
