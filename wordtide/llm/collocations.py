"""Phrase collocations by Toivonen's method.

A sample of documents proposes the phrases that seem frequent, level by level with a threshold
below its share. One pass over all texts counts the proposed phrases and their negative border:
phrases that were not proposed, though the phrase without its last word and the one without its
first were. Every part of a frequent phrase is frequent, so if nothing on the border is frequent,
nothing beyond it is. Otherwise the border's failures join the proposed phrases, and a further pass
counts what that adds: the new border, the border of that and so on up to the longest phrases, so
that it closes at once. The result does not depend on the sample.

Passes count hashes of phrases, of 61 bits. Proposed phrases are told by a bitmap with two bits per
phrase, of bounded size; a phrase that only seems to be in it is counted in vain and changes no
result. With its count a phrase keeps the tag of some document that holds it; a last pass reads the
words of the frequent phrases, only from documents with the tag.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.llm.shingles import _mix
from wordtide.operators.ranking import top_per_group
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 100
LONGEST = 5
TOP = 2000
# The sample: this share of the documents, by a hash of id and language. Its threshold lies so many
# standard deviations of a count below the share of the full one.
SHARE = 0.25
DEVIATIONS = 3.0
# The bitmap of proposed phrases has 32 bits a phrase within these bounds (a power of two; 16 MB at most).
LEAST_BITS, MOST_BITS = 18, 27
# What a task holds at once: bytes of text that are split together, hashes not yet handed on.
SLICE_BYTES = 1 << 19
HELD_HASHES = 1 << 19
TAGS = 1 << 16
UNKNOWN = "und"  # fixed value: the language of rows without one
LEVELS = 8  # phrase hashes carry the number of words in their lowest three bits


def collocations(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    share: float = SHARE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words per language.

    Words and phrases as in `frequent_phrases`; n counts a language's words, a a phrase's
    occurrences, at least `least`. Cutting a phrase after its first words gives l and r, the
    occurrences of both parts, and floor(1000 a n / (l r)); the lowest of a phrase's cuts is its
    score, ties at the shortest first part. Phrases inside a longer candidate with as many
    occurrences are left out. Order: score and a falling, phrase rising by UTF-8 bytes. Null
    texts are empty, a null language is `und`; repeated rows count again; an empty table, or one
    without frequent phrases, gives no rows; other columns do not matter.
    """
    counts = cut_lineage(frequent_phrases(docs, id_col, text, lang, least, longest, share), "phrases")
    return best_phrases(counts, top)


def best_phrases(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The scored phrases from lang, phrase, words, f; a phrase of 0 words holds n."""
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))  # one row per language
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    cuts = counts.where("words > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("_all"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    )
    joined = lambda low, n: F.array_join(F.slice("_all", low, n), " ")
    cuts = cuts.select(
        "lang", "phrase", "a", "words", "k", joined(F.lit(1), F.col("k")).alias("_first"),
        joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest"),
    )
    of = lambda part, name: parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = (
        cuts.join(of("_first", "l"), ["lang", "_first"])
        .join(of("_rest", "r"), ["lang", "_rest"])
        .join(total, "lang")
        .withColumn("score", F.expr("cast(a as decimal(18,0)) * 1000 * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * r)"))
    )
    # Only a phrase with one word more can be met first: those between have as many occurrences as both ends.
    longer = cuts.where("words > 2").select("lang", "a", F.explode(F.array(*_ends())).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("_cut")
    kept = (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(lowest)
        .join(longer, ["lang", "phrase"], "left")
        .where("_longer is null or _longer < a")
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    )
    ranked = top_per_group(kept, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top, ["phrase"])
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _ends():
    """The phrase without its last word and without its first, from the cuts where they stand."""
    return [
        F.when(F.col("k") == F.col("words") - 1, F.col("_first")),
        F.when(F.col("k") == 1, F.col("_rest")),
    ]


def frequent_phrases(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    share: float = SHARE,
) -> DataFrame:
    """lang, phrase, words, f: phrases of 1 to `longest` words with f >= least, exact, and per language
    a row of 0 words and an empty phrase, whose f counts all words.

    A-Z become a-z. Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at
    blanks and tabs; a phrase lies inside a piece, occurrences may overlap.
    """
    if not 1 <= longest < LEVELS:
        raise ValueError(f"Phrases have 1 to {LEVELS - 1} words.")
    draw = F.xxhash64(F.col(id_col), F.col(lang))
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(text).cast("string").cast("binary").alias("text"),
        F.pmod(F.shiftright(draw, 20), F.lit(TAGS)).cast("int").alias("tag"),
        F.pmod(draw, F.lit(1 << 20)).alias("_draw"),
    )
    drawn = rows.where(F.col("_draw") < int(share * (1 << 20))).drop("_draw")
    rows = rows.drop("_draw")
    proposed = _propose(cut_lineage(drawn, "sample"), _sample_threshold(least, share), longest)
    levels = range(1, longest + 1)
    hashes = cut_lineage(_totals(rows, proposed, None, levels).where(F.col("n") >= least), "frequent")
    failed = cut_lineage(hashes.mapInArrow(_outside(proposed, longest), "hash long"), "failed")
    if not failed.isEmpty():
        # A frequent phrase not yet counted has two parts that are proposed, failures, or counted
        # in this pass themselves; so none is left after it.
        more = _totals(rows, _united(proposed, _bitmap(failed)), proposed, levels).where(F.col("n") >= least)
        hashes = hashes.unionByName(cut_lineage(more, "expanded"))
    tagged = hashes.select(_tagged(F.col("hash"), F.col("tag")).alias("hash"))
    schema = "hash long, lang string, phrase string, words int, n long"
    texts = cut_lineage(rows.mapInArrow(_texts(_bitmap(hashes), _bitmap(tagged), longest), schema), "texts")
    words = texts.where("words = 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    named = texts.where("words > 0").drop("n").dropDuplicates(["hash"])
    return named.join(hashes.select("hash", F.col("n").alias("f")), "hash").drop("hash").unionByName(words)


def _tagged(value, tag):
    """Hash of a phrase and a tag, the same in columns and arrays."""
    return value.bitwiseXOR(F.shiftleft(tag.cast("long"), 44)).bitwiseXOR(F.shiftleft(tag.cast("long"), 17))


def _sample_threshold(least, share):
    from math import floor, sqrt

    return max(1, floor(least * share - DEVIATIONS * sqrt(least * share)))


def _propose(drawn, threshold, longest):
    """Bitmap of the phrases that are frequent in the sample, longer ones from the shorter."""
    proposed = None
    for words in range(1, longest + 1):
        found = cut_lineage(_totals(drawn, proposed, None, [words]).where(F.col("n") >= threshold).select("hash"), "level")
        if found.isEmpty():
            break
        proposed = _united(proposed, _bitmap(found))
    return proposed if proposed is not None else _no_bits()


def _totals(rows, proposed, earlier, levels):
    """hash, n, tag of the phrases of these lengths whose two parts are proposed; the tag of a document with it.

    With `earlier`, the phrases that this bitmap had counted are left out, and parts that are
    counted now pass for proposed.
    """
    counted = rows.mapInArrow(_counts(proposed, earlier, list(levels)), "hash long, n long, tag int")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"), F.max("tag").alias("tag"))


def _no_bits():
    import numpy as np

    return np.zeros(1 << (LEAST_BITS - 3), dtype="uint8")


def _bitmap(hashes: DataFrame):
    """Bits of the phrases, built by the executors; of bounded size, whatever the number of phrases."""
    import numpy as np

    bits = LEAST_BITS
    count = hashes.count()
    while bits < MOST_BITS and (1 << bits) < 32 * count:
        bits += 1
    at = hashes.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), _second("hash", bits))).alias("slot"))
    at = at.withColumn("slot", F.col("slot") + 1)
    chunks = at.groupBy(F.expr("bitmap_bucket_number(slot)").alias("chunk")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")
    )
    out = np.zeros(1 << (bits - 3), dtype="uint8")
    for row in chunks.collect():  # as many bytes as the bitmap at most
        part = np.frombuffer(bytes(row["bits"]), dtype="uint8")
        low = (row["chunk"] - 1) * len(part)
        out[low : low + len(part)] |= part[: len(out) - low]
    return out


def _second(value, bits):
    """The other bit of a phrase, from lower bits of its hash."""
    return F.shiftrightunsigned(F.shiftleft(value, 28), 64 - bits)


def _united(one, two):
    """Both bitmaps as one, of the size of the larger: a bit of the smaller covers all that share its leading bits."""
    import numpy as np

    if one is None or len(one) == len(two):
        return two if one is None else one | two
    small, large = sorted((one, two), key=len)
    wide = np.repeat(np.unpackbits(small, bitorder="little"), len(large) // len(small))
    return large | np.packbits(wide, bitorder="little")


def _inside(bitmap, hashes):
    """Which hashes have both of their bits in the bitmap."""
    import numpy as np

    bits = np.uint64(len(bitmap).bit_length() + 2)
    here = np.ones(len(hashes), dtype=bool)
    for slot in (hashes >> (np.uint64(64) - bits), (hashes << np.uint64(28)) >> (np.uint64(64) - bits)):
        here &= (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("uint8")) & 1 == 1
    return here


def _outside(bitmap, longest):
    """Hashes of counted phrases, shorter than the longest, that were not proposed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes = np.asarray(batch.column(batch.schema.names.index("hash"))).view("uint64")
            keep = ~_inside(bitmap, hashes) & (hashes % np.uint64(LEVELS) < longest)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view("int64"))], ["hash"])

    return run


class _Words:
    """Words of some texts: hash, first byte, byte behind, piece; `skip` words are there as context only."""

    def __init__(self, data, ends, langs, tags, skip=0):
        import numpy as np

        kind, values = _tables()
        found = np.frombuffer(data, dtype="uint8")
        kinds = kind[found]
        place = np.flatnonzero(kinds == 0)
        first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
        sizes = np.diff(np.append(first, len(place)))
        power = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 0, 0x9E3779B97F4A7C15, dtype="uint64"), dtype="uint64")
        offset = np.arange(len(place)) - np.repeat(first, sizes)
        self.data, self.skip = data, skip
        self.start = place[first]
        self.end = self.start + sizes
        self.piece = np.cumsum(kinds == 2)[self.start]
        self.text = np.searchsorted(ends, self.start, side="right")
        whole = np.add.reduceat(values[found[place]] * power[offset], first) if len(first) else np.array([], "uint64")
        self.hash = _mix(whole)
        self.lang = np.asarray(langs, dtype="uint64")[self.text] if len(first) else whole
        self.tag = np.asarray(tags, dtype="int32")[self.text] if len(first) else self.text.astype("int32")
        self.made = {}

    def phrases(self, words):
        """Hashes of all runs of so many words, and which of them are phrases."""
        if words not in self.made:
            self.made[words] = self._phrases(words)
        return self.made[words]

    def _phrases(self, words):
        import numpy as np

        n = max(0, len(self.hash) - words + 1)
        total = self.lang[:n] * np.uint64(0xD6E8FEB86659FD93)
        odd = np.random.default_rng(words).integers(0, 2**63, words, dtype="uint64") * np.uint64(2) + np.uint64(1)
        for k in range(words):
            total = total + self.hash[k : k + n] * odd[k]
        whole = self.piece[:n] == self.piece[words - 1 :] if n else np.array([], bool)
        return (_mix(total) & ~np.uint64(LEVELS - 1)) | np.uint64(words), whole

    def own(self, words):
        """Which runs of so many words are more than context."""
        import numpy as np

        return np.arange(max(0, len(self.hash) - words + 1)) + words > self.skip

    def words(self, at, words):
        """A phrase as text."""
        return b" ".join([self.data[s:e] for s, e in zip(self.start[at : at + words], self.end[at : at + words])])


def _tables():
    """Kind of each byte (word, blank, end of a piece) and its value, A-Z as a-z."""
    import numpy as np

    kind = np.zeros(256, dtype="uint8")
    kind[[0x09, 0x20]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    values = np.random.default_rng(20240517).integers(0, 2**64, 256, dtype="uint64")
    values[65:91] = values[97:123]
    return kind, values


def _slices(batches, context):
    """_Words of a bounded number of bytes and the languages of their texts.

    Short texts go together. A long one is cut between words; the cut part begins with so many
    words of the part before, so that each phrase lies in one part as a whole and is counted in
    the part where it ends. Only a single longer word makes a larger part.
    """
    import re

    import numpy as np
    import xxhash

    edge = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
    held, langs, tags, size = [], [], [], 0

    def made():
        ends = np.cumsum([len(t) + 1 for t in held])
        salts = [xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")) for lang in langs]
        return _Words(b"\n".join(held) + b"\n", ends, salts, tags), langs

    for batch in batches:
        for lang, text, tag in zip(*batch.columns):
            text, lang, tag = (text.as_py() or b"").lower(), lang.as_py(), tag.as_py()
            if len(text) <= SLICE_BYTES:
                if held and size + len(text) > SLICE_BYTES:
                    yield made()
                    held, langs, tags, size = [], [], [], 0
                held.append(text)
                langs.append(lang)
                tags.append(tag)
                size += len(text) + 1
                continue
            salt, at, before = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")), 0, b""
            while at < len(text):
                found = edge.search(text, at + SLICE_BYTES)
                cut = found.start() if found else len(text)
                part = before + text[at:cut] + b"\n"
                skip = len(_Words(before + b"\n", [len(before) + 1], [salt], [tag]).start) if before else 0
                words = _Words(part, [len(part)], [salt], [tag], skip)
                yield words, [lang]
                first = words.start[-context:] if context else words.start[:0]
                before = part[first[0] : -1] if len(first) else b""
                at = cut
    if held:
        yield made()


def _added(held):
    """Hashes with the sums of their counts, and the tag of one of each."""
    import numpy as np

    hashes, counts, tags = (np.concatenate(c) for c in zip(*held))
    found, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype("int64"), tags[first]


def _counts(proposed, earlier, levels):
    """Counts by hash, added up over as many slices of a task as fit."""

    def parts_in(words, bitmap, level):
        """Which phrases of a level have both parts in the bitmap."""
        hashes, whole = words.phrases(level)
        if level == 1 or not len(hashes):
            return whole
        parts = _inside(bitmap, words.phrases(level - 1)[0])
        return whole & parts[:-1] & parts[1:]

    def wanted(words):
        """Per level the phrases to count, and the tags of their documents."""
        import numpy as np

        shorter = None
        for level in levels:
            hashes, whole = words.phrases(level)
            if earlier is None or level == 1 or not len(hashes):
                now = parts_in(words, proposed, level)
            else:
                parts = _inside(proposed, words.phrases(level - 1)[0]) | shorter
                now = whole & parts[:-1] & parts[1:]
            if earlier is not None:
                now = shorter = now & ~parts_in(words, earlier, level)
            now = np.flatnonzero(now & words.own(level))
            yield hashes[now], words.tag[now]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def rows():
            found = _added(held)
            for at in range(0, len(found[0]), 1 << 16):
                hashes, n, tag = (c[at : at + (1 << 16)] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view("int64")), pa.array(n), pa.array(tag)], ["hash", "n", "tag"])

        for words, _ in _slices(batches, max(levels) - 1):
            if not len(words.hash):
                continue
            for hashes, tags in wanted(words):
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((found, n, tags[first]))
                size += len(found)
            if size > HELD_HASHES:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    return run


def _texts(frequent, tagged, longest):
    """hash, lang, phrase, words of frequent phrases in documents with their tag, and the number of words per language.

    A phrase is written out once a task, as far as it is held; a few that only seem frequent are, too.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, types = ["hash", "lang", "phrase", "words", "n"], ["int64", "string", "string", "int32", "int64"]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        totals, out, seen = {}, [], set()
        for words, langs in _slices(batches, longest - 1):
            if not len(words.hash):
                continue
            for lang, n in zip(langs, np.bincount(words.text[words.skip :], minlength=len(langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            for level in range(1, longest + 1):
                hashes, whole = words.phrases(level)
                place = np.flatnonzero(whole & words.own(level))
                place = place[_inside(frequent, hashes[place])]
                tag = words.tag[place].astype("uint64")
                place = place[_inside(tagged, hashes[place] ^ (tag << np.uint64(44)) ^ (tag << np.uint64(17)))]
                found, first = np.unique(hashes[place], return_index=True)
                for h, at in zip(found.view("int64").tolist(), place[first].tolist()):
                    if h not in seen:
                        seen.add(h)
                        out.append((h, langs[words.text[at]], words.words(at, level).decode("utf-8", "replace"), level, 0))
            if len(out) > 1 << 16:
                yield made(out)
                out = []
                seen = seen if len(seen) < 1 << 20 else set()
        out += [(None, lang, "", 0, n) for lang, n in totals.items()]
        if out:
            yield made(out)

    return run
