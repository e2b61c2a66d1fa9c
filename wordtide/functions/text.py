"""Text as column expressions: documents, sentences, tokens, context windows.

Every function takes and returns columns, so Spark keeps the work inside the
scan stage. Positions are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide the results.
DOCUMENT_MARKER = r"@@(?=\d{7})"
REDACTION_MARK = "@ @ @ @ @ @ @ @ @ @"
SENTENCE_PATTERN = r"[^.!?]*[.!?]+|[^.!?]+"
TOKEN_PATTERN = r"\p{L}+|\d+|[^\s\p{L}\d]"
ABBREVIATION_SPLIT = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"
SENTENCE_ENDS = [".", "!", "?"]
PADDING_TOKENS = ["[PAD]", "[UNK]"]
# Markup left in the corpus and its plain form, in this order.
MARKUP = [("< p >", ""), ("/ /", ""), ("& lt ;", "<"), ("& gt ;", ">"), ("  ", " ")]
WHITESPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def split_documents(raw: Column) -> Column:
    """Array of (text_id, doc_text) for a file of documents behind id markers.

    Text before the first marker belongs to no document. A marker directly
    followed by another one yields an empty document.
    """
    parts = F.split(raw, DOCUMENT_MARKER)
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(bodies, document)


def document(record: Column) -> Column:
    """(text_id, doc_text) of what follows a marker."""
    return F.struct(
        F.substring(record, 1, 7).cast("long").alias("text_id"), strip(F.substr(record, F.lit(8))).alias("doc_text")
    )


def sentences(text: Column) -> Column:
    """Sentences end at runs of . ! ?; joined together they give the text back."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def tokens(text: Column) -> Column:
    """Letter runs, digit runs, and single other marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def drop_redacted_sentences(text: Column) -> Column:
    trimmed = F.transform(sentences(text), strip)
    kept = F.filter(trimmed, lambda s: ~F.contains(s, F.lit(REDACTION_MARK)) & (s != ""))
    return F.array_join(kept, " ")


def abbreviation_aware_sentences(text: Column, max_length: int | None = 150) -> Column:
    """Split after . or ? unless an abbreviation precedes; keep the short ones."""
    parts = F.split(F.translate(text, "\n", " "), ABBREVIATION_SPLIT)
    if max_length is None:
        return parts
    return F.filter(parts, lambda s: F.length(s) < max_length)


def first_position(words: Column, word: Column | str) -> Column:
    """Position of the first occurrence, null if there is none."""
    found = F.array_position(words, F.lit(word) if isinstance(word, str) else word)
    return F.when(found > 0, (found - 1).cast("int"))


def tag_of_first(words: Column, tags: Column, word: Column | str, missing: str = "X") -> Column:
    return F.coalesce(F.get(tags, first_position(words, word)), F.lit(missing))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def wrap(text: Column, width: int = 50, line_break: str = "<br>") -> Column:
    """Lines of at most `width` characters, broken at blanks; longer words are cut."""
    plain = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    line = rf"(.{{0,{width - 1}}}\S)(?: +|$)|(\S{{{width}}})"
    wrapped = F.regexp_replace(F.rtrim(plain), line, f"$1$2{line_break}")
    return F.regexp_replace(wrapped, f"{line_break}$", "")


def name_before_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def _indexes(words: Column, keep) -> Column:
    return F.transform(words, lambda word, i: F.when(keep(word, i), i))


def _let(value: Column, body) -> Column:
    """Compute `value` once and use it inside the lambdas of `body`.

    A plain column inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sentence_ends(words: Column) -> Column:
    return F.filter(_indexes(words, lambda w, i: w.isin(SENTENCE_ENDS)), lambda i: i.isNotNull())


def _start(ends: Column, size: Column, at: Column) -> Column:
    before = F.array_max(F.filter(ends, lambda i: i <= at))
    inside = (at >= 0) & (at < size)
    return F.when(inside, F.coalesce(before, F.lit(-1)) + 1).otherwise(at + 1)


def _end(ends: Column, size: Column, at: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(ends, lambda i: i >= at)), F.greatest(size, at))


def sentence_start(words: Column, position: Column) -> Column:
    """Index after the nearest sentence end at or before `position`."""
    return _let(_sentence_ends(words), lambda ends: _start(ends, F.size(words), position))


def sentence_end(words: Column, position: Column) -> Column:
    """Index of the nearest sentence end at or after `position`."""
    return _let(_sentence_ends(words), lambda ends: _end(ends, F.size(words), position))


def context_window(words: Column, position: Column, width: int = 10) -> Column:
    """The target in [[ ]] with up to `width` tokens on each side."""
    first = F.greatest(position - width, F.lit(0))
    before = F.array_join(F.slice(words, first + 1, position - first), " ")
    after = F.array_join(F.slice(words, position + 2, F.lit(width)), " ")
    marked = F.concat(F.lit("[["), F.get(words, position), F.lit("]]"))
    return F.concat_ws(" ", F.nullif(before, F.lit("")), marked, F.nullif(after, F.lit("")))


def snippet_edges(words: Column, position: Column) -> Column:
    """First and last token of the target's sentence and its two neighbours."""
    size = F.size(words)

    def edges(ends: Column) -> Column:
        inner = F.struct(
            (_start(ends, size, position) - 2).alias("first"), (_end(ends, size, position) + 1).alias("last")
        )
        return _let(
            inner,
            lambda at: F.struct(
                F.greatest(_start(ends, size, at["first"]), F.lit(0)).alias("first"),
                _end(ends, size, at["last"]).alias("last"),
            ),
        )

    return _let(_sentence_ends(words), edges)


def snippet_text(words: Column, position: Column, edge: Column) -> Column:
    """Readable text between the edges: word pieces rejoined, the target in [[ ]]."""
    def joined(first: Column, length: Column) -> Column:
        def spelled(run: Column) -> Column:
            # Padding becomes an empty token, which leaves its blanks behind.
            shown = F.transform(F.slice(words, first + 1, length), lambda w: F.when(w.isin(PADDING_TOKENS), "").otherwise(w))
            odd = F.contains(run, F.lit("##"))
            for token in PADDING_TOKENS:
                odd = odd | F.contains(run, F.lit(token))
            # Few runs hold such tokens; the others are only searched.
            plain = F.replace(F.concat(F.lit(" "), F.array_join(shown, " ")), F.lit(" ##"), F.lit(""))
            return F.when(odd, plain).otherwise(F.concat(F.lit(" "), run))

        return _let(F.array_join(F.slice(words, first + 1, length), " "), spelled)

    target = F.get(words, position)
    marked = F.concat(F.when(target.startswith("##"), "").otherwise(" "), F.lit("[["), target, F.lit("]]"))
    before = joined(edge["first"], position - edge["first"])
    after = joined(position + 1, F.greatest(edge["last"] - position, F.lit(0)))

    def readable(text: Column) -> Column:
        found, plain = F.lit(False), text
        for mark, other in MARKUP:
            found = found | F.contains(text, F.lit(mark))
            plain = F.replace(plain, F.lit(mark), F.lit(other))
        return F.when(found, plain).otherwise(text)

    return _let(strip(F.concat(before, marked, after)), readable)


def snippet_wanted(
    words: Column, position: Column, affixation: bool = False, min_context: int | None = None
) -> Column:
    """False where the target is only a part of a longer word, unless `affixation`,
    and where fewer than `min_context` tokens stand on either side, if asked for."""
    wanted = F.lit(True)
    if not affixation:
        wanted = wanted & ~F.coalesce(F.get(words, position + 1).startswith("##"), F.lit(False))
    if min_context is not None:
        wanted = wanted & (position >= min_context) & (F.size(words) - position > min_context)
    return wanted


def trim_around_target(text: Column, offset: Column, from_start: Column) -> Column:
    """Drop up to `offset` words at one end, never the [[target]] or beyond it."""
    words = F.split(text, " ")
    is_target = _indexes(words, lambda w, i: w.startswith("[[") & w.endswith("]]"))
    size = F.size(words)
    # Without a target at least one word stays.
    room_before = F.coalesce(F.array_min(is_target), size - 1)
    room_after = F.coalesce(size - 1 - F.array_max(is_target), size - 1)
    cut = F.least(offset, F.when(from_start, room_before).otherwise(room_after))
    return F.array_join(F.slice(words, F.when(from_start, cut + 1).otherwise(1), size - cut), " ")
