"""Phrase collocations against a plain count of all runs of words."""

import collections
import random
import re

import pytest

from wordtide.llm import collocations as C


def plain(rows, least, longest=5, top=2000):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        inside = any(
            other == lang and len(longer) > len(words) and n >= a and n >= least
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), n in f.items() if n >= a
        )
        if not inside:
            cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            score, _, (left, right) = min((1000 * a * total[lang] // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, each in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(each)[:top], 1)
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, f long, phrase string")


def made(seed, n=300):
    draw = random.Random(seed)
    words = ["the", "New", "YORK", "city", "é", "a b", "x-y", "of", "ÉCOLE", "zz"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b"]
    rows = [(draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 30)))) for _ in range(n)]
    rows += [("en", None), ("fr", ""), ("en", " \t "), ("en", "New York city of " * 40), ("de", "solo")]
    return rows + rows[:20]


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("share", [0.25, 0.0, 1.0])
def test_any_sample_gives_the_same_phrases(spark, share):
    rows = made(1)
    expected = plain(rows, 12)
    assert len(expected) > 40
    assert found(C.collocations(frame(spark, rows), least=12, share=share)) == expected


def test_top_and_lengths(spark):
    rows = made(2)
    assert found(C.collocations(frame(spark, rows), least=5, longest=3, top=4)) == plain(rows, 5, 3, 4)


def test_a_missed_phrase_needs_more_passes(spark, monkeypatch):
    """Nothing is proposed: all longer phrases are beyond the border."""
    rows = made(3, 200)
    passes = []
    whole = C._totals
    monkeypatch.setattr(C, "_totals", lambda r, p, e, levels: passes.append(levels) or whole(r, p, e, levels))
    monkeypatch.setattr(C, "_sample_threshold", lambda least, share: 10**9)
    assert found(C.collocations(frame(spark, rows), least=4, share=0.5)) == plain(rows, 4)
    assert passes[-2:] == [range(1, 6)] * 2


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    monkeypatch.setattr(C, "HELD_HASHES", 100)
    draw = random.Random(4)
    long = " ".join(draw.choice(["ab", "cd", "efghi. jk", "l" * 90]) for _ in range(600))
    rows = [("en", long), ("en", long.upper()), ("fr", "ab cd " * 30), *made(5, 60)]
    assert found(C.collocations(frame(spark, rows), least=6)) == plain(rows, 6)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 4)
    monkeypatch.setattr(C, "MOST_BITS", 5)
    rows = made(6, 150)
    assert found(C.collocations(frame(spark, rows), least=6)) == plain(rows, 6)


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 9 * 10**13 + 7, 10**12 + 11, 10**12 + 39, 3 * 10**12 + 1
    rows = [("en", "", 0, n), ("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)]
    got = C.best_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [r["score"] for r in got] == [1000 * a * n // (left * right)]


def test_empty_tables(spark):
    assert C.collocations(frame(spark, made(1)).limit(0)).count() == 0
    assert C.collocations(frame(spark, [("en", None), (None, "")])).count() == 0


def test_bitmaps_hold_both_sizes(spark):
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 2**64, 500, dtype="uint64")
    frame = spark.createDataFrame([(int(h),) for h in hashes.view("int64")], "hash long")
    small, large = C._bitmap(frame), np.zeros(1 << 17, dtype="uint8")
    both = C._united(small, large)
    assert len(both) == len(large)
    for bitmap in (small, both):
        assert C._inside(bitmap, hashes).all()
    others = np.random.default_rng(2).integers(0, 2**64, 5000, dtype="uint64")
    assert C._inside(small, others).mean() < 0.01
