"""Alignment of two tokenizers against a plain walk over both token lists."""

import collections
import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from wordtide.llm import alignment

TEXTS = [
    "The café's naïve rules, unbelievable!",
    None,
    "",
    " ",
    "  two  blanks\n\nand\ta tab ",
    "日本語のテキスト 🙂🙃 x",
    "a <|endoftext|> b </s> <s> <unk> <0x41>",
    "a ▁ mark in the text",
    "ab\x00cd\u0007",
    "repeated words " * 700,
    "x" * 5000,
    "The café's naïve rules, unbelievable!",
]


def tokens_of(text, one, two, spec):
    if not text:
        return [], []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    whole = (" " + text).encode()
    same = b"".join(spec.a_bytes[i] for i in a) == whole == b"".join(spec.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def ranges(ids, texts):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(texts[i]), i))
        at += len(texts[i])
    return out


def plain(rows):
    """Every row's columns by loops over all pairs of tokens near each other."""
    spec = alignment.read_tokenizers()
    one = Tokenizer.from_file(alignment.BYTE_MODEL)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    made = []
    for key, text in rows:
        a, b = (ranges(ids, texts) for ids, texts in zip(tokens_of(text, one, two, spec), (spec.a_bytes, spec.b_bytes)))
        links, low = [], 0
        for start, end, i in a:
            while b[low][1] <= start:
                low += 1
            at = low
            while at < len(b) and b[at][0] < end:
                links.append((i, b[at][2]))
                at += 1
        parts, p, q = [], 0, 0
        for cut in sorted({t[1] for t in a} & {t[1] for t in b}):
            sides = [[], []]
            while p < len(a) and a[p][1] <= cut:
                sides[0].append(str(a[p][2]))
                p += 1
            while q < len(b) and b[q][1] <= cut:
                sides[1].append(str(b[q][2]))
                q += 1
            parts.append("|".join(",".join(s) for s in sides))
        made.append((key, len(a), len(b), parts, links))
    counts = collections.Counter(pair for *_, links in made for pair in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (key, a, b, len(parts), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
        for key, a, b, parts, links in made
    ]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, row long, n_a string")


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


@pytest.mark.parametrize("sent", [1 << 20, 40, 0])
def test_alignment_equals_plain_walk(spark, sent):
    rows = [*enumerate(TEXTS), (None, TEXTS[0]), (3, "The other text of an id")]
    got = found(alignment.align(frame(spark, rows), sent_pairs=sent))
    assert got == sorted(plain(rows), key=str)


def test_alignment_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 60)
    monkeypatch.setattr(alignment, "SLICE_TOKENS", 50)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 4)
    rows = list(enumerate(TEXTS))
    assert found(alignment.align(frame(spark, rows))) == sorted(plain(rows), key=str)


def test_documents_of_the_given_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(alignment.align(docs)) == sorted(plain(rows), key=str)


def test_overlaps_carry_places_and_bytes(spark):
    spec = alignment.read_tokenizers()
    rows = [(7, TEXTS[0]), (8, None), (9, TEXTS[5])]
    links = alignment.overlaps(alignment.encode(frame(spark, rows))).collect()
    assert {r["id"] for r in links} == {7, 9}
    for r in links:
        assert r["start"] < r["end"]
    whole = {7: (" " + TEXTS[0]).encode(), 9: (" " + TEXTS[5]).encode()}
    for key, data in whole.items():
        covered = sorted((r["start"], r["end"]) for r in links if r["id"] == key)
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        one = [r for r in links if r["id"] == key and r["a_place"] == 0]
        assert data.startswith(spec.a_bytes[one[0]["a_id"]])


def test_empty_table(spark):
    assert alignment.align(frame(spark, []).limit(0)).count() == 0


def test_fast_encoder_equals_the_model(spark, tiny):
    spec = alignment.read_tokenizers()
    assert spec.ranked
    encoder = alignment._Encoder(spec)
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [t for t in TEXTS if t]
    texts += ["a  b c d' s 's don't x1 2y é f ¡Hola! où est l'été — «ça»", "Ünï ə ́a z", "a " * 50, "\x85\xa0 \x1c\x1d ªº²¼ \u01c0"]
    texts += ["".join(map(chr, range(0x250))), "\r\n" * 9 + "  x   " + "aaaaaaa" * 30]
    for text in texts:
        assert encoder.first(" " + text).tolist() == encoder.by_model(" " + text)


def test_bytes_that_are_no_utf8_have_no_tokens(spark):
    rows = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text union all select 2L, 'a b'")
    got = found(alignment.align(rows))
    assert got[0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[1][1] > 0
