"""SimHash near-duplicates against all pairs and a plain fingerprint."""

import random
import re

import numpy as np
import pytest
import xxhash

from wordtide.llm import simhash as S


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    n = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + n]).encode(), 42) for i in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, errors=4):
    """Smallest id reachable, from all pairs of different fingerprints."""
    fps = np.array([f for _, f in rows], dtype="uint64")
    ids = [i for i, _ in rows]
    label = np.arange(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= errors):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
    least = {}
    for i, g in zip(ids, label.tolist()):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, f"{f:016x}", least.get(g)) for (i, f), g in zip(rows, label.tolist())]


def found(df, columns=("doc_id", "fingerprint", "component_id")):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def classes_of(spark, fps):
    return spark.createDataFrame([(int(np.uint64(f).view("int64")), i) for i, f in enumerate(fps)], "fp long, rep long")


def linked(spark, fps, **how):
    labels = {r["rep"]: r["label"] for r in S.components(S.links(classes_of(spark, fps), **how)).collect()}
    return [labels.get(i, i) for i in range(len(fps))]


def expected(fps, errors=4):
    return [c for _, _, c in plain_components(list(enumerate(fps)), errors)]


def random_fps(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype="uint64")


def family(centre, n, bits, seed):
    """Fingerprints with a few of some bits of a centre turned."""
    draw = random.Random(seed)
    return [int(centre) ^ sum(1 << b for b in draw.sample(bits, draw.randint(1, 4))) for _ in range(n)]


def test_texts_of_all_kinds(spark):
    base = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing"
    texts = [base, base.upper(), base + ".", None, "", " \t\x0b", "one", "One", "one two three", "é è À\x1fb", "x " * 3000, "x " * 2999]
    rows = [(i, t, 0, "f") for i, t in enumerate(texts)] + [(None, base, 1, "g"), (None, "alone, without an id", 1, "g"), (0, base, 0, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep long, fp string")
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert found(S.near_duplicates(docs)) == sorted(want, key=str)


def test_documents_of_the_given_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert found(S.near_duplicates(docs)) == sorted(plain_components(rows), key=str)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["ab", "c", "defg", "h" * 30]) for _ in range(n)) for n in (0, 1, 3, 4, 50, 400)]
    monkeypatch.setattr(S, "STEP_BYTES", 10)
    assert [S.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, monkeypatch, seed):
    """Small leaves and parts: near pairs lie across cuts of every tree; chains reach far."""
    monkeypatch.setattr(S, "PART_ROWS", 40)
    monkeypatch.setattr(S, "SAMPLE", 300)
    draw = random.Random(seed)
    fps = list(map(int, random_fps(1500, seed)))
    for f in fps[:120]:
        fps.append(f ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6))))
    chain = fps[0]
    for _ in range(12):
        chain ^= sum(1 << b for b in draw.sample(range(64), 4))
        fps.append(chain)
    fps = sorted(set(fps), key=lambda f: xxhash.xxh64_intdigest(str(f)))
    want = expected(fps)
    assert len(set(want)) < len(fps) - 60
    assert linked(spark, fps) == want


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 50)
    monkeypatch.setattr(S, "SLICE_ROWS", 64)
    monkeypatch.setattr(S, "SAMPLE", 200)
    one, two = map(int, random_fps(2, 5))
    fps = {*family(one, 900, range(12), 1), *family(two, 700, range(20, 50), 2), *family(one ^ 0xFF00 << 40, 300, range(0, 64, 3), 3)}
    fps |= set(map(int, random_fps(300, 6)))
    fps = sorted(fps, key=lambda f: xxhash.xxh64_intdigest(str(f)))
    assert linked(spark, fps) == expected(fps)


@pytest.mark.parametrize("errors,trees", [(0, 1), (3, 1), (5, 2), (4, 5)])
def test_other_distances_and_numbers_of_trees(spark, monkeypatch, errors, trees):
    monkeypatch.setattr(S, "PART_ROWS", 30)
    fps = list(map(int, random_fps(300, 9)))
    draw = random.Random(3)
    fps += [f ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6))) for f in fps[:100]]
    fps = list(dict.fromkeys(fps))
    assert linked(spark, fps, errors=errors, trees=trees) == expected(fps, errors)


def test_shards_hold_a_small_part_of_the_rows(spark):
    """A value is sent to few of the leaves."""
    fps = random_fps(40_000, 7)
    import pyarrow as pa

    drawn = pa.table({"fp": fps[:20_000].view("int64"), "rep": np.arange(20_000)})
    forest = S._forest(drawn, 4, 3, 2_000_000)
    for tree, mask in zip(forest["trees"], forest["masks"]):
        row, leaf, own = tree.visits(fps & mask)
        assert len(tree.sampled) > 100
        later = (leaf >= own[row]).sum() / len(fps)
        assert later < 0.1 * len(tree.sampled)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    one = spark.createDataFrame([(4, None)], "doc_id long, text string")
    assert found(S.near_duplicates(one)) == [(4, "0" * 16, 4)]


def test_rows_dealt_grow_with_the_classes(spark, monkeypatch):
    """Five times the classes are sent to about five times as many places."""
    monkeypatch.setattr(S, "PART_ROWS", 1000)
    dealt, deal = [], S._deal
    monkeypatch.setattr(S, "_deal", lambda placed: dealt.append(deal(placed)) or dealt[-1])
    for n in (3_000, 15_000):
        S.links(classes_of(spark, random_fps(n, 11))).count()
    few, many = (d.count() for d in dealt)
    assert many < 6.5 * few


def test_large_labels_meet_others_inside_a_task(spark, monkeypatch):
    """Rows of a common label in a leaf skip each other, and one link stands for all with another label."""
    monkeypatch.setattr(S, "COMMON", 20)
    monkeypatch.setattr(S, "SAMPLE", 150)
    monkeypatch.setattr(S, "LED_ROWS", 100)
    one = int(random_fps(1, 12)[0])
    fps = {*family(one, 600, range(12), 1), *family(one ^ 0x3F << 30, 400, range(40, 52), 2), *map(int, random_fps(200, 13))}
    fps |= {f ^ 1 << 63 ^ 1 << 25 for f in list(fps)[:60]}
    fps = sorted(fps, key=lambda f: xxhash.xxh64_intdigest(str(f)))
    assert linked(spark, fps) == expected(fps)
