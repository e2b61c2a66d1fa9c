"""MinHash near-dedup by a multi-index Hamming join.

Signatures of b-bit MinHash values are cut into chunks. By the pigeonhole principle two
signatures at a distance of at most t agree in some chunk up to t // chunks errors; with
t // 2 + 1 chunks that is one error at most, and the errors are enumerated: a key is a
chunk without one of its values. So all pairs within distance t share a key. t follows
from the similarity threshold and the accepted chance of missing a pair right at it.

Texts with equal sets are one class and stand for themselves once. Within a bucket of
equal keys, members are first held against its first one and the one before them. Near
pairs make families, confirmed ones components; afterwards only pairs of different
components are looked at, block by block inside the families, and those of different
families in a bucket. So a group of copies costs about its size as far as links join it, and
pairs that fail are not moved. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.llm.shingles import _mix, shingle_sets, signatures
from wordtide.operators.blocks import attach_small, fits_broadcast
from wordtide.operators.streams import whole_groups
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACES = 64
MISS = 1e-6
BLOCK_ROWS = 512
SET_BLOCK = 128
SLOTS = 64  # a power of two, no less than the places of a signature


def most_errors(percent: int, places: int = PLACES, miss: float = MISS) -> int:
    """The distance that a pair at the threshold exceeds with a chance of at most `miss`."""
    from math import comb

    p, below = 1 - percent / 100, 0.0
    for t in range(places + 1):
        below += comb(places, t) * p**t * (1 - p) ** (places - t)
        if 1 - below <= miss:
            return t
    return places


def chunk_edges(places: int, errors: int) -> list[tuple[int, int]]:
    """Chunks of nearly equal length, enough of them that one has one error at most."""
    chunks = min(places, errors // 2 + 1)
    cuts = [places * i // chunks for i in range(chunks + 1)]
    return list(zip(cuts, cuts[1:]))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = 3,
    percent: int = 85,
    places: int = PLACES,
    miss: float = MISS,
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of shingles;
    component_id is the smallest id that links reach, kept tells whether the row has it. Rows
    without words (empty or null text) have n_shingles 0 and are components of their own. A row
    without id takes its class's component, or null, and is not kept. Repeated rows of an id get
    the same component and are all kept together. An empty table gives no rows.
    """
    kind = "long"
    schema = "id long, n long, set_key binary, sig binary"
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text).alias("text"))
    base = cut_lineage(rows.mapInArrow(_describe(words, places), schema), "sets")
    reps = cut_lineage(
        base.where("n > 0 and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        "classes",
    )
    labels = _components_of(rows, reps, words, percent, places, miss)
    classes = reps.join(labels, "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component_id")
    )
    # Left rows of a large class meet a single right row: a join that can be split.
    joined = base.select("id", "n", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _components_of(rows, reps, words, percent, places, miss):
    """rep, label of the classes that are linked to others."""
    errors = most_errors(percent, places, miss)
    edges = chunk_edges(places, errors)
    keys = reps.select("rep", "sig").mapInArrow(_keys(edges), "key long, rep long")
    placed = keys.repartition("key").sortWithinPartitions("key", "rep")
    buckets = cut_lineage(placed.mapInArrow(_buckets, "key long, rep long, low long, before long"), "buckets")
    signed = reps.select("rep", "n", "sig")
    sets = _sets_of(rows, buckets.select("rep").distinct(), words)

    # Members of a bucket are held against its smallest id and against the one before them.
    first = (
        buckets.select("rep", F.explode(F.array_distinct(F.array("low", "before"))).alias("head"))
        .where("rep <> head")
        .select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))
        .distinct()
    )
    near = cut_lineage(_near_pairs(first, signed, percent, errors), "near")
    family = components(near).withColumnRenamed("label", "family")
    links = cut_lineage(_confirmed(near, family, sets, percent), "links")

    # Pairs that links have not yet joined: within a family of near pairs, and then across families.
    inner = _within_families(family, components(links), signed, sets, percent, errors)
    inner = cut_lineage(inner, "inner")
    named = cut_lineage(
        buckets.select("key", "rep").join(family, "rep", "left").withColumn("family", F.coalesce("family", "rep")),
        "members",
    )
    counted = named.groupBy("key").agg(
        F.min("family").alias("_l"), F.max("family").alias("_m"), F.count("*").alias("size")
    )
    mixed = cut_lineage(counted.where("_l <> _m").select("key", "size"), "mixed")
    left = named.join(mixed, "key").join(signed, "rep").withColumnRenamed("family", "label")
    rest = cut_lineage(_pairs_in_buckets(left, edges, percent, errors), "rest")
    more = _confirmed(rest, components(rest).withColumnRenamed("label", "family"), sets, percent)
    return components(links.unionByName(inner).unionByName(cut_lineage(more, "more")))


def _near_pairs(pairs, signed, percent, errors):
    """Pairs whose sizes and signatures allow a link."""
    of = lambda side: signed.select(
        F.col("rep").alias(side), F.col("n").alias(f"_n{side}"), F.col("sig").alias(f"_s{side}")
    )
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    size = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent
    return joined.where(size).mapInArrow(_close(errors), "a long, b long")


def _sets_of(rows, wanted, words):
    """rep and set of the wanted texts, from the texts once more; only ids are moved if they are few."""
    wanted = cut_lineage(wanted.select(F.col("rep").alias("id")), "wanted")
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "id", "left_semi")
    return cut_lineage(texts.mapInArrow(_sets(words), "rep long, items binary"), "items").dropDuplicates(["rep"])


def _confirmed(pairs, family, sets, percent):
    """The pairs whose full sets are similar enough.

    Texts are dealt to blocks, those of a component of candidates to as few as hold them; a task
    gets the sets of two blocks and the pairs between them, so a set is moved once for each
    block that it meets, not for each pair.
    """
    sized = family.groupBy("family").agg(_blocks_of("_blocks"))
    bins = max(1, -(-family.count() // SET_BLOCK))
    place = F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    # A large family is one key: its rows meet its single row of `sized` by size, not by key.
    met = attach_small(family, sized, ["family"], ["rep"])
    dealt = cut_lineage(met.select("rep", F.pmod(place, F.lit(bins)).alias("block")), "dealt")
    of = lambda side: dealt.select(F.col("rep").alias(side), F.col("block").alias(f"_{side}"))
    placed = cut_lineage(
        pairs.join(of("a"), "a").join(of("b"), "b").select(
            "a", "b", F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y")
        ),
        "placed",
    )
    meets = placed.select("x", "y").distinct().select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sent = sets.join(dealt, "rep").join(meets, "block").select("x", "y", "rep", "items")
    return (
        placed.groupBy("x", "y")
        .cogroup(sent.withColumnsRenamed({"x": "_x", "y": "_y"}).groupBy("_x", "_y"))
        .applyInArrow(_similar(percent), "a long, b long")
    )


def _blocks_of(name):
    """How many blocks a group of sets fills."""
    return F.ceil(F.count("*") / SET_BLOCK).cast("int").alias(name)


def _within_families(family, labels, signed, sets, percent, errors):
    """Links between components of a family, as many as it takes to join them.

    Large components fill blocks of their own, small ones share blocks. Two blocks of the same
    component need not meet; all others do, and a task looks at the pairs of two blocks.
    Families of a single block share tasks.
    """
    named = family.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    state = named.groupBy("family").agg(F.min("label").alias("_l"), F.max("label").alias("_m"), F.count("*").alias("_f"))
    mixed = state.where("_l <> _m").select("family", "_f")
    sizes = named.groupBy("family", "label").agg(F.count("*").alias("_c"))
    large = F.col("_c") >= SET_BLOCK
    met = attach_small(attach_small(named, mixed, ["family"], ["rep"]), sizes, ["family", "label"], ["rep"])
    named = met.select(
        "rep", "family", "label", large.alias("large"), F.when(large, F.col("label")).otherwise(F.col("family")).alias("own"), "_f"
    )
    named = cut_lineage(named, "open")
    parts = named.groupBy("family", "large", "own").agg(_blocks_of("_p"))
    bins = max(1, -(-named.where(F.col("_f") <= SET_BLOCK).count() // SET_BLOCK))
    place = F.xxhash64("family", "large", "own", F.pmod(F.xxhash64("rep"), F.col("_p")))
    block = F.when(F.col("_f") <= SET_BLOCK, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(place)
    met = attach_small(named, parts, ["family", "large", "own"], ["rep"])
    dealt = cut_lineage(met.select("rep", "family", "label", "large", "own", "_f", block.alias("block")), "dealt")
    alone = dealt.where(F.col("_f") <= SET_BLOCK).select(F.col("block").alias("x"), F.col("block").alias("y")).distinct()
    of = lambda side: dealt.where(F.col("_f") > SET_BLOCK).select(
        "family", F.col("block").alias(side), F.col("large").alias(f"_g{side}"), F.col("own").alias(f"_o{side}")
    ).distinct()
    same = F.col("_gx") & F.col("_gy") & (F.col("_ox") == F.col("_oy"))
    meets = of("x").join(of("y"), "family").where((F.col("x") <= F.col("y")) & ~same).select("x", "y").unionByName(alone)
    each = cut_lineage(meets, "meets").withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    sent = dealt.select("rep", "family", "label", "block").join(each, "block").join(signed, "rep").join(sets, "rep")
    columns = ["x", "y", "rep", "family", "label", "block", "n", "sig", "items"]
    return sent.select(*columns).groupBy("x", "y").applyInArrow(_join_blocks(percent, errors), "a long, b long")


def _pairs_in_buckets(left, edges, percent, errors):
    """Pairs of different families within each bucket, by blocks; each pair in one of its buckets only."""
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    cut = (
        left.withColumn("_blocks", blocks)
        .withColumn("own", own)
        .withColumn("_other", other)
        .withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")})
        .drop("_blocks", "_other", "size")
    )
    keys = ["key", "i", "j"]
    placed = cut.select(*keys, "own", "rep", "label", "n", "sig").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(_bucket_pairs(edges, percent, errors), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep, label: the smallest id of the component for every id in links (a, b).

    Each round every id moves to the smallest of its neighbours and itself, twice over, and
    links are rewritten to the new ids; the number of links shrinks at least by half a round or so.
    Links are moved, components are never gathered.
    """
    steps = []
    edges = cut_lineage(links.select("a", "b").where("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("to"))
        least = cut_lineage(least, "least")
        jump = least.select(F.col("rep").alias("to"), F.col("to").alias("far"))
        moved = cut_lineage(least.join(jump, "to").select("rep", F.col("far").alias("to")), "moved")
        steps.append(moved)
        of = lambda side, m=moved: m.select(F.col("rep").alias(side), F.col("to").alias(f"_{side}"))
        edges = cut_lineage(
            edges.join(of("a"), "a").join(of("b"), "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .where("a <> b").distinct(),
            "edges",
        )
    if not steps:
        return edges.select(F.col("a").alias("rep"), F.col("b").alias("label"))
    found = steps[0].withColumnRenamed("to", "label")
    for step in steps[1:]:
        after = step.select(F.col("rep").alias("label"), F.col("to").alias("_to"))
        found = found.join(after, "label", "left").select("rep", F.coalesce("_to", "label").alias("label"))
    return cut_lineage(found, "labels")


def _describe(words, places):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, keys, sigs, held, weight = [], [], [], [], 0

                def flush(held, sigs=sigs):
                    sigs += [s.tobytes() for s in signatures(held, places)]

                for found in shingle_sets((t.as_py() for t in part.column(1)), words):
                    sizes.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    held.append(found)
                    weight += len(found)
                    if weight > 500_000:
                        flush(held)
                        held, weight = [], 0
                flush(held)
                empty = np.array(sizes) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, "int64"),
                        pa.array(keys, pa.binary(), mask=empty),
                        pa.array(sigs, pa.binary(), mask=empty),
                    ],
                    ["id", "n", "set_key", "sig"],
                )

    return run


def _matrix(column):
    """Binary signatures as rows of 16-bit values."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype="uint16").reshape(len(column), -1)


def _keys(edges):
    """For every chunk and every value left out of it, a hash of the others; the lowest bits name the place left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        draw = np.random.default_rng(7)
        places = edges[-1][1]
        odd = draw.integers(0, 2**63, places, dtype="uint64") * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                terms = _mix((_matrix(part.column(1)).astype("uint64") + np.uint64(1)) * odd)
                keys = []
                for low, high in edges:
                    whole = terms[:, low:high].sum(axis=1, dtype="uint64")
                    for out in range(low, high):
                        own = (whole - terms[:, out]) & ~np.uint64(SLOTS - 1)
                        keys.append(own | np.uint64(out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view("int64")), pa.array(np.tile(np.asarray(part.column(0)), len(keys)))],
                    ["key", "rep"],
                )

    return run


def _buckets(batches):
    """Of rows sorted by key and rep those that share their key, with its first rep and the rep before; keeps one row."""
    import numpy as np
    import pyarrow as pa

    held = None

    def rows(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "low", "before"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = (np.asarray(batch.column(c)) for c in (0, 1))
        if held is not None:
            key, rep = np.append(held[0], key), np.append(held[1], rep)
        same = key[1:] == key[:-1]
        starts = np.append(True, ~same)
        firsts = rep[starts]
        before = np.where(starts, rep, np.append(rep[:1], rep[:-1]))
        if held is not None:
            firsts[0], before[0] = held[2], held[3]
        low = firsts[np.cumsum(starts) - 1]
        shared = np.append(held[4] if held is not None else False, same)
        keep = np.flatnonzero((shared[:-1] | same))
        if len(keep):
            yield rows([c[keep] for c in (key, rep, low, before)])
        held = (key[-1:], rep[-1:], low[-1], before[-1], bool(shared[-1]))
    if held is not None and held[4]:
        yield rows([held[0], held[1], np.array([held[2]]), np.array([held[3]])])


def _close(errors):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                gap = _matrix(batch.column(names.index("_sa"))) != _matrix(batch.column(names.index("_sb")))
                keep = pa.array(np.flatnonzero(gap.sum(axis=1) <= errors))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(c)).take(keep) for c in ("a", "b")], ["a", "b"]
                )

    return run


def _sets(words):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = shingle_sets((t.as_py() for t in part.column(1)), words)
                items = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), items], ["rep", "items"])

    return run


def _alike(one, two, percent):
    """Whether two sorted sets are similar enough."""
    import numpy as np

    both = np.concatenate([one, two])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _similar(percent):
    def run(pairs, sets):
        import numpy as np
        import pyarrow as pa

        held = {}
        for rep, item in zip(sets.column("rep").to_pylist(), sets.column("items")):
            held[rep] = np.frombuffer(item.as_py(), dtype="uint64")
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        take = pa.array([i for i, (x, y) in enumerate(zip(a, b)) if _alike(held[x], held[y], percent)], "int64")
        return pa.table({"a": pairs.column("a").take(take), "b": pairs.column("b").take(take)})

    return run


def _join_blocks(percent, errors):
    """Links that join components of a family across two blocks, or within one."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        across = key[0].as_py() != key[1].as_py()
        table = table.sort_by([("family", "ascending"), ("rep", "ascending")])
        column = lambda name: table.column(name).to_numpy()
        rep, family, block, n = (column(c) for c in ("rep", "family", "block", "n"))
        label, sig, items = column("label").copy(), _matrix(table.column("sig")), table.column("items")
        held, out = {}, []
        ends = np.searchsorted(family, family, side="right")

        def items_of(i):
            if i not in held:
                held[i] = np.frombuffer(items[i].as_py(), dtype="uint64")
            return held[i]

        for i in range(len(rep)):
            to = np.arange(i + 1, ends[i])
            fit = (label[to] != label[i]) & (np.minimum(n[i], n[to]) * 100 >= np.maximum(n[i], n[to]) * percent)
            if across:
                fit &= block[to] != block[i]
            to = to[fit]
            if len(to):
                to = to[(sig[to] != sig[i]).sum(axis=1) <= errors]
            for j in to.tolist():
                if label[i] != label[j] and _alike(items_of(i), items_of(j), percent):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    label[label == label[j]] = label[i]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, "int64"), "b": pa.array(b, "int64")})

    return run


def _bucket_pairs(edges, percent, errors):
    """Rows come sorted by block of bucket; a row is held against those d places further on, for all rows at once."""

    def pairs(table, ends):
        import numpy as np

        column = lambda name: table.column(name).to_numpy()
        rep, label, n, own = (column(c) for c in ("rep", "label", "n", "own"))
        slot = column("key") % SLOTS
        across, sig = column("i") != column("j"), _matrix(table.column("sig"))
        group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for d in range(1, int(np.diff(ends, prepend=0).max())):
            x = np.flatnonzero(group[d:] == group[:-d])
            y = x + d
            fit = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            fit &= ~across[x] | (own[x] != own[y])
            x, y = x[fit], y[fit]
            gap = sig[x] != sig[y]
            near = gap.sum(axis=1) <= errors
            x, y, gap = x[near], y[near], gap[near]
            # A pair belongs to the first slot that it shares: there each pair is met once.
            first = np.full(len(x), -1)
            for low, high in edges:
                wrong = gap[:, low:high].sum(axis=1)
                where = low + gap[:, low:high].argmax(axis=1)  # the error, or the chunk's first place
                first = np.where((first < 0) & (wrong <= 1), where, first)
            here = first == slot[x]
            one, two = rep[x[here]], rep[y[here]]
            if len(one):
                yield np.minimum(one, two), np.maximum(one, two)

    def run(batches):
        import pyarrow as pa

        for table, ends in whole_groups(batches, ["key", "i", "j"]):
            for a, b in pairs(table, ends):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run
