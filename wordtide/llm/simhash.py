"""SimHash near-dedup by vantage-point trees.

The 64 bits of a fingerprint fall into as many blocks as there are trees. Two fingerprints that
differ in at most `errors` bits differ in at most errors // trees of them in some block, the radius
of a search. A tree divides the values of its block by their Hamming distance from vantage points;
its leaves are shards. By the triangle inequality a value can only have neighbours on the far side
of a cut if its own distance lies within the radius of it: a fingerprint is sent to the shard that it
belongs to and to the shards whose boundaries its radius overlaps, of two such shards to one only.
Pairs are decided on all 64 bits.

The trees are fitted on a bounded sample; all fingerprints are placed by them. Equal fingerprints
are one class. Classes are first linked to sampled ones in their shard; classes with a common
component need not meet any more, so a large group of near copies fills shards of its own, which
only others visit. Shards are cut into parts of bounded size, and so are their visitors.

The number of shards is fixed up to LEAVES * PART_ROWS classes, so a fingerprint is sent to as many
shards on average however many there are. The task of a part divides its members by a tree of its
own, with small leaves, and leads members and visitors through it. Beyond that number shards grow with the classes.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.llm.minhash import components
from wordtide.operators.blocks import attach_small, fits_broadcast
from wordtide.operators.streams import whole_groups
from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 4
SEED = 42
ERRORS = 4
TREES = 3
# Fingerprints that the trees are fitted on, about, by a hash, and how many of them a leaf keeps at least.
SAMPLE = 1 << 16
LEAST_SAMPLED = 8
# Leaves of a tree, about. Fingerprints of a part of a shard, and visitors that a task holds against a part.
LEAVES = 96
PART_ROWS = 1 << 18
SLICE_ROWS = 1 << 20
# Inside a task: members of a leaf at least, rows led through the tree at once, members of a label that skip each other.
LEAST_MEMBERS = 48
LED_ROWS = 1 << 15
COMMON = 1024
VANTAGES = 12  # tried for a cut
STEP_BYTES = 1 << 22

PLACED = "tree int, leaf int, home boolean, rep long, fp long, label long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp, the 64 bits as a long, of every row.

    A-Z become a-z, words end at blanks and tabs to carriage returns. Shingles of so many words,
    joined by blanks, repeats included, have an XXH64 each; with fewer words the whole sequence is
    the one shingle. A bit is set if over half of the hashes have it; it is never without words.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(_fingerprints(words), "id long, fp long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    errors: int = ERRORS,
    trees: int = TREES,
) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id of every row.

    Rows are linked if their fingerprints differ in at most `errors` bits; component_id is the
    smallest id that links reach. Null and empty texts, or texts without words, have fingerprint
    zero and are linked like any others. A row without id takes its class's component, or null.
    Ids are taken to be unique; repeated rows of an id and text all stay and change nothing. An
    empty table gives no rows; other columns do not matter.
    """
    base = cut_lineage(fingerprints(docs, id_col, text, words), "fingerprints")
    classes = cut_lineage(base.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")
    labels = components(links(classes, errors, trees))
    named = classes.join(labels, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return base.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def links(classes: DataFrame, errors: int = ERRORS, trees: int = TREES) -> DataFrame:
    """a, b: links between classes (fp, rep) of different fingerprints, as many as their components take."""
    count = classes.count()
    if count < 2:
        return classes.selectExpr("rep as a", "rep as b").where("false")
    share = F.lit(int((1 << 30) * min(1.0, SAMPLE / count)))
    drawn = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).toArrow()
    forest = classes.sparkSession.sparkContext.broadcast(_forest(drawn, errors, trees, count))
    near = cut_lineage(classes.mapInArrow(_near_sampled(forest, errors), "a long, b long"), "sampled")
    labels = components(near)
    labelled = classes.join(labels, "rep", "left").select("rep", "fp", "label")
    placed = cut_lineage(labelled.mapInArrow(_place(forest), PLACED), "placed")
    dealt = _deal(placed)
    keys = ["key", "visitor"]
    tasks = dealt.repartition("key").sortWithinPartitions(*keys)
    found = tasks.mapInArrow(_solve(forest, errors), "a long, b long")
    return near.unionByName(cut_lineage(found, "links"))


def _deal(placed: DataFrame) -> DataFrame:
    """key, visitor, first, tree, rep, fp, label: which rows meet in which task.

    A label with many members in a shard has parts of its own there (`own`), the others share the
    rest. A row of the rest visits the later parts of the rest and all owned ones; a row of an
    owned part visits those owned by larger labels; a row from another shard visits all. Nobody visits
    what its own label owns. Part and visitors are dealt to slices, each with all of the part's rows.
    """
    shard = ["tree", "leaf"]
    counts = cut_lineage(placed.groupBy(*shard, "label", "home").agg(F.count("*").alias("n")), "counts")
    members = counts.where("home")
    owned = cut_lineage(
        members.where(f"label is not null and n >= {PART_ROWS}").select(*shard, "label", F.col("n").alias("owned")), "owned"
    )
    all_rows = counts.groupBy(*shard).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("home"), F.col("n"))).alias("_home"))
    same = counts.groupBy(*shard, "label").agg(F.sum("n").alias("_same"))
    taken = owned.groupBy(*shard).agg(F.sum("owned").alias("_taken"))
    rest = all_rows.join(taken, shard, "left").select(
        *shard, F.lit(None).cast("long").alias("own"), (F.col("_home") - F.coalesce("_taken", F.lit(0))).alias("n"), F.col("_all").alias("visitors")
    )
    own = owned.join(same, [*shard, "label"]).join(all_rows, shard).select(
        *shard, F.col("label").alias("own"), F.col("owned").alias("n"), (F.col("_all") - F.col("_same")).alias("visitors")
    )
    shards = rest.unionByName(own).where("n > 0").select(
        *shard, "own", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.col("visitors") / SLICE_ROWS)).cast("int").alias("slices"),
    )
    # Rows whose label owns parts of their shard; a table of few rows a shard.
    plain = placed.withColumn("_label", F.coalesce("label", F.lit(0)))
    known = owned.select(*shard, F.col("label").alias("_label")).withColumn("_owns", F.lit(True))
    if fits_broadcast(known):
        marked = plain.join(F.broadcast(known), [*shard, "_label"], "left")
    else:
        marked = plain.join(known, [*shard, "_label"], "left")
    owns = F.coalesce(F.col("_owns") & F.col("label").isNotNull(), F.lit(False))
    marked = marked.select(*shard, "home", "rep", "fp", "label", owns.alias("owns"))
    met = attach_small(marked, shards, shard, ["rep"])
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    resident = F.col("home") & F.when(F.col("owns"), F.col("own").eqNullSafe(F.col("label"))).otherwise(F.col("own").isNull())
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    later = F.when(mine + 1 < F.col("parts"), F.sequence(mine + 1, F.col("parts") - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    visits = (
        F.when(F.col("own").eqNullSafe(F.col("label")) & F.col("own").isNotNull(), none)
        .when(~F.col("home"), every)
        .when(F.col("owns"), F.when(F.col("own") > F.col("label"), every).otherwise(none))
        .when(F.col("own").isNull(), later)
        .otherwise(every)
    )
    slices = F.sequence(F.lit(0), F.col("slices") - 1)
    stays = met.where(resident).select("*", mine.alias("part"), F.explode(slices).alias("slice"), F.lit(False).alias("visitor"))
    comes = met.select("*", F.explode(visits).alias("part")).select(
        "*", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slices")).cast("int").alias("slice"), F.lit(True).alias("visitor")
    )
    return stays.unionByName(comes).select(
        F.xxhash64("tree", "leaf", "own", "part", "slice").alias("key"),
        "visitor",
        (F.col("slice") == 0).alias("first"),
        "tree",
        "rep",
        "fp",
        "label",
    )


def _blocks(trees):
    """Masks of the bits of each tree."""
    import numpy as np

    cuts = [64 * i // trees for i in range(trees + 1)]
    return [np.uint64((1 << high) - (1 << low)) for low, high in zip(cuts, cuts[1:])]


class _Tree:
    """Nodes as arrays: vantage point, cut, children; a leaf has its number and the sampled rows in it."""

    def __init__(self, values, radius, least):
        import numpy as np

        self.radius = radius
        self.vantage, self.cut, self.children, self.leaf, self.sampled = [], [], [], [], []
        draw = np.random.default_rng(SEED)
        open_nodes = [(None, 0, np.arange(len(values)))]
        while open_nodes:
            parent, side, rows = open_nodes.pop()
            node = len(self.leaf)
            if parent is not None:
                self.children[parent][side] = node
            found = self._best_cut(values[rows], draw) if len(rows) > 2 * least else None
            self.children.append([-1, -1])
            if found is None:
                self.vantage.append(0)
                self.cut.append(0)
                self.leaf.append(len(self.sampled))
                self.sampled.append(rows)
                continue
            vantage, cut = found
            near = np.bitwise_count(values[rows] ^ vantage) <= cut
            self.vantage.append(int(vantage))
            self.cut.append(int(cut))
            self.leaf.append(-1)
            open_nodes += [(node, 1, rows[~near]), (node, 0, rows[near])]
        self.vantage = np.array(self.vantage, dtype="uint64")
        self.cut, self.leaf = np.array(self.cut), np.array(self.leaf)
        self.children = np.array(self.children)

    def _best_cut(self, values, draw):
        """Vantage point and cut with the least work: members of each side times those that visit it."""
        import numpy as np

        best, found = 0.95 * len(values) ** 2, None
        for vantage in values[draw.permutation(len(values))[:VANTAGES]]:
            upto = np.cumsum(np.bincount(np.bitwise_count(values ^ vantage), minlength=65)).astype("float64")
            near, far = upto[:64], len(values) - upto[:64]
            visit_near = upto[np.minimum(64, np.arange(64) + self.radius)]
            visit_far = len(values) - np.append(np.zeros(self.radius), upto)[:64]
            work = np.where((near > 0) & (far > 0), near * visit_near + far * visit_far, np.inf)
            if work.min() < best:
                best, found = work.min(), (vantage, int(work.argmin()))
        return found

    def visits(self, values):
        """Row and leaf of every visit, and each row's own leaf."""
        import numpy as np

        own = np.zeros(len(values), dtype="int64")
        row, node, home = np.arange(len(values)), np.zeros(len(values), dtype="int64"), np.ones(len(values), dtype=bool)
        rows, leaves = [], []
        while len(row):
            done = self.leaf[node] >= 0
            rows.append(row[done])
            leaves.append(self.leaf[node[done]])
            at_home = done & home
            own[row[at_home]] = self.leaf[node[at_home]]
            row, node, home = row[~done], node[~done], home[~done]
            gap = np.bitwise_count(values[row] ^ self.vantage[node]).astype("int64")
            cut = self.cut[node]
            near, far = gap <= cut + self.radius, gap > cut - self.radius
            left = gap <= cut
            row, node, home = (
                np.concatenate([row[near], row[far]]),
                np.concatenate([self.children[node[near], 0], self.children[node[far], 1]]),
                np.concatenate([home[near] & left[near], home[far] & ~left[far]]),
            )
        return np.concatenate(rows), np.concatenate(leaves), own


def _forest(drawn, errors, trees, count):
    """Trees over the sample's values in each block, with LEAVES leaves or, if more, leaves for about PART_ROWS of all rows."""
    import numpy as np

    fps = drawn.column("fp").to_numpy().view("uint64")
    reps = drawn.column("rep").to_numpy()
    least = max(LEAST_SAMPLED, int(len(fps) / max(LEAVES, count / PART_ROWS) / 2))
    masks = _blocks(trees)
    return {
        "trees": [_Tree(fps & mask, errors // trees, least) for mask in masks],
        "masks": masks,
        "fps": np.array(fps),
        "reps": np.array(reps),
    }


def _rows(batch):
    import numpy as np

    names = batch.schema.names
    return (np.asarray(batch.column(names.index(c)).to_numpy(zero_copy_only=False)) for c in ("rep", "fp"))


def _near_sampled(forest, errors):
    """Links of rows to the first sampled row of their own leaf that is near, per tree."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = forest.value
        for batch in batches:
            rep, fp = _rows(batch)
            fp = fp.view("uint64")
            pairs = []
            for tree, mask in zip(held["trees"], held["masks"]):
                own = tree.visits(fp & mask)[2]
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(len(tree.sampled) + 1))
                for leaf, sampled in enumerate(tree.sampled):
                    rows = order[ends[leaf] : ends[leaf + 1]]
                    if not len(rows) or not len(sampled):
                        continue
                    for at in range(0, len(rows), 4096):
                        part = rows[at : at + 4096]
                        near = np.bitwise_count(fp[part][:, None] ^ held["fps"][sampled][None, :]) <= errors
                        near &= rep[part][:, None] != held["reps"][sampled][None, :]
                        hit = np.flatnonzero(near.any(axis=1))
                        pairs.append((rep[part[hit]], held["reps"][sampled[near[hit].argmax(axis=1)]]))
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.array([], "int64")
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.array([], "int64")
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _place(forest):
    """Every row at its own leaf and at the later leaves that its radius overlaps, for each tree."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = forest.value
        for batch in batches:
            rep, fp = _rows(batch)
            label = batch.column(batch.schema.names.index("label"))
            for number, (tree, mask) in enumerate(zip(held["trees"], held["masks"])):
                row, leaf, own = tree.visits(fp.view("uint64") & mask)
                keep = leaf >= own[row]
                row, leaf = row[keep], leaf[keep]
                for at in range(0, len(row), 1 << 16):
                    r, to = row[at : at + (1 << 16)], leaf[at : at + (1 << 16)]
                    columns = [
                        pa.array(np.full(len(r), number, dtype="int32")),
                        pa.array(to.astype("int32")),
                        pa.array(to == own[r]),
                        pa.array(rep[r]),
                        pa.array(fp[r]),
                        label.take(pa.array(r)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "home", "rep", "fp", "label"])

    return run


def _solve(forest, errors):
    """Links of a part among its rows, in its first slice, and with the visitors of each slice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        masks = forest.value["masks"]
        radius = errors // len(masks)

        def near(one, two, rows, others):
            """Places in both of near rows."""
            step = max(1, (1 << 20) // max(1, len(others)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                x, y = np.nonzero(np.bitwise_count(one["fp"][part][:, None] ^ two["fp"][others][None, :]) <= errors)
                yield part[x], others[y]

        def common_labels(members, held):
            """Labels of many rows of a leaf, each with the leaf's other rows."""
            found, counts = np.unique(members["label"][held][members["has"][held]], return_counts=True)
            return [(x, held[~members["has"][held] | (members["label"][held] != x)]) for x in found[counts >= COMMON]]

        def between(one, two, leaves, mask, tree):
            """Places in both of near rows that share a leaf; rows of a common label meet those without it only."""
            common = {n: common_labels(two, held) for n, held in enumerate(leaves) if len(held) >= COMMON}
            for start in range(0, len(one["fp"]), LED_ROWS):
                row, leaf, _ = tree.visits(one["fp"][start : start + LED_ROWS] & mask)
                order = np.argsort(leaf, kind="stable")
                row, ends = row[order] + start, np.searchsorted(leaf[order], np.arange(len(leaves) + 1))
                for number in np.flatnonzero(np.diff(ends)):
                    rows = row[ends[number] : ends[number + 1]]
                    for label, others in common.get(number, ()):
                        theirs = one["has"][rows] & (one["label"][rows] == label)
                        yield from near(one, two, rows[theirs], others)
                        rows = rows[~theirs]
                    yield from near(one, two, rows, leaves[number])

        def links(one, two, fine, tree):
            for x, y in between(one, two, fine.sampled, masks[tree], fine):
                # The rows of a label are linked to it already, so its link stands for theirs.
                a, b = one["to"][x], two["to"][y]
                gap = one["fp"][x] ^ two["fp"][y]
                keep = a != b
                for mask in masks[:tree]:  # such a pair is found in an earlier tree
                    keep &= np.bitwise_count(gap & mask) > radius
                if keep.any():
                    both = np.unique(np.sort(np.stack([a[keep], b[keep]]), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for table, ends in whole_groups(batches, ["key"]):
            for low, high in zip([0, *ends[:-1]], ends):
                group = table.slice(low, high - low)
                visitor = group.column("visitor").to_numpy()
                label = group.column("label").combine_chunks()
                columns = {
                    "rep": group.column("rep").to_numpy(),
                    "fp": group.column("fp").to_numpy().view("uint64"),
                    "has": label.is_valid().to_numpy(zero_copy_only=False),
                    "label": label.fill_null(0).to_numpy(),
                }
                columns["to"] = np.where(columns["has"], columns["label"], columns["rep"])
                cut = int(np.searchsorted(visitor, True))
                if not cut:
                    continue
                members = {k: v[:cut] for k, v in columns.items()}
                guests = {k: v[cut:] for k, v in columns.items()}
                tree = group.column("tree")[0].as_py()
                fine = _Tree(members["fp"] & masks[tree], radius, LEAST_MEMBERS)
                if group.column("first")[0].as_py() and not (members["has"].all() and (members["label"] == members["label"][0]).all()):
                    yield from links(members, members, fine, tree)
                if len(guests["rep"]):
                    yield from links(guests, members, fine, tree)

    return run


def _fingerprints(words):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                found = [fingerprint(t.as_py(), words) for t in texts.slice(at, 1000)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 1000), pa.array(np.array(found, dtype="uint64").view("int64"))], ["id", "fp"]
                )

    return run


def fingerprint(data, words: int = WORDS) -> int:
    """Of UTF-8 bytes, or None; long texts are hashed piece by piece."""
    import re

    import numpy as np

    ones, total, held = np.zeros(64, dtype="int64"), 0, []
    data, at = (data or b"").lower(), 0
    while at < len(data):
        cut = len(data)
        if cut - at > STEP_BYTES:
            blank = re.compile(rb"[\x20\x09-\x0d]").search(data, at + STEP_BYTES)
            cut = blank.start() if blank else cut
        held += data[at:cut].split()  # at the same bytes as the pattern above
        at = cut
        if len(held) >= words:
            n, bits = _bits(held, words)
            ones, total, held = ones + bits, total + n, held[len(held) - words + 1 :] if words > 1 else []
    if not total and held:
        total, ones = _bits(held, len(held))
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("uint64")[0])


def _bits(held, words):
    """Number of shingles and, for each bit, how many of their hashes have it."""
    import numpy as np
    import xxhash

    joined = b" ".join(held)
    ends = np.cumsum([len(w) + 1 for w in held]) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(held) - words + 1].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype="uint64")
    ones = np.zeros(64, dtype="int64")
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view("uint8").reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype="uint16")
    return len(hashes), ones
