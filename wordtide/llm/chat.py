"""Chat formatting by schema fingerprints.

A record is JSON of any layout. Its fingerprint is a hash of its nested field paths; a
table of declarative mappings says for each fingerprint where the turns are. All turns
end up as rows (conversation, position, role, text), which a template turns into text.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The control strings of the template.
HEAD = "### "
COLON = ":\n"
END = "</turn>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    paths: the nested field paths it needs, as `paths_of` writes them; other fields may be there
    too. turns: for layouts with a fixed set of turns (role, path of the text) pairs, of which
    null texts are left out; for layouts with lists (path of the list, name of its role, name of
    its text) for each list, one after another; for layouts with a row per turn (path of the
    position, path of the role, path of the text).
    """

    name: str
    paths: tuple[str, ...]
    kind: str
    turns: tuple


def _lists(name: str, role: str, text: str, *lists: str) -> tuple[Mapping, ...]:
    """A layout of lists of turns, with texts as strings or as lists of parts."""
    turns = tuple((x, role, text) for x in lists)
    return tuple(
        Mapping(name + suffix, tuple(f"{x}[].{y}" for x in lists for y in (role, text + mark)), "list", turns)
        for suffix, mark in (("", ""), ("_of_parts", "[]"))
    )


# The first layout whose paths a record has is taken, so those that need more stand before those that need less.
LAYOUTS = (
    Mapping("turn_row", ("conv", "role", "text", "turn"), "row", ("turn", "role", "text")),
    *(
        Mapping(
            name,
            ("conversation", "index", content, "message.role"),
            "row",
            ("index", "message.role", "message.content"),
        )
        for name, content in (("turn_message", "message.content"), ("turn_message_of_parts", "message.content[]"))
    ),
    *_lists("messages", "role", "content", "messages"),
    *_lists("conversations", "from", "value", "conversations"),
    *_lists("prompt_messages", "role", "content", "prompt", "completion"),
    Mapping("prompt", ("completion", "prompt"), "fixed", (("user", "prompt"), (ASSISTANT, "completion"))),
    Mapping("response", ("prompt", "response"), "fixed", (("user", "prompt"), (ASSISTANT, "response"))),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        "fixed",
        (("system", "instruction"), ("user", "input"), (ASSISTANT, "output")),
    ),
    Mapping("short_instruction", ("instruction", "output"), "fixed", (("user", "instruction"), (ASSISTANT, "output"))),
    Mapping("question", ("answer", "question"), "fixed", (("user", "question"), (ASSISTANT, "answer"))),
    Mapping("no_prompt_messages", ("completion[].role", "prompt[0]"), "list", (("completion", "role", "content"),)),
    Mapping("no_messages", ("messages[0]",), "list", (("messages", "role", "content"),)),
    Mapping("no_conversations", ("conversations[0]",), "list", (("conversations", "from", "value"),)),
)
# Other names of the roles in public layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
NO_JSON, NO_LAYOUT, NO_TURNS = "no JSON", "unknown layout", "no turns"


def _fields(value: Column) -> Column:
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is(value: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind + "<"))


def paths_of(variant: Column) -> Column:
    """Sorted distinct nested field paths of a record, two levels deep; null if it is no JSON object.

    `a` is a field, `a.b` a field of an object, `a[].b` a field of the objects in a list, `a[]` a
    list of other values, `a[0]` an empty list, `a[].b[]` a list in each. Dots, brackets and
    backslashes in names are escaped, so no name looks like a path.
    """
    name = lambda e: F.regexp_replace(e["key"], r"([.\[\\])", r"\\$1")
    mark = lambda e: F.when(_is(e["value"], "ARRAY"), "[]").otherwise("")

    def below(value, prefix):
        inner = F.transform(_fields(value), lambda e: F.concat(prefix, F.lit("."), name(e), mark(e)))
        return F.when(F.size(inner) > 0, inner).otherwise(F.array(prefix))

    def paths(e):
        own, value = name(e), e["value"]
        items = _items(value)
        many = F.concat(own, F.lit("[]"))
        listed = F.array_distinct(F.flatten(F.transform(items, lambda i: below(i, many))))
        return (
            F.when(_is(value, "OBJECT"), below(value, own))
            .when(_is(value, "ARRAY") & (F.size(items) == 0), F.array(F.concat(own, F.lit("[0]"))))
            .when(_is(value, "ARRAY"), listed)
            .otherwise(F.array(own))
        )

    return F.sort_array(F.array_distinct(F.flatten(F.transform(_fields(variant), paths))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def layout_name(paths: Column, layouts: tuple[Mapping, ...] = LAYOUTS) -> Column:
    """The layout with the fingerprint of these paths, else the first one whose paths are all among them, else null."""
    literal = lambda m: F.array(*map(F.lit, sorted(m.paths)))
    exact = F.create_map(*[x for m in layouts for x in (fingerprint(literal(m)), F.lit(m.name))])
    each = F.array(*[F.struct(F.lit(m.name).alias("name"), literal(m).alias("paths")) for m in layouts])
    held = F.filter(each, lambda m: F.size(F.array_except(m["paths"], paths)) == 0)
    return F.coalesce(exact[fingerprint(paths)], F.get(held, F.lit(0))["name"])


def _sources(mapping: Mapping) -> Column:
    """The mapping as an array of structs: where its items are, and which of their fields hold role, text and position."""
    rows = []
    for turn in mapping.turns if mapping.kind != "row" else [mapping.turns]:
        if mapping.kind == "row":
            position, role, text = turn
            at = text.rpartition(".")[0] or None
            rows.append((at, role.rpartition(".")[2], None, text.rpartition(".")[2], position))
        elif mapping.kind == "list":
            rows.append((turn[0], turn[1], None, turn[2], None))
        else:
            rows.append((None, None, turn[0], turn[1], None))
    names = ("at", "role_field", "role", "text_field", "position_field")
    many = F.lit(mapping.kind == "list").alias("many")
    string = lambda x, n: F.lit(x).cast("string").alias(n)
    return F.array(*[F.struct(*map(string, row, names), many) for row in rows])


def _role(role: Column, rename: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.when(rename, names[F.lower(role)]), role, F.lit(""))


def _text(value: Column) -> Column:
    """Text of a value: of a list its parts that are strings or have a text, joined; of an object its text or JSON."""
    string = F.try_variant_get(value, "$", "string")
    field = lambda x: F.try_variant_get(x, "$.text", "string")
    part = lambda x: F.when(_is(x, "OBJECT"), field(x)).otherwise(F.try_variant_get(x, "$", "string"))
    parts = F.array_join(F.transform(_items(value), part), "")
    return F.when(_is(value, "ARRAY"), parts).when(_is(value, "OBJECT"), F.coalesce(field(value), string)).otherwise(string)


def canonical_turns(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Records (conv_id, record as JSON) as rows conv_id, position, role, text, layout, fingerprint, unmatched.

    The mapping is looked up by fingerprint in a map literal, as there are few layouts; a record
    with further fields takes the first layout whose paths it has. The turns of a layout with rows
    keep their own position. Texts in parts are joined; parts without text, such as pictures, add
    nothing; an item of a list that is no object is a turn without a role. Records that are no JSON,
    have an unknown layout or hold no turn give a row with null position, role and text, and
    `unmatched` says which of these it is (else null), so none is lost silently.
    """
    parsed = records.select("conv_id", F.try_parse_json("record").alias("_v"))
    seen = parsed.withColumns({"_p": paths_of(F.col("_v")), "_m": F.try_variant_get("_v", "$", "map<string,variant>")})
    named = seen.withColumns({"layout": layout_name(F.col("_p"), layouts), "fingerprint": fingerprint(F.col("_p"))})
    where = F.create_map(*[x for m in layouts for x in (F.lit(m.name), _sources(m))])
    field = lambda x, name: F.when(_is(x, "OBJECT"), F.try_variant_get(x, "$", "map<string,variant>")[name])

    def turns_of(source):
        whole = source["at"].isNull()
        own = F.col("_m")[source["at"]]
        items = F.when(whole, F.array(F.col("_v"))).when(source["many"], _items(own)).otherwise(F.array(own))

        def turn(x):
            get = lambda name: F.when(whole, F.col("_m")[name]).otherwise(field(x, name))
            role = F.try_variant_get(get(source["role_field"]), "$", "string")
            value = F.when(_is(x, "OBJECT"), get(source["text_field"])).otherwise(x)
            return F.struct(
                F.try_variant_get(F.col("_m")[source["position_field"]], "$", "long").alias("position"),
                F.coalesce(source["role"], _role(role, source["many"])).alias("role"),
                _text(value).alias("text"),
            )

        # In layouts with fixed turns null texts are left out.
        return F.filter(F.transform(items, turn), lambda t: source["role"].isNull() | t["text"].isNotNull())

    placed = lambda t, i: F.struct(
        F.when(F.col("_s")[0]["position_field"].isNull(), i.cast("long")).otherwise(t["position"]).alias("position"),
        t["role"].alias("role"),
        F.coalesce(t["text"], F.lit("")).alias("text"),
    )
    each = F.filter(F.transform("_s", turns_of), lambda x: x.isNotNull())
    made = named.withColumn("_s", where[F.col("layout")]).withColumn("_t", F.transform(F.flatten(each), placed))
    some = F.coalesce(F.size("_t") > 0, F.lit(False))
    reason = F.when(F.col("_v").isNull(), NO_JSON).when(F.col("layout").isNull(), NO_LAYOUT).when(~some, NO_TURNS)
    # A record without turns gives one row of nulls.
    return made.select(
        "conv_id", "layout", "fingerprint", reason.alias("unmatched"), F.explode_outer("_t").alias("_t")
    ).select("conv_id", "_t.position", "_t.role", "_t.text", "layout", "fingerprint", "unmatched")


def unmatched(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """A row for each record without turns: conv_id, fingerprint (null if it is no JSON object), layout, unmatched."""
    lost = canonical_turns(records, layouts).where(F.col("text").isNull())
    known = F.when(F.col("unmatched") != NO_JSON, F.col("fingerprint")).alias("fingerprint")
    return lost.select("conv_id", known, "layout", "unmatched")


def escaped(text: Column) -> Column:
    """Text in which no control string is left: backslashes are doubled, control strings broken by one."""
    for plain, safe in (("\\", "\\\\"), (HEAD, "#\\## "), (END, "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """Turns with piece, loss_from, loss_to.

    The pieces of a conversation, in order of position, are its training text; characters
    loss_from (counted in code points, from 0) up to loss_to of a piece carry loss.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(HEAD), role, F.lit(COLON))
    body = escaped(F.col("text"))
    learned = F.col("role") == ASSISTANT
    return turns.withColumns({"_head": head, "_body": body}).select(
        "conv_id",
        "position",
        "role",
        "text",
        F.concat("_head", "_body", F.lit(END + "\n")).alias("piece"),
        F.when(learned, F.length("_head")).otherwise(0).cast("int").alias("loss_from"),
        F.when(learned, F.length("_head") + F.length("_body")).otherwise(0).cast("int").alias("loss_to"),
    )


READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns, digests and lengths of every conversation, from its formatted text and mask alone.

    Conversations are placed by id and sorted; a task goes through its rows one after another
    and keeps digests, not texts, so a conversation of any length needs little memory. Digests
    are sequential, therefore one conversation is read by one task. Rows without position
    come first, ties go by role and text, repeated rows all count.
    """
    order = ["conv_id", "position", "role", "text"]
    placed = pieces.repartition("conv_id").sortWithinPartitions(*order)
    return placed.select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(_read, READ_BACK)


def _unescape(text):
    import re

    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _read(batches):
    import hashlib
    import re

    import pyarrow as pa

    head = re.compile(r"### ((?:[^\\:]|\\.|:(?!\n))*):\n", re.S)

    def conversations():
        current, n, turns, loss, learned, chars = None, 0, None, None, 0, 0
        for batch in batches:
            for conv, piece, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if n and conv != current:
                    yield current, n, turns.hexdigest(), learned, loss.hexdigest(), chars
                    n = 0
                if not n:
                    current, turns, loss, learned, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0
                found = head.match(piece)
                end = piece.find(END + "\n")
                if not found or end < found.end() or end + len(END) + 1 != len(piece):
                    raise ValueError("a piece is not one turn of the template")
                role, text = _unescape(found[1]), _unescape(piece[found.end() : end])
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                part = _unescape(piece[start:stop])
                loss.update(part.encode("utf-8", "surrogatepass"))
                n, learned, chars = n + 1, learned + len(part), chars + len(piece)
        if n:
            yield current, n, turns.hexdigest(), learned, loss.hexdigest(), chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    held = []
    for row in conversations():
        held.append(row)
        if len(held) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def format_chats(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Format records of any known layout, write the text, and read it back: rows of READ_BACK.

    Null texts are empty turns (in layouts with fixed turns they are left out), null roles are
    empty; a null conv_id is a conversation of its own. Records without turns (`unmatched` lists
    them with the reason) raise no error here and add nothing.
    """
    # A turn's text is never null; a filter by `unmatched` would go below the explode and match each record again.
    turns = canonical_turns(records, layouts).where(F.col("text").isNotNull())
    return read_back(cut_lineage(formatted(turns), "chat"))
