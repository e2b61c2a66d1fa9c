"""Secret scans by assignment-aware lexing.

Texts are lexed as source code and configuration: every name with a literal, or with a
reference to another name, becomes a pair; constants are followed through references and
concatenations; a literal is scored by the sensitive words of the name it ends up in and
by its own make-up. Three base patterns are found besides, whatever the lexer says.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base patterns, their least lengths, and their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

# How much a word within a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "bearer": 0.9,
    "authorization": 0.8, "auth": 0.5, "private": 0.5, "signing": 0.5, "encryption": 0.5, "access": 0.4, "api": 0.4,
    "client": 0.2, "session": 0.3, "key": 0.4, "salt": 0.5, "pin": 0.4, "jwt": 0.8, "oauth": 0.6, "webhook": 0.4,
    "dsn": 0.4,
}
# Words that say that the value only describes a secret.
NAME_EXCUSES = ("file", "path", "name", "length", "size", "policy", "type", "url", "uri", "hint", "label", "field",
                "count", "expiry", "expires", "ttl", "id")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "none", "null", "true", "false", "redacted")
THRESHOLD = 0.8
LEAST_LITERAL = 6

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by
    commas; base_sha256 is over the base kinds only. Kind `literal` are the lexer's finds that
    no `assign` span covers. Null and empty texts have no spans; repeated rows are scanned each;
    null ids stay null; an empty table gives no rows. Whole texts are read, of any length.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(_scan(id_col), f"`{id_col}` {kind}, {SCHEMA}")


def findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span: id, kind, start, end, value, name, score; name and score for literals only."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, kind string, start long, end long, value string, name string, score double"
    return docs.select(id_col, text).mapInArrow(_findings(id_col), schema)


def redact(docs: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """All columns, with every span of a text replaced by the marker; overlapping spans by a single one.

    Null texts stay null, texts without spans stay as they are.
    """
    return docs.mapInArrow(_redact(text, marker), docs.schema)


def redacted(text: str, marker: str) -> str:
    parts, at = [], 0
    for start, _, end, *_ in all_spans(text)[1]:
        if start >= at:
            parts += [text[at:start], marker]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def base_spans(text: str) -> list:
    """(start, rank of kind, end) of the three base patterns."""
    import re

    found = []
    if (":" in text or "=" in text) and any(w in (low := text.lower()) for w in ASSIGN_WORDS):
        for m in re.finditer(ASSIGN, text, re.I | re.A):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= LEAST["access"]]
    # A run shorter than the least length holds no match, so the length may stand in the pattern.
    long_run = HEX.removesuffix("+") + "{%d,}" % LEAST["hex"]
    found += [(m.start(), 2, m.end()) for m in re.finditer(long_run, text)]
    return sorted(found)


def pairs(text: str) -> list:
    """The lexer: (name, parts) of every assignment, parts being (start, end, literal?) of the right side.

    Reads `name = "x"`, `name: x`, `"name": "x"`, `map["name"] = x`, `name := x`, `name => x`,
    `export name=x`, strings of one or three quotes, chains joined by + or blanks between
    strings, `<name>x</name>`, and ${name}, $name or bare references. A bare value reaches to the
    next blank, quote, bracket, comma or semicolon, without . ! ? : at its end.
    """
    import re

    if not any(c in text for c in "=:>"):
        return []
    target = re.compile(
        r"""(?:(?<![\w.-])(?P<q>["']?)(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*+)(?P=q)(?:[ \t]*\])?(?:\s?:\s?[A-Z]\w*)?"""
        r"""[ \t]*(?::=|=>|==?|:)[ \t]*|<(?P<tag>[A-Za-z_][\w.-]*)>)"""
    )
    part = re.compile(
        r"""(?:(?:Bearer|Basic)[ \t]+)?(?:(?P<triple>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')"""
        r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
        r"""|\$\{(?P<braced>\w+)\}|\$(?P<dollar>[A-Za-z_]\w*)|(?P<bare>[^\s"'`,;<>()\[\]{}]*[^\s"'`,;<>()\[\]{}.!?:]))""",
        re.S,
    )
    joint = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*|[ \t]+(?=[\"'])")
    operator = re.compile(r"[=:>]{1,2}(?:\s?[A-Z]\w*[ \t]*=)?[ \t]*")
    # Names are sought between an operator and what was read before it; no stretch is read twice.
    found, at = [], 0
    for op in re.finditer("[=:>]", text):
        op = op.start()
        if op < at:
            continue
        line = max(text.rfind("\n", at, op) + 1, at)
        best = next((m for m in target.finditer(text, line, operator.match(text, op).end()) if m.end() > op), None)
        if best is None:
            at = op
            continue
        end, parts = best.end(), []
        while (p := part.match(text, end)) is not None:
            group = p.lastgroup
            start, stop = p.span(group)
            quotes = {"string": 1, "triple": 3}.get(group, 0)
            if quotes:
                parts.append((start + quotes, stop - quotes, True))
            else:
                parts.append((start, stop, group == "bare" and not text[start:stop].isidentifier()))
            end = p.end()
            j = joint.match(text, end)
            if not j:
                break
            end = j.end()
        if parts:
            found.append((best["name"] or best["tag"], parts))
        at = max(end, op + 1)
    return found


def sensitivity(name: str) -> float:
    """Sum of the weights of a name's words, at most 1; 0 if the name only describes a secret."""
    import re

    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if words and words[-1] in NAME_EXCUSES:
        return 0.0
    return min(1.0, sum(NAME_WEIGHTS.get(w, 0.0) for w in dict.fromkeys(words)))


def strength(value: str) -> float:
    """From 0 to 1: how much a literal looks like a secret by length, kinds of characters and variety."""
    low = value.lower()
    if len(value) < LEAST_LITERAL or any(p in low for p in PLACEHOLDERS):
        return 0.0
    kinds = sum((any(map(str.isdigit, value)), value != low, value != value.upper(), not value.isalnum()))
    variety = len(set(value)) / min(len(value), 16)
    return min(1.0, 0.5 + 0.15 * kinds) * min(1.0, 0.4 + variety)


def literals(text: str) -> list:
    """(start, end, name, score) of literals at or over THRESHOLD, after following constants."""
    lexed = pairs(text)
    if not lexed:
        return []
    spans_of = _resolver(text, lexed)
    found = {}
    for at, (name, _) in enumerate(lexed):
        weight = sensitivity(name)
        if weight <= 0:
            continue
        spans = spans_of(at)
        score = 0.5 * weight + 0.5 * strength("".join(text[a:b] for a, b in spans))
        if weight * strength("".join(text[a:b] for a, b in spans)) > 0 and score >= THRESHOLD:
            for a, b in spans:
                if b > a and score > found.get((a, b), ("", 0.0))[1]:
                    found[a, b] = (name, score)
    return [(a, b, name, score) for (a, b), (name, score) in sorted(found.items())]


def _resolver(text, lexed):
    """Function from an assignment to the literals that it ends up with, in order, each once.

    A reference stands for the nearest assignment of its name before it, or for the first one
    behind it if there is none; references are followed to their end, circles are left.
    """
    from bisect import bisect_right

    places = {}
    for at, (name, parts) in enumerate(lexed):
        places.setdefault(name, ([], []))
        places[name][0].append(parts[-1][1])
        places[name][1].append(at)
    known = {}

    def named(start, end, now):
        ends, numbers = places.get(text[start:end], ((), ()))
        before = bisect_right(ends, start)
        if before:
            return numbers[before - 1]
        return next((n for n in numbers[:2] if n != now), now if numbers else None)

    def spans_of(at):
        stack, entered = [at], set()
        while stack:
            now = stack[-1]
            if now in known:
                stack.pop()
                continue
            parts = lexed[now][1]
            needs = {} if now in entered else {n: None for s, e, literal in parts if not literal and (n := named(s, e, now)) is not None}
            entered.add(now)
            waiting = [n for n in needs if n not in known and n not in entered]
            if waiting:
                stack += waiting
                continue
            out = {}
            for start, end, literal in parts:
                other = None if literal else named(start, end, now)
                if other is not None and other != now:
                    out.update(dict.fromkeys(known.get(other, ())))
                elif literal or (other is None and len(parts) == 1):
                    out[start, end] = None  # a bare word that names nothing is a value of its own
            known[now] = tuple(out)
            stack.pop()
        return known[at]

    return spans_of


def all_spans(text: str) -> tuple:
    """(base spans, all spans with name and score), sorted by start, then kind, then end."""
    base = base_spans(text)
    covers = [(s, e) for s, kind, e in base if kind == 0]
    extra, at = [], 0
    for a, b, name, score in literals(text):
        while at < len(covers) and covers[at][1] <= a:
            at += 1
        if not (at < len(covers) and covers[at][0] <= a and b <= covers[at][1]):
            extra.append((a, 3, b, name, score))
    return base, sorted([(*s, None, None) for s in base] + extra, key=lambda s: s[:3])


def _joined(spans):
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _scan(id_col):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for value in batch.column(1):
                base, whole = all_spans(value.as_py() or "")
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(whole))
            arrays = [batch.column(0), *(pa.array(c, "int64") for c in counts)]
            arrays += [pa.array(digests, "string"), pa.array(spans, "string")]
            yield pa.RecordBatch.from_arrays(
                arrays, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return run


def _redact(text, marker):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.names.index(text)
            kind = batch.schema.field(at).type
            out = [redacted(t, marker) if (t := v.as_py()) else t for v in batch.column(at)]
            columns = [*batch.columns]
            columns[at] = pa.array(out, kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _findings(id_col):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, at = [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                for start, kind, end, name, score in all_spans(text)[1]:
                    rows.append((KINDS[kind], start, end, text[start:end], name, score))
                    at.append(i)
            types = ["string", "int64", "int64", "string", "string", "float64"]
            columns = list(zip(*rows)) or [[]] * 6
            arrays = [batch.column(0).take(pa.array(at, "int64"))]
            arrays += [pa.array(c, t) for c, t in zip(columns, map(_type, types))]
            yield pa.RecordBatch.from_arrays(
                arrays, [id_col, "kind", "start", "end", "value", "name", "score"]
            )

    return run


def _type(name):
    import pyarrow as pa

    return {"string": pa.string(), "int64": pa.int64(), "float64": pa.float64()}[name]
