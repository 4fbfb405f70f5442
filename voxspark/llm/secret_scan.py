"""Secret scan with assignment-aware lexing.

Three base kinds are fixed patterns. Besides them each text is lexed into name-literal pairs by one loop
over its tokens with a stack of open brackets. An assignment is a name (bare, dotted, quoted, a subscript's
string, a flag, an XML attribute), perhaps a declared type, an operator (``=``, ``:``, ``:=``, ``=>``) and
a value: quoted literals, bare words, names, lists and calls of these, on the next line too if the
operator's has none, or a YAML block scalar. Braces open a container whose pairs are read on their own, so
nested JSON is. ``a = b = "..."`` gives both names the literal; an entry that names itself
(``name: DB_PASSWORD`` beside ``value: ...``) is a pair. XML elements and bearer headers are pairs as well.

Values refer to names: each assignment is a node with its literals and the nodes it refers to, also through
``"${A}"``, so ``A = "x7Gk..."; db_password = A`` reports the literal where it is written. From sensitive
nodes, heaviest first, every node is visited once, so any text takes linear time. A target name is split
at case changes and separators and its words weigh in; ``key`` only with a word that makes it a secret
one, and a last word such as ``id`` or ``url`` takes all weight away. The literal adds its length and
variety. Spans of kind ``target`` are literals that reach ``threshold``. Comments are lexed like code: a
secret there is one. Constants passed by position aren't followed; a blank line closes what is open.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; a span
found twice as a target counts once; names are seen in text order, so a later assignment to the same
name replaces the earlier one; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from voxspark.llm.common import documents, slices

KINDS = ("assign", "access", "hex", "target")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

MASK = "[SECRET]"

#: Words of a target name and their weights.
SENSITIVE = {"password": 3, "passwd": 3, "pass": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "private": 1, "access": 1, "auth": 2, "authorization": 2, "api": 1, "signing": 1, "session": 1, "cookie": 1, "bearer": 2, "pin": 1, "salt": 1}
#: Words that make a key after them a secret one.
KEYED = {"api", "secret", "private", "access", "signing", "encryption", "auth", "master", "shared", "account", "storage", "service", "ssh"}
#: Last words of names that only describe a secret.
DESCRIBING = {"id", "name", "type", "url", "uri", "path", "file", "field", "label", "count", "length", "size", "limit", "ttl", "expiry", "expires", "header", "prefix", "policy", "hint", "placeholder", "page", "form", "column", "table"}
#: Attributes and entries that hold another one's name, and those that hold its value.
NAMING, HOLDING = {"key", "name", "id"}, {"value", "default", "content", "data"}

#: Quoted literals: over several lines in threes, else in one line, with escapes.
QUOTED = r"""\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"""
TOKEN = re.compile(
    rf"""(?P<string>{QUOTED})|(?P<blank>\n[ \t]*\n)|(?P<line>\n)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<end>[,;])|(?P<flag>(?<![\w-])--?[A-Za-z][\w-]*)|"""
    r"""(?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|(?P<other>===?|!==?|<=|>=|::|->)|(?P<op>:=|=>|=|:)""",
    re.ASCII | re.DOTALL,
)
#: A value without quotes that is more than a name.
BARE = re.compile(r"[\w$+/.@%^&*!~=-]*[\w$+/@%^&*!~=-]", re.ASCII)
#: Such a value that holds `=` at its end only, and dots behind that.
PADDED = re.compile(r"([\w$+/.@%^&*!~-]*)(=*)\.*", re.ASCII)
SPACE = re.compile(r"[ \t]*")
SCALAR = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n((?:[ \t]+[^\n]*\S[^\n]*(?:\n|\Z)|[ \t]*\n)+)")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*)>(?P<value>[^<>\n]+)</(?P=name)>", re.ASCII)
HEADER = re.compile(r"(?P<name>[Bb]earer)[ \t]+(?P<value>[A-Za-z0-9._~+/=-]{16,})", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))|\{([A-Za-z_]\w*)\}", re.ASCII)
#: No name of a text without any of these weighs enough; words that hold others are left out.
HINTS = [w for w in (*SENSITIVE, "key") if not any(o != w and o in w for o in (*SENSITIVE, "key"))]


def hinted(text: str) -> bool:
    """Whether a sensitive word stands in the text, in any case; plain searches, which are much faster than one pattern."""
    low = text.lower()
    return any(w in low for w in HINTS)


def name_score(name: str) -> int:
    """Sum of the weights of the sensitive words in a target name."""
    words = [w if w in SENSITIVE else w.removesuffix("s") for w in map(str.lower, WORDS.findall(name))]
    if not words or words[-1] in DESCRIBING:
        return 0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    keyed = 2 * any(b == "key" and a in KEYED for a, b in zip(words, words[1:], strict=False))
    return sum(SENSITIVE.get(w, 0) for w in {*words, *joined}) + keyed


def literal_score(literal: str) -> int:
    """0 to 3: long enough, more than one class of characters, varied."""
    if len(literal) < 6:
        return 0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 1 + (classes >= 2) + (max(Counter(literal).values()) <= max(2, len(literal) // 3))


#: Start, end and whether a literal is quoted.
Literal = tuple[int, int, bool]


@dataclass(slots=True)
class Assignment:
    """What a value is made of: its own literals and the assignments it refers to."""

    names: list[str]
    depth: int
    op: str = ""
    literals: list[Literal] = field(default_factory=list)
    refers: list[Assignment] = field(default_factory=list)
    words: int = 0  # names in the value, known or not
    seen: bool = False

    def bare(self) -> bool:
        return not (self.literals or self.refers or self.words)


class Lexer:
    """Assignments of one text, in the order in which they end."""

    def __init__(self, text: str):
        self.text, self.done = text, []
        self.bound: dict[str, Assignment] = {}
        self.open: list[str] = []  # brackets: ( [ { as written, s for a subscript
        self.active: list[Assignment] = []
        self.key: tuple[str, int, int] | None = None  # a name or string that an operator may follow, with its span
        self.alias: str | None = None
        self.sub: tuple[str, int, int] | None = None
        self.on = {kind: getattr(self, f"on_{kind}") for kind in TOKEN.groupindex}

    def run(self) -> list[Assignment]:
        at, text, on = 0, self.text, self.on
        while m := TOKEN.search(text, at):
            at = on[m.lastgroup](m) or m.end()
        self.close_to(0)
        return self.done

    def value_of(self) -> Assignment | None:
        """The assignment whose value is being read here."""
        return self.active[-1] if self.active and "s" not in self.open[self.active[-1].depth :] else None

    def finish(self, a: Assignment) -> None:
        for name in a.names:
            self.bound[name] = a
        if len(a.names) == 1 and a.names[0].lower() in NAMING and len(a.literals) == 1:
            start, end, _ = a.literals[0]
            self.alias = self.text[start:end]
        self.done.append(a)

    def close_to(self, depth: int, same: bool = True) -> None:
        """Ends assignments that began deeper than `depth`, and those at it."""
        while self.active and (self.active[-1].depth > depth or (same and self.active[-1].depth == depth)):
            self.finish(self.active.pop())

    def on_string(self, m: re.Match) -> None:
        size = 3 if m[0][:3] in ('"""', "'''") else 1
        start, end = m.start() + size, m.end() - size
        self.key = (self.text[start:end], m.start(), m.end())
        if self.open[-1:] == ["s"]:
            self.sub = self.key
            return
        a = self.value_of()
        if a and end > start:
            known = REFERENCE.fullmatch(self.text, start, end)
            bound = self.bound.get(next(g for g in known.groups() if g)) if known else None
            a.refers.append(bound) if bound else a.literals.append((start, end, True))

    def on_name(self, m: re.Match) -> int | None:
        a = self.value_of()
        if a is None:
            self.key = (m[0], m.start(), m.end())
            return None
        end = self.padded_end(m.start()) if a.bare() else 0
        if end > m.end() and not self.text.startswith(":", end):
            if m[0] in self.bound and self.text[m.end()] in "+":
                return self.word(a, m)
            a.literals.append((m.start(), end, False))
            self.key = None
            return end
        return self.word(a, m)

    def padded_end(self, at: int) -> int:
        """Where the value without quotes ends, 0 if it holds `=` before its end; looks no further than the first of these."""
        m = PADDED.match(self.text, at)
        if not m[2]:
            return at + len(m[1].rstrip("."))
        return 0 if BARE.match(self.text[m.end() : m.end() + 1]) else m.end(2)

    def word(self, a: Assignment, m: re.Match) -> None:
        """A name in a value: an earlier one's literals, else perhaps a literal itself."""
        self.key = (m[0], m.start(), m.end())
        bound = self.bound.get(m[0].lstrip("$"))
        if bound:
            a.refers.append(bound)
        elif a.bare():
            a.literals.append((m.start(), m.end(), False))
        a.words += 1

    def on_flag(self, m: re.Match) -> None:
        name = m[0].lstrip("-")
        if self.value_of() is None and m[0].startswith("--"):
            self.active.append(Assignment([name], len(self.open), "--"))
        self.key = (name, m.start(), m.end())

    def on_op(self, m: re.Match) -> int | None:
        top = self.active[-1] if self.active and self.active[-1].depth == len(self.open) else None
        key, self.key = self.key, None
        if key is None or SPACE.match(self.text, key[2]).end() != m.start():
            if top and top.op == "--" and top.bare():
                return self.begun(m)
            if m[0] == "=" and top and top.op == ":" and not any(q for *_, q in top.literals):
                top.op, top.literals, top.refers, top.words = "=", [], [], 0  # what stood there was a type
                return self.begun(m)
            return None
        name = key[0]
        if top:
            last = top.literals[-1:] == [(key[1], key[2], False)] or (top.refers[-1:] and self.bound.get(name) is top.refers[-1])
            if top.op == "--" and name == top.names[0]:
                top.op = "="
                return self.begun(m)
            if m[0] == "=" and top.op == ":" and not any(q for *_, q in top.literals):
                top.op, top.literals, top.refers, top.words = "=", [], [], 0
                return self.begun(m)
            if m[0] == "=" and last and top.words == 1:  # a = b = "...": both names get the value
                top.names.append(name)
                top.literals, top.refers, top.words = [], [], 0
                return self.begun(m)
            if top.literals and top.literals[-1][0] in (key[1], key[1] + 1, key[1] + 3) and len(top.literals) == 1 and not top.refers:
                top.literals.clear()  # it was the next pair's name
            self.close_to(len(self.open))
        names = [name]
        if name.lower() in HOLDING and self.alias:
            names.append(self.alias)
        self.active.append(Assignment(names, len(self.open), m[0]))
        return self.begun(m)

    def begun(self, m: re.Match) -> int | None:
        """Behind an operator: a block scalar, or a bare value that begins with no letter."""
        a, at = self.active[-1], m.end()
        if m[0] == ":" and (block := SCALAR.match(self.text, at)):
            start = block.start(1)
            for line in block[1].splitlines(keepends=True):
                body = line.strip()
                if body:
                    a.literals.append((start + line.index(body), start + line.index(body) + len(body), True))
                start += len(line)
            return block.end()
        at = SPACE.match(self.text, at).end()
        if not re.match(r"[A-Za-z_$=-]", self.text[at : at + 1]) and (whole := BARE.match(self.text, at)):
            a.literals.append((at, whole.end(), False))
            return whole.end()
        return None

    def on_open(self, m: re.Match) -> None:
        after = self.text[m.start() - 1 : m.start()]
        if m[0] == "[" and (after.isalnum() or after in ("_", "]", ")")) and after:
            self.open.append("s")
            self.sub = None
            return
        a = self.value_of()
        if m[0] == "{" and a and a.bare():
            self.finish(self.active.pop())  # a container: its pairs are read on their own
        elif m[0] == "(" and a and a.literals and not a.literals[-1][2] and a.words == 1:
            a.literals.pop()  # a call's name
        self.open.append(m[0])
        self.key = None

    def on_close(self, m: re.Match) -> None:
        kind = self.open.pop() if self.open else ""
        if kind == "s":
            self.key = (self.sub[0], m.start(), m.end()) if self.sub else None
            return
        self.close_to(len(self.open), same=False)
        if m[0] == "}":
            self.alias = None
        self.key = None

    def on_end(self, m: re.Match) -> None:
        if "s" in self.open[-1:]:
            return
        inside = self.open[-1:] if m[0] == "," else []
        # in a list or call only pairs of its own end
        self.close_to(len(self.open))
        self.key = None if not inside else self.key

    def on_line(self, m: re.Match) -> None:
        while self.active and self.active[-1].depth == len(self.open) and not (self.active[-1].bare() and self.active[-1].op in (":", "=")):
            self.finish(self.active.pop())
        if self.active and self.active[-1].bare() and self.active[-1].depth == len(self.open):
            self.active[-1].op += "\n"
            if self.active[-1].op.count("\n") > 1:
                self.active.pop()
        self.key = None

    def on_blank(self, m: re.Match) -> int:
        self.close_to(0)
        self.open, self.key, self.alias = [], None, None
        return m.end() - 1

    def on_other(self, m: re.Match) -> None:
        self.key = None


def target_spans(text: str, threshold: int = 5) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants.

    Name and literal both count: a literal of score 0 (short, empty, or the mask) is never a span.
    """
    found: set[tuple[int, int]] = set()

    def weigh(weight: int, literals: list[Literal]) -> None:
        for start, end, quoted in literals:
            value = text[start:end]
            score = 0 if MASK in value else literal_score(value)
            # a bare word counts only when it does not read like a plain word
            if score and weight + score >= threshold and (quoted or re.search(r"\d", value)):
                found.add((start, end))

    if not hinted(text):
        return []
    # a name and its operator, or an entry and the name it holds, stand in one line
    if any((":" in line or "=" in line or "--" in line) and hinted(line) for line in text.split("\n")):
        known = [(max(map(name_score, a.names)), a) for a in Lexer(text).run()]
        # heaviest first, so that no assignment needs a second visit
        for weight, a in sorted((x for x in known if x[0] >= 2), key=lambda x: -x[0]):
            todo = [a]
            while todo:
                node = todo.pop()
                if not node.seen:
                    node.seen = True
                    weigh(weight, node.literals)
                    todo += node.refers
    for pattern in (ELEMENT, HEADER) if "</" in text or "earer" in text else ():
        for m in pattern.finditer(text):
            weight = name_score(m["name"] if pattern is ELEMENT else "authorization " + m["name"])
            weigh(weight if weight >= 2 else -9, [(*m.span("value"), pattern is ELEMENT)])
    return sorted(found)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, kind's place, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(s, 3, e) for s, e in target_spans(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, mask: str = MASK) -> str:
    """The text with every span, overlapping ones merged, replaced by the mask."""
    out, at = [], 0
    for s, _, e in scan(text):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        count = lambda k: pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64())  # noqa: E731, B023
        base = [hashlib.sha256(joined([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), count(0), count(1), count(2), count(3), pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_target", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_target, base_sha256, spans) for each row."""
    return documents(docs, id_col, text_col).mapInArrow(
        _scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, n_target long, base_sha256 string, spans string"
    )


def _masked(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = pa.array([x if x is None else redact(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names)

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in the text; null texts stay null."""
    return docs.mapInArrow(_masked(docs.columns, docs.columns.index(text_col)), docs.schema)
