"""Secret scans by one combined deterministic automaton.

All rules are compiled together: each rule's expression becomes a nondeterministic automaton, subset construction joins
them into one deterministic automaton that may begin a match at any byte, partition refinement minimises it, and the result
is a transition array over byte classes. One pass over the bytes of a batch finds where any rule ends a match. The pass is
vectorised: the batch is cut into lanes at bytes that lead every state to the start state, and all lanes step together.

No match can hold such a reset byte. In the stretch between two of them that holds an end, two automata of that rule alone give
the leftmost non-overlapping spans: one of the reversed expression runs backwards and marks where matches begin, one of the
expression itself runs on from the first such place to the longest match, and so on behind it. Only private keys go over many
lines and can't be written as an automaton: where a BEGIN marker is found, an expression is matched in the whole text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_steps, raw, sha


class Rule(NamedTuple):
    kind: str
    #: For the automaton: every match that is kept holds one of these.
    found: str
    #: For the spans: leftmost longest matches, which don't overlap.
    exact: str
    #: Group of `exact` that must have `least` bytes; shorter matches are dropped. What comes before the group is `head`.
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    #: Whether a match may cross reset bytes; `exact` then looks at the whole text.
    whole: bool = False
    head: str = ""


WORD, URL = "[A-Za-z0-9]", "[A-Za-z0-9_-]"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The automaton counts only what is common in ordinary text (hex runs); other lengths are left to `exact`, since every
#: counter multiplies the states.
BASE = (
    Rule("assign", ASSIGN + "[A-Za-z0-9+/_.=-]", ASSIGN + "([A-Za-z0-9+/_.=-]+)", 2, 6, True, head=ASSIGN),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", 0, 24),
)
#: What follows a private key's BEGIN line: all up to its END line, if no other marker comes first; else header lines and lines of base64.
KEY_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1-----"
KEY_LINES = r"(?:\s*+[A-Za-z][A-Za-z-]*+:\x20[^\r\n]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{32,}+={0,2})++(?:(?:\s|\\[rn])*+=?[A-Za-z0-9+/]++={0,2}(?=\s*+\Z|[\x20\t]*+[\r\n]))?+"
#: Spans that are added to those of BASE.
ADDED = (
    Rule("private_key", "-----BEGIN ", r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?)-----(?:" + KEY_TO_END + "|" + KEY_LINES + ")?+", whole=True),
    Rule("git_token", "gh[pousr]_" + WORD, "gh[pousr]_" + WORD + "+", 0, 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ" + URL + r"+\.eyJ", "eyJ" + URL + r"+\.eyJ" + URL + r"+\." + URL + "+"),
    Rule("maps_key", "AIza" + URL, "AIza" + URL + "+", 0, 39),
)
KINDS = tuple(r.kind for r in BASE + ADDED)


# --- expression -> nondeterministic automaton ---


class _Parser:
    """Literals, escapes, classes, groups, alternation and ? * + {n} {m,n}; what the rules need and no more."""

    def __init__(self, text: str, ignore_case: bool):
        self.text, self.at, self.ignore_case = text, 0, ignore_case
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self, backwards: bool = False) -> tuple[int, int]:
        tree = self.either()
        if self.at != len(self.text):
            raise ValueError(f"can't read {self.text!r} at {self.at}")
        return self.build(_reversed(tree) if backwards else tree)

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("either", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            x = self.single()
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                x = ("repeat", x, *self.times())
            out.append(x)
        return ("sequence", out)

    def times(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        low, comma, high = self.text[self.at : (end := self.text.index("}", self.at))].partition(",")
        self.at = end + 1
        return int(low), int(high) if high else None if comma else int(low)

    def single(self):
        c = self.take()
        if c == "(":
            x = self.either()
            self.take()
            return x
        if c == "[":
            return ("bytes", self.bytes_of())
        return ("bytes", self.cased({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def bytes_of(self) -> frozenset[int]:
        out: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                out |= set(range(low, ord(self.take()) + 1))
            else:
                out.add(low)
        self.take()
        return self.cased(out)

    def cased(self, points: set[int]) -> frozenset[int]:
        return frozenset(points | {ord(f(chr(p))) for p in points if p < 128 for f in (str.lower, str.upper)} if self.ignore_case else points)

    def build(self, tree) -> tuple[int, int]:
        kind = tree[0]
        if kind == "bytes":
            a, b = self.state(), self.state()
            self.edges[a].append((tree[1], b))
            return a, b
        if kind == "sequence":
            a = b = self.state()
            for x in tree[1]:
                c, d = self.build(x)
                self.edges[b].append((None, c))
                b = d
            return a, b
        if kind == "either":
            a, b = self.state(), self.state()
            for x in tree[1]:
                c, d = self.build(x)
                self.edges[a].append((None, c))
                self.edges[d].append((None, b))
            return a, b
        _, x, low, high = tree
        a = b = self.state()
        for _ in range(low):
            c, d = self.build(x)
            self.edges[b].append((None, c))
            b = d
        if high is None:
            c, d = self.build(x)
            self.edges[b].append((None, c))
            self.edges[d].append((None, b))
            return a, b
        end = self.state()
        for _ in range(high - low):
            self.edges[b].append((None, end))
            c, d = self.build(x)
            self.edges[b].append((None, c))
            b = d
        self.edges[b].append((None, end))
        return a, end


def _reversed(tree):
    kind = tree[0]
    if kind == "bytes":
        return tree
    if kind == "repeat":
        return ("repeat", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "sequence" else parts)


class Automaton(NamedTuple):
    step: np.ndarray  # state * classes + class of byte -> state * classes
    classes: np.ndarray  # byte -> class
    accepts: np.ndarray  # state -> bits of the rules that end a match there
    resets: np.ndarray  # byte -> whether every state goes to the start state on it


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    return compiled([(r.found, r.ignore_case) for r in rules])


def compiled(expressions: list[tuple[str, bool]], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """One automaton of (expression, ignore case); anywhere: a match may begin at any byte; backwards: of what they match, reversed."""
    edges: list[list[tuple[frozenset[int] | None, int]]] = [[]]
    ends: dict[int, int] = {}
    for k, (text, ignore_case) in enumerate(expressions):
        p = _Parser(text, ignore_case)
        a, b = p.parse(backwards)
        base = len(edges)
        edges += [[(on, to + base) for on, to in row] for row in p.edges]
        edges[0].append((None, a + base))
        ends[b + base] = 1 << k
    # byte classes: bytes that no edge tells apart
    sets = {on for row in edges for on, _ in row if on is not None}
    names: dict[tuple, int] = {}
    classes = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(names))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for on, to in edges[todo.pop()]:
                if on is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(s for s in out if s in ends or any(on is not None for on, _ in edges[s]))

    start = closed({0})
    found, todo, rows = {start: 0}, [start], []
    while len(rows) < len(todo):
        here, row = todo[len(rows)], []
        for b in sample:
            to = closed(({0} if anywhere else set()) | {t for s in here for on, t in edges[s] if on is not None and b in on})
            if to not in found:
                found[to] = len(found)
                todo.append(to)
            row.append(found[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({ends[s] for s in x if s in ends}) for x in todo], np.int64)
    # minimise: split the states until those of a block go to the same blocks
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        now = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if now.max() == block.max():
            break
        block = now
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first != first[block[0]], kind="stable")  # the start state becomes 0
    rename = np.empty_like(order)
    rename[order] = np.arange(order.size)
    small = rename[block[table[first[order]]]]
    n = len(names)
    return Automaton((small * n).astype(np.int32).ravel(), classes.astype(np.uint8), accepts[first[order]], (small == 0).all(0)[classes])


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return compile_rules(rules)


class _Steps:
    """An automaton as lists, for short stretches: next state by state and byte, or -1 where nothing can match any more."""

    def __init__(self, text: str, ignore_case: bool, **how: bool):
        auto = compiled([(text, ignore_case)], **how)
        width = int(auto.classes.max()) + 1
        rows = auto.step.reshape(-1, width)[:, auto.classes] // width
        self.accepts = (auto.accepts > 0).tolist()
        dead = [k for k, row in enumerate(rows) if not self.accepts[k] and (row == k).all()]
        self.rows = [[-1 if to in dead else to for to in row] for row in rows.tolist()]

    def begins(self, data: bytes, low: int, high: int) -> list[int]:
        """Places, descending, at which this automaton, run backwards from high, accepts."""
        out, state, rows, accepts = [], 0, self.rows, self.accepts
        for at in range(high - 1, low - 1, -1):
            state = rows[state][data[at]]
            if accepts[state]:
                out.append(at)
        return out

    def longest(self, data: bytes, at: int, high: int) -> int:
        """Where the longest match that begins at `at` ends; -1 without any."""
        last, state, rows, accepts = -1, 0, self.rows, self.accepts
        while at < high and (state := rows[state][data[at]]) >= 0:
            at += 1
            if accepts[state]:
                last = at
        return last


class _Spans:
    """The spans of one rule in a stretch that no match crosses."""

    def __init__(self, rule: Rule):
        self.least = rule.least
        self.back = _Steps(rule.exact, rule.ignore_case, anywhere=True, backwards=True)
        self.on = _Steps(rule.exact, rule.ignore_case, anywhere=False)
        self.head = _Steps(rule.head, rule.ignore_case, anywhere=False) if rule.head else None

    def __call__(self, data: bytes, low: int, high: int) -> list[tuple[int, int]]:
        out, at = [], low
        for begin in reversed(self.back.begins(data, low, high)):
            if begin >= at:
                at = self.on.longest(data, begin, high)
                if at - (self.head.longest(data, begin, at) if self.head else begin) >= self.least:
                    out.append((begin, at))
        return out


@lru_cache(maxsize=64)
def spans_of(rule: Rule) -> _Spans:
    return _Spans(rule)


LANES = 2048


def ends_of(data: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Places (of the last byte) and rule bits of all match ends in data, which must end with a reset byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(auto.resets[data]) + 1
    starts = np.unique(np.append(0, cuts[np.minimum(np.searchsorted(cuts, np.linspace(0, n, min(LANES, n // 64 + 1), endpoint=False)[1:]), cuts.size - 1)]))
    starts = starts[starts < n]
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    byte_class = auto.classes[data]
    accepts = np.zeros(auto.step.size, bool)
    width = int(auto.classes.max()) + 1
    accepts[np.arange(auto.accepts.size) * width] = auto.accepts > 0
    state = np.zeros(starts.size, np.int32)
    places, bits = [], []
    alive, step = starts.size, auto.step
    live_until = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # lanes longer than k
    for k, alive in enumerate(live_until.tolist()):
        state = step[state[:alive] + byte_class[starts[:alive] + k]]
        hit = np.flatnonzero(accepts[state])
        if hit.size:
            places.append(starts[hit] + k)
            bits.append(auto.accepts[state[hit] // width])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, bits = np.concatenate(places), np.concatenate(bits)
    at = np.argsort(places, kind="stable")
    return places[at], bits[at]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.rules, self.auto = rules, automaton(rules)
        self.exact = [re.compile(r.exact.encode(), re.IGNORECASE * r.ignore_case) if r.whole else spans_of(r) for r in rules]
        if not self.auto.resets[0]:
            raise ValueError("a rule may match a NUL byte")

    def spans(self, batch: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For the texts with spans: (start, rule, end) in bytes, sorted."""
        joined = b"\0".join(batch) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        places, bits = ends_of(data, self.auto)
        if not places.size:
            return {}
        cuts = np.flatnonzero(self.auto.resets[data])
        right = np.searchsorted(cuts, places)
        limits = np.cumsum([len(x) + 1 for x in batch])
        out: dict[int, list[tuple[int, int, int]]] = {}
        done: set[tuple[int, int]] = set()
        every = np.unique(right)
        which = np.bitwise_or.reduceat(bits, np.searchsorted(right, every))
        for r, b in zip(every.tolist(), which.tolist()):
            low, high = int(cuts[r - 1]) + 1 if r else 0, int(cuts[r])
            doc = int(np.searchsorted(limits, low, "right"))
            base = int(limits[doc - 1]) if doc else 0
            for k, rule in enumerate(self.rules):
                if not b >> k & 1 or (doc, k) in done:
                    continue
                if rule.whole:
                    done.add((doc, k))
                    found = [m.span() for m in self.exact[k].finditer(joined, base, int(limits[doc]) - 1)]
                else:
                    found = self.exact[k](joined, low, high)
                out.setdefault(doc, []).extend((a - base, k, z - base) for a, z in found)
        return {d: sorted(x) for d, x in out.items() if x}


def points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if text.isascii():
        return spans
    before = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Per row: id, spans array<struct<kind,start,end>> in code points, end exclusive, by start, then rule.

    A null or empty text has no spans; repeated rows repeat; null ids stay. No shuffle; memory is bounded by one step's text.
    """

    def make():
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            batch = raw(part, "text")
            found = scanner.spans(batch)
            rows = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in points(batch[d], found[d])] if d in found else [] for d in range(len(batch))]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

        return run

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_steps(source, "text", make, schema).withColumnRenamed("id", id_col)


def _redacted(text: bytes, spans: list[tuple[int, int, int]], kinds: list[str]) -> bytes:
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kinds[k]}>".encode()]
        at = b
    return b"".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """The same rows and columns, each secret replaced by its kind in angle brackets; the length column (if there is one) follows.

    Overlapping spans become one replacement, named after the first. Rows without secrets stay as they are, null texts too.
    """
    schema = docs.schema

    def make():
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            batch = raw(part, text_col)
            found = scanner.spans(batch)
            if not found:
                return part
            new = {d: _redacted(batch[d], x, kinds).decode(errors="replace") for d, x in found.items()}
            cols = dict(zip(part.schema.names, part.columns))
            cols[text_col] = pa.array([new.get(i, x) for i, x in enumerate(cols[text_col].to_pylist())], pa.string())
            if length_col in cols:
                cols[length_col] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(cols[length_col].to_pylist())], cols[length_col].type)
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols.values(), part.schema)], schema=part.schema)

        return run

    return map_steps(docs, text_col, make, schema)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """op8's columns from scan()'s: counts of the base kinds, digest of their spans, and all spans as text."""
    from pyspark.sql import functions as F

    base = [r.kind for r in BASE]
    item = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in base], F.sha2(F.array_join(F.transform(own, item), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", item), ",").alias("spans"))
