"""Secret scan: all rules compiled into one minimal automaton that reads each byte once.

Rules are regular expressions over ASCII (literals, escapes, classes, groups, | ? * + {m,n}).
Thompson automata of all rules, each free to begin at any byte, are determinised together by
subset construction, minimised by partition refinement and laid out as transition rows over byte
classes. One pass over a text's bytes walks these rows; a row that accepts names the rules that
have a match ending there. Such an end is rare: only then a rule's reversed automaton finds the
leftmost begin (not before the rule's last match) and its own automaton extends the match as far
as it goes. A rule's matches so are leftmost, longest and don't overlap; for the rules here this
equals a backtracking search, since no choice in them depends on order. A match whose value is
shorter than the rule's least length is dropped after it was consumed.

Spans are kind:start:end in code points, ordered by start and then by rule. Beside the three base
kinds there are the rules in EXTRA; they add spans and never take one away.

Defined cases: null text is empty (no spans); an empty table gives no rows; each row is scanned by
itself, repeated rows too; extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """prefix and value are matched one after the other; value needs at least `least` characters,
    or the whole match if `whole`. scan is the value pattern used in the combined automaton, where
    a stricter one with the same matches of enough length keeps accepting ends rare."""

    kind: str
    prefix: str
    value: str
    least: int
    whole: bool = False
    scan: str = ""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")

BASE = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 8),
    Rule("access", "AKIA", "[A-Z0-9]+", 16, whole=True),
    Rule("hex", "", "[0-9a-f]+", 32, scan="[0-9a-f]{32}[0-9a-f]*"),
)
EXTRA = (
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("stripe", "[sr]k_live_", "[A-Za-z0-9]+", 16),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "-----", 5),
)


# --- regular expressions to automata ---------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1


class _Parser:
    """Recursive descent to a syntax tree: ('set', bytes), ('cat', ..), ('or', ..), ('rep', x, m, n)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.row())
        return ("or", *parts) if len(parts) > 1 else parts[0]

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", *parts)

    def repeat(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return tree

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            tree = self.either()
            self.i += 1
            return tree
        if c == "[":
            self.i += 1
            return ("set", self.members())
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.char()]))

    def members(self) -> frozenset[int]:
        negate = self.peek() == "^"
        self.i += negate
        out: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(range(256)) - out if negate else frozenset(out)


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Adds tree behind start and gives the state where it ends."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.steps[start].append((tree[1], end))
        return end
    if kind == "cat":
        for part in tree[1:]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1:]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[_build(nfa, part, first)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = _build(nfa, part, start)
    end = nfa.state()
    nfa.empty[start].append(end)
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        last = _build(nfa, part, loop)
        nfa.empty[last] += [loop, end]
    else:
        for _ in range(high - low):
            start = _build(nfa, part, start)
            nfa.empty[start].append(end)
    return end


def _reverse(tree):
    if tree[0] == "cat":
        return ("cat", *map(_reverse, tree[:0:-1]))
    if tree[0] == "or":
        return ("or", *map(_reverse, tree[1:]))
    return ("rep", _reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


@dataclass
class Dfa:
    """rows[state][byte class] is the next state; accepts[state] the ids of what ends there."""

    classes: bytes
    rows: list[list[int]]
    accepts: list[tuple[int, ...]]


def byte_classes(sets: list[frozenset[int]]) -> bytes:
    """The class of each byte: bytes that are in the same sets share one."""
    seen: dict[tuple, int] = {}
    return bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))


def determinise(trees: list, anywhere: bool) -> Dfa:
    """Subset construction over all trees at once; anywhere: a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[_build(nfa, tree, first)] = k
    classes = byte_classes(list({s for step in nfa.steps for s, _ in step}))
    sample = {c: b for b, c in enumerate(classes)}

    closed: list[frozenset[int]] = []
    for s in range(len(nfa.empty)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closed.append(frozenset(x for x in seen if nfa.steps[x] or x in final))
    by_class: list[list[frozenset[int]]] = []
    for step in nfa.steps:
        targets = [frozenset().union(*(closed[t] for s, t in step if sample[c] in s)) for c in range(len(sample))]
        by_class.append(targets)
    number = {closed[start]: 0}
    order, rows = [closed[start]], []
    for subset in order:
        row = []
        for c in range(len(sample)):
            to = frozenset().union(*(by_class[s][c] for s in subset))
            if anywhere:
                to |= closed[start]
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    return minimise(Dfa(classes, rows, [tuple(sorted(final[s] for s in subset if s in final)) for subset in order]))


def minimise(dfa: Dfa) -> Dfa:
    """Merge states that no input can tell apart, by refinement until the blocks hold."""
    table = np.array(dfa.rows, np.int64)
    labels = {a: i for i, a in enumerate(dict.fromkeys(dfa.accepts))}
    block = np.array([labels[a] for a in dfa.accepts], np.int64)
    count = len(labels)
    while True:
        key = np.column_stack([block, block[table]])
        _, first, block = np.unique(key, axis=0, return_index=True, return_inverse=True)
        block = block.reshape(-1)
        if len(first) == count:
            break
        count = len(first)
    swap = np.arange(count)  # the start state stays number 0
    swap[[0, block[0]]] = swap[[block[0], 0]]
    block = swap[block]
    first = first[swap]
    return Dfa(dfa.classes, block[table[first]].tolist(), [dfa.accepts[i] for i in first])


def parse(pattern: str):
    return _Parser(pattern).parse()


# --- scanning --------------------------------------------------------------------------------


class _End:
    """Stands for an accepting row in the scan; as it has no items, the walk stops there."""

    __slots__ = ("row", "rules")

    def __init__(self, row: list, rules: tuple[int, ...]):
        self.row, self.rules = row, rules


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + EXTRA):
        self.rules = rules
        self.dfa = determinise([("cat", parse(r.prefix), parse(r.scan or r.value)) for r in rules], True)
        rows: list[list] = [[] for _ in self.dfa.rows]
        nodes = [_End(row, a) if a else row for row, a in zip(rows, self.dfa.accepts)]
        for row, to in zip(rows, self.dfa.rows):
            row += [nodes[t] for t in to]
        self.start = rows[0]
        both = [("cat", parse(r.prefix), parse(r.value)) for r in rules]
        self.back = [determinise([_reverse(("cat", parse(r.prefix), parse(r.scan or r.value)))], False) for r in rules]
        self.whole = [determinise([t], False) for t in both]
        self.front = [determinise([parse(r.prefix)], False) for r in rules]

    @staticmethod
    def reach(dfa: Dfa, data: bytes, at: int, end: int, step: int) -> int:
        """The last place where dfa, started at `at`, accepts on its way to `end`; -1 if nowhere."""
        state, best, classes, rows, accepts = 0, -1, dfa.classes, dfa.rows, dfa.accepts
        dead = {}
        if accepts[0]:
            best = at
        while at != end:
            state = rows[state][classes[data[at if step > 0 else at - 1]]]
            at += step
            if accepts[state]:
                best = at
            elif dead.setdefault(state, all(t == state for t in rows[state])):
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start and then rule."""
        n, row, found = len(data), self.start, []
        done = [0] * len(self.rules)
        walk = iter(data.translate(self.dfa.classes))
        while True:
            try:
                for c in walk:
                    row = row[c]
                if type(row) is not _End:
                    break
                end = n
            except TypeError:  # row is an _End; c is the byte after it
                end = n - walk.__length_hint__() - 1
            for r in row.rules:
                if end > done[r]:
                    self._take(data, r, end, done, found)
            if end == n:
                break
            row = row.row[c]
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _take(self, data: bytes, r: int, end: int, done: list[int], found: list) -> None:
        start = self.reach(self.back[r], data, end, done[r], -1)
        if start < 0:
            return
        end = done[r] = self.reach(self.whole[r], data, start, len(data), 1)
        rule = self.rules[r]
        begin = start if rule.whole or not rule.prefix else self.reach(self.front[r], data, start, end, 1)
        if end - begin >= rule.least:
            found.append((r, start, end))

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        found = self.scan(data)
        if found and not data.isascii():
            begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            at = np.concatenate([[0], np.cumsum(begins)])
            found = [(r, int(at[s]), int(at[e])) for r, s, e in found]
        return [(self.rules[r].kind, s, e) for r, s, e in found]


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, and all spans, per row."""
    kinds = [r.kind for r in BASE]

    def make():
        scan = scanner().spans

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                found = scan(text.as_buffer().to_pybytes())
                base = [x for x in found if x[0] in kinds]
                joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                counts = [sum(x[0] == k for x in base) for k in kinds]
                spans = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
                out.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), spans))
            columns = [*zip(*out)]
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_arrow(rows, make, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
