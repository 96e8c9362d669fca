"""Secret scans by one combined deterministic automaton.

All rule expressions are compiled to one automaton by subset construction and minimised; it is
held as transition arrays over byte classes. The automaton reads every text once, from its last
byte to its first, and knows the rules turned round: a state that accepts rule ``r`` says that a
match of ``r`` starts at this byte. From the starts, in text order, the longest match is walked
with the same rule's forward automaton, over bytes of matches only, so the spans are leftmost,
longest and non-overlapping for each rule, whatever the rules are.

Rules are ASCII expressions with literals, classes, groups, ``|``, ``? * +`` and ``{m}``,
``{m,}``, ``{m,n}``. In UTF-8 no byte of a longer code point is ASCII, so bytes can be scanned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEAD = 0


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans of ``head`` followed by ``pattern``.

    A match whose part after the (longest) head is shorter than ``least`` bytes is dropped; its
    bytes stay consumed.
    """

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Lengths that only drop matches are kept out of the automaton: counters of several rules multiply its states.
#: A key block from BEGIN to END, its header fields too (a single hyphen is text, five begin the last line). In a text that
#: ends or breaks off before END, the first line and the lines of key characters after it.
KEY_NAME = "[A-Z0-9 ]*PRIVATE KEY( BLOCK)?"
KEY_BODY = "(-?[A-Za-z0-9+/=\\x20\\x0a\\x0d\\x09:,.;()@<>_\\\\])*"
KEY_LINES = "([\\x0a\\x0d\\\\]+[A-Za-z0-9+/=]+)*"
#: Fixed formats: the base kinds first, in the order in which ties are listed, then public token formats.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", f"""({NAMES})["']?\\x20*[:=]\\x20*["']?""", 6),
    Rule("access", "[A-Z0-9]+", "AKIA", 16),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", "[A-Za-z0-9]+", "gh[pousr]_", 36),
    Rule("slack", "[A-Za-z0-9-]+", "xox[abprs]-", 10),
    Rule("google", "[A-Za-z0-9_-]+", "AIza", 35),
    Rule("stripe", "[A-Za-z0-9]+", "[rs]k_live_", 16),
    Rule("jwt", "[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyJ", 40),
    Rule("private_key", f"-----BEGIN {KEY_NAME}-----({KEY_BODY}-----END {KEY_NAME}-----|{KEY_LINES})?"),
    Rule("url_login", "[A-Za-z0-9._~!$%^*+=-]+@", "://[A-Za-z0-9._-]+:", 7),
)
RULES = BASE + ADDED


class Expression:
    """Parser of one rule expression into a tree: ('set', mask), ('cat', parts), ('or', parts), ('rep', node, m, n)."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern.encode("ascii"), 0

    def parse(self) -> tuple:
        tree = self.either()
        if self.i != len(self.s):
            raise ValueError(f"cannot read {self.s[self.i:]!r}")
        return tree

    def peek(self) -> int:
        return self.s[self.i] if self.i < len(self.s) else -1

    def take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == ord("|"):
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def atom(self) -> tuple:
        c = self.take()
        if c == ord("("):
            tree = self.either()
            self.take()
            return tree
        if c == ord("["):
            return ("set", self.members())
        return ("set", 1 << (self.escaped() if c == ord("\\") else c))

    def escaped(self) -> int:
        c = self.take()
        if c == ord("x"):
            self.i += 2
            return int(self.s[self.i - 2:self.i], 16)
        return c

    def members(self) -> int:
        mask, last = 0, -1
        while self.peek() != ord("]"):
            c = self.take()
            if c == ord("-") and last >= 0 and self.peek() != ord("]"):
                for x in range(last, self.take() + 1):
                    mask |= 1 << x
                last = -1
                continue
            last = self.escaped() if c == ord("\\") else c
            mask |= 1 << last
        self.take()
        return mask

    def repeated(self, node: tuple) -> tuple:
        while True:
            c = self.peek()
            if c >= 0 and c in b"?*+":
                self.take()
                node = ("rep", node, int(c == ord("+")), 1 if c == ord("?") else None)
            elif c == ord("{"):
                end = self.s.index(b"}", self.i)
                low, comma, high = self.s[self.i + 1:end].partition(b",")
                self.i = end + 1
                node = ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
            else:
                return node


class Graph:
    """Non-deterministic automaton: moves[state] = [(byte mask, target)], free[state] = [targets]."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, start: int, back: bool) -> int:
        """Append ``tree`` after ``start``; returns its end. ``back`` builds the expression turned round."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in (reversed(tree[1]) if back else tree[1]):
                start = self.add(part, start, back)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                enter = self.state()
                self.free[start].append(enter)
                self.free[self.add(part, enter, back)].append(end)
            return end
        _, node, low, high = tree
        for _ in range(low):
            start = self.add(node, start, back)
        if high is None:
            hub = self.state()
            self.free[start].append(hub)
            self.free[self.add(node, hub, back)].append(hub)
            return hub
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(node, start, back)
            self.free[start].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte class]`` and ``accepts[state]``, a bit for each rule; ``classes[byte]``. State 1 is the start."""

    table: np.ndarray
    accepts: np.ndarray
    classes: np.ndarray


def byte_classes(graph: Graph) -> np.ndarray:
    """Class of each byte: bytes that no transition tells apart share one."""
    masks = sorted({m for moves in graph.moves for m, _ in moves})
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(tuple(m >> b & 1 for m in masks), len(seen)) for b in range(256)])


def determinise(graph: Graph, start: int, ends: dict[int, int], restart: bool) -> Automaton:
    """Subset construction; with ``restart`` a match may begin at every byte. ``ends`` maps a final state to its rule."""
    classes = byte_classes(graph)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(classes.max() + 1)]
    root = graph.closure([start])
    ids: dict[frozenset[int], int] = {frozenset(): DEAD, root: 1}
    rows, accepts, todo = [[DEAD] * len(sample)], [0], [root]
    while todo:
        here = todo.pop(0)
        row = []
        for b in sample:
            after = graph.closure([t for s in here for m, t in graph.moves[s] if m >> b & 1] + ([start] if restart else []))
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            row.append(ids[after])
        rows.append(row)
        accepts.append(sum(1 << r for s, r in ends.items() if s in here))
    return Automaton(np.array(rows), np.array(accepts, dtype=np.int64), classes)


def minimise(a: Automaton) -> Automaton:
    """Partition refinement: states stay together while they accept alike and lead to the same parts."""
    _, part = np.unique(a.accepts, return_inverse=True)
    while True:
        keys = np.column_stack([part, part[a.table]])
        _, finer = np.unique(keys, axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    # the start keeps number 1, the dead state 0
    order = {int(part[DEAD]): 0}
    order.setdefault(int(part[1]), 1)
    for p in map(int, part):
        order.setdefault(p, max(2, len(order)))
    size = max(order.values()) + 1
    table, accepts = np.zeros((size, a.table.shape[1]), dtype=np.int64), np.zeros(size, dtype=np.int64)
    for s, p in enumerate(part):
        table[order[int(p)]] = [order[int(part[t])] for t in a.table[s]]
        accepts[order[int(p)]] = a.accepts[s]
    return Automaton(table, accepts, a.classes)


def compiled(patterns: Iterable[str], back: bool, restart: bool) -> Automaton:
    graph = Graph()
    start = graph.state()
    ends = {graph.add(Expression(p).parse(), start_of(graph, start), back): r for r, p in enumerate(patterns)}
    return minimise(determinise(graph, start, ends, restart))


def start_of(graph: Graph, start: int) -> int:
    enter = graph.state()
    graph.free[start].append(enter)
    return enter


def linked_rows(a: Automaton) -> list[list]:
    """The transition arrays as 257 slots a state: the rows it leads to by byte, then its accept bits."""
    rows: list[list] = [[None] * 257 for _ in a.table]
    for row, to, accept in zip(rows, a.table, a.accepts):
        row[:256] = [rows[t] for t in to[a.classes]]
        row[256] = int(accept)
    return rows


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> tuple[list, list[tuple]]:
    """Start state of the combined automaton, and (start, dead) of the forward automata of each rule and its head."""
    combined = linked_rows(compiled([r.head + r.pattern for r in rules], back=True, restart=True))
    return combined[1], [tuple((rows[1], rows[DEAD]) for p in (r.head + r.pattern, r.head)
                               for rows in [linked_rows(compiled([p], back=False, restart=False))]) for r in rules]


def starts(raw: bytes, first: list) -> list[tuple[int, int]]:
    """(position, rule bits) of every byte at which a match starts, in text order; one pass over the bytes."""
    state, at, found = first, len(raw), []
    for b in reversed(raw):
        at -= 1
        state = state[b]
        if state[256]:
            found.append((at, state[256]))
    found.reverse()
    return found


def longest(raw: bytes, at: int, first: list, dead: list) -> int:
    """End of the longest match from ``at``."""
    state, end = first, at
    for i in range(at, len(raw)):
        state = state[raw[i]]
        if state is dead:
            break
        if state[256]:
            end = i + 1
    return end


def scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in code points, by start, then rule."""
    if not text:
        return []
    first, forward = scanner(rules)
    raw = text.encode("utf-8", "surrogatepass")
    spans, upto = [], [0] * len(rules)
    for at, bits in starts(raw, first):
        r = 0
        while bits:
            if bits & 1 and at >= upto[r]:
                whole, head = forward[r]
                end = upto[r] = longest(raw, at, *whole)
                if not rules[r].least or end - longest(raw, at, *head) >= rules[r].least:
                    spans.append((at, end, r))
            bits >>= 1
            r += 1
    if len(raw) == len(text):
        return spans
    places, seen, points = {}, 0, 0
    for byte in sorted({x for s in spans for x in s[:2]}):
        points += len(raw[seen:byte].decode("utf-8", "surrogatepass"))
        places[byte], seen = points, byte
    return [(places[a], places[b], r) for a, b, r in spans]


def redacted(text: str | None, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with every stretch of overlapping spans replaced by the kind of its first one."""
    if not spans:
        return text
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, r in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, r])
    for a, b, r in merged:
        out += [text[done:a], f"[{rules[r].kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


SPANS = "array<struct<start:int,end:int,kind:string>>"


def found(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules in the whole text; null and empty texts have none."""

    @F.arrow_udf(SPANS)
    def secret_spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.array([[{"start": a, "end": b, "kind": rules[r].kind} for a, b, r in scan(t.as_py(), rules)] for t in texts], kind)

    return secret_spans(text)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans``. Rows are judged alone: no shuffle, empty in empty out."""
    return docs.withColumn("spans", found(F.col(text), rules)).drop(text)


def cleaned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by their kind in brackets; all rows and columns stay.

    ``length``, if there is such a column, becomes the number of code points of the new text.
    """

    @F.arrow_udf("string")
    def without_secrets(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t, scan(t, rules), rules) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn(text, without_secrets(F.col(text)))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
