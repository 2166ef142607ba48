"""Secrets found by one deterministic automaton over the bytes of a text.

All rules are compiled together: pattern -> position automaton -> subset
construction -> minimisation -> one array of transitions by (state, byte class).
A task lays its texts end to end and reads every byte once. Many stretches of
the stream advance side by side in a numpy vector; they are cut behind bytes
after which every state is the start state, so a cut can't break a match.

The automaton tells where matches of each rule end. The start of a match comes
from walking the rule's reversed automaton back from that end. Matches of a rule
don't overlap: the match that ends first is taken with its leftmost start, and
the search goes on behind it. For rules whose tail is one repeated class, as all
of ``RULES`` are, that is the leftmost, longest match.

Null and empty texts have no spans. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _parser as patterns

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import flat, pieces


@dataclass(frozen=True)
class Rule:
    """``pattern`` is ASCII; matches shorter than ``least`` characters (of ``group``) are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# Hex runs are maximal, so asking for 6 here and dropping those below 24 gives the
# same spans as a run of any length, without reporting every letter a to f.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{6,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
BASE = ("assign", "access", "hex")

SPANS = "array<struct<kind:string,start:int,end:int>>"


class _Positions:
    """Nondeterministic automaton with empty moves; a move carries a 256-bit set of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, at: int, fold: bool = False) -> int:
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                at = self._step(at, _both(arg) if fold else 1 << arg)
            elif name == "IN":
                bits = 0
                for kind, value in arg:
                    lo, hi = value if str(kind) == "RANGE" else (value, value)
                    if str(kind) not in ("RANGE", "LITERAL"):
                        raise ValueError(f"unsupported set item {kind}")
                    for b in range(lo, hi + 1):
                        bits |= _both(b) if fold else 1 << b
                at = self._step(at, bits)
            elif name == "SUBPATTERN":
                _, add, _, inner = arg
                at = self.build(inner, at, fold or bool(add & re.IGNORECASE))
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.build(branch, at, fold)].append(end)
                at = end
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                lo, hi, inner = arg
                for _ in range(lo):
                    at = self.build(inner, at, fold)
                if hi == patterns.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[at].append(loop)
                    self.empty[loop].append(end)
                    self.empty[self.build(inner, loop, fold)].append(loop)
                    at = end
                else:
                    end = self.state()
                    for _ in range(hi - lo):
                        self.empty[at].append(end)
                        at = self.build(inner, at, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"unsupported pattern item {name}")
        return at

    def _step(self, at: int, bits: int) -> int:
        if bits >> 128:
            raise ValueError("patterns are ASCII")
        to = self.state()
        self.moves[at].append((bits, to))
        return to

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _both(b: int) -> int:
    c = chr(b)
    return (1 << ord(c.lower())) | (1 << ord(c.upper())) if c.isalpha() else 1 << b


@dataclass(frozen=True)
class Automaton:
    rules: tuple[Rule, ...]
    classes: np.ndarray  # byte -> class
    table: np.ndarray  # state * width + class -> target state * width
    width: int
    start: int
    accepting: int  # states (times width) from here on accept
    accepts: np.ndarray  # state - accepting / width -> bit set of rules
    resets: np.ndarray  # byte -> every state moves to the start
    backward: tuple  # a reversed automaton for each rule


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal automaton of all rules, found at any position of a stream."""
    nfa = _Positions()
    starts, finals = [], {}
    for i, rule in enumerate(rules):
        starts.append(nfa.state())
        finals[nfa.build(patterns.parse(rule.pattern), starts[-1])] = i
    # byte classes: bytes that no move tells apart
    sets = sorted({bits for moves in nfa.moves for bits, _ in moves})
    groups: dict[tuple, int] = {}
    classes = np.array([groups.setdefault(tuple(bits >> b & 1 for bits in sets), len(groups)) for b in range(256)], np.uint8)
    members = [int(np.flatnonzero(classes == c)[0]) for c in range(len(groups))]
    # subset construction; the start is added at every byte
    first = nfa.closure(starts)
    numbers, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for b in members:
            to = nfa.closure([t for s in state for bits, t in nfa.moves[s] if bits >> b & 1]) | first
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        rows.append(row)
    table = np.array(rows)
    accept = np.array([sum(1 << finals[s] for s in state if s in finals) for state in order], np.int64)
    # minimisation: split blocks until moves agree
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    one = np.unique(block, return_index=True)[1]
    table, accept, start = block[table[one]], accept[one], int(block[0])
    # accepting states get the highest numbers
    rank = np.empty(len(one), np.int64)
    by_accept = np.argsort(accept != 0, kind="stable")
    rank[by_accept] = np.arange(len(one))
    table, accept, start = rank[table[by_accept]], accept[by_accept], int(rank[start])
    width, quiet = len(groups), int((accept == 0).sum())
    resets = (table == start).all(axis=0)[classes]
    return Automaton(
        rules, classes, (table * width).astype(np.int32).ravel(), width, start * width, quiet * width, accept[quiet:], resets,
        tuple(_reversed(nfa, starts[i], next(s for s, r in finals.items() if r == i)) for i in range(len(rules))),
    )


def _reversed(nfa: _Positions, start: int, final: int) -> tuple[list[dict[int, int]], list[bool]]:
    """Deterministic reversed automaton of one rule: moves by byte, and which states hold its start."""
    back: list[list[tuple[int, int]]] = [[] for _ in nfa.moves]
    empty: list[list[int]] = [[] for _ in nfa.moves]
    for s, moves in enumerate(nfa.moves):
        for bits, t in moves:
            back[t].append((bits, s))
        for t in nfa.empty[s]:
            empty[t].append(s)
    turned = _Positions()
    turned.empty, turned.moves = empty, back
    first = turned.closure([final])
    numbers, order, moves = {first: 0}, [first], []
    for state in order:
        row = {}
        for b in range(128):
            to = turned.closure([t for s in state for bits, t in back[s] if bits >> b & 1])
            if to:
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                row[b] = numbers[to]
        moves.append(row)
    return moves, [start in state for state in order]


def _run(a: Automaton, stream: np.ndarray, width: int) -> np.ndarray:
    """The state after each byte. Stretches of about ``width`` bytes advance together."""
    codes = a.classes[stream]
    marks = np.flatnonzero(a.resets[stream]) + 1
    wanted = np.arange(width, len(stream), width)
    cuts = marks[np.minimum(np.searchsorted(marks, wanted), len(marks) - 1)] if len(marks) else marks
    begin = np.unique(np.concatenate([[0], cuts[cuts < len(stream)]]))
    length = np.diff(np.append(begin, len(stream)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")
    states = np.empty(len(stream), np.int32)
    now = np.full(len(begin), a.start, np.int32)
    at = begin.copy()
    for n in live:
        now, at = now[:n], at[:n]
        now = a.table[now + codes[at]]
        states[at] = now
        at += 1
    return states


def find(a: Automaton, offsets: np.ndarray, data: np.ndarray, width: int = 1 << 10) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule, end) in code points of every row, ordered."""
    rows = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    if len(data) == 0:
        return found
    # a byte that no text holds parts the rows
    stream = np.insert(data, offsets[1:], 0xFF)
    begins = offsets[:-1] + np.arange(rows)
    states = _run(a, stream, width)
    hits = np.flatnonzero(states >= a.accepting)
    if len(hits) == 0:
        return found
    which = a.accepts[(states[hits] - a.accepting) // a.width]
    for r, rule in enumerate(a.rules):
        own = hits[(which >> r & 1).astype(bool)]
        own = own[np.append(np.diff(own) != 1, True)] if len(own) else own
        moves, holds = a.backward[r]
        exact = re.compile(rule.pattern, re.ASCII)
        free, row = 0, -1
        for end, doc in zip((own + 1).tolist(), (np.searchsorted(begins, own, "right") - 1).tolist(), strict=True):
            if doc != row:
                free, row = int(begins[doc]), doc
            start, state, p = -1, 0, end
            while p > free and (state := moves[state].get(stream[p - 1], -1)) >= 0:
                p -= 1
                if holds[state]:
                    start = p
            if start < 0:
                continue  # inside an earlier match
            free = end
            got = exact.fullmatch(stream[start:end].tobytes().decode("ascii"))
            if len(got[rule.group]) >= rule.least:
                head = stream[begins[doc] : start]
                chars = int(((head & 0xC0) != 0x80).sum())
                found[doc].append((chars, r, chars + end - start))
    for spans in found:
        spans.sort()
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, piece: int = 4 << 20) -> DataFrame:
    """``id_col`` and ``spans`` of every row, ordered by start, then by the rules' order.

    Only the two columns are read; repeated ids stay separate rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_rules(tuple(rules)))  # a few hundred KB, bounded by the rules

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        kinds = [r.kind for r in a.rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in pieces(batches, 1, piece):
            found = find(a, *flat(part.column(1)))
            spans = pa.array([[{"kind": kinds[r], "start": s, "end": e} for s, r, e in one] for one in found], kind)
            yield pa.RecordBatch.from_arrays([part.column(0), spans], ["id", "spans"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, spans {SPANS}"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, base: Sequence[str] = BASE, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(id_col, *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
