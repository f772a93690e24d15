"""Secret scans by one deterministic automaton for all rules.

Each rule's regular expression becomes a nondeterministic automaton whose states are
kept in the order in which a backtracking matcher would try them. Subset
construction over these ordered lists, for all rules side by side, gives one
deterministic automaton: its transitions restart a rule by themselves where a match
of it has ended, and name the rules whose matches end there. Partition refinement makes it
minimal, and it is laid out as one transition array a state. A text is then read once,
byte by byte, for all rules. Where a match ends, the rule's reversed automaton finds the
leftmost place it can begin, and a third one says whether the match is to be kept.

Matches are those of ``re.finditer``: leftmost, non-overlapping within a rule, and what
is matched but not kept is passed over all the same.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate
from operator import getitem, length_hint
from re import _constants as sre  # the standard library's own parser of patterns
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import map_arrow, worker_state


class Rule(NamedTuple):
    """``pattern`` is what is matched and passed over, ``keep`` what a match must be as a whole (all if None)."""

    kind: str
    pattern: str
    keep: str | None = None
    ignore_case: bool = False


_ASSIGN = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{}"

#: Kinds, patterns and least lengths of the base rules, in the order of the list.
#: A maximal run of hex digits is found as one of 32 or more at once: shorter runs are
#: whole matches that are dropped, so leaving them unmatched changes nothing.
BASE_RULES = (
    Rule("assign", _ASSIGN.format("+"), _ASSIGN.format("{8,}"), ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)

#: What the scan adds: headers of private keys, tokens that have a well-known form.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{35,}"),
)
RULES = BASE_RULES + MORE_RULES

MATCH = -1


class Nfa:
    """States in program order: ``step[s]`` is a set of bytes and the next state, or ``fork[s]`` the next states by preference."""

    def __init__(self, pattern: str, ignore_case: bool = False, backwards: bool = False):
        self.step: dict[int, tuple[frozenset[int], int]] = {}
        self.fork: dict[int, tuple[int, ...]] = {}
        self._case, self._back = ignore_case, backwards
        self._n = 0
        self.start = self._sequence(list(_parser.parse(pattern)), MATCH)

    def _new(self) -> int:
        self._n += 1
        return self._n

    def _bytes(self, allowed: frozenset[int], to: int) -> int:
        if self._case:
            allowed |= {ord(chr(b).swapcase()) for b in allowed if chr(b).isascii() and chr(b).isalpha()}
        state = self._new()
        self.step[state] = (allowed, to)
        return state

    def _fork(self, *to: int) -> int:
        state = self._new()
        self.fork[state] = to
        return state

    def _sequence(self, items: list, to: int) -> int:
        for op, value in items if self._back else reversed(items):
            to = self._one(op, value, to)
        return to

    def _one(self, op, value, to: int) -> int:
        if op is sre.LITERAL:
            return self._bytes(_ascii([value]), to)
        if op is sre.IN:
            return self._bytes(_members(value), to)
        if op is sre.BRANCH:
            return self._fork(*[self._sequence(list(way), to) for way in value[1]])
        if op is sre.SUBPATTERN:
            return self._sequence(list(value[-1]), to)
        if op is sre.MAX_REPEAT:
            least, most, inner = value
            inner = list(inner)
            if most is sre.MAXREPEAT:
                loop = self._new()
                self.fork[loop] = (self._sequence(inner, loop), to)
                to = loop
            else:
                for _ in range(most - least):
                    to = self._fork(self._sequence(inner, to), to)
            for _ in range(least):
                to = self._sequence(inner, to)
            return to
        raise ValueError(f"not supported in a rule: {op}")

    def closure(self, states: Sequence[int], stop: bool) -> tuple[list[int], bool]:
        """Reading states by preference, and whether a match is among them; ``stop`` drops what comes after it."""
        out, seen, matched = [], set(), False
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s == MATCH:
                matched = True
                if stop:
                    break
            elif s not in seen:
                seen.add(s)
                if s in self.step:
                    out.append(s)
                else:
                    stack.extend(reversed(self.fork[s]))
        return out, matched

    def after(self, states: Sequence[int], byte: int) -> list[int]:
        return [self.step[s][1] for s in states if byte in self.step[s][0]]


def _ascii(codes: Sequence[int]) -> frozenset[int]:
    if any(c > 127 for c in codes):
        raise ValueError("rules are of ASCII characters")
    return frozenset(codes)


def _members(items: list) -> frozenset[int]:
    found: set[int] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(value)
        elif op is sre.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a set: {op}")
    return _ascii(sorted(found))


def byte_classes(nfas: Sequence[Nfa]) -> np.ndarray:
    """For each byte the number of its class: bytes of one class are in the same sets everywhere."""
    sets = sorted({tuple(sorted(allowed)) for n in nfas for allowed, _ in n.step.values()})
    signs = [tuple(b in s for s in map(frozenset, sets)) for b in range(256)]
    order = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
    return np.array([order[s] for s in signs])


class Table(NamedTuple):
    """A deterministic automaton with outputs on its transitions.

    ``move[s, c]`` is the state after class ``c``, ``said[s, c]`` the number of the set of
    rules that end before that byte, ``final[s]`` that of those that end with the text.
    """

    classes: np.ndarray
    move: np.ndarray
    said: np.ndarray
    final: np.ndarray
    sets: list[tuple[int, ...]]


def minimal(table: Table) -> Table:
    """The automaton with states that no text tells apart made one (partition refinement)."""
    block = np.unique(np.c_[table.said, table.final], axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.c_[block, block[table.move]], axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    first = np.unique(block, return_index=True)[1]
    order[block[np.sort(first)]] = np.arange(len(first))  # the start state stays number 0
    block = order[block]
    keep = np.sort(first)
    return Table(table.classes, block[table.move[keep]], table.said[keep], table.final[keep], table.sets)


def _determinize(start, after: Callable, final: Callable, classes: np.ndarray) -> Table:
    """Explore from ``start``; ``after(state, byte)`` gives the next state and what ended before the byte."""
    examples = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    number, states = {start: 0}, [start]
    sets: dict[tuple[int, ...], int] = {(): 0}
    move, said = [], []
    for state in states:
        row, out = [], []
        for b in examples:
            to, ended = after(state, b)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
            out.append(sets.setdefault(ended, len(sets)))
        move.append(row)
        said.append(out)
    last = [sets.setdefault(final(s), len(sets)) for s in states]
    return minimal(Table(classes, np.array(move), np.array(said), np.array(last), list(sets)))


def compile_scan(rules: Sequence[Rule]) -> Table:
    """All rules in one automaton that finds where their matches end."""
    nfas = [Nfa(r.pattern, r.ignore_case) for r in rules]
    begin = []
    for rule, n in zip(rules, nfas):
        states, empty = n.closure([n.start], True)
        if empty:
            raise ValueError(f"rule {rule.kind} matches the empty text")
        begin.append((tuple(states), False))
    memo: dict = {}

    def one(k: int, state: tuple[tuple[int, ...], bool], b: int) -> tuple[tuple, bool]:
        """A rule's next state and whether a match ended before ``b``; its threads are in order of preference."""
        n, (threads, matched) = nfas[k], state
        to, found = n.closure(n.after(threads, b), True)
        if matched and not found:
            if to:
                raise ValueError(f"a match of rule {rules[k].kind} could go on without ending anew")
            return one(k, begin[k], b)[0], True
        if not matched and not found:
            to = list(dict.fromkeys(to + list(begin[k][0])))  # a match may begin at the next byte, as the last choice
        return (tuple(to), found), False

    def after(state, b: int):
        nexts, ended = [], []
        for k, own in enumerate(state):
            if (k, own, b) not in memo:
                memo[k, own, b] = one(k, own, b)
            to, over = memo[k, own, b]
            nexts.append(to)
            if over:
                ended.append(k)
        return tuple(nexts), tuple(ended)

    def final(state) -> tuple[int, ...]:
        return tuple(k for k, own in enumerate(state) if own[1])

    return _determinize(tuple(begin), after, final, byte_classes(nfas))


def compile_anchored(pattern: str, ignore_case: bool = False, backwards: bool = False) -> Table:
    """An automaton for texts that match as a whole; a match is the set ``(0,)`` in ``final``."""
    n = Nfa(pattern, ignore_case, backwards)
    states, matched = n.closure([n.start], False)

    def after(state, b: int):
        to, found = n.closure(n.after(state[0], b), False)
        return (tuple(sorted(to)), found), ()

    return _determinize((tuple(sorted(states)), matched), after, lambda s: (0,) if s[1] else (), byte_classes([n]))


class Compiled(NamedTuple):
    kinds: list[str]
    scan: Table
    backwards: list[Table]
    keep: list[Table | None]


def compile_rules(rules: Sequence[Rule] = RULES) -> Compiled:
    return Compiled(
        [r.kind for r in rules],
        compile_scan(rules),
        [compile_anchored(r.pattern, r.ignore_case, backwards=True) for r in rules],
        [compile_anchored(r.keep, r.ignore_case) if r.keep else None for r in rules],
    )


class Scanner:
    """The automata laid out for reading, in one worker."""

    def __init__(self, compiled: Compiled):
        scan = compiled.scan
        self._rows: list[list] = [[] for _ in scan.move]
        self._stops: list[tuple[tuple[int, ...], list]] = []
        number: dict[tuple[int, int], int] = {}
        for row, move, said in zip(self._rows, scan.move.tolist(), scan.said.tolist()):
            cells = []
            for to, ended in zip(move, said):
                if not ended:
                    cells.append(self._rows[to])
                    continue
                if (to, ended) not in number:
                    number[to, ended] = len(self._stops)
                    self._stops.append((scan.sets[ended], self._rows[to]))
                cells.append(number[to, ended])  # a number in place of a row stops the reading
            row.extend(cells[c] for c in scan.classes.tolist())
        self._final = {id(row): scan.sets[f] for row, f in zip(self._rows, scan.final.tolist())}
        self._backwards = [_Anchored(t) for t in compiled.backwards]
        self._keep = [t and _Anchored(t) for t in compiled.keep]

    def ends(self, data: bytes) -> list[tuple[int, tuple[int, ...]]]:
        """``(place, rules)`` wherever matches end, in order: one pass over the bytes."""
        found: list[tuple[int, tuple[int, ...]]] = []
        left, last = iter(data), deque(maxlen=1)
        cell = self._rows[0]
        while True:
            try:
                last.extend(accumulate(left, getitem, initial=cell))
                over = True
            except TypeError:  # a number was led to, and the byte after it has been taken
                over = False
            cell = last[0]
            if isinstance(cell, list):
                break
            at = len(data) - length_hint(left) - (1 if over else 2)
            byte = None if over else data[at + 1]
            while not isinstance(cell, list):
                ended, row = self._stops[cell]
                found.append((at, ended))
                if byte is None:
                    cell = row
                else:
                    cell, at = row[byte], at + 1
                    byte = next(left, None) if not isinstance(cell, list) else byte
            if byte is None:
                break
        if final := self._final[id(cell)]:
            found.append((len(data), final))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, end, rule)`` in bytes of all matches to be kept, in that order."""
        found = []
        passed: dict[int, int] = {}
        for end, ended in self.ends(data):
            for k in ended:
                start = self._backwards[k].furthest(data, passed.get(k, 0), end)
                passed[k] = end
                if self._keep[k] is None or self._keep[k].whole(data[start:end]):
                    found.append((start, end, k))
        return sorted(found, key=lambda s: (s[0], s[2]))


class _Anchored:
    """Rows of an automaton for texts as a whole."""

    def __init__(self, table: Table):
        self._rows: list[list] = [[] for _ in table.move]
        for row, move in zip(self._rows, table.move.tolist()):
            row.extend(self._rows[move[c]] for c in table.classes.tolist())
        self._accepting = {id(row) for row, f in zip(self._rows, table.final.tolist()) if table.sets[f]}
        stuck = [id(row) for row in self._rows if all(x is row for x in row) and id(row) not in self._accepting]
        self._dead = stuck[0] if stuck else None

    def whole(self, data: bytes) -> bool:
        return id(reduce(getitem, data, self._rows[0])) in self._accepting

    def furthest(self, data: bytes, low: int, end: int) -> int:
        """The least place from ``low`` on from which ``data`` up to ``end``, read backwards, matches."""
        row, best = self._rows[0], end
        for at in range(end - 1, low - 1, -1):
            row = row[data[at]]
            if id(row) == self._dead:
                break
            if id(row) in self._accepting:
                best = at
        return best


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes, sorted by start, as spans of code points; what is matched is ASCII."""
    out, at, points = [], 0, 0
    for start, end, k in spans:
        points += len(data[at:start].decode())
        at = start
        out.append((points, points + end - start, k))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]], kinds: Sequence[str]) -> str:
    """``text`` with each span, or run of spans that overlap, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, end, k in spans:
        if start >= at:
            out += [text[at:start], f"[{kinds[k]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", redact: bool = False
) -> DataFrame:
    """``id_col, spans``, and with ``redact`` also ``redacted``, one row per row of ``docs``.

    ``spans`` are structs ``kind, start, end`` in code points, the end exclusive, by start
    and then in the order of ``rules``; ``redacted`` is the text with the kinds in place of
    the spans. Texts are read whole, in one pass of their bytes. A NULL text counts as empty
    and has no spans. Rows that repeat are scanned one by one, NULL ids stay NULL, an empty
    table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(compile_rules(rules)))
    key = uuid.uuid4().hex
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = shared.value[0]
        scanner = worker_state("secrets", key, lambda: Scanner(Compiled(*shared.value)))
        spans, texts = [], []
        for data in batch.column("text").to_pylist():
            data = data or b""
            found = in_code_points(data, scanner.spans(data))
            spans.append([{"kind": kinds[k], "start": a, "end": b} for a, b, k in found])
            if redact:
                texts.append(redacted(data.decode(), found, kinds))
        out = [batch.column("id"), pa.array(spans, pa.list_(span))]
        names = ["id", "spans"]
        if redact:
            out.append(pa.array(texts, pa.string()))
            names.append("redacted")
        return pa.RecordBatch.from_arrays(out, names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = "id long, spans array<struct<kind: string, start: long, end: long>>" + (", redacted string" if redact else "")
    return map_arrow(texts, run, schema).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
