"""Byte-level BPE as a deterministic automaton over the token alphabet.

The automaton has one state per token: "the last token read". At first there
are the 256 byte tokens and every byte may follow every byte. The merge rules
are then applied in order; the gadget of rule ``(u, v) -> w`` changes the
transition table in three steps:

1. state ``w`` gets a copy of the row of ``v`` (what may follow ``v`` may
   follow ``w``);
2. the transition from ``u`` on ``v`` is taken away (the rule joins the two);
3. column ``w`` becomes a copy of column ``u`` (where ``u`` could be read and
   ``v`` after it, ``w`` can be read).

Afterwards exactly one path spells each word, and it is the word's BPE
encoding. For 50,000 rules the full table has 2.5 thousand million cells.
:class:`MergeAutomaton` keeps the gadgets instead and works a cell out when it
is first needed, walking back over the copies that made it; worked out cells
are kept in a table. :func:`explicit_table` builds the whole table and serves
as the definition in tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import map_arrow, worker_state

#: How the vocabulary's pre-splitting pattern reads. White space
#: is the Unicode property, spelled out because libraries differ on ``\s``.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|["
    + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
WHITE = frozenset(chr(i) for i in range(0x3001) if regex.match(f"[{SPACE}]", chr(i)))
#: Cells and pieces that a worker keeps; when full, it starts anew.
CELLS = 1_000_000
PIECES = 300_000
KEPT_CHARS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file.

    Printable bytes of Latin-1 stand for themselves, the others are numbered
    from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """``(label of each id, rules (u, v, w) in order, special strings)``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    code = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max([*model["vocab"].values(), *special.values()]) + 1)
    for token, i in model["vocab"].items():
        labels[i] = bytes(map(code.__getitem__, token))
    for token, i in special.items():
        labels[i] = token.encode()
    ids = model["vocab"]
    rules = []
    for rule in model["merges"]:
        u, v = rule.split(" ") if isinstance(rule, str) else rule
        rules.append((ids[u], ids[v], ids[u + v]))
    return labels, rules, special


def explicit_table(alphabet: Iterable[int], rules: Iterable[tuple[int, int, int]]) -> dict[int, set[int]]:
    """The whole transition table, gadget by gadget: which token may follow which."""
    alphabet = list(alphabet)
    follow = {a: set(alphabet) for a in alphabet}
    for u, v, w in rules:
        if v not in follow.get(u, ()):
            continue
        follow[w] = set(follow[v])
        follow[u].discard(v)
        for row in follow.values():
            if u in row:
                row.add(w)
    return follow


class MergeAutomaton:
    """The automaton of a merge table, its cells worked out on demand."""

    def __init__(self, labels: list[bytes], rules: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels = labels
        self.special = special
        n = len(labels)
        self._n = n
        self._order = [-1] * n
        self._left = [-1] * n
        self._right = [-1] * n
        self._joins: dict[int, int] = {}
        self._cells: dict[int, bool] = {}
        made = {w for _, _, w in rules}
        self._token = {
            x: i for i, x in enumerate(labels) if len(x) == 1 and i not in made and i not in special.values()
        }
        for order, (u, v, w) in enumerate(rules):
            if labels[u] not in self._token or labels[v] not in self._token or not self._connects(u, v):
                continue  # the rule can never fire
            if labels[w] in self._token:
                raise ValueError("two rules make one token")
            self._order[w], self._left[w], self._right[w] = order, u, v
            self._joins[u * n + v] = order
            self._token[labels[w]] = w
        self._longest: dict[bytes, int] = {}
        for x in self._token:
            self._longest[x[:2]] = max(self._longest.get(x[:2], 1), len(x))

    def _connects(self, p: int, w: int) -> bool:
        """Whether token ``w`` may follow state ``p``."""
        n, order = self._n, self._order
        before = 1 << 60
        while True:
            joined = self._joins.get(p * n + w)
            if joined is not None and joined < before:
                return False
            op, ow = order[p], order[w]
            if op < 0 and ow < 0:
                return True
            if op > ow:  # step 1: the row was copied before the gadget's removal
                before, p = op, self._right[p]
            elif ow > op:  # step 3: the column was copied after it
                before, w = ow + 1, self._left[w]
            else:
                before, p, w = op, self._right[p], self._left[w]

    def follows(self, p: int, w: int) -> bool:
        """Table-driven form of :meth:`_connects`."""
        key = p * self._n + w
        found = self._cells.get(key)
        if found is None:
            if len(self._cells) >= CELLS:
                self._cells.clear()
            found = self._cells[key] = self._connects(p, w)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids on the one path that spells ``word``.

        Longest arcs are tried first. The path to a position is unique, so a
        position without a way on is closed for good and each is left once.
        """
        n = len(word)
        token, longest, follows = self._token, self._longest, self.follows
        path: list[int] = []
        ends = [0]
        reach = [n]
        closed = set()
        while ends[-1] < n:
            at = ends[-1]
            size = min(reach[-1], n - at, longest.get(word[at : at + 2], 1))
            while size > 0:
                found = token.get(word[at : at + size])
                if found is not None and at + size not in closed and (not path or follows(path[-1], found)):
                    break
                size -= 1
            if size:
                reach[-1] = size - 1
                path.append(found)
                ends.append(at + size)
                reach.append(n)
            else:
                if not path:
                    raise ValueError("a byte has no token")
                closed.add(at)
                path.pop()
                ends.pop()
                reach.pop()
        return path


class Encoder:
    """Texts to packed ids and back, with bounded caches of pieces.

    Where a text has single spaces between other characters, no pre-split word
    crosses the place before such a space, so pieces between spaces are looked
    up whole. Other texts are pre-split by the pattern.
    """

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self._split = regex.compile(SPLIT).findall
        self._special = [s for s in automaton.special if s]
        self._breaks = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")"
        )
        self._words: dict[str, bytes] = {}
        self._pieces = _Pieces(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = self._pack(self.automaton.encode(word.encode()))
            if len(word) <= KEPT_CHARS:
                if len(self._words) >= PIECES:
                    self._words.clear()
                self._words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if not piece or piece[0] in WHITE or piece[-1] in WHITE:
            raise _Adjoins
        return b"".join(map(self._word, self._split(" " + piece)))

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if rest and head and head[-1] not in WHITE:
                packed = b"".join(map(self._pieces.__getitem__, rest))
                return b"".join(map(self._word, self._split(head))) + packed
        except _Adjoins:
            pass
        return b"".join(map(self._word, self._split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self._special):
            return self._plain(text)
        special = self.automaton.special
        return b"".join(
            self._pack([special[part]]) if part in special else self._plain(part)
            for part in self._breaks.split(text)
            if part
        )

    def decode(self, packed: bytes) -> str:
        """The labels of the arcs in turn."""
        label = self.automaton.labels.__getitem__
        return b"".join(map(label, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


class _Adjoins(Exception):
    """White space of a piece adjoins the space next to the piece."""


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self._encode(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_tokens, ids, decoded``, one row per row of ``docs``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers (the
    layout of token shards; :func:`ids_of` gives an array), ``decoded`` the text
    that they spell. ``vocabulary`` is the path of a byte-level BPE file with one
    rule for each joined token; special strings in a text become their ids.

    A NULL text counts as empty and gives no ids and an empty text. Repeated
    rows are encoded one by one, NULL ids stay NULL, an empty table gives no
    rows, other columns are not read. Texts are taken whole.
    """
    labels, rules, special = read_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((labels, rules, special))
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = worker_state("bpe", key, lambda: Encoder(MergeAutomaton(*shared.value)))
        packed = [coder.encode(x) if x else b"" for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array(packed, pa.binary()),
                pa.array([coder.decode(x) for x in packed], pa.string()),
            ],
            ["id", "n_tokens", "ids", "decoded"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(texts, run, "id long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
