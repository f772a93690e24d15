import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callsieve.llm.bpe import Encoder, MergeAutomaton, encode_documents, explicit_table, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return Encoder(MergeAutomaton(*read_vocabulary(PATH)))


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def same(coder, text):
    ids = coder.encode(text)
    assert ids == packed(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert coder.decode(ids) == text


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(coder, text):
    same(coder, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "ing", "'s", "'", "1", "½", "\xa0", "ß", "aaaa", "<|endoftext|>", "\x1c"])))
def test_adjoining_parts(coder, parts):
    same(coder, "".join(parts))


@pytest.mark.parametrize("seed", range(6))
def test_cells_equal_the_explicit_construction(seed):
    """Random rules over three bytes, rules that never fire and self-joins included."""
    rng = random.Random(seed)
    labels = [b"a", b"b", b"c"]
    rules = []
    for _ in range(25):
        u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[u] + labels[v] not in labels:
            rules.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    table = explicit_table(range(3), rules)
    automaton = MergeAutomaton(labels, rules, {})
    for p in table:
        assert {w for w in table if automaton.follows(p, w)} == table[p]
    for _ in range(300):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        assert automaton.encode(word) == merged(word, labels, rules)


def merged(word, labels, rules):
    """Textbook BPE: apply each rule in order, left to right."""
    ids = [labels.index(bytes([b])) for b in word]
    for u, v, w in rules:
        out, i = [], 0
        while i < len(ids):
            if ids[i : i + 2] == [u, v]:
                out.append(w)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def test_documents(spark, messy, nothing):
    rows = encode_documents(messy, PATH).collect()
    source = messy.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    expected = []
    for r in source:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), packed(ids), text))
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[2]).digest())
    assert sorted([tuple(r)[:2] + (bytes(r.ids), r.decoded) for r in rows], key=key) == sorted(expected, key=key)
    assert encode_documents(nothing, PATH).count() == 0
