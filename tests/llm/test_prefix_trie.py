import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import difference, duck

from callsieve.llm import prefix_trie as p
from callsieve.llm.queries import ORACLE_SQL, op13_prefix_trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, d string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        opener = c - int(np.fmod(c, 100))
        out[c] = own.get(opener, [])[:h] + t[h:]
    return out


def brute(convs):
    """``(conv_id, depth)`` to the other columns, from sequences as tuples."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    out = {}
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out[min(own), len(node)] = (
            min(members[node[:-1]]) if node else None, len(own), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()
        )
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def some_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, n), *range(1000, 1000 + n), -7, -100, -107]:
        if rng.random() < 0.1:
            continue
        same = rng.random() < 0.5
        for t in range(rng.randrange(1, 9)):
            text = f"turn {t}" if same else rng.choice(["a", "bb", "", None, "é\U0001f600"])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]) if not same else "user", text, "clash"))
    return rows + rows[:5] + [(None, 0, "user", "nobody", "clash")]


@pytest.mark.parametrize("shard", [1, 3, 20, p.SHARD])
def test_equals_brute_force(spark, shard):
    rows = some_conversations(shard, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(p.conversation_trie(df, shard=shard)) == brute(rebuilt([r[:4] for r in rows]))


def test_long_conversations_are_chained_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(c, t, "user", f"{t}" if t < 30 - c or c == 9 else rng.choice("xyz"), "") for c in range(12) for t in range([40, 8, 4, 5, 3][c % 5])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(p.conversation_trie(df, shard=2)) == brute(rebuilt([r[:4] for r in rows]))


def test_hot_turns(spark):
    """A third of all conversations are the same, another third begin with the same turn."""
    rows = []
    for c in range(300):
        kind = c % 3
        for t in range(6):
            rows.append((1000 * c, t, "user", f"same {t}" if kind == 0 or (kind == 1 and t == 0) else f"{c} {t}", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(p.conversation_trie(df, openings=False, shard=10)) == brute({c: [("user", r[3]) for r in rows if r[0] == c] for c in {r[0] for r in rows}})


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert p.conversation_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "a", "b", "")], SCHEMA)
    assert p.conversation_trie(nobody).count() == 0
    one = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)
    turnless = spark.createDataFrame([(one, None, None, None, "")], SCHEMA)
    ends = hashlib.sha256(str(one).encode()).hexdigest()
    assert found(p.conversation_trie(turnless)) == {(one, 0): (None, 1, 0, 1, 0, ends)}


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 2**63, (2 * n, 2), dtype=np.uint64)
        table = p.PerfectHash(keys[:n])
        assert sorted(table.slots) == list(range(n))
        assert (table.find(keys[:n]) == table.slots).all()
        assert (table.find(keys[n:]) == -1).all()
    with pytest.raises(ValueError):
        p.PerfectHash(np.zeros((2, 2), np.uint64))


def test_query_equals_its_sql(spark):
    assert difference(op13_prefix_trie(spark, SF), duck(SF), ORACLE_SQL["op13_prefix_trie"]) is None


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, SF)) == brute(rebuilt(rows))
