import re
from itertools import permutations

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from callsieve.llm import filter_audit as a
from callsieve.llm.queries import ORACLE_SQL, op11_filter_audit

SF = "/root/testdata/sf0.001"


def masks(rows):
    """Of ``(id, part, text)``, by the words of the contract."""
    out = []
    for i, part, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
            any(i is not None and j is not None and j < i and (t or "") == text for j, _, t in rows),
        ]
        out.append((i, part or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


ROWS = [
    (1, "s", "one word"), (2, "s", "one word"), (2, "t", "one word"), (None, "t", "one word"), (3, None, None), (4, None, ""), (5, "", " \t\n\x0b\f\r "),
    (6, "s", "word " * 300), (7, "s", " ".join(f"w{i}" for i in range(200))), (8, "s", " ".join(f"w{i}" for i in range(199))), (9, "t", "A" * 500),
    (10, "t", "x" * 98 + "AA"), (11, "t", "x" * 97 + "AAA"), (12, "t", "50 %"), (13, "u", "no break space É"), (14, "u", "a\x00b"),
    (15, "u", "word " * 300), (-1, "u", "one word"), (16, "u", "One word"), (17, "u", "a|b"), (18, "u", "long words " * 30000),
]


@pytest.mark.parametrize("limit", [a.SKETCH_BYTES, 0])
def test_flags(spark, limit):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, source string, text string, mask string")
    found = a.flag_documents(df, sketch_bytes=limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(masks(ROWS), key=key)


def test_odd_tables(spark, messy, nothing):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, None), (None, 1, 1), (99, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    assert a.audit_filters(nothing, labels).count() == 0
    rows = [(r.doc_id, r.source, r.text) for r in messy.collect()]
    got = {(r.part, r.filter_order, r.step): r for r in a.audit_filters(messy, labels).collect()}
    assert {k[0] for k in got} == {"", "s"} and len(got) == 2 * 600
    check(got, masks(rows), {5: (1, 1), 6: (0, 1)})
    assert a.audit_filters(messy, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def check(got, flags, labels):
    parts = {p for _, p, _ in flags}
    shapley = {}
    for part in parts:
        own = [(i, m) for i, p, m in flags if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                fail = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                r = got[part, order, step]
                assert (r.kept, r.removed) == (len(left), len(fail))
                assert r.redundant == sum(bool(m & bit) for _, m in own) - len(fail)
                assert r.unique_fails == sum(m == bit for _, m in own)
                assert r.good_lost == sum(labels.get(i, (0, 0))[0] for i, _ in fail)
                assert r.toxic_lost == sum(labels.get(i, (0, 0))[1] for i, _ in fail)
                shapley[part, x] = shapley.get((part, x), 0) + len(fail)
    assert all(r.shapley == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def test_unique_texts_are_cleared_and_repeats_never(spark):
    """The sketch has no false "unique", and few false "maybe"."""
    rows = [(i, f"text {i if i % 10 else i // 50}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    blocks = -(-len(rows) * a.PER_DOCUMENT // a.BLOCK)
    h = F.xxhash64("text")
    keyed = df.withColumns({"block": F.pmod(h, F.lit(blocks)), "probes": F.xxhash64(F.lit("probes"), h)})
    looked = keyed.join(a.sketch(keyed, blocks), "block").select("text", a._may_repeat().alias("maybe")).collect()
    count = {}
    for _, t in rows:
        count[t] = count.get(t, 0) + 1
    assert len(looked) == len(rows)
    assert all(r.maybe for r in looked if count[r.text] > 1)
    assert sum(r.maybe for r in looked if count[r.text] == 1) < 0.06 * len(rows)


def test_hot_texts_and_others_take_two_ways(spark):
    rows = [(i, "s", "hot" if i % 3 == 0 else f"text {i % 997}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    got = {r.doc_id: bool(r.mask & 16) for r in a.flag_documents(df).collect()}
    assert got == {i: i > first[t] for i, _, t in rows}


def test_query_equals_its_sql(spark):
    assert difference(op11_filter_audit(spark, SF), duck(SF), ORACLE_SQL["op11_filter_audit"]) is None


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {(r.part, r.filter_order, r.step): r for r in op11_filter_audit(spark, SF).collect()}
    check(got, masks(docs), labels)
    assert len(got) == 600 * len({d[1] for d in docs})
