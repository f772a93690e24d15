import re

from callsieve.llm.decontaminate import find_hits, hit_words, remove_contaminated
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n):
    w, hit, names = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        k = min(n, len(v))
        for window in {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == window:
                    hit.update(range(i, i + k))
                    if item_id is not None:
                        names.add(str(item_id))
    return len(w), len(hit), sorted(names)


ITEMS = [
    (1, "One two three, four five SIX"), (2, "three four five six seven"), (10, "short É"), (3, None), (4, "?!"), (None, "a nameless item here now"),
    (5, "one two three four"),
]
DOCS = [
    (1, "zero ONE two three four-five six seven eight nine one two three four"), (2, "short é short É; short"), (3, None), (4, ""),
    (None, "a nameless item here now"), (5, "clean text of no interest"), (6, "one two three"), (6, "one two three four"), (6, "one two three four"),
    (7, "x one two three four five six"),
]


def frames(spark):
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, window string")
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, window string, items int")
    return docs, bench


def test_equals_brute_force(spark):
    docs, bench = frames(spark)
    expected = sorted([(i, *brute(t, ITEMS, 4)) for i, t in DOCS], key=str)
    for limit in (1 << 20, 0):  # broadcast, shuffled
        got = find_hits(docs, bench, 4, broadcast_bytes=limit).withColumn("n", hit_words(F.col("spans")))
        assert sorted([(r.doc_id, r.n_words, r.n, r["items"]) for r in got.collect()], key=str) == expected
        assert got.columns == ["doc_id", "window", "n_words", "spans", "items", "n"]


def test_removal(spark):
    docs, bench = frames(spark)
    clean = {r.doc_id for r in remove_contaminated(docs, bench, 4).collect()}
    assert clean == {3, 4, 5}
    cut = remove_contaminated(docs, bench, 4, spans=True)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns
    assert words(texts[1]) == ["zero", "eight", "nine"]
    assert texts[5] == "clean text of no interest" and texts[3] is None


def test_empty_tables(spark):
    docs, bench = frames(spark)
    assert find_hits(docs.limit(0), bench).count() == 0
    rows = find_hits(docs, bench.limit(0)).collect()
    assert len(rows) == len(DOCS) and all(r.spans == [] and r["items"] == [] for r in rows)


def test_no_python_in_the_plan(spark):
    docs, bench = frames(spark)
    plan = find_hits(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
