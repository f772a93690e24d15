import numpy as np
import public_tokenizers
from test_decontaminate import brute as brute_hits
from test_ngram_join import shingles
from tokenizers import Tokenizer

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(p.written(stage(spark, kept[-1], SF), "test-stage"))
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r for r in x.collect()} for x in kept]
    assert all(set(b) <= set(a) and all(a[i] == b[i] for i in b) for a, b in zip(rows, rows[1:]))
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in rows[1] for i in clean]) > 0.95
    assert np.mean([i in rows[1] for i, r in labels.items() if r.quality == 0]) < 0.15
    assert len(rows[2]) > 0.98 * len(rows[1])
    # near copies: no two that stay are linked, and each that went has a chain to one that stayed
    sets = {i: shingles(r.text) for i, r in rows[2].items()}
    linked = {i: [] for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                linked[i].append(j)
                linked[j].append(i)
    seen, expected = set(), set()
    for i in ids:
        if i not in seen:
            expected.add(i)
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += linked[k]
    assert set(rows[3]) == expected
    assert set(rows[4]) == {i for i, r in rows[3].items() if not brute_hits(r.text, items, 10)[1]}
    out = p.STAGES[-1][1](spark, kept[-1], SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r.doc_id for r in out) == sorted(rows[4])
    for r in out[::10]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(rows[4][r.doc_id].text, add_special_tokens=False).ids
        assert r.decoded == rows[4][r.doc_id].text


def test_run_on_odd_tables(spark, tmp_path, messy, nothing):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    messy.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or -1 for r in out) == [-1, 3, 4, 5, 6, 7, 9]  # 0, 1, 2 have no words, 8 no language
