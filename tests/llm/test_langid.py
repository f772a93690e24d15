import zlib

import pytest
import zstandard

from callsieve.llm import langid
from callsieve.llm.langid import BLOCK_BYTES, DICTIONARY_BYTES, Classifier, Model, blocks, classify, fit, held_out
from callsieve.llm.queries import op2_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.lang_pred for r in rows} == {d.lang for d in docs.values()}
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in out)
    assert right >= 0.98 * len(out), (right, len(out))
    assert sum(r.accepted for r in rows) >= 0.995 * len(rows)


def test_learns_from_training_rows_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang")
    assert fit(docs, ~held_out()) == fit(other, ~held_out())


def test_odd_rows(spark, messy, nothing):
    model = fit(messy)
    assert set(model.dictionaries) == {"en", "de"}
    df = classify(messy.withColumnRenamed("source", "score"), model)
    rows = df.collect()
    assert len(rows) == messy.count() and df.columns.count("score") == 1
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in model.dictionaries
    assert fit(nothing) == Model({})
    assert classify(nothing, Model({})).count() == 0
    assert Classifier(Model({})).predict("some text") == ("und", 0.0, False)
    assert Classifier(Model({"en": b"aaaaaaaa", "fr": b"aaaaaaaa"})).predict("tie")[::2] == ("en", False)


def test_rejects_unlearned_and_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and length(text) > 400").cache()
    texts = {lang: [r.text for r in docs.filter(f"lang = '{lang}'").orderBy("doc_id").limit(40).collect()] for lang in ("de", "en", "es", "fr")}
    for left_out in ("de", "fr"):
        known = Classifier(fit(docs.filter(docs.lang != left_out)))
        assert sum(known.predict(t)[2] for t in texts[left_out]) <= 0.1 * len(texts[left_out])
        assert sum(known.predict(t)[2] for t in texts["en"]) >= 0.95 * len(texts["en"])
    known = Classifier(fit(docs))
    halves = [(a[:2000], b[:2000]) for a, b in zip(texts["de"], texts["fr"])]
    even = [(a[: min(len(a), len(b))], b[: min(len(a), len(b))]) for a, b in halves]
    words = [" ".join(w for pair in zip(a.split(), b.split()) for w in pair) for a, b in even]
    assert sum(known.predict(t)[2] for t in words) <= 0.25 * len(words)
    assert known.predict("ζηθ αβγ δεζ ικλμ νξο πρστ " * 30)[2] is False


def test_every_sampled_text_has_a_share_of_the_dictionary(spark):
    letter = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    rows = [(i, " ".join([letter(i)] * 200), "xx") for i in range(400)]
    made = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).dictionaries["xx"]
    assert len(made) <= DICTIONARY_BYTES
    assert all(letter(i).encode() in made for i in range(400))


def joined(spark, lang, size):
    """A long text of many learned ones; every other document, so that the dictionary has not seen it all."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(f"lang = '{lang}' and source <> 'src0'").select("doc_id", "text")
    text = "\n".join(r.text for r in rows.orderBy("doc_id").collect())
    return text[:size]


def test_long_texts_are_accepted_and_unlearned_ones_are_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").cache()
    model = fit(docs)
    known = Classifier(model)
    long_texts = {lang: joined(spark, lang, 1_000_000) for lang in model.dictionaries}
    for lang, text in long_texts.items():
        assert len(text) == 1_000_000
        for size in (1_000, 30_000, 200_000, 1_000_000):
            assert known.predict(text[:size])[::2] == (lang, True), (lang, size)
    for lang, text in long_texts.items():
        others = Classifier(Model({k: v for k, v in model.dictionaries.items() if k != lang}))
        assert others.predict(text)[2] is False, lang


@pytest.mark.parametrize("words", ["long words ", "the and that with ", "und die der nicht ", "x "])
def test_repeated_words_keep_the_answer_of_a_short_piece(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    known = Classifier(fit(docs))
    short, long = known.predict(words * 1000), known.predict(words * 100_000)
    assert short[::2] == long[::2]


def test_blocks_are_the_whole_text():
    for data in (b"", b"a", b"word " * 20_000, b"x" * 100_000, b"x" * BLOCK_BYTES, ("é" * 9 + " ").encode() * 30_000):
        parts = blocks(data)
        assert b"".join(parts) == data
        assert all(len(p) <= BLOCK_BYTES * 3 // 2 for p in parts)
        assert all(len(p) >= BLOCK_BYTES for p in parts[:-1])


def test_equals_plain_compression(spark):
    """Sizes from fresh compressors, one language and one block at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, ~held_out())
    found = {(r.doc_id, r.lang_pred, r.accepted) for r in op2_langid(spark, SF).collect()}

    def sizes(data, level):
        out = {}
        for lang, content in model.dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            total = 0
            for part in blocks(data):
                raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress(part))
            out[lang] = total
        return sorted((n, lang) for lang, n in out.items())

    for r in docs.filter("doc_id % 12 = 0").collect():
        data = langid.letters(r.text or "").encode()
        if not any(map(str.isalpha, data.decode())):
            assert (r.doc_id, "und", False) in found
            continue
        clear = lambda s: s[1][0] - s[0][0] >= max(langid.CLOSE * s[0][0], langid.CLOSE_BYTES)
        got = sizes(data, langid.LEVEL) if len(data) >= langid.SHORT_BYTES else sizes(data, langid.CLOSE_LEVEL)
        if len(data) >= langid.SHORT_BYTES and not clear(got):
            got = sizes(data, langid.CLOSE_LEVEL)
        assert (r.doc_id, got[0][1], clear(got)) in found
