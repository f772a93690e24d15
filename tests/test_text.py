import hashlib

from pyspark.sql import functions as F

from callsieve.functions import text as X

ODD = [
    "", " ", "a b  c d", "x\r\ny\n\n z\x1c\x1dq\x85w e\x0bk", "a1²⑨٣\U00011f50",
    "HTTPS://x", "see WWW.y", "\U0001f600 é", "\x1f\x1f a", "\n\n", "t​x", " lead and trail　",
    "one line", "  ", "p\x0cq", "tab\tsep\t\tx", "\x1ea\x1f \x1eb",
]


def test_features_equal_python_on_odd_unicode(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    t = F.col("t")
    rows = df.select(
        "i", X.fingerprint(t).alias("fp"), X.strip(t).alias("s"),
        *[c.alias(k) for k, c in X.text_features(t).items()],
    ).collect()
    for r in rows:
        s = ODD[r.i]
        flat = " ".join(s.split())
        assert r.fp == hashlib.sha256(flat.encode()).hexdigest()
        assert r.s == s.strip()
        assert r.char_count == len(s)
        assert r.word_count == len(s.split())
        assert r.turn_count == max(sum(bool(x.strip()) for x in s.splitlines()), 1)
        assert r.digit_ratio == sum(c.isdigit() for c in s) / max(len(s), 1)
        assert r.has_url == int(any(m in s.lower() for m in X.URL_MARKS))


def test_every_white_space_code_point_is_known():
    assert X.WHITESPACE_CHARS == "".join(c for c in map(chr, range(0x110000)) if c.isspace())


def test_missing_text(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(X.fingerprint(F.col("t")).alias("fp"), X.turn_count(F.col("t")).alias("n")).first()
    assert r.fp == hashlib.sha256(b"None").hexdigest() and r.n is None


def test_same_entity_for_respaced_text(spark):
    a, b = "Clerk: 3 parcels\nVisitor: mine\nsee www.parcels.example", "Clerk: 3  parcels Visitor: mine\tsee www.parcels.example"
    rows = (
        spark.createDataFrame([(a,), (b,)], "t string")
        .select("t", X.fingerprint(F.col("t")).alias("fp"), X.turn_count(F.col("t")).alias("n"))
        .collect()
    )
    assert rows[0].fp == rows[1].fp
    assert {r.t: r.n for r in rows} == {a: 3, b: 1}


def test_extract_transcript(spark):
    cases = {
        "sys\n\nTranscript:\nhello\n\nVerdict:": "hello",
        "no markers": "no markers",
        "Transcript:\nopen end": "open end",
        "Transcript:\na\n\nVerdict: b\n\nVerdict:": "a",
        "\n\nVerdict:Transcript:\nx": "x",
        "Transcript:\nTranscript:\ny\n\nVerdict:": "Transcript:\ny",
        "Transcript:\n\n\nVerdict:": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    for r in df.select("p", X.extract_transcript(F.col("p")).alias("t")).collect():
        assert r.t == cases[r.p]


def test_excerpt(spark):
    texts = ["a|b \n c", "x" * 180, "y" * 181]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.e for r in df.select("t", X.excerpt(F.col("t")).alias("e")).collect()}
    assert got[texts[0]] == "a\\|b c"
    assert got[texts[1]] == texts[1]
    assert got[texts[2]] == "y" * 179 + "…"
