import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callsieve.llm import arc_warc as a
from callsieve.llm.queries import op4_warc

records = st.lists(st.tuples(st.sampled_from(["http://a/", "dns:x", "http://b/x y"]), st.just("1.2.3.4"), st.just("20010203040506"), st.just("text/html"), st.binary(max_size=80)))


@settings(max_examples=150, deadline=None)
@given(records, st.sampled_from([1, 2]))
def test_arc_round_trip(rows, version):
    found = list(a.parse_arc(a.write_arc("f.arc", version, rows)))
    assert [(r.url, r.ip, r.date, r.type, r.body) for r in found] == rows


def test_arc_faults():
    with pytest.raises(ValueError):
        list(a.parse_arc(b"http://a/ 1.2.3.4 20010203040506 text/html 3\nabc\n"))
    with pytest.raises(ValueError):
        list(a.parse_arc(a.write_arc("f", 1, []) + b"not a header line\n"))
    cut = a.write_arc("f", 1, [("http://a/", "-", "2001", "text/html", b"0123456789")])[:-4]
    assert a.converted(next(a.parse_arc(cut)))[-1] is True


def test_dates_types_and_ids():
    assert a.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert a.iso_date("200102") == "2001-02-01T00:00:00Z"
    assert a.converted(a.ArcRecord("dns:x", "-", "2001", "text/dns", 3, b"abc"))[4] == "resource"
    row = a.converted(a.ArcRecord("http://a/", "-", "2001", "text/html", 40, b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nbody"))
    assert row[0] == 7 and row[6] == b"body" and row[4] == "response"
    assert a.record_id("u", "d", "x", 1) == a.record_id("u", "d", "x", 1) != a.record_id("u", "d", "x", 2)


def expected(rows):
    smallest = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 100 and page_id is not None:
            smallest[html] = min(smallest.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = smallest.get(html) if len(body) >= 100 else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages(spark, tmp_path):
    long = "é" * 60
    rows = [
        (5, "http://a/", long), (3, None, long), (3, None, long), (None, "http://b/ c", long), (9, "http://c/", long + "WARC/1.1\r\n\r\n"),
        (1, "http://d/", "short"), (2, "http://d/", "short"), (4, "http://e/", None), (6, "http://e/", ""), (7, "http://f/", "\r\n\r\n" * 40),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    # what a revisit names is the record identifier of its response, and payloads come back whole
    a.pages_to_warc(df, f"file://{tmp_path}/warc")
    back = a.read_warc(spark, f"file://{tmp_path}/warc").collect()
    ids = {r.key: r.record_id for r in back if r.record_type == "response"}
    assert all(ids[r.refers_to] == r.refers_to_id for r in back if r.record_type == "revisit")
    whole = sorted(r.block.split(b"\r\n\r\n", 1)[1] for r in back if r.record_type == "response")
    assert whole == sorted((html or "").encode() for k, _, html in rows if k in ids)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op4_warc(spark, str(tmp_path)).count() == 0


def test_responses_are_told_from_the_converted_records(spark, tmp_path):
    """Archives of others, whose payloads no table of pages knows."""
    body = lambda k, x: f"HTTP/1.1 200 OK\r\nX-Page-Id: {k}\r\n\r\n{x}".encode()
    first = a.write_arc("a.arc", 1, [("http://a/", "-", "20010203", "text/html", body(7, "x" * 200)), ("http://b/", "-", "2002", "text/html", body(3, "y" * 200))])
    second = a.write_arc("b.arc", 2, [("http://c/", "-", "2003", "text/html", body(2, "x" * 200)), ("http://d/", "-", "2004", "text/html", body(9, "short"))])
    archives = spark.createDataFrame([("a.arc", first), ("b.arc", second)], "name string, content binary")
    a.archives_to_warc(archives, f"file://{tmp_path}/warc")
    back = {r.key: r for r in a.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in back.items()} == {7: ("revisit", 2), 3: ("response", None), 2: ("response", None), 9: ("response", None)}
    assert back[7].refers_to_id == back[2].record_id and back[7].date == "2001-02-03T00:00:00Z"


def test_many_copies_of_one_page(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "error page " * 20 if i % 3 == 0 else f"page {i} " * 20) for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
