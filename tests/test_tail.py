import json
import random

import pytest

from callsieve.sources import tail as T
from callsieve.sources.files import indexed_lines
from callsieve.streaming import ingest as I


def read(spark, path, since, block=T.BLOCK_BYTES):
    df, size = T.tail_lines(spark, path, since, block)
    rows = sorted(map(tuple, df.collect()))
    return [v for _, v in rows], [i for i, _ in rows], size


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_equals_a_full_read_wherever_it_is_cut(spark, tmp_path, end):
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 0, 1, 2, 7, 40]) + rng.choice(["", "é", "\U0001f600"]) for _ in range(60)]
    file = tmp_path / "f.txt"
    file.write_bytes(end.join(texts).encode() + (end.encode() if texts[-1] else b"last"))
    path = f"file://{file}"
    want = [r.value for r in indexed_lines(spark, path, skip_blank=False).orderBy("row_idx").collect()]
    for block in (1, 3, 16, 100, T.BLOCK_BYTES):
        got, at, size = read(spark, path, T.Bookmark(0, 0), block)
        assert got == want and at == list(range(len(want))) and size == file.stat().st_size


def test_only_new_bytes_are_read(spark, tmp_path):
    file = tmp_path / "f.txt"
    file.write_bytes(b"\xff" * 100 + b"\n")  # what is before the bookmark is not even text
    mark = T.Bookmark(7, 101)
    with file.open("ab") as f:
        f.write(b"one\ntwo\r\n\nthree")
    assert read(spark, str(file), mark)[:2] == (["one", "two", "", "three"], [7, 8, 9, 10])
    assert read(spark, f"file:{file}", mark, 2)[:2] == (["one", "two", "", "three"], [7, 8, 9, 10])


def test_line_that_was_not_ended_is_not_a_new_one(spark, tmp_path):
    file = tmp_path / "f.txt"
    file.write_bytes(b"one\ntw")
    lines, _, size = read(spark, str(file), T.Bookmark(0, 0))
    assert lines == ["one", "tw"]
    with file.open("ab") as f:
        f.write(b"o\nthree\n")
    assert read(spark, str(file), T.Bookmark(2, size))[:2] == (["three"], [2])
    with file.open("ab") as f:
        f.write(b"\r")
    mark = T.Bookmark(4, file.stat().st_size)
    with file.open("ab") as f:
        f.write(b"\nfive")
    assert read(spark, str(file), mark)[:2] == (["five"], [4])


def test_files_that_cannot_be_read_this_way(spark, tmp_path):
    file = tmp_path / "f.txt"
    file.write_text("short\n")
    assert T.tail_lines(spark, str(file), T.Bookmark(9, 900)) is None
    assert T.tail_lines(spark, "unknown://host/f.txt", T.Bookmark(0, 0)) is None
    lines, at, _ = read(spark, str(file), T.Bookmark(1, 6))
    assert (lines, at) == ([], [])


def test_landing_reads_from_the_bookmark(spark, tmp_path, folder, monkeypatch):
    line = lambda i: json.dumps({"event_id": f"e{i}", "occurred_at": "2031-02-03T04:05:06Z", "source": "s", "transcript": "text"}) + "\n"
    file, store = tmp_path / "g.jsonl", I.StreamStore(f"{folder}/s")
    asked = []
    real = T.tail_lines
    monkeypatch.setattr(I, "tail_lines", lambda spark, path, since: asked.append(since) or real(spark, path, since))
    size = 0
    for k in range(3):
        with file.open("a") as f:
            f.write("".join(line(10 * k + i) for i in range(10)))
        assert I.process_jsonl(spark, f"file://{file}", store, "p/1").first().accepted == 10
        assert asked[-1] == T.Bookmark(10 * k, size)
        size = file.stat().st_size
    monkeypatch.setattr(I, "tail_lines", lambda *_: None)  # no byte known: everything is read, with the same result
    with file.open("a") as f:
        f.write(line(30) + line(0))
    r = I.process_jsonl(spark, f"file://{file}", store, "p/1").first()
    assert (r.accepted, r.duplicates, r.next_offset) == (1, 1, 32)
