import base64
import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest

from ticksmith.llm import queries, warc
from ticksmith.llm.storage import shared_dir


def brute(rows, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) for unique page ids."""
    payload = {p: (h or "").encode() for p, _, h in rows}
    last: dict = {}
    for p, b in payload.items():
        last[b] = max(last.get(b, p), p)
    return sorted((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if last[b] == p or len(b) < min_bytes else ("revisit", last[b]))) for p, b in payload.items())


ROWS = [(1, "http://a", "<p>same</p>"), (2, "http://b\nc", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://e", "WARC/1.1\r\nWARC-Type: fake\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (6, "http://f", "é\r\n\r\nü"), (7, "http://g", "<p>same</p>"), (8, "u", "y" * 300_000)]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, n long").repartition(3)
    assert sorted(map(tuple, warc.write_and_read(pages, min_bytes).collect())) == brute(ROWS, min_bytes)


def test_records_by_hand(spark):
    """Archives are read by a plain parser of the format."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    path = shared_dir(spark, "test-warc")
    warc.write_archives(pages, path)
    data = b"".join(gzip.open(p).read() for p in sorted(Path(path.removeprefix("file://")).glob("part-*")))
    at, found, ids = 0, [], set()
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[at + len(head) + 4 :][:size]
        assert data[at + len(head) + 4 + size :][:4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
        ids.add(fields["WARC-Record-ID"])
        found.append((fields, block.partition(b"\r\n\r\n")[2]))
    assert len(ids) == len(found) == len(ROWS)
    kinds = {int(f["X-Page-ID"]): f["WARC-Type"] for f, _ in found}
    assert kinds == {1: "revisit", 2: "revisit", 3: "revisit", 4: "response", 5: "response", 6: "response", 7: "response", 8: "response"}
    texts = {p: (h or "").encode() for p, _, h in ROWS}
    for f, payload in found:
        if f["WARC-Type"] == "response":
            assert payload == texts[int(f["X-Page-ID"])]
        else:
            assert payload == b"" and f["WARC-Refers-To"] in ids and f["WARC-Profile"].endswith("identical-payload-digest")


def test_odd_ids(spark):
    rows = [(None, "a", "p"), (None, "b", "p"), (3, "c", "q"), (3, "d", "q"), (None, "e", "z")]
    got = warc.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([("None", "response", "None"), ("None", "revisit", "None"), ("3", "response", "None"), ("3", "revisit", "3"), ("None", "response", "None")])
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_equals_its_sql(spark, small):
    got = sorted(map(tuple, queries.op7_warc_revisits(spark, small).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    assert got == sorted(con.execute(queries.OP7_SQL).fetchall(), key=str)


def test_damage_is_found(spark):
    path = shared_dir(spark, "test-warc-damage")
    warc.write_archives(spark.createDataFrame([(1, "u", "hello world")], "page_id long, url string, html string").coalesce(1), path, compression="none")
    file = next(Path(path.removeprefix("file://")).glob("part-*"))
    text = file.read_bytes().replace(b"hello", b"jello")
    copy = shared_dir(spark, "test-warc-damaged")
    folder = Path(copy.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_bytes(text)
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archives(spark, copy).collect()
