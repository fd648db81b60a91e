import gzip
import hashlib
import io
import os

import duckdb
import pytest

from linkset.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha1 string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


def run(spark, ws, rows, **kw):
    archives = warc.crawl(pages(spark, rows), ws, **kw)
    records = ws.save(warc.read_records(archives), "records")
    return archives, records, warc.assemble(records, ws)


def test_round_trip(spark, ws):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/x?y=1", big), (2, None, big), (9, "http://b", big), (4, "http://c\r\nEvil: 1", "small"),
            (5, "http://[bad", "small"), (6, "", None), (7, "http://é/ü", ""), (8, "http://long", "z" * 3_000_000),
            (None, "http://null", "no id"), (3, "http://twice", "again"), (3, "http://twice", "again")]
    archives, records, captures = run(spark, ws, rows)
    assert records.count() == 3 * len(rows)
    got = {r.page_id: r for r in warc.page_captures(captures, ws).collect()}
    assert len(got) == 10                       # by id: two rows share one
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        owner = 9 if i in (1, 2) else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), owner)
        assert r.record_type == ("revisit" if owner else "response")
    nested = captures.where("type = 'response'").collect()
    html = {(r or "").encode() for _, _, r in rows}
    assert {bytes(c.response.payload) for c in nested} == html
    assert all([q.type for q in c.requests] == ["request"] and len(c.metadata) == 1 for c in nested)


def test_every_row_is_a_capture(spark, ws):
    """Repeated rows, equal ids with other urls, and many rows without an id."""
    big, other = "b" * 2000, "é" * 600
    rows = [(1, "http://a", big), (1, "http://a", big), (1, "http://b", big),          # revisits
            (7, "http://a", big), (7, "http://a", big), (7, "http://c", big), (7, None, big),
            (None, "http://n", big), (None, "http://n", big), (None, None, big),
            (None, "http://n", None), (None, "http://n", None), (None, None, None), (None, None, ""),
            (None, "http://o", other), (None, "http://o", other),
            (3, "http://s", "small"), (3, "http://s", "small"), (3, "http://t", "small"), (4, "http://s", "small")]
    _, records, captures = run(spark, ws, rows)
    assert records.count() == records.select("record_id").distinct().count() == 3 * len(rows)
    main = {r.record_id: r.type for r in records.collect()}
    assert all(main[r.refers_to] == "response" for r in records.where("refers_to is not null").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    res = con.execute(warc.OP1_SQL)
    cols = [d[0] for d in res.description]
    got = [tuple(r) for r in warc.page_captures(captures, ws).select(cols).collect()]
    assert sorted(got, key=repr) == sorted(res.fetchall(), key=repr)


def test_archives_are_members_any_reader_can_open(spark, ws):
    archives, _, _ = run(spark, ws, [(i, "http://x", "p" * 2000) for i in range(5)])
    n = 0
    for r in archives.collect():
        path = r.uri.removeprefix("file:")
        assert os.path.exists(path)
        with gzip.open(path) as f:
            found = list(warc.parse(f))
        assert len(found) == r.records
        n += sum(h["warc-type"] == ["revisit"] for h, _ in found)
    assert n == 4


def test_links_may_be_on_either_record(spark, ws):
    """Response names request; metadata names request; another names nothing."""
    rec = lambda kind, rid, to: warc.record(kind, rid, {
        "WARC-Concurrent-To": to, "Content-Type": "application/warc-fields"}, b"page-id: 5\r\n")
    data = (rec("metadata", "<m>", "<q>") + rec("response", "<r>", "<q>") + rec("request", "<q>", None)
            + rec("metadata", "<alone>", None))
    rows = [("f", h, b) for h, b in warc.parse(io.BytesIO(data))]
    assert [h["warc-record-id"][0] for _, h, _ in rows] == ["<m>", "<r>", "<q>", "<alone>"]
    path = f"{ws.root.removeprefix('file:')}/hand.warc"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    records = ws.save(warc.read_records(spark.createDataFrame([(f"file://{path}",)], "uri string")), "r")
    got = {c.capture_id: c for c in warc.assemble(records, ws).collect()}
    assert set(got) == {"<r>", "<alone>"}
    assert [q.record_id for q in got["<r>"].requests] == ["<q>"] and [m.record_id for m in got["<r>"].metadata] == ["<m>"]
    assert got["<alone>"].response is None


def test_no_record_of_a_foreign_archive_is_lost(spark, ws):
    """Two requests of one response, chains of metadata, a record of two captures,
    one that goes over an id nobody has, and a chain without a response."""
    def rec(rid, kind, *to):
        return (rid, kind, list(to))
    rows = [rec("r", "response"), rec("q1", "request", "r"), rec("q2", "request", "r"), rec("m1", "metadata", "q1"),
            rec("m2", "metadata", "m1"), rec("m3", "metadata", "m2"),
            rec("s", "resource"), rec("both", "metadata", "r", "s"), rec("gone1", "metadata", "nobody"),
            rec("v", "revisit", "nobody"), rec("z1", "request"), rec("z2", "metadata", "z1"), rec("z3", "metadata", "z2"),
            rec("alone", "metadata"), rec("alone", "metadata")]
    schema = warc.RECORD
    names = [c.split()[0] for c in ("record_id type concurrent_to").split()]
    frame = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    empty = spark.createDataFrame([], schema)
    records = ws.save(empty.unionByName(frame.select(*names), allowMissingColumns=True), "hand")
    got = {c.capture_id: ([q.record_id for q in c.requests], [m.record_id for m in c.metadata])
           for c in warc.assemble(records, ws).collect()}
    # m1..m3 hang on q1, both on r and s: what is linked without a response between is in every capture it meets
    assert got == {"r": (["q1", "q2"], ["both", "m1", "m2", "m3"]), "s": ([], ["both"]), "v": ([], ["gone1"]),
                   "z1": (["z1"], ["z2", "z3"]), "alone": ([], ["alone"])}


def test_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"hello\r\n")))


def test_empty(spark, ws):
    _, records, captures = run(spark, ws, [])
    assert records.count() == 0 and warc.page_captures(captures, ws).count() == 0
