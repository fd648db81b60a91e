"""WARC archives: written from pages, read back, and assembled into captures.

:func:`write_archive` writes a request, a response or revisit, and a metadata
record per page, gzip member by member. :func:`read_records` streams archives
into one row per record. :func:`assemble` joins request, response and metadata
records through WARC-Concurrent-To into one nested row per capture. It looks
at record headers only, in any order and from any file: the link may be on
either record, and a record may be linked to one that is linked to the
response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkset.llm import files
from linkset.llm.common import arrow_limits, attach, table
from linkset.plans.solve import connected_components_named
from linkset.plans.workspace import Workspace

MIN_SHARED = 1000              # payloads under so many bytes never become revisits
FILE_BYTES = 64 << 20          # an archive is closed beyond this
DATE = "2020-01-01T00:00:00Z"  # pages carry no date of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")


def record_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def record(kind: str, rid: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    head = "WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def capture_records(main: str, page_id: int | None, url: str | None, payload: bytes | None,
                    size: int, sha1: str, refers_to: str | None) -> list[bytes]:
    """The three records of a page, ``main`` is the id of its response; ``refers_to``
    makes it a revisit of that record, which needs the payload's size only."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    parts = None
    try:
        parts = urlsplit(url or "")
    except ValueError:
        pass
    path = ((parts.path or "/") + ("?" + parts.query if parts.query else "")) if parts else "/"
    host = parts.netloc if parts else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    shared = {"WARC-Target-URI": url, "WARC-Payload-Digest": digest}
    if refers_to is None:
        body = record("response", main, shared | {
            "Content-Type": "application/http; msgtype=response"}, http + payload)
    else:
        body = record("revisit", main, shared | {
            "WARC-Profile": PROFILE, "WARC-Refers-To": refers_to,
            "Content-Type": "application/http; msgtype=response"}, http)
    linked = {"WARC-Target-URI": url, "WARC-Concurrent-To": main}
    ask = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(errors="replace")
    note = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id),) if v is not None).encode()
    return [record("request", record_id(), linked | {
                "Content-Type": "application/http; msgtype=request"}, ask), body,
            record("metadata", record_id(), linked | {
                "Content-Type": "application/warc-fields"}, note)]


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``page_id url payload size sha1 refers_to shared`` rows as archives
    under ``folder``, every row under record ids of its own. The lazy result has
    one row ``uri records`` per file, and one row ``sha1 response`` with the id of
    its response per ``shared`` row. Write it to a table first and take the
    archives' names and the ids from there."""
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, n, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        def rows(uris, records, digests, ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(uris, pa.string()), pa.array(records, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(ids, pa.string())],
                names=["uri", "records", "sha1", "response"])

        for b in batches:
            ids: list[tuple[str, str]] = []
            for *row, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    uri, n, size = files.new_name(folder, ".warc.gz"), 0, 0
                    out = files.open_out(uri)
                main = record_id()
                if shared:
                    ids.append((row[4], main))
                for rec in capture_records(main, *row):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(rec) + z.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size > FILE_BYTES:
                    out.close()
                    out = None
                    done.append((uri, n))
            if ids:
                yield rows([None] * len(ids), [None] * len(ids), *zip(*ids, strict=True))
        if out is not None:
            out.close()
            done.append((uri, n))
        yield rows([d[0] for d in done], [d[1] for d in done], [None] * len(done), [None] * len(done))

    columns = pages.select("page_id", "url", F.col("payload").cast("binary"), "size", "sha1", "refers_to", "shared")
    return columns.mapInArrow(run, "uri string, records long, sha1 string, response string")


def parse(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of each record of an open archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        yield headers, stream.read(int(headers["content-length"][0]))


RECORD = ("record_id string, type string, date string, target_uri string, concurrent_to array<string>, "
          "refers_to string, payload_digest string, payload_bytes long, payload_sha1 string, "
          "fields array<struct<name:string,value:string>>, payload binary")


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in column ``uri``; without
    ``payloads`` the bytes are measured and hashed, but not returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()),
            ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())),
            ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload_sha1", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
            ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for uri in b.column(0).to_pylist():
                with files.open_in(uri) as raw, gzip.open(raw) if uri.endswith(".gz") else io.BufferedReader(raw) as f:
                    for h, block in parse(f):
                        one = lambda k: h.get(k, [None])[0]  # noqa: B023,E731
                        http = "application/http" in (one("content-type") or "")
                        payload = block.partition(b"\r\n\r\n")[2] if http else block
                        body = one("warc-type") == "response"
                        fields = []
                        if one("content-type") == "application/warc-fields":
                            fields = [{"name": k.strip(), "value": v.strip()} for k, c, v in (
                                x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if c]
                        rows.append((one("warc-record-id"), one("warc-type"), one("warc-date"),
                                     one("warc-target-uri"), h.get("warc-concurrent-to", []),
                                     one("warc-refers-to"), one("warc-payload-digest"), len(payload),
                                     hashlib.sha1(payload).hexdigest() if body else None,
                                     fields, payload if payloads else None))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield flush()
                            rows, held = [], 0
        yield flush()

    return archives.select("uri").mapInArrow(run, RECORD)


def assemble(records: DataFrame, workspace: Workspace) -> DataFrame:
    """One nested row per capture: ``capture_id type response requests metadata``.

    A capture is a response, revisit or resource record with all the requests,
    metadata and other records that are concurrent to it, directly or through
    any number of records that are none of these three (also through an id that
    no record has). A record concurrent to several captures is in each of them;
    records linked to none are, with what they are linked to, a capture without a response,
    under their smallest id. ``requests`` and ``metadata`` are arrays by id. Records
    with an equal id are one record. ``records`` must be a written table.
    """
    r = records.dropDuplicates(["record_id"])
    head = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    is_anchor = F.col("type").isin(*ANCHORS)
    link = records.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y"))
    pairs = workspace.save(link.unionByName(link.select(F.col("y").alias("x"), F.col("x").alias("y")))
                           .distinct(), "pairs")
    anchors = r.where(is_anchor).select(F.col("record_id").alias("y"))
    loose = pairs.join(anchors.withColumnRenamed("y", "x"), "x", "left_anti")     # from all other records
    near = workspace.save(loose.join(anchors, "y", "left_semi").select("x", F.col("y").alias("capture_id")), "near")
    among = workspace.save(loose.join(anchors, "y", "left_anti").where("x < y"), "among")
    others = r.where(~is_anchor).withColumn("x", F.col("record_id"))
    if among.isEmpty():
        placed = others.join(near, "x", "left")
    else:
        group = workspace.save(connected_components_named(among, src="x", dst="y", workspace=workspace)
                               .select(F.col("name").alias("x"), F.col("component").alias("group")), "groups")
        of = lambda rows: rows.join(group, "x", "left").withColumn("group", F.coalesce("group", "x"))
        captures = of(near).select("group", "capture_id").distinct()
        placed = of(others).join(captures, "group", "left").withColumn("x", F.col("group"))
    mine = placed.withColumn("capture_id", F.coalesce("capture_id", "x")).groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", head))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", F.struct(
            "record_id", "type", "target_uri", "fields", "payload")))).alias("metadata"))
    main = r.where(is_anchor).select(F.col("record_id").alias("capture_id"), "type", head.alias("response"))
    return main.join(mine, "capture_id", "full").withColumns({
        c: F.coalesce(c, F.array()) for c in ("requests", "metadata")})


def crawl(pages: DataFrame, workspace: Workspace, min_shared: int = MIN_SHARED) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; returns their names.

    Responses are written first. The ids that they got are looked up when the
    revisits are written, so that rows may be equal in everything. Only payloads
    that repeat are looked up, so pages are not shuffled unless very many
    payloads repeat.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    owners = (p.select("page_id", "sha1", "size").where(F.col("size") >= min_shared)
              .groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")))
    owners = workspace.save(owners.where("n > 1"), "owners")
    again = F.coalesce(F.col("page_id") != F.col("owner"), F.lit(False))     # never of a page without id
    first = attach(p, owners, ["sha1"], "n", ["page_id", "url"]).where(~again)
    first = first.withColumns({"refers_to": F.lit(None).cast("string"),
                               "shared": F.coalesce(F.col("page_id") == F.col("owner"), F.lit(False))})
    folder = f"{workspace.root}/warc"
    done = workspace.save(write_archive(first, folder), "responses")
    archives = done.where("uri is not null").select("uri", "records")
    ids = done.where("response is not null").groupBy("sha1").agg(F.min("response").alias("refers_to"))
    ids = workspace.save(owners.join(ids, "sha1"), "owner-ids")
    if ids.isEmpty():
        return archives
    rest = attach(p.drop("payload"), ids, ["sha1"], "n", ["page_id", "url"]).where(again)
    rest = rest.withColumns({"payload": F.lit(None).cast("string"), "shared": F.lit(False)})
    done = workspace.save(write_archive(rest, folder), "revisits")
    return archives.unionByName(done.select("uri", "records"))


def page_captures(captures: DataFrame, workspace: Workspace) -> DataFrame:
    """``page_id payload_bytes payload_digest record_type refers_to target_uri``
    of each capture; a revisit takes length and page of what it refers to."""
    noted = F.flatten(F.transform("metadata", lambda m: m["fields"]))
    page = F.get(F.filter(noted, lambda f: f["name"] == "page-id"), F.lit(0))["value"]
    flat = captures.select(
        "capture_id", page.cast("long").alias("page_id"), "type",
        F.col("response.target_uri").alias("target_uri"), F.col("response.refers_to").alias("ref"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_sha1").alias("sha1"))
    flat = workspace.save(flat, "captures")
    asked = flat.where("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    owner = flat.select(F.col("capture_id").alias("ref"), F.col("page_id").alias("owner"),
                        F.col("bytes").alias("owner_bytes"), F.col("sha1").alias("owner_sha1"))
    owner = workspace.save(owner.join(asked, "ref"), "referred")
    j = attach(flat, owner, ["ref"], "n", ["capture_id"])
    again = F.col("type") == "revisit"
    return j.select("page_id", F.when(again, F.col("owner_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
                    F.when(again, F.col("owner_sha1")).otherwise(F.col("sha1")).alias("payload_digest"),
                    F.col("type").alias("record_type"), F.col("owner").alias("refers_to"), "target_uri")


def op1_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; among equal payloads the rows with the
    largest page_id, and those without one, are responses; every row is a
    capture of its own, also if it equals another; a null page_id or url is
    kept as null; an empty table gives no rows."""
    ws = Workspace(spark, label="op1")
    archives = crawl(table(spark, sf_dir, "pages"), ws)
    spread = archives.repartition(max(1, archives.count()), "uri")
    records = ws.save(read_records(spread, payloads=False), "records")
    return page_captures(assemble(records, ws), ws)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html,
                  octet_length(encode(coalesce(html, ''))) AS payload_bytes, url FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to, url AS target_uri
FROM p LEFT JOIN o USING (html)
"""
