"""Operator 5: WARC archives: write captures, read records back, assemble transactions.

``write_archives`` turns each page into request, response (or revisit) and metadata records and lets Spark's text writer store them: one record
a row, two line ends between records, gzip by file, any file system that Spark writes to. ``read_records`` parses archives inside tasks,
``assemble`` joins request, response and metadata records through their concurrent-to identifiers and emits one nested row per capture.

Of captures with equal payloads of at least ``floor`` bytes the one with the largest page_id is the response and the others revisit it. Equality
is by SHA-256 and length.

Defined cases: null html is an empty payload; a null url is written as ``urn:none`` and control characters in urls as %20; a null page_id is
smaller than all others and comes back as null; repeated rows are captures of their own, of which one is the response; an empty table gives
no rows; other columns are ignored. A capture without request or metadata keeps nulls there.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, read, scratch_path, settle, typed

END = "\r\n"
FLOOR_BYTES = 1000
#: Records an archive holds at most, so that one archive fits a task.
RECORDS_PER_FILE = 9_000
#: Groups of equal payloads up to which their table (digest and id) is broadcast, about 40 MB.
FEW_GROUPS = 250_000
_RECORD = "record_id string, type string, concurrent_to string, uri string, date string, digest string, refers_to string, payload_bytes long, fields map<string,string>"


def _urn(*parts: Column) -> Column:
    """A record identifier in UUID form from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, rid: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """Header lines (null ones left out) and block of one record as a string."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def dedup_plan(pages: DataFrame, floor: int = FLOOR_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) plus payload, sizes, digests and ``keeper``: the page_id of the response that stands for the payload.

    Only digests are grouped. Tables of few groups are broadcast, larger ones joined by shuffle; payloads move in the latter case alone.
    """
    rows = typed(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary")), "same": F.sha2("html", 256)})
    long = rows.where(F.col("payload_bytes") >= floor)
    groups = settle(
        long.groupBy("same", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1).select("same", F.col("payload_bytes").alias("bytes"), "keeper")
    )
    side = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups
    side = side.withColumnRenamed("same", "group")
    joined = rows.join(side, (F.col("same") == F.col("group")) & (F.col("payload_bytes") == F.col("bytes")), "left")
    return joined.withColumn("grouped", F.col("group").isNotNull()).drop("group", "bytes")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", floor: int = FLOOR_BYTES) -> None:
    """Write one capture per row of ``pages``. The keeper of a group is a response; among rows equal to it in page_id, one by url."""
    rows = dedup_plan(pages, floor)
    # rows of a group that share the keeper's page_id: the first by url is the response
    lead = rows.where(F.col("grouped") & F.col("page_id").eqNullSafe(F.col("keeper")))
    ties = settle(lead.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("url", F.lit(""))).alias("first_url")).where(F.col("n") > 1))
    maybe = F.col("grouped") & F.col("page_id").eqNullSafe(F.col("keeper"))
    if ties.isEmpty():
        rows = rows.withColumn("is_response", ~F.col("grouped") | maybe)
    else:
        tied = F.broadcast(ties) if ties.count() <= FEW_GROUPS else ties
        rows = rows.join(tied.select(F.col("same").alias("tie"), "first_url"), F.col("same") == F.col("tie"), "left")
        lead = maybe & (F.col("tie").isNull() | (F.coalesce("url", F.lit("")) == F.col("first_url")))
        one = F.row_number().over(Window.partitionBy(F.when(lead & F.col("tie").isNotNull(), F.col("same")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))).orderBy("page_id"))
        rows = rows.withColumn("is_response", ~F.col("grouped") | (lead & (one == 1)))
    row_key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "same", F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("row_key", row_key)
    group_id = _urn(F.lit("group"), "same")
    rid = F.when(F.col("is_response") & F.col("grouped"), group_id).otherwise(_urn(F.lit("capture"), "row_key"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")
    rows = rows.withColumns({"rid": rid, "uri": uri})
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    revisit = ~F.col("is_response")
    only = lambda c: F.when(revisit, c)
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("rid"),
        [*common, digest, ("WARC-Refers-To", only(group_id)), ("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))],
        "application/http;msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    tied_to = [*common, ("WARC-Concurrent-To", F.col("rid"))]
    request = _record("request", _urn(F.lit("request"), "row_key"), tied_to, "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{END}{END}")))
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(f"{END}payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(END)
    )
    metadata = _record("metadata", _urn(F.lit("metadata"), "row_key"), tied_to, "application/warc-fields", fields)
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END + END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _inflated(content: bytes):
    """Pieces of a gzip file of one or more members, or of plain bytes."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        member = zlib.decompressobj(31)
        at = 0
        while at < len(rest) and not member.eof:
            yield member.decompress(rest[at : at + (1 << 18)])
            at += 1 << 18
        tail = member.flush()
        if tail:
            yield tail
        rest = member.unused_data + rest[at:] if member.eof else b""


def parse_records(content: bytes):
    """(headers with lower-case names, block) of each record; lengths come from Content-Length, so blocks may hold any bytes."""
    buffer, at = bytearray(), 0
    pieces = _inflated(content)

    def fill(upto: int | None) -> bool:
        """Read on until ``upto`` bytes or, without it, until a header's end is there."""
        nonlocal at
        while (len(buffer) - at < upto) if upto is not None else (buffer.find(b"\r\n\r\n", at) < 0):
            piece = next(pieces, None)
            if piece is None:
                return False
            if at > 1 << 20:
                del buffer[:at]
                at = 0
            buffer.extend(piece)
        return True

    while True:
        while fill(2) and buffer[at : at + 2] == b"\r\n":
            at += 2
        if not fill(None):
            if bytes(buffer[at:]).strip():
                raise ValueError("truncated WARC record")
            return
        end = buffer.find(b"\r\n\r\n", at)
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        length = int(headers["content-length"])
        if not fill(length):
            raise ValueError("truncated WARC record")
        block = bytes(buffer[at : at + length])
        at += length
        yield headers, block


def _reader(with_payload: bool):
    names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * with_payload

    def flush(rows):
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches):
        rows, held = [], 0
        for b in batches:
            for content in b.column("content"):
                for h, block in parse_records(content.as_py()):
                    kind, payload, fields, digest = h.get("warc-type"), None, None, None
                    if kind in ("response", "revisit", "request"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                    if kind == "response":
                        digest = hashlib.sha1(payload).hexdigest()
                        if h.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                            raise ValueError(f"payload of {h.get('warc-record-id')} does not match its digest")
                    elif kind == "revisit":
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    row = [h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, h.get("warc-refers-to"), None if payload is None else len(payload), fields]
                    rows.append(tuple(row + [payload] * with_payload))
                    held += len(block) * with_payload + 500
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)

    return work


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; lengths and digests are of the bytes read, payloads themselves on request."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), _RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, its request and its metadata fields, joined by concurrent-to identifiers."""
    main = records.where(F.col("type").isin("response", "revisit"))
    main = main.select(F.col("record_id").alias("capture_id"), F.struct(*(c for c in main.columns if c not in ("concurrent_to", "fields"))).alias("response"))
    tied = records.where(F.col("concurrent_to").isNotNull())
    requests = tied.where("type = 'request'").groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "uri", "date")).alias("request"))
    metadata = tied.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by("fields", "record_id").alias("metadata"))
    return main.join(requests, "capture_id", "left").join(metadata, "capture_id", "left")


def page_records(captures: DataFrame) -> DataFrame:
    """The digest of a capture per page: revisits are resolved to the page of the response that they refer to."""
    page = F.col("metadata").getItem("page-id")
    rows = settle(
        captures.select(
            "capture_id", F.when(page != "none", page).cast("long").alias("page_id"), F.col("metadata").getItem("payload-bytes").cast("long").alias("stated"),
            F.col("response.payload_bytes").alias("held"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("ref"), F.col("response.uri").alias("uri"),
        )
    )
    refs = rows.where(F.col("ref").isNotNull()).select("ref").distinct()
    target = settle(rows.where("record_type = 'response'").select(F.col("capture_id").alias("ref"), F.col("page_id").alias("refers_to")).join(refs, "ref", "left_semi"))
    target = F.broadcast(target) if target.count() <= FEW_GROUPS else target
    full = F.when(F.col("record_type") == "response", F.col("held")).otherwise(F.col("stated"))
    return rows.join(target, "ref", "left").select("page_id", full.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "uri")


@query(
    "op5_warc_transactions",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
    FROM k
    """,
)
def op5(spark, sf):
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf, "pages"), path)
    captures = assemble(read_records(spark, path))
    return page_records(captures).drop("uri")
