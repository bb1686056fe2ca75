"""WARC archives: writing captures and assembling them again from their records.

Writing: each page becomes a request, a response (or revisit) and a metadata record, linked by WARC-Concurrent-To to the
response. Of pages with equal payloads the one with the largest ``page_id`` holds the payload; the others are revisit
records that refer to it (``min_bytes``: smaller payloads are always stored). Who refers to whom is settled on ids and digests alone;
payloads are shuffled once, compressed, by the page they belong to, so one that a third of all pages share makes no task large.

Every record is a gzip member of its own, as WARC readers expect. Spark's text writer writes the members as they are: the
last byte of a member is the highest of its length, zero below 16 MB, so a row is a member without it and the line separator is
that byte. Larger records are cut into several members, which gzip readers take for one stream. Part files are committed
by Spark's own protocol; their number follows from the bytes of all payloads, ``FILE_BYTES`` each.

Reading: archives are inflated member by member and cut at their Content-Length fields, one file at a time. Transactions
are assembled by joining request and metadata records to their response or revisit through the concurrent-to identifier,
and revisits to the response they refer to, giving one nested row per capture.

Defined cases: a null html is an empty payload; a null url gives no WARC-Target-URI and is read back as null; control
characters in a url are percent-encoded in the archive, and the url is read back from the metadata record unchanged.
Pages with a null id, and rows with the id of another page, are captures of their own: record ids come from id, url,
digest and a number among rows that have all three; a null id is smaller than any other. Other columns are ignored. No pages give no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_path, written

#: Bytes of payloads in an archive file, which is read as a whole.
FILE_BYTES = 64 << 20
LEVEL = 4
_DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SMALL = 1 << 24


def _deflated(data: bytes, last: bool) -> bytes:
    """A raw deflate stream; unless it is the last, another can follow it."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _digest_batches(packed: bool):
    def run(batches):
        for t in batches:
            raw = [(x or "").encode() for x in t.column("html").to_pylist()]
            digest = pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw], pa.string())
            more = pa.array([_deflated(x, False) for x in raw], pa.binary()) if packed else pa.array([len(x) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("page_id"), t.column("url"), digest, more], ["page_id", "url", "payload_digest", "packed" if packed else "payload_bytes"])

    return run


def _rows(pages: DataFrame, packed: bool) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(_digest_batches(packed), "page_id long, url string, payload_digest string, " + ("packed binary" if packed else "payload_bytes long"))
    name = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce(F.sha1("url"), F.lit("-")), "payload_digest")
    return rows.withColumn("name", name)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per distinct (page_id, url, payload): its bytes and digest, ``times`` it stands in ``pages``, ``name``, and ``refers_name``,
    the row that holds its payload (itself for one), null where every row holds its own."""
    found = _rows(pages, False).groupBy("name").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload_digest").alias("payload_digest"), F.first("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("times"))
    large = found.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("o"), "name")).alias("top"))
    out = found.join(first, "payload_digest", "left")
    return out.select("page_id", "url", "payload_bytes", "payload_digest", "name", "times", F.when(F.col("payload_bytes") >= min_bytes, F.col("top.name")).alias("refers_name"))


def _uuid(kind: str, key: str) -> str:
    """A name-based record id from the capture's key."""
    h = hashlib.md5(f"{kind}:{key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-a{h[17:20]}-{h[20:]}>"


def _record(kind: str, rid: str, uri: str | None, more: list[str], content_type: str, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {_DATE}", *([f"WARC-Target-URI: {uri}"] if uri is not None else []), *more]
    return _CRLF.join([*lines, f"Content-Type: {content_type}", f"Content-Length: {size}", "", ""]).encode()


def _members(head: bytes, payload: bytes = b"", packed: bytes = b"") -> list[bytes]:
    """A record as gzip members, each without its last byte; ``packed`` is the payload as deflated before."""
    end = b"\r\n\r\n"
    size = len(head) + len(payload) + len(end)
    if size >= _SMALL:
        data = head + payload + end
        return [gzip.compress(data[k : k + _SMALL // 2], LEVEL, mtime=0)[:-1] for k in range(0, size, _SMALL // 2)]
    stream = _deflated(head, False) + packed + _deflated(end, True) if payload else _deflated(head + end, True)
    crc = zlib.crc32(end, zlib.crc32(payload, zlib.crc32(head)))
    return [b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + stream + struct.pack("<II", crc, size)[:-1]]


def _record_rows(name, page_id, url, digest, times, refers_name, packed):
    """The members of the records of all captures with this name."""
    uri = None if url is None else re.sub(r"[\x00-\x20]", "%20", re.sub("[\r\n]", "%0A", url.replace("%", "%25")))
    fields = f"page: {json.dumps({k: v for k, v in (('page_id', page_id), ('url', url)) if v is not None}, ensure_ascii=False)}\r\n".encode()
    ask = b"GET / HTTP/1.1\r\n\r\n"
    for copy in range(times):
        key = f"{name}/{copy}"
        main = _uuid("response", key)
        linked = [f"WARC-Concurrent-To: {main}"]
        yield from _members(_record("request", _uuid("request", key), uri, linked, "application/http; msgtype=request", len(ask)) + ask)
        own = refers_name is None or refers_name == name and not copy
        payload = zlib.decompressobj(-15).decompress(packed) if own else b""
        more = [f"WARC-Payload-Digest: sha1:{digest}"]
        if not own:
            more += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uuid('response', f'{refers_name}/0')}"]
        head = _record("response" if own else "revisit", main, uri, more, "application/http; msgtype=response", len(_HEAD) + len(payload)) + _HEAD.encode()
        yield from _members(head, payload, packed if own else b"")
        yield from _members(_record("metadata", _uuid("metadata", key), uri, linked, "application/warc-fields", len(fields)) + fields)


def _member_batches(batches):
    cols = ("name", "page_id", "url", "payload_digest", "times", "refers_name", "packed")
    for t in batches:
        out, size = [], 0
        for row in zip(*(t.column(c).to_pylist() for c in cols), strict=True):
            for m in _record_rows(*row):
                out.append(m)
                size += len(m)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])


def records(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One binary column: the gzip members of all records, each without its last byte, a zero; a partition is a file."""
    found = captures(pages, min_bytes)
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    payloads = _rows(pages, True).select("name", "packed").repartition(files, "name")
    met = found.repartition(files, "name").join(payloads, "name")
    # repeated rows have the same name and payload: one is enough; the join has sorted them together
    one = met.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("name"))).where("_n = 1").drop("_n")
    return one.mapInArrow(_member_batches, "value binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    out = records(pages, min_bytes, file_bytes).select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").text(path)


def _inflated(data: memoryview):
    """The contents of each gzip member."""
    at, n, step = 0, len(data), 1 << 16
    while at < n:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= n:
                raise ValueError("the archive is cut short")
            piece = data[at : at + step]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(out)


def _parse(data: bytes):
    """(headers, body) of each record of one archive."""
    held = b""
    for part in _inflated(memoryview(data)):
        held = held + part if held else part
        end = held.find(b"\r\n\r\n")
        if end < 0:
            continue
        head = held[:end].decode().split(_CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in head[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if len(held) < stop + 4:
            continue  # goes on in the next member
        if held[stop:] != b"\r\n\r\n":
            raise ValueError(f"the record {fields.get('WARC-Record-ID')} is longer than it says")
        yield fields, held[end + 4 : stop]
        held = b""
    if held:
        raise ValueError("the last record is cut short")


RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, fields string, payload string, payload_bytes long, payload_sha1 string"


def _record_batches(payloads: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RECORDS.split(", ")]

    def run(batches):
        for t in batches:
            for content in t.column("content"):
                rows: list[tuple] = []
                for f, body in _parse(content.as_py()):
                    kind, payload = f["WARC-Type"], None
                    if kind in ("response", "revisit", "request"):
                        payload = body[body.index(b"\r\n\r\n") + 4 :]
                    store = kind == "response"
                    rows.append((
                        kind, f["WARC-Record-ID"], f.get("WARC-Concurrent-To"), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                        body.decode() if kind == "metadata" else None, payload.decode() if store and payloads else None,
                        len(payload) if store else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if store else None,
                    ))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_record_batches(payloads), RECORDS)


def read_captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: the page, and its request, response and metadata records."""
    found = read_records(spark, path, payloads)
    if not payloads:  # small then, and used four times: the archives are inflated once
        found = written(found, "records")
    main = found.where("type IN ('response', 'revisit')").select(
        F.col("record_id").alias("id"), F.struct("type", "record_id", "uri", "digest", "refers_to", "payload", "payload_bytes", "payload_sha1").alias("response")
    )
    side = lambda kind, *cols: found.where(F.col("type") == kind).select(F.col("concurrent_to").alias("id"), F.struct(*cols).alias(kind))
    whole = main.join(side("request", "record_id", "uri"), "id", "left").join(side("metadata", "record_id", "fields"), "id", "left")
    page = F.from_json(F.regexp_extract("metadata.fields", r"(?s)\Apage: (.*)\r\n\z", 1), "page_id long, url string")
    whole = whole.withColumn("page", page)
    stored = whole.where("response.type = 'response'").select(
        F.col("id").alias("target"), F.struct(F.col("page.page_id").alias("page_id"), F.col("response.payload").alias("payload"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_sha1")).alias("original"),
    )
    # a record that refers to none gets a key of its own, which is nobody's: they would all meet in one task as null
    whole = whole.withColumn("wanted", F.coalesce("response.refers_to", F.concat(F.lit("none of "), "id")))
    return whole.join(stored, F.col("wanted") == F.col("target"), "left").select("page", "request", "response", "metadata", "original")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads the captures back: what the archives hold, per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    found = read_captures(spark, path, payloads=False)
    own = lambda c: F.coalesce(F.col(f"response.{c}"), F.col(f"original.{c}"))
    return found.select(
        F.col("page.page_id").alias("page_id"), own("payload_bytes").alias("payload_bytes"), own("payload_sha1").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", F.col("original.page_id")).alias("refers_to"), F.col("page.url").alias("url"),
    )
