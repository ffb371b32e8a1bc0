"""Legacy ARC archives and their conversion to WARC.

An ARC file begins with a version block, which tells the version and so the fields of all header lines; each record is a
header line, as many bytes as it declares, and a line feed.  The converter reads these as a stream, one record in memory
at a time, and writes a WARC file for each ARC file: the version block becomes a warcinfo record, HTTP responses
become response records or, if a later record has the same payload, revisit records without it, and all else becomes
resource records.  Record ids are made from the place of a record in its archive, timestamps from the ARC dates, and
digests from the bytes, so a converted file is the same whenever it is made again.

Files are read and written by tasks, one file a task, in a folder all executors share; a file appears whole or not at
all.  Equal payloads are found by Spark: digests are grouped with map-side maxima, and a file's decisions travel back to it
as one small row, so payloads are never shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.store import opened, put
from plumbline.session import fresh_path

ARC_BYTES = 64 << 20
RECORDED = "20240101000000"
ADDRESS = "0.0.0.0"
ORDER_HEADER = "x-page-id"
LEAST_REVISIT = 0
ORIGIN = "plumbline"
# Fields of a header line by version; all but the URL are free of spaces.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_IDS = uuid.UUID("9f0d8c52-6c0e-5d1b-9a57-3a1f5d7c2e10")


def _member(data: bytes) -> bytes:
    """One gzip member, the same bytes every time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def arc_head(name: str, version: int, date: str = RECORDED) -> bytes:
    body = f"{version} 0 {ORIGIN}\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", date, "text/plain", len(body)) + body + b"\n"


def arc_line(version: int, url: str, date: str, mime: str, length: int, status: str = "-", name: str = "-") -> bytes:
    middle = "" if version == 1 else f" {status} - - 0 {name}"
    return f"{url} {ADDRESS} {date} {mime}{middle} {length}\n".encode()


def arc_records(stream) -> Iterator[dict]:
    """The records of an ARC stream, the version block first.

    What does not parse ends the file with a record that has an error and no body, so nothing is lost in silence.
    """
    version, number = 0, 0
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        told = {"number": number, "error": None, "version": version}
        fields = FIELDS[version or 1]
        values = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape").rsplit(" ", len(fields) - 1)
        if not version and line.startswith(b"filedesc:") and len(values) == len(fields) and not values[-1].isdigit():
            values = []
        if len(values) != len(fields) or not re.fullmatch(r"[0-9]+", values[-1]):
            yield told | {"error": f"record {number}: no header line", "url": None, "date": None, "mime": None, "status": None, "body": b""}
            return
        found = dict(zip(fields, values, strict=True))
        length = int(found["Archive-length"])
        body = stream.read(length)
        told |= {"url": found["URL"], "date": found["Archive-date"], "mime": found["Content-type"], "status": found.get("Result-code"), "body": body}
        if len(body) < length:
            yield told | {"error": f"record {number}: {len(body)} of {length} bytes"}
            return
        if not number:
            first = body.split(b"\n", 1)[0].split(b" ")
            version = int(first[0]) if found["URL"].startswith("filedesc:") and first[0] in (b"1", b"2") else 0
            if not version:
                yield told | {"error": "no version block"}
                return
            told["version"] = version
        yield told
        number += 1


def http_parts(body: bytes) -> tuple[bytes, bytes] | None:
    """Head, with its empty line, and payload of an HTTP response; None for what is none."""
    if not body.startswith(b"HTTP/"):
        return None
    for end in (b"\r\n\r\n", b"\n\n"):
        head, met, payload = body.partition(end)
        if met:
            return head + met, payload
    return body, b""


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return found[1].decode("latin-1") if found else None


def _write_arc(folder: str, versions: tuple[int, ...], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload")), strict=True))
        row, number = next(rows, None), 0
        while row is not None:
            version = versions[(part + number) % len(versions)]
            name, told = f"part-{part:06d}-{number:04d}.arc.gz", {}

            def fill(out, name=name, version=version, told=told):
                nonlocal row
                out.write(_member(arc_head(name, version)))
                size = records = 0
                while row is not None and size < most:
                    key, url, payload = row
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                    head += "" if key is None else f"X-Page-Id: {key}\r\n"
                    body = head.encode() + b"\r\n" + payload
                    place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
                    out.write(_member(arc_line(version, place, RECORDED, "text/html", len(body), "200", name) + body + b"\n"))
                    size, records, row = size + len(body), records + 1, next(rows, None)
                told["records"] = records

            size = put(f"{folder}/{name}", fill)
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "name": name, "records": told["records"], "bytes": size}])
            number += 1

    return run


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", versions: tuple[int, ...] = (1, 2), most: int = ARC_BYTES) -> DataFrame:
    """Write each row as a record of an ARC file; (file, name, records, bytes) of the files, of the versions in turn.

    The payload is the html in UTF-8, empty for null; the id stands in the HTTP head, none for null.  White space and
    control characters of a URL are percent-encoded; a null or empty one becomes urn:none.  Other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    return written(rows.mapInArrow(_write_arc(folder.rstrip("/"), versions, most), "file string, name string, records long, bytes long"), "arc-files")


def _streamed(path: str):
    file = opened(path)
    magic = file.read(2)
    file.seek(0)
    return gzip.GzipFile(fileobj=file) if magic == b"\x1f\x8b" else io.BufferedReader(file, 1 << 20)


# WARC


def _record_id(name: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{name}#{number}')}>"


def _timestamp(date: str) -> str:
    """WARC's form of an ARC date of 14 digits; of a shorter or broken one what can be told, else 1970."""
    d = date if re.fullmatch(r"[0-9]{4,14}", date or "") else "1970"
    d = (d + "00000101000000"[len(d) :]) if len(d) < 14 else d
    month, day = max(1, min(12, int(d[4:6]))), max(1, min(31, int(d[6:8])))
    return f"{d[:4]}-{month:02d}-{day:02d}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, name: str, number: int, date: str, mime: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(name, number)), ("WARC-Date", _timestamp(date)), *more]
    head += [("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of a WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block


def _order(head: bytes, name: str) -> int | None:
    """A header's number; none where it is no number of 64 bits."""
    value = http_header(head, name)
    if not value or not re.fullmatch(r"[+-]?0*[0-9]{1,19}", value):
        return None
    return int(value) if -(1 << 63) <= int(value) < 1 << 63 else None


def _payloads(order_header: str):
    """What decides on the type of each record: the digest and size of its payload, and its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("name", pa.string()), ("number", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("rank", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("error", pa.string())])
        for b in batches:
            for path, name in zip(b.column("file").to_pylist(), b.column("name").to_pylist(), strict=True):
                rows = []
                with _streamed(path) as stream:
                    for r in arc_records(stream):
                        parts = None if r["error"] or not r["number"] else http_parts(r["body"])
                        if not parts and not r["error"]:
                            continue
                        url = r["url"] and r["url"].encode("utf-8", "replace").decode()
                        told = {"name": name, "number": r["number"], "url": url, "date": r["date"] and _timestamp(r["date"]), "error": r["error"], "digest": None, "size": None, "rank": None}
                        if parts:
                            told |= {"digest": sha1(parts[1]), "size": len(parts[1]), "rank": _order(parts[0], order_header)}
                        rows.append(told)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def _convert(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, revisits in zip(*(b.column(c).to_pylist() for c in ("file", "name", "revisits")), strict=True):
                again, told = {r["number"]: r for r in revisits or []}, {"records": 0}
                warc = re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz"

                def fill(out, path=path, name=name, again=again, told=told):
                    with _streamed(path) as stream:
                        for r in arc_records(stream):
                            if r["error"]:
                                break
                            out.write(_member(_converted(name, r, again.get(r["number"]))))
                            told["records"] += 1

                size = put(f"{folder}/{warc}", fill)
                yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{warc}", "name": warc, "records": told["records"], "bytes": size}])

    return run


def _converted(name: str, r: dict, first: dict | None) -> bytes:
    """The WARC record of an ARC record; first is the record that has its payload already, if any."""
    if not r["number"]:
        fields = f"software: plumbline\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {r['version']}\r\n".encode()
        return warc_record("warcinfo", name, 0, r["date"], "application/warc-fields", fields, [("WARC-Filename", name)])
    target, parts = ("WARC-Target-URI", r["url"]), http_parts(r["body"])
    if not parts:
        return warc_record("resource", name, r["number"], r["date"], r["mime"], r["body"], [target, ("WARC-Payload-Digest", f"sha1:{sha1(r['body'])}")])
    head, payload = parts
    digest, http = ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), "application/http; msgtype=response"
    if not first:
        return warc_record("response", name, r["number"], r["date"], http, r["body"], [target, digest])
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first["name"], first["first"]))]
    more += [("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]), ("X-Payload-Length", str(len(payload)))]
    return warc_record("revisit", name, r["number"], r["date"], http, head, [target, digest, *more])


def _one_each(files: DataFrame, *columns: str) -> DataFrame:
    """A task for each file."""
    return files.select(*columns).repartition(max(1, files.count()))


def to_warc(files: DataFrame, folder: str, order_header: str = ORDER_HEADER, least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """Convert ARC files, rows (file, name) with names of their own, to WARC files below folder.

    Gives the WARC files as (file, name, records, bytes), and what could not be read as (name, number, error): a file is
    converted up to there.  Of HTTP records with equal payloads of at least least bytes the one of greatest rank, the
    number in its order_header, is the response and the others revisit it; records without rank come before all
    others, ties go to the greater name and place.  Empty in, empty out.
    """
    found = written(_one_each(files, "file", "name").mapInArrow(_payloads(order_header), "name string, number long, digest string, size long, rank long, url string, date string, error string"), "arc-payloads")
    sized = found.filter(F.col("digest").isNotNull() & (F.col("size") >= least))
    best = sized.groupBy("digest", "size").agg(F.max(F.struct("rank", "name", "number", "url", "date")).alias("best"), F.count("*").alias("copies")).filter("copies > 1")
    again = sized.join(written(best, "payload-responses"), ["digest", "size"]).filter("name <> best.name OR number <> best.number")
    told = F.struct("number", F.col("best.name").alias("name"), F.col("best.number").alias("first"), F.col("best.url").alias("url"), F.col("best.date").alias("date"))
    decided = again.select("name", told.alias("revisit")).groupBy("name").agg(F.collect_list("revisit").alias("revisits"))
    work = written(files.select("file", "name").join(decided, "name", "left"), "arc-decisions")
    out = _one_each(work, "file", "name", "revisits").mapInArrow(_convert(folder.rstrip("/")), "file string, name string, records long, bytes long")
    return written(out, "warc-files"), found.filter("error IS NOT NULL").select("name", "number", "error")


def _read_warc(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _warc_rows(batches, payloads)

    return run


def _warc_rows(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()), ("rank", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for b in batches:
        for path in b.column("file").to_pylist():
            rows, held = [], 0
            with _streamed(path) as stream:
                for head, block in warc_records(stream):
                    record = {"record_id": head["warc-record-id"], "record_type": head["warc-type"], "url": head.get("warc-target-uri"), "date": head["warc-date"], "refers_to_id": head.get("warc-refers-to"), "rank": None}
                    if record["url"]:
                        record["url"] = record["url"].encode("utf-8", "replace").decode()
                    parts = http_parts(block) if record["record_type"] in ("response", "revisit") else (b"", block)
                    if record["record_type"] == "revisit":
                        record |= {"payload": None, "payload_bytes": int(head["x-payload-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
                    else:
                        record |= {"payload": parts[1] if payloads else None, "payload_bytes": len(parts[1]), "payload_digest": sha1(parts[1])}
                        if head.get("warc-payload-digest", "sha1:" + record["payload_digest"]) != "sha1:" + record["payload_digest"]:
                            raise ValueError(f"{record['record_id']}: the payload does not have its digest")
                    record["rank"] = _order(parts[0], ORDER_HEADER)
                    rows.append(record)
                    held += len(block) if payloads else 0
                    if held > 8 << 20 or len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, kind)


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, url, date, refers_to_id, rank, payload_bytes, payload_digest, payload) of all records.

    The payload of a response is its HTTP body, left out without payloads; digests are those of the bytes read, and must be those told.  A revisit
    has no payload here, its size and digest are those of the full one.
    """
    return _one_each(files, "file").mapInArrow(_read_warc(payloads), "record_id string, record_type string, url string, date string, refers_to_id string, rank long, payload_bytes long, payload_digest string, payload binary")


def query(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    arcs = write_arc(pages, fresh_path(spark, "arc"))
    warcs, _ = to_warc(arcs, fresh_path(spark, "warc"))
    back = read_warc(warcs, payloads=False).filter("record_type IN ('response', 'revisit')")
    back = written(back.select("record_id", "record_type", "refers_to_id", F.col("rank").alias("page_id"), "payload_bytes", "payload_digest"), "warc-records")
    wanted = back.select(F.col("refers_to_id").alias("record_id")).filter("record_id IS NOT NULL").distinct()
    firsts = back.join(written(wanted, "responses-wanted"), "record_id").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    firsts = written(firsts, "responses")  # plain exchanges on both sides: Spark can split a payload that very many pages have
    return back.join(firsts, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = ", ".join(f"'{i:04b}'" for i in range(16))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS best FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: [{_DIGITS}][strpos('0123456789abcdef', c)]), '') AS bits FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, i * 5 + j, 1) AS INT) * CAST(pow(2, 5 - j) AS INT)))::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""
