import base64
import hashlib
import io

import pytest

from plumbline.llm import archives

V1 = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 77\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n\n"


def arc(version, *records):
    out = archives.arc_head("x.arc", version)
    for url, date, mime, body in records:
        out += archives.arc_line(version, url, date, mime, len(body), "200") + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines(version):
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n\x00\xff\nnot a header 1 2 3\n"
    found = list(archives.arc_records(io.BytesIO(arc(version, ("http://a/b c", "20010102030405", "text/html", body), ("dns:a", "2001", "text/dns", b"")))))
    assert [r["version"] for r in found] == [version] * 3 and not any(r["error"] for r in found)
    assert (found[1]["url"], found[1]["date"], found[1]["mime"], found[1]["body"]) == ("http://a/b c", "20010102030405", "text/html", body)
    assert found[1]["status"] == ("200" if version == 2 else None) and found[2]["body"] == b""


def test_broken_archives():
    good = arc(1, ("http://a/", "20010102030405", "text/html", b"abc"))
    assert [r["error"] for r in archives.arc_records(io.BytesIO(good + b"garbage line\nmore"))][-1] == "record 2: no header line"
    assert list(archives.arc_records(io.BytesIO(good[:-2])))[-1]["error"] == "record 1: 2 of 3 bytes"
    assert list(archives.arc_records(io.BytesIO(b"http://a/ 1.1.1.1 2001 text/html 1\nx\n")))[-1]["error"] == "no version block"
    assert list(archives.arc_records(io.BytesIO(b""))) == []


def test_timestamps():
    assert archives._timestamp("20010203040506") == "2001-02-03T04:05:06Z"
    assert archives._timestamp("2001") == "2001-01-01T00:00:00Z" and archives._timestamp("x") == "1970-01-01T00:00:00Z" == archives._timestamp(None)


@pytest.mark.parametrize(("value", "number"), [("9223372036854775807", 2**63 - 1), ("-9223372036854775808", -(2**63)), ("9223372036854775808", None), ("-007", -7), ("x", None), ("", None)])
def test_rank(value, number):
    assert archives._order(b"HTTP/1.1 200 OK\r\nX-Page-Id: " + value.encode() + b"\r\n", "X-Page-Id") == number


def test_conversion(spark, tmp_path):
    same = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\nhello"
    one = arc(1, ("http://a/", "20010102030405", "text/html", same % 3), ("dns:a", "20010102030405", "text/dns", b"1.2.3.4"))
    two = arc(2, ("http://b/", "20020102030405", "text/html", same % 9), ("http://c/", "20020102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\n"))
    for name, data in (("one.arc", one), ("two.arc", two + b"broken")):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"{tmp_path}/{n}", n) for n in ("one.arc", "two.arc")], "file string, name string")
    warcs, rejects = archives.to_warc(files, f"{tmp_path}/out")
    assert [(r["name"], r["error"]) for r in rejects.collect()] == [("two.arc", "record 3: no header line")]
    rows = archives.read_warc(warcs).collect()
    assert sorted(r["record_type"] for r in rows) == ["resource", "response", "response", "revisit", "warcinfo", "warcinfo"]
    revisit, = (r for r in rows if r["record_type"] == "revisit")
    first, = (r for r in rows if r["record_id"] == revisit["refers_to_id"])
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    assert (revisit["url"], revisit["payload_bytes"], revisit["payload_digest"], revisit["date"]) == ("http://a/", 5, digest, "2001-01-02T03:04:05Z")
    assert (first["url"], first["payload"], first["payload_digest"], first["rank"]) == ("http://b/", bytearray(b"hello"), digest, 9)
    again, _ = archives.to_warc(files, f"{tmp_path}/again")
    for a, b in zip(warcs.orderBy("name").collect(), again.orderBy("name").collect(), strict=True):
        assert open(a["file"], "rb").read() == open(b["file"], "rb").read()


def test_query(spark, tmp_path):
    wide = [-(2**63), 2**63 - 1, 1234567890123456789, -1234567890123456789, 2**62]  # ids may have 19 digits
    rows = [(i, f"http://h/{i}", f"<p>{n % 7}</p>" if n % 3 else f"é{i}", 1) for n, i in enumerate([*range(60), *wide])] + [(60, None, None, 1), (61, "", "", 1), (62, "http://x y\n", "\r\n\r\n" * 5, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    best = {}
    for i, _, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -(2**63)), i)
    want = set()
    for i, _, t, _ in rows:
        raw, first = (t or "").encode(), best[t or ""]
        want.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert {tuple(r) for r in archives.query(spark, str(tmp_path)).collect()} == want


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warcs, rejects = archives.to_warc(archives.write_arc(none, f"{tmp_path}/a"), f"{tmp_path}/w")
    assert archives.read_warc(warcs).count() == 0 and rejects.count() == 0
