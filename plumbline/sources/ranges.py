"""XML records read by byte ranges, so that one large file is many tasks.

A range gives the records whose start tag begins in it; it looks for the first one behind its own begin, and reads on
behind its end until its last record is whole.  Records are told as text and parsed by Spark with the columns that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.readers import ARTICLE_SCHEMA, ENTRY_SCHEMA, articles, entries

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
# Read behind a range for its last record, at first.
BEYOND = 1 << 13


def records(stream: BinaryIO, tag: str, begin: int, end: int, chunk: int = CHUNK) -> Iterator[str]:
    """The elements of that tag whose start tag begins at a byte from begin up to end; an element that the file's end cuts is left out.

    Files are UTF-8, and no comment or CDATA section holds the tag.
    """
    start, stop = re.compile(rb"<" + tag.encode() + rb"(?=[\s/>])"), b"</" + tag.encode() + b">"
    if begin:
        stream.seek(begin)
    buffer, at, here = b"", begin, 0  # buffer[here] is the byte at of the file; what is before it is dropped when more is read

    def more(size: int) -> bool:
        nonlocal buffer, here
        part = stream.read(size)
        buffer, here = buffer[here:] + part, 0
        return bool(part)

    def reach() -> int:
        """To the end of the range at once, but no further than a chunk."""
        return max(1, min(chunk, end - at - (len(buffer) - here)))

    while at < end:
        found = start.search(buffer, here)
        if not found:
            keep = min(len(buffer) - here, len(tag) + 1)  # a start tag may be cut here, before the byte that ends its name
            at, here = at + len(buffer) - here - keep, len(buffer) - keep
            if not more(reach()):
                return
            continue
        at, here = at + found.start() - here, found.start()
        if at >= end:
            return
        searched, beyond = 0, BEYOND
        while True:
            close = buffer.find(b">", here)
            if close > here and buffer[close - 1 : close] == b"/" and buffer.find(b"<", here + 1, close) < 0:
                size = close + 1 - here  # an element without content
                break
            last = buffer.find(stop, here + searched)
            if last >= 0:
                size = last + len(stop) - here
                break
            searched = max(0, len(buffer) - here - len(stop))
            # behind the range only the rest of one record is wanted: little at first, then more
            left = end - at - (len(buffer) - here)
            if not more(reach() if left > 0 else min(chunk, beyond)):
                return
            beyond = beyond if left > 0 else 2 * beyond
        yield buffer[here : here + size].decode("utf-8", "replace")
        at, here = at + size, here + size


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class XmlRecords(DataSource):
    """Format ``xmlrecords``: column record; options path (a file or folder), tag, rangeBytes and suffix (of the files in a folder)."""

    @classmethod
    def name(cls) -> str:
        return "xmlrecords"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tag, self.bytes, self.suffix = options["path"], options["tag"], int(options.get("rangebytes", RANGE_BYTES)), options.get("suffix", "")

    def partitions(self):
        import pyarrow.fs as fs

        system, place = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(place)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", "."))]
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            step = max(1, f.size) if f.path.endswith((".gz", ".bz2")) else self.bytes  # a packed file can only be read whole
            parts += [_Range(f.path, a, 1 << 62 if f.path.endswith((".gz", ".bz2")) else min(a + step, f.size)) for a in range(0, f.size, step)]
        return parts or [_Range("", 0, 0)]

    def read(self, part):
        import pyarrow.fs as fs

        if not part.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        if part.path.endswith((".gz", ".bz2")):
            with system.open_input_stream(part.path) as stream:  # unpacked by suffix
                yield from ((r,) for r in records(stream, self.tag, 0, part.end))
        else:
            with system.open_input_file(part.path) as stream:
                yield from ((r,) for r in records(stream, self.tag, part.begin, part.end))


def _parsed(spark: SparkSession, path: str, tag: str, schema: str, range_bytes: int, suffix: str) -> DataFrame:
    spark.dataSource.register(XmlRecords)
    raw = spark.read.format("xmlrecords").option("tag", tag).option("rangeBytes", range_bytes).option("suffix", suffix).load(path)
    # What does not parse is left out, as by the other readers, whose rejects tell it.
    parsed = F.from_xml("record", schema + ", _corrupt string", {"attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Exploded, so that a record is parsed once: a plain column would be put into the filter and the columns alike.
    return raw.select(F.explode(F.array(parsed)).alias("e")).filter("e IS NOT NULL AND e._corrupt IS NULL").select("e.*").drop("_corrupt")


def read_article_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of read_article_xml() from a file or folder, in tasks of about range_bytes each."""
    return articles(_parsed(spark, path, "PubmedArticle", ARTICLE_SCHEMA, range_bytes, ""))


def read_feed_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of read_feed_xml() from a file or folder, in tasks of about range_bytes each."""
    return entries(_parsed(spark, path, "entry", ENTRY_SCHEMA, range_bytes, ""))
