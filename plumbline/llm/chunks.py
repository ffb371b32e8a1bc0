"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of every text; where its upper bits are zero, a chunk ends.  The hash depends on the last
WINDOW bytes only, so an insertion moves the chunks around it and leaves those behind it as they were.  Chunks are
deduplicated by 128-bit digest over all documents: a chunk is a copy if a document of smaller id has it too.  Runs of
neighbouring copies that are long enough are told; short chunks that agree by chance are not.

A digest costs one row a chunk, grouped with map-side minima, so a chunk that every document has is no load for any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, written
from plumbline.llm.wordhash import blocks, text_bytes

WINDOW = 16
MIN_BYTES = 16
MAX_BYTES = 192
BITS = 5
LEAST_BYTES = 96
_GEAR = np.random.default_rng(1).integers(0, 2**32, 256, dtype=np.uint32)


def _cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end, in bytes from the first text's start; never inside a character."""
    rolled, width = _GEAR[data], 1
    while width < WINDOW:
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
        width *= 2
    ends = (rolled & np.uint32(((1 << BITS) - 1) << (WINDOW - BITS))) == 0
    inside = (data & 0xC0) == 0x80
    ends[:-1] &= ~inside[1:]
    places = np.flatnonzero(ends) + 1
    first = np.searchsorted(places, at)
    out = []
    for k in range(len(at) - 1):
        start, end, cuts = int(at[k]), int(at[k + 1]), []
        for c in [*places[first[k] : first[k + 1]].tolist(), end]:
            while c - start > MAX_BYTES:
                start += MAX_BYTES
                while inside[start]:
                    start -= 1
                cuts.append(start)
            if c - start >= MIN_BYTES or (c == end and c > start):
                cuts.append(c)
                start = c
        out.append(cuts)
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for whole in batches:
        for a, b in blocks(whole.column(2)):
            batch = whole.slice(a, b - a)
            data, at = text_bytes(batch.column(2))
            cuts = _cuts(data, at)
            n = np.fromiter(map(len, cuts), np.int64, len(cuts))
            ends = np.fromiter((c for x in cuts for c in x), np.int64, int(n.sum()))
            text = np.repeat(np.arange(len(cuts)), n)
            number = np.arange(len(ends)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.where(number == 0, at[text], np.concatenate([[0], ends[:-1]]) if len(ends) else ends)
            raw = data.tobytes()
            digests = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    pa.array(number.astype(np.int32)),
                    pa.array((starts - at[text]).astype(np.int32)),
                    pa.array((ends - at[text]).astype(np.int32)),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                ],
                ["id", "version", "number", "begin", "end", "digest1", "digest2"],
            )


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, number, begin, end, digest1, digest2): the chunks of each text, in bytes of its UTF-8 form.

    Rows with a null id and null texts take no part; an empty text has no chunk.  version is the text's hash.
    """
    known = _named(docs, doc_id, text).filter("id IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(_chunked, "id long, version long, number int, begin int, end int, digest1 long, digest2 long")


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("id", "version", "begin", "end", "n_chunks", "first_id")}
            for i, version, copies in zip(*(b.column(k).to_pylist() for k in ("id", "version", "copies")), strict=True):
                run: list[tuple] = []
                for c in [*sorted((c["number"], c["begin"], c["end"], c["first_id"]) for c in copies), None]:
                    if run and (c is None or c[0] != run[-1][0] + 1):
                        if run[-1][2] - run[0][1] >= least:
                            longest = max(run, key=lambda x: (x[2] - x[1], -x[3]))
                            for k, v in zip(out, (i, version, run[0][1], run[-1][2], len(run), longest[3]), strict=True):
                                out[k].append(v)
                        run = []
                    if c:
                        run.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64() if k in ("id", "version", "first_id") else pa.int32()) for k in out], list(out))

    return run


def copied_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES) -> DataFrame:
    """(id, version, begin, end, n_chunks, first_id): runs of chunks that documents of smaller id have too, least bytes long.

    first_id is the smallest id that has the run's longest chunk.  Texts under one id count as one document, whose
    repeats within itself are not told; repeated rows are told once.  Rows with a null id and null texts take no part.
    Other columns are not read.  Empty in, empty out.
    """
    table = written(chunks(docs, doc_id, text), "chunks")
    digest = ["digest1", "digest2"]
    first = table.groupBy(*digest).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    # Written, so that the join has plain exchanges on both sides and Spark can split a chunk that very many texts have.
    copies = table.join(written(first, "first-chunks"), digest).filter("id > first_id")
    gathered = copies.groupBy("id", "version").agg(F.collect_set(F.struct("number", "begin", "end", "first_id")).alias("copies"))
    return gathered.mapInArrow(_runs(least), "id long, version long, begin int, end int, n_chunks int, first_id long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw, out, done = text.encode(), [], 0
            for r in sorted(runs or [], key=lambda r: r["begin"]):
                out.append(raw[done : r["begin"]])
                done = r["end"]
            texts.append(b"".join([*out, raw[done:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES) -> DataFrame:
    """The documents, all columns, without the runs that copied_runs() finds; a text may be empty afterwards."""
    with scratch(docs.sparkSession):
        found = copied_runs(docs, doc_id, text, least).groupBy("id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
        found = written(found, "copied-runs", outlives=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    met = named.join(found, ["id", "version"], "left")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    cut = met.filter("runs IS NOT NULL").select("row", "text", "runs").mapInArrow(_cut, f"row {kind}, text string")
    cut = cut.select(F.col("row").withField(f"`{text}`", F.col("text")).alias("row"))
    return met.filter("runs IS NULL").select("row").unionByName(cut).select("row.*")


def query(spark, folder: str) -> DataFrame:
    found = copied_runs(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("begin").alias("byte_begin"), F.col("end").alias("byte_end"), "n_chunks", F.col("first_id").alias("first_doc_id"))
