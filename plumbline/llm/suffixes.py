"""Repeated passages by a sparse suffix array.

Of the suffixes of all texts, word by word, only those are retained that start where the text itself says so: a window
of HEAD words is chosen if its hash is the smallest among SPREAD neighbouring windows.  Every passage of LEAST words
that stands in two texts then has a chosen start at the same place in both.  Suffixes are grouped by their first HEAD
words; those whose head no other text has are dropped.  Around the others each window of LEAST words that
chooses the start is compared by hash with all windows like it: the smallest id that has it is its first document.  Windows
that an earlier document has too make the passages.

Sorted suffixes and their neighbours alone would lose passages: a neighbour shares the most words behind the start, but
another text may share fewer of these and more of those before it, and only with that one are there LEAST words.

All sorting and grouping is Spark's, on narrow rows with map-side minima.  Of equal texts only that of the smallest id is
searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, word_count, written
from plumbline.llm.wordhash import blocks, mixed, span_hashes, text_bytes, word_spans

LEAST = 50
HEAD = 12
SPREAD = LEAST - HEAD + 1
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _stretches(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of words[first:last], by sums of powers; equal words give equal hashes wherever they stand."""
    n = len(words) + 1
    up, down = np.full(n, _STEP, np.uint64), np.full(n, _BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[last] - sums[first]) * down[first])


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick of every width neighbouring values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _chosen(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at which a retained suffix starts, and the hash of its first HEAD words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heads = len(words) - HEAD + 1
    if heads < SPREAD:
        return none
    at = np.arange(heads)
    heads_hash = _stretches(words, at, at + HEAD)
    least = _slide(heads_hash, SPREAD, np.minimum)
    end = np.repeat(before[1:], np.diff(before))[: len(least)]
    least[np.arange(len(least)) + LEAST > end] = 0  # a window over the end of a text chooses nothing
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, SPREAD, np.maximum) == heads_hash)
    return chosen, heads_hash[chosen]


def _words(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(batch)
    starts, ends, before = word_spans(data, at)
    return span_hashes(data, starts, ends), before


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a, b in blocks(whole.column(2)):
            batch = whole.slice(a, b - a)
            words, before = _words(batch.column(2))
            chosen, head = _chosen(words, before)
            text = np.searchsorted(before, chosen, "right") - 1
            version = batch.column(1).to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(version << 32 | chosen - before[text])], ["head", "id", "place"]
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of LEAST words that choose one of the given starts.  Which head a window chooses is its own affair, so equal windows are told alike."""
    for whole in batches:
        for a, b in blocks(whole.column(2)):
            batch = whole.slice(a, b - a)
            words, before = _words(batch.column(2))
            lists = batch.column(3)
            starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts += np.repeat(before[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.arange(len(words) - HEAD + 1)
            heads = _stretches(words, at, at + HEAD)
            least = _slide(heads, SPREAD, np.minimum)
            end = np.repeat(before[1:], np.diff(before))[: len(least)]
            at = np.flatnonzero((np.arange(len(least)) + LEAST <= end) & np.isin(least, heads[starts]))
            text = np.searchsorted(before, at, "right") - 1
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - before[text]).astype(np.int32)), pa.array(_stretches(words, at, at + LEAST).view(np.int64))],
                ["id", "version", "at", "key"],
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one text that overlap or touch become one span; of its sources the smallest id is told."""
    for b in batches:
        lists = b.column("spans")
        flat = lists.flatten()
        at, first_id = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "first_id"))
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((at, row))
        at, row, first_id = at[order], row[order], first_id[order]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + LEAST)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        rows = pa.array(row[first])
        smallest = np.minimum.reduceat(first_id, first) if len(first) else first_id
        told = [pa.array(at[first].astype(np.int32)), pa.array((at[last] + LEAST).astype(np.int32)), pa.array(smallest)]
        yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("version").take(rows), *told], ["id", "version", "begin", "end", "first_id"])


def _named(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    t = F.col(text)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(t).bitwiseAND(0x7FFFFFFF).alias("version"), t.alias("text"), *more)


def _searched(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Windows (id, version, at, first_id) of the texts (id, version) in reps that a text of smaller id has too."""
    suffixes = known.mapInArrow(_suffixes, "head long, id long, place long")
    version, at = F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
    one = F.struct("id", version)
    heads = suffixes.groupBy("head").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a < b").select("head")
    # Written, so that the join has plain exchanges on both sides and Spark can split a head that very many texts have.
    heads = written(heads, "heads")
    starts = suffixes.join(heads, "head").groupBy("id", version.alias("version")).agg(F.collect_set(at).alias("starts"))
    # Texts meet their starts in a join that is planned alike at every size.
    wanted = starts.join(reps, ["id", "version"], "left_semi")
    placed = known.join(wanted.hint("merge"), ["id", "version"]).select("id", "version", "text", "starts")
    windows = written(placed.mapInArrow(_windows, "id long, version long, at int, key long"), "windows")
    first = windows.groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("last")).filter("first_id < last")
    met = windows.join(written(first.select("key", "first_id"), "first-windows"), "key").filter("id > first_id")
    return met.select("id", "version", "at", "first_id")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, version, begin, end, first_id): words begin to end of a text stand in a document of smaller id too.

    Passages of LEAST words or more that documents share are found, whole, in all of them but the first.  Spans of a text
    that meet are told as one, first_id is the smallest id that has LEAST words of it.  version, of the text's hash, tells texts under one id apart; such
    texts count as one document, whose repeats within itself are not told.  A text that equals one of a smaller id is
    told whole.  Rows with a null id, null texts and texts of fewer words take no part.  Repeated rows are told once.
    Words are compared by hash.  Other columns are not read.  Empty in, empty out.
    """
    known = _named(docs, doc_id, text).filter("id IS NOT NULL AND text IS NOT NULL")
    slim = written(known.select("id", "version", F.xxhash64(F.lit(4), "text").alias("more"), word_count(F.col("text")).cast("int").alias("n")), "texts")
    equal = written(slim.groupBy("version", "more").agg(F.min("id").alias("first_id")), "equal-texts")
    spans = _searched(known, equal.select(F.col("first_id").alias("id"), "version"))
    gathered = spans.groupBy("id", "version").agg(F.collect_set(F.struct("at", "first_id")).alias("spans"))
    found = gathered.mapInArrow(_merged, "id long, version long, begin int, end int, first_id long")
    copies = slim.join(equal, ["version", "more"]).filter((F.col("id") > F.col("first_id")) & (F.col("n") >= LEAST)).distinct()
    return found.unionByName(copies.select("id", "version", F.lit(0).alias("begin"), F.col("n").alias("end"), "first_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without their spans, and whether they had any."""
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch, texts = whole.slice(i, 500), []
            spanned = batch.column("spans").to_pylist()
            for text, spans in zip(batch.column("text").to_pylist(), spanned, strict=True):
                if not spans:
                    texts.append(text)
                    continue
                data, at = text_bytes(pa.array([text]))
                starts, _, _ = word_spans(data, at)
                raw, out, done = data.tobytes(), [], 0
                for s in sorted(spans, key=lambda s: s["begin"]):
                    out.append(raw[done : starts[s["begin"]]])
                    done = starts[s["end"]] if s["end"] < len(starts) else len(raw)
                texts.append(b"".join([*out, raw[done:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([bool(s) for s in spanned])], ["row", "text", "cut"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The documents, all columns, without the passages that repeats() finds in them; the first copy of each stays.

    The column named length, if any, gets the characters of what is left.  A document of which no word is left goes.
    """
    with scratch(docs.sparkSession):
        found = repeats(docs, doc_id, text).groupBy("id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        found = written(found, "spans", outlives=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Documents go through one join, with one copy of their text, and it is planned alike at every size.
    named = _named(docs, doc_id, text, row).drop("text")
    met = named.join(found.hint("merge"), ["id", "version"], "left").select("row", F.col(f"row.`{text}`").alias("text"), "spans")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    cut = met.mapInArrow(_cut, f"row {kind}, text string, cut boolean").filter(~F.col("cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.withColumn("row", F.col("row").withField(f"`{text}`", F.col("text")))
    if length:
        shorter = F.length("text").cast(docs.schema[length].dataType)
        cut = cut.withColumn("row", F.when(F.col("cut"), F.col("row").withField(f"`{length}`", shorter)).otherwise(F.col("row")))
    return cut.select("row.*")


def query(spark, folder: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("begin").alias("word_begin"), F.col("end").alias("word_end"), F.col("first_id").alias("first_doc_id"))
