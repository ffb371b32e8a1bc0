"""Shared pieces: what a word is, tables written in the shared folder, SQL text helpers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import fresh_path

# A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


_scopes: list[list[str]] = []


def written(df: DataFrame, label: str, outlives: bool = False, codec: str = "snappy") -> DataFrame:
    """Compute once, keep as Parquet in the shared folder, go on from there: lost executors cost nothing before it.

    Inside scratch() the table goes when the block ends, unless it outlives that.
    """
    path = fresh_path(df.sparkSession, label)
    if _scopes[outlives:]:
        _scopes[-1 - outlives].append(path)
    with _small_batches(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows that go to a Python worker at a time; ten thousand texts and what is made of them are tens of megabytes on both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of no more than BATCH_ROWS rows inside; a smaller size that the user set stays."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written inside; nothing that is still to be computed may read from it then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null and for texts without words."""
    found = F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))), " +")
    return F.filter(found, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What make gives, made once in each worker process; functions reach workers by value, so their modules can't hold it."""
    store = sys.__dict__.setdefault("_plumbline_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]
