"""Generators over a request table: every request row says how many rows it wants, and its parameters.

A generator is a vectorised function of Arrow columns, one entry for each wanted row: the request's columns and row_no.
Requests are cut into slices before the generator runs, so that one huge request is many tasks and many small ones
share a batch.  A generator that depends on its arguments alone gives the same rows in every partitioning and retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.records import validate_table
from plumbline.session import quoted

SLICE_ROWS = 1 << 16
SLICES = 1 << 12  # slices of a request that one row of the first cut stands for
BATCH_ROWS = 1 << 16

BatchGenerator = Callable[[pa.Table], dict[str, pa.Array]]


def _wanted(slices: pa.RecordBatch) -> Iterator[pa.Table]:
    """A row for each wanted one: its request's columns and row_no, at most BATCH_ROWS at a time."""
    counts = slices.column("rows").to_numpy()
    ends = np.cumsum(counts)
    request = slices.column("request")
    first = slices.column("first").to_numpy()
    for begin in range(0, int(ends[-1]) if len(ends) else 0, BATCH_ROWS):
        place = np.arange(begin, min(begin + BATCH_ROWS, int(ends[-1])))
        which = np.searchsorted(ends, place, "right")
        row_no = first[which] + place - (ends[which] - counts[which])
        columns = request.take(pa.array(which)).flatten()
        yield pa.table([*columns, pa.array(row_no)], [*[f.name for f in request.type], "row_no"])


def _made(generator: BatchGenerator, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted in _wanted(batch):
                made = generator(wanted)
                if any(len(made[c]) != wanted.num_rows for c in names):
                    raise ValueError("a generator gives one entry for each wanted row")
                rows = pa.StructArray.from_arrays([c.combine_chunks() for c in wanted.columns[:-1]], wanted.column_names[:-1])
                yield pa.RecordBatch.from_arrays([rows, wanted["row_no"].combine_chunks(), *[made[c] for c in names]], ["request", "row_no", *names])

    return run


def generate_rows(
    requests: DataFrame, generator: BatchGenerator, returns: str, rows: str = "rows", schema: dict | None = None, slice_rows: int = SLICE_ROWS, partitions: int | None = None
) -> DataFrame:
    """Every request's columns, row_no (from 0), the columns of ``returns`` and ``error``.

    A request whose columns break the JSON ``schema`` gives one row with the first error and nothing made.  A null or
    negative number of rows is none.  Requests with columns called like the made ones raise; equal requests each get
    their rows.  Only requests are shuffled, in slices; ``partitions`` defaults to the session's.
    """
    out = T.StructType.fromDDL(returns)
    names = [f.name for f in out]
    taken = {c.lower() for c in requests.columns} & {n.lower() for n in [*names, "row_no", "error"]}
    if taken:
        raise ValueError(f"request columns are called like made ones: {sorted(taken)}")
    checked = validate_table(requests, schema) if schema else requests.withColumn("error", F.lit(None).cast("string"))
    request = F.struct(*[F.col(quoted(c)) for c in requests.columns]).alias("request")
    last = F.col(quoted(rows)).cast("long") - 1
    wanted = checked.filter(F.col("error").isNull() & (last >= 0)).select(request, last.alias("last"))
    coarse = wanted.select("request", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(slice_rows * SLICES).cast("long"))).alias("coarse"))
    end = F.least("last", F.col("coarse") + F.lit(slice_rows * SLICES - 1))
    fine = coarse.select("request", "last", F.explode(F.sequence("coarse", end, F.lit(slice_rows).cast("long"))).alias("first"))
    slices = fine.select("request", "first", F.least(F.lit(slice_rows).cast("long"), F.col("last") + 1 - F.col("first")).alias("rows"))
    # a given number of partitions: sized by what is made, adaptive planning would join them by the requests' few bytes
    spread = slices.repartition(partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    result = T.StructType([T.StructField("request", slices.schema["request"].dataType), T.StructField("row_no", T.LongType()), *out])
    made = spread.mapInArrow(_made(generator, names), result).select("request.*", "row_no", *[quoted(n) for n in names], F.lit(None).cast("string").alias("error"))
    if not schema:
        return made
    broken = checked.filter(F.col("error").isNotNull())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in out]
    return made.unionByName(broken.select(*[quoted(c) for c in requests.columns], F.lit(None).cast("long").alias("row_no"), *empty, "error"))
