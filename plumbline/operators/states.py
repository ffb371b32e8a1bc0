"""Mergeable states: column profiles over grouping sets, stored sketches, and aggregates that a caller defines.

Whatever is asked of many groupings is worked out once for the finest of them; coarser ones merge states, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import quoted, written

# --- profiles over grouping sets -----------------------------------------------------------

DISTINCT_BITS = 12  # of the sketches: 2**12 registers, a standard error of 1.04 / 2**6 = 1.6 percent


def finest_states(df: DataFrame, dims: list[str], columns: list[str]) -> DataFrame:
    """A row for each combination of dims: rows ``n``, and for each numeric column a struct (filled, mean, m2, low, high, distinct).

    m2 is the sum of squared distances to the mean, distinct a sketch of the values (of their text).  One scan, states are merged
    before the shuffle; written once.
    """
    states = []
    for c in columns:
        x = F.col(quoted(c)).cast("double")
        parts = {"filled": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "low": F.min(x), "high": F.max(x), "distinct": F.hll_sketch_agg(F.col(quoted(c)).cast("string"), DISTINCT_BITS)}
        states.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(c))
    return written(df.groupBy(*map(quoted, dims)).agg(F.count("*").alias("n"), *states), "finest-states")


def profile_sets(df: DataFrame, dims: list[str], columns: list[str], sets: list[list[str]] | None = None, distinct: bool = True) -> DataFrame:
    """(level, dims, column, rows, filled, mean, std, low, high, distinct) for every column and every combination of each set of dims (all subsets by default).

    level tells the set as bits, as GROUPING_ID does: a 1 for each of dims that is summed over, whose cell is null then.  std is that of a sample, null for fewer than
    two values.  distinct is an estimate: 95 in 100 are within 3.3 percent.  Missing cells are left out; missing dims are a group.
    """
    sets = sets if sets is not None else [[d for i, d in enumerate(dims) if not bits >> i & 1] for bits in range(1 << len(dims))]
    finest = finest_states(df, dims, columns)
    # Squares are taken around the mean of all, so that large means cost no digits.
    centre = finest.agg(*[(F.sum(F.col(quoted(c))["mean"] * F.col(quoted(c))["filled"]) / F.sum(F.col(quoted(c))["filled"])).alias(c) for c in columns]).first()
    middle = {c: float(centre[c]) if centre[c] is not None else 0.0 for c in columns}
    long = finest.select(*map(quoted, dims), "n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(middle[c]).alias("middle"), F.col(quoted(c)).alias("s")) for c in columns])).alias("e"))
    shift = F.col("e.s.mean") - F.col("e.middle")
    sums = {
        "rows": F.sum("n"), "filled": F.sum("e.s.filled"), "first": F.sum(F.col("e.s.filled") * shift), "second": F.sum(F.col("e.s.m2") + F.col("e.s.filled") * shift * shift),
        "low": F.min("e.s.low"), "high": F.max("e.s.high"), "middle": F.max("e.middle"),
    }
    if distinct:
        sums["distinct"] = F.hll_sketch_estimate(F.hll_union_agg("e.s.distinct"))
    out = None
    for chosen in sets:  # each merges the written states, a row for each combination
        level = sum(1 << len(dims) - 1 - i for i, d in enumerate(dims) if d not in chosen)
        grouped = long.groupBy(*map(quoted, chosen), F.col("e.column").alias("column")).agg(*[v.alias(f"_{k}") for k, v in sums.items()])
        names = [F.col(quoted(d)) if d in chosen else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims]
        part = grouped.select(F.lit(level).alias("level"), *names, "column", *[f"_{k}" for k in sums])
        out = part if out is None else out.unionByName(part)
    shifted = F.col("_first") / F.col("_filled")
    spread = F.greatest(F.col("_second") - F.col("_first") * shifted, F.lit(0.0)) / (F.col("_filled") - 1)
    made = [F.col("_rows").alias("rows"), F.col("_filled").alias("filled"), F.when(F.col("_filled") > 0, F.col("_middle") + shifted).alias("mean"), F.when(F.col("_filled") > 1, F.sqrt(spread)).alias("std")]
    made += [F.col("_low").alias("low"), F.col("_high").alias("high"), *([F.col("_distinct").alias("distinct")] if distinct else [])]
    return out.select("level", *map(quoted, dims), "column", *made)


# --- stored sketches -----------------------------------------------------------------------

QUANTILE_SIZE = 400
RANK_ERROR = 0.0068  # of a sketch of that size: 99 in 100 ranks are told within it, as a share of the values


def sketches(df: DataFrame, keys: list[str], columns: list[str], size: int = QUANTILE_SIZE) -> DataFrame:
    """(keys, column, n, quantiles, distinct): a sketch of the ranks and one of the distinct values for each key and numeric column.

    Store it by day or by load; merged() gives those of any coarser grouping.  Missing cells and NaNs are left out; a column
    without values has an empty sketch.
    """
    rows = df.select(*map(quoted, keys), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None)).alias("x")) for c in columns])).alias("e"))
    grouped = rows.groupBy(*map(quoted, keys), F.col("e.column").alias("column"))
    return grouped.agg(F.count("e.x").alias("n"), F.kll_sketch_agg_double("e.x", F.lit(size)).alias("quantiles"), F.hll_sketch_agg(F.col("e.x").cast("string"), DISTINCT_BITS).alias("distinct"))


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of sketches(), by coarser keys; states are merged, the data is not read."""
    return stored.groupBy(*map(quoted, keys), "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def sketched_quantiles(stored: DataFrame, shares: list[float]) -> DataFrame:
    """(keys, column, share, value) and the number of distinct values: values whose rank is within RANK_ERROR of the share."""
    told = F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, shares))).alias("value"))).alias("q")
    rest = [F.col(quoted(c)) for c in stored.columns if c not in ("quantiles", "distinct")]
    return stored.filter("n > 0").select(*rest, F.hll_sketch_estimate("distinct").alias("distinct"), told).select(*rest, "distinct", "q.*")


def sketched_ks(left: DataFrame, right: DataFrame, steps: int = 500) -> DataFrame:
    """(keys, column, statistic, bound) for two tables of sketches with the same keys: how far their distributions lie apart at most.

    Each side stands for itself with steps quantiles, and these are counted up to each value of both; the exact statistic is within bound of the one
    told: RANK_ERROR of either side and the share of a quantile.  Keys that only one side has are left out.
    """
    keys = [c for c in left.columns if c not in ("n", "quantiles", "distinct")]
    at = F.array(*[F.lit((i + 0.5) / steps) for i in range(steps)])
    sides = []
    for sketched, one, two in ((left, 1, 0), (right, 0, 1)):
        told = sketched.filter("n > 0").select(*map(quoted, keys), F.explode(F.kll_sketch_get_quantile_double("quantiles", at)).alias("_x"))
        sides.append(told.select("*", F.lit(one).alias("_l"), F.lit(two).alias("_r")))
    values = sides[0].unionByName(sides[1]).groupBy(*map(quoted, keys), "_x").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    upto = Window.partitionBy(*map(quoted, keys)).orderBy("_x")  # no more than two times steps rows for a key
    apart = values.select(*map(quoted, keys), F.sum("_l").over(upto).alias("_l"), F.sum("_r").over(upto).alias("_r"))
    found = apart.groupBy(*map(quoted, keys)).agg((F.max(F.abs(F.col("_l") - F.col("_r"))) / steps).alias("statistic"), F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return found.filter("_l > 0 AND _r > 0").drop("_l", "_r").withColumn("bound", F.lit(2 * RANK_ERROR + 1 / steps))


# --- aggregates that a caller defines ------------------------------------------------------


@dataclass(frozen=True)
class Aggregate:
    """A user-defined aggregate over Arrow batches: states are bytes, so that they can be shuffled and merged in any order.

    init() gives an empty state; update(state, batch) adds rows of one group; merge(state, state) joins two; finish(state) gives the
    result, a dict of the columns of result (a DDL string).
    """

    init: Callable[[], bytes]
    update: Callable[[bytes, pa.RecordBatch], bytes]
    merge: Callable[[bytes, bytes], bytes]
    finish: Callable[[bytes], dict[str, Any]]
    result: str


STATES = 50_000
FAN = 64


def _updated(keys: list[str], columns: list[str], aggregate: Aggregate, most: int):
    """Rows to states: one for each group that a task sees, given out early where there are too many to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, bytes] = {}
        at: dict[tuple, pa.RecordBatch] = {}

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(list(at.values())).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(states.values()), pa.binary())], [*rows.schema.names, "_state"])

        for batch in batches:
            own = batch.select(keys)
            places: dict[tuple, list[int]] = {}
            cells = [c.to_pylist() for c in own.columns]
            for i, key in enumerate(zip(*cells, strict=True) if cells else [()] * batch.num_rows):
                places.setdefault(key, []).append(i)
            data = batch.select(columns)
            for key, rows in places.items():
                if key not in states:
                    states[key], at[key] = aggregate.init(), own.slice(rows[0], 1)
                states[key] = aggregate.update(states[key], data if len(rows) == batch.num_rows else data.take(pa.array(rows)))
            if len(states) > most:
                yield out()
                states, at = {}, {}
        if states:
            yield out()

    return run


def _merged_states(keys: list[str], aggregate: Aggregate, last: bool, names: list[str], kinds: list[pa.DataType]):
    """Sorted states to one for each run of equal keys; only the present one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, row = None, None, None

        def out(rows: list[tuple[pa.RecordBatch, bytes]]) -> pa.RecordBatch:
            whole = pa.Table.from_batches([r for r, _ in rows]).combine_chunks().to_batches()[0]
            if not last:
                return pa.RecordBatch.from_arrays([*whole.columns, pa.array([s for _, s in rows], pa.binary())], [*whole.schema.names, "_state"])
            done = [aggregate.finish(s) for _, s in rows]
            return pa.RecordBatch.from_arrays([*whole.columns, *[pa.array([d[n] for d in done], k) for n, k in zip(names, kinds, strict=True)]], [*whole.schema.names, *names])

        for batch in batches:
            done, own = [], batch.select(keys) if keys else batch.select(["_state"])
            cells = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            for i, s in enumerate(batch.column(batch.schema.get_field_index("_state")).to_pylist()):
                here = tuple(c[i] for c in cells)
                if state is not None and here == key:
                    state = aggregate.merge(state, s)
                    continue
                if state is not None:
                    done.append((row, state))
                key, state, row = here, s, own.slice(i, 1)
            if done:
                yield out(done)
        if state is not None:
            yield out([(row, state)])

    return run


def aggregated(df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, most: int = STATES, fan: int = FAN) -> DataFrame:
    """(keys, the aggregate's result) for each combination of keys over the given columns; a NaN key should not be used.

    Tasks update states batch by batch, so a hot key is one state a task when it is shuffled; states are merged twice, first within fan parts of each key, then over
    these.  A task holds at most ``most`` states while it updates and one while it merges, never a group's rows.  Missing keys are a key.  Empty in, empty out.
    """
    key_fields = [df.schema[k] for k in keys]
    state = T.StructType([*key_fields, T.StructField("_state", T.BinaryType())])
    result = T.StructType.fromDDL(aggregate.result)
    read = list(dict.fromkeys([*keys, *columns]))
    states = df.select(*map(quoted, read)).mapInArrow(_updated(keys, columns, aggregate, most), state)
    if not keys:
        states = states.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    kinds = [to_arrow_type(f.dataType) for f in result.fields]
    part = F.pmod(F.xxhash64("_state", F.monotonically_increasing_id()), F.lit(fan)).cast("int")
    parted = states.withColumn("_part", part).repartition(*map(quoted, by), "_part").sortWithinPartitions(*map(quoted, by), "_part")
    names, some = [f.name for f in result.fields], T.StructType([*(key_fields or [T.StructField("_all", T.IntegerType())]), T.StructField("_state", T.BinaryType())])
    once = parted.select(*map(quoted, by), "_state").mapInArrow(_merged_states(by, aggregate, False, names, kinds), some)
    done = once.repartition(*map(quoted, by)).sortWithinPartitions(*map(quoted, by))
    out = done.mapInArrow(_merged_states(by, aggregate, True, names, kinds), T.StructType([*some.fields[:-1], *result.fields]))
    return out.select(*map(quoted, [*keys, *names]))
