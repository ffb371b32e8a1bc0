"""Order statistics that never put a whole column into one task.

* ``running_totals``: running sums over an ordered column, in two phases: inside
  value buckets (parallel), then bucket offsets (a few rows) joined back.
* ``exact_quantiles``: linear-interpolated quantiles.  Small tables use Spark's
  ``percentile``; beyond ``SMALL_ROWS`` rows a sample brackets the wanted ranks,
  counts make the brackets certain, and only the few values inside are fetched.
  Nothing is shuffled, and a poor sample costs a round, never exactness.
* ``smallest_k_cutoffs``: exact selection of k rows by their uniform 64-bit draw.
* ``top_per_group``: the first k rows of every group, hot groups included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import quoted

SMALL_ROWS = 250_000
ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 4096
SAMPLES_PER_BUCKET = 64
SAMPLE_ROWS = 200_000
FETCH_ROWS = 100_000
SIGMAS = 6.0


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket)))


def bucket_index(value: Column, bounds: list) -> Column:
    """How many sorted ``bounds`` lie below ``value``, found in two short array scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(b[-1]) for b in blocks])
    nested = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    coarse = F.size(F.filter(heads, lambda h: h < value))
    fine = F.size(F.filter(F.get(nested, coarse), lambda b: b < value))
    return F.when(coarse < len(blocks), coarse * step + fine).otherwise(F.lit(len(bounds)))


def numeric_bounds(df: DataFrame, columns: list[str], buckets: int, rows: int) -> dict[str, list[float]]:
    """Roughly equal-depth bounds of each column from a sample of bounded size; they steer work, not results."""
    if buckets <= 1:
        return {c: [] for c in columns}
    fraction = min(1.0, SAMPLES_PER_BUCKET * buckets / max(rows, 1))
    sample = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns]).sample(fraction, seed=7).toArrow().to_pandas()
    out = {}
    for c in columns:
        values = np.sort(sample[c].to_numpy(dtype=float))
        values = values[~np.isnan(values)]
        at = (np.arange(1, buckets) * len(values)) // buckets
        out[c] = [float(v) for v in np.unique(values[at])] if len(values) else []
    return out


def sampled_bounds(distinct: DataFrame, column: str, buckets: int) -> list:
    """Bounds for a column of any orderable type from the values of smallest hash (a fixed-size sample)."""
    if buckets <= 1:
        return []
    col = F.col(quoted(column))
    size = 64 * buckets
    rows = distinct.select(col.alias("v")).where(col.isNotNull()).orderBy(F.xxhash64("v")).limit(size).collect()
    values = sorted(r["v"] for r in rows)
    return sorted({values[i * len(values) // buckets] for i in range(1, buckets)}) if values else []


def running_totals(
    counts: DataFrame, key: str, value: str, measures: list[str], bounds: dict[int, list]
) -> DataFrame:
    """Add ``upto_<m>`` (inclusive running sum by value), ``all_<m>`` and ``next_value`` per key.

    ``counts`` holds one row per (key, value); the key is a small number (a column's place), which
    sorts much faster than a name.  ``bounds`` gives the bucket bounds of each key.
    """
    if not any(bounds.values()):  # one bucket per key: the running sum is already whole
        whole = Window.partitionBy(key)
        ordered = whole.orderBy(value)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.select(
            key,
            value,
            *measures,
            *[F.sum(m).over(upto).alias(f"upto_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
            F.lead(value).over(ordered).alias("next_value"),
        )
    bucket = F.lit(0)
    for name, cuts in bounds.items():
        if cuts:
            bucket = F.when(F.col(key) == name, bucket_index(F.col(value), cuts)).otherwise(bucket)
    # never null, so that the join below does not test it on every input row
    bucket = F.coalesce(bucket, F.lit(0))
    bucketed = counts.withColumn("_bucket", bucket)
    ordered = Window.partitionBy(key, "_bucket").orderBy(value)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select(
        "*",
        *[F.sum(m).over(upto).alias(f"_run_{m}") for m in measures],
        F.lead(value).over(ordered).alias("_next"),
    )
    totals = bucketed.groupBy(key, "_bucket").agg(
        *[F.sum(m).alias(m) for m in measures], F.min(value).alias("_first")
    )
    by_bucket = Window.partitionBy(key).orderBy("_bucket")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(key)
    # at most one row per key and bucket: keys are column names, buckets are capped by MAX_BUCKETS
    offsets = totals.select(
        F.col(key),
        F.col("_bucket"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(everything).alias(f"all_{m}") for m in measures],
        F.lead("_first").over(by_bucket).alias("_next_first"),
    )
    joined = local.join(F.broadcast(offsets), [key, "_bucket"])
    return joined.select(
        key,
        value,
        *measures,
        *[(F.col(f"_run_{m}") + F.col(f"_off_{m}")).alias(f"upto_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
        F.coalesce(F.col("_next"), F.col("_next_first")).alias("next_value"),
    )


def dense_ranks(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Each distinct non-null value of ``column`` with its 0-based rank: columns (value, rank).

    ``rows`` is the number of distinct values where it is known; otherwise it is estimated.
    """
    if rows is None:
        rows = df.select(F.approx_count_distinct(F.col(quoted(column)))).first()[0]
    distinct = df.select(F.col(quoted(column)).alias("value")).where("value is not null").distinct()
    buckets = bucket_count(rows)
    cuts = sampled_bounds(distinct, "value", buckets)
    ranked = running_totals(
        distinct.select(F.lit(0).alias("key"), "value", F.lit(1).cast("long").alias("n")),
        "key",
        "value",
        ["n"],
        {0: cuts},
    )
    return ranked.select("value", (F.col("upto_n") - 1).alias("rank"))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], rows: int | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """One row; per column an array of exact linear-interpolated quantiles (null for an empty column)."""
    rows = df.count() if rows is None else rows
    if rows <= small_rows:
        return df.agg(
            *[
                F.percentile(F.when(_inside(F.col(quoted(c)).cast("double"), -math.inf, math.inf), F.col(quoted(c)).cast("double")), F.lit([float(p) for p in probabilities])).alias(c)
                for c in columns
            ]
        )
    found = _select_ranks(df, columns, probabilities)
    lists = [F.lit(found[c] or None).cast("array<double>").alias(c) for c in columns]
    return df.sparkSession.range(1).select(*lists)


def _inside(value: Column, low: float, high: float) -> Column:
    test = value.isNotNull() & ~F.isnan(value)
    if low > -math.inf:
        test = test & (value > F.lit(low))
    if high < math.inf:
        test = test & (value < F.lit(high))
    return test


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _select_ranks(
    df: DataFrame, columns: list[str], probabilities: list[float], sample_rows: int = SAMPLE_ROWS, fetch_rows: int = FETCH_ROWS
) -> dict[str, list[float]]:
    values = {c: F.col(quoted(c)).cast("double") for c in columns}
    named = [values[c].alias(c) for c in columns]
    row = df.agg(*[F.count_if(_inside(values[c], -math.inf, math.inf)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    answer: dict[tuple[str, int], float] = {}
    # wanted (column, rank) -> open interval that holds it, rows up to its lower end, rows inside
    state: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for c in columns:
        for p in probabilities:
            if sizes[c]:
                for rank in (math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1))):
                    state[(c, rank)] = (-math.inf, math.inf, 0, sizes[c])
    boost = 1.0
    while state:
        small = [k for k, s in state.items() if s[3] <= fetch_rows]
        if small:
            tests = [_inside(values[c], state[(c, r)][0], state[(c, r)][1]) for c, r in small]
            got = df.where(_any(tests)).select(*named).toArrow().to_pandas()
            for c, r in small:
                low, high, below, _ = state.pop((c, r))
                v = got[c].to_numpy(dtype=float)
                v = v[(v > low) & (v < high)]
                answer[(c, r)] = float(np.partition(v, r - below)[r - below])
        if not state:
            break
        intervals = {(c, *state[(c, r)]) for c, r in state}
        fraction = min(1.0, boost * sample_rows * len(intervals) / sum(i[4] for i in intervals))
        source = df
        if any(i[1] > -math.inf or i[2] < math.inf for i in intervals):
            source = df.where(_any([_inside(values[i[0]], i[1], i[2]) for i in intervals]))
        sample = source.select(*named).sample(fraction, seed=11).toArrow().to_pandas()
        guess = {}
        for c, r in state:
            low, high, below, inside = state[(c, r)]
            v = sample[c].to_numpy(dtype=float)
            v = np.sort(v[(v > low) & (v < high)])
            if len(v):
                middle = (r - below) / inside * len(v)
                slack = SIGMAS * math.sqrt(len(v) * 0.25) + 2
                guess[(c, r)] = (float(v[max(0, int(middle - slack))]), float(v[min(len(v) - 1, int(middle + slack))]))
        if not guess:
            boost *= 4.0
            continue
        brackets = sorted({(k[0], *g) for k, g in guess.items()})
        aggs = []
        for i, (c, lo, hi) in enumerate(brackets):
            v = values[c]
            aggs += [
                F.count_if(v < F.lit(lo)).alias(f"l{i}"),
                F.count_if(v == F.lit(lo)).alias(f"a{i}"),
                F.count_if((v > F.lit(lo)) & (v < F.lit(hi))).alias(f"m{i}"),
                F.count_if(v == F.lit(hi)).alias(f"z{i}"),
            ]
        seen = df.agg(*aggs).first()
        for k, (lo, hi) in guess.items():
            i = brackets.index((k[0], lo, hi))
            low, high, below, inside = state[k]
            rank = k[1]
            under, at_lo, middle, at_hi = seen[f"l{i}"], seen[f"a{i}"], seen[f"m{i}"], seen[f"z{i}"]
            if rank < under:
                state[k] = (low, lo, below, under - below)
            elif rank < under + at_lo:
                answer[k] = lo
                del state[k]
            elif lo < hi and rank < under + at_lo + middle:
                state[k] = (lo, hi, under + at_lo, middle)
            elif lo < hi and rank < under + at_lo + middle + at_hi:
                answer[k] = hi
                del state[k]
            else:
                reached = under + at_lo + (middle + at_hi if lo < hi else 0)
                state[k] = (hi, high, reached, below + inside - reached)
    out = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if sizes[c]:
                pos = p * (sizes[c] - 1)
                a, b = answer[(c, math.floor(pos))], answer[(c, math.ceil(pos))]
                out[c].append(a + (b - a) * (pos - math.floor(pos)))
    return out


LOWEST, SPAN = -(2**63), 2**64


def smallest_k_cutoffs(df: DataFrame, draws: dict[str, Column], k: int, rows: int, fetch_rows: int = FETCH_ROWS) -> dict[str, int]:
    """For each named uniform 64-bit draw, the value of its k-th smallest row (signed order).

    Uniform draws put the k-th smallest near ``k / rows`` of the range: count around
    there, keep the part that holds it, and fetch that part once it is small.  A bad
    guess (or repeated draws) halves the range instead, so the search always ends.
    """
    if not 0 < k <= rows:
        raise ValueError("k must lie between 1 and the number of rows")
    lit = lambda x: F.lit(x).cast("long")
    # range that holds the k-th draw, rows below it, rows inside it
    state = {n: (LOWEST, LOWEST + SPAN - 1, 0, rows) for n in draws}
    small: dict[str, tuple[int, int, int]] = {}
    cutoffs: dict[str, int] = {}
    while state:
        guess = {}
        for n, (low, high, below, inside) in state.items():
            share = (k - below) / max(inside, 1)
            reach = 8.0 * math.sqrt(inside * max(0.0, share * (1.0 - share))) + 64.0
            width = high - low
            a = max(low, low + int((share - reach / max(inside, 1)) * width))
            b = min(high, low + int((share + reach / max(inside, 1)) * width))
            guess[n] = (a, b) if a <= b and 2 * (b - a) <= width else (low, low + width // 2)
        names = list(state)
        counted = df.agg(
            *[F.count_if(draws[n] < lit(guess[n][0])).alias(f"l{i}") for i, n in enumerate(names)],
            *[F.count_if(draws[n].between(lit(guess[n][0]), lit(guess[n][1]))).alias(f"m{i}") for i, n in enumerate(names)],
            *[F.count_if(draws[n] <= lit(state[n][1])).alias(f"h{i}") for i, n in enumerate(names)],
        ).first()
        for i, n in enumerate(names):
            low, high, below, _ = state[n]
            (a, b), less, middle, upto = guess[n], counted[f"l{i}"], counted[f"m{i}"], counted[f"h{i}"]
            if k > upto:
                raise ValueError(f"fewer than {k} rows")
            if k <= less:
                low, high, inside = low, a - 1, less - below
            elif k <= less + middle:
                low, high, below, inside = a, b, less, middle
            else:
                low, high, below, inside = b + 1, high, less + middle, upto - less - middle
            if low == high:
                cutoffs[n] = low
            elif inside <= fetch_rows:
                small[n] = (low, high, below)
            else:
                state[n] = (low, high, below, inside)
                continue
            del state[n]
    if small:
        tests = [draws[n].between(lit(low), lit(high)) for n, (low, high, _) in small.items()]
        got = df.where(_any(tests)).select(*[draws[n].alias(f"d{i}") for i, n in enumerate(small)]).toArrow().to_pandas()
        for i, (n, (low, high, below)) in enumerate(small.items()):
            v = got[f"d{i}"].to_numpy()
            v = v[(v >= low) & (v <= high)]
            cutoffs[n] = int(np.partition(v, k - below - 1)[k - below - 1])
    return cutoffs


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, spread_on: str, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group, with ``place`` 1..k.

    Two stages: the best k of each salted part of a group, then the best k of those,
    so a group holding much of the table is still sorted by many tasks.
    """
    salt = F.pmod(F.xxhash64(F.col(quoted(spread_on))), F.lit(salts))
    groups = [F.col(quoted(c)) for c in keys]
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    kept = df.withColumn("_salt", salt).withColumn("place", F.row_number().over(part)).where(F.col("place") <= k)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return kept.drop("_salt", "place").withColumn("place", F.row_number().over(whole)).where(F.col("place") <= k)
