"""Quality profile of one table.  Every profile is one aggregate, turned long at the end."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ranks import exact_quantiles, running_totals
from plumbline.session import numeric_columns, quoted, string_columns, with_stats

# Fixed value: text without control characters; one trailing line feed passes.
CLEAN_TEXT = r"(?d)^[^\x00-\x1f]*$"
NON_ASCII = r"[^\x00-\x7F]"


def per_column(df: DataFrame, columns: list[str], **metrics) -> DataFrame:
    """One row per column, one field per metric; ``metrics`` map a Column to an aggregate."""
    if not columns:
        schema = df.sparkSession.range(0).select(F.lit("").alias("column"), *[F.lit(0.0).alias(m) for m in metrics])
        return schema
    rows = [
        F.struct(F.lit(c).alias("column"), *[fn(F.col(quoted(c))).alias(m) for m, fn in metrics.items()]) for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def mean_of(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null for an empty whole."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def completeness(df: DataFrame) -> DataFrame:
    """(column, filled, rows, completeness); the row ``*`` covers all cells."""
    cols = df.columns
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(cols)])
    total = functools.reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(cols))])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled"), F.col("n").alias("cells"))
        for i, c in enumerate(cols)
    ]
    rows.append(F.struct(F.lit("*").alias("column"), total.alias("filled"), (F.col("n") * len(cols)).alias("cells")))
    return counted.select(F.inline(F.array(*rows))).withColumn("completeness", share(F.col("filled"), F.col("cells")))


def null_counts(df: DataFrame) -> DataFrame:
    return per_column(df, df.columns, nulls=lambda c: F.count_if(c.isNull()))


def distinct_counter(approximate: bool):
    return F.approx_count_distinct if approximate else F.count_distinct


def uniqueness_by_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values over all rows.  Exact counts are planned as expand + two-level grouping."""
    count = distinct_counter(approximate)
    out = per_column(df, df.columns, distinct_values=count, total=lambda c: F.count(F.lit(1)))
    return out.select("column", "distinct_values", F.coalesce(share(F.col("distinct_values"), F.col("total")), F.lit(0.0)).alias("uniqueness"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Repeats after the first (nulls equal) and their share of all rows."""
    groups = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"), F.sum("_n").alias("_rows"))
    return out.select("duplicate_rows", share(F.col("duplicate_rows"), F.col("_rows")).alias("duplicate_ratio"))


def uniqueness_score(df: DataFrame) -> DataFrame:
    """(mean over columns of distinct / non-null  +  distinct rows / rows) / 2."""
    cols = df.columns
    by_column = df.agg(
        *[F.coalesce(share(F.count_distinct(F.col(quoted(c))), F.count(F.col(quoted(c)))), F.lit(0.0)).alias(f"u{i}") for i, c in enumerate(cols)]
    ).select(mean_of([F.col(f"u{i}") for i in range(len(cols))]).alias("column_uniqueness"))
    rows = df.groupBy(*[F.col(quoted(c)) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    by_row = rows.agg(F.coalesce(share(F.count(F.lit(1)), F.sum("_n")), F.lit(0.0)).alias("row_uniqueness"))
    return by_row.select(by_column.scalar().alias("column_uniqueness"), "row_uniqueness").select(
        "column_uniqueness",
        "row_uniqueness",
        ((F.col("column_uniqueness") + F.col("row_uniqueness")) / 2.0).alias("uniqueness_score"),
    )


def string_consistency(df: DataFrame) -> DataFrame:
    out = per_column(
        df,
        string_columns(df),
        avg_length=lambda c: F.coalesce(F.avg(F.length(c)), F.lit(0.0)),
        length_std=lambda c: F.when(F.count(c) == 0, F.lit(0.0)).otherwise(F.stddev_samp(F.length(c))),
    )
    ratio = F.col("length_std") / F.nullif(F.col("avg_length"), F.lit(0.0))
    return out.withColumn("format_consistency", F.when(F.col("avg_length") > 0, F.lit(1.0) - ratio).otherwise(F.lit(1.0)))


def numeric_consistency(df: DataFrame) -> DataFrame:
    out = per_column(
        df, numeric_columns(df), mean=lambda c: F.avg(c.cast("double")), std=lambda c: F.stddev_samp(c.cast("double"))
    ).where("mean is not null")
    ratio = F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))
    return out.withColumn("coefficient_of_variation", F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(ratio))


def consistency_by_column(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """Share of the filled cells that are of the column's type; with ``expected``, that can be cast to that type.

    A string column without a filled cell has no score (null).
    """
    expected = expected or {}
    types = {f.name: f.dataType for f in df.schema.fields}

    def score(name: str) -> Column:
        c = F.col(quoted(name))
        if name in expected:
            return share(F.count(c.try_cast(expected[name])), F.count(c))
        if isinstance(types[name], T.StringType):
            return F.when(F.count(c) > 0, F.lit(1.0))
        return F.lit(1.0)

    rows = [F.struct(F.lit(c).alias("column"), score(c).alias("consistency")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def consistency_score(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    by_column = consistency_by_column(df, expected)
    return by_column.agg(F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("consistency_score"))


def validity_by_column(df: DataFrame) -> DataFrame:
    """64-bit numbers: finite share.  Text: share without control characters.  Others 1.  No filled cell: 0."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def score(name: str) -> Column:
        c, kind = F.col(quoted(name)), types[name]
        if isinstance(kind, T.DoubleType):
            finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
            # a NaN counts as a missing cell
            filled = F.count_if(c.isNotNull() & ~F.isnan(c))
            ratio = share(F.count_if(finite), filled)
        elif isinstance(kind, T.StringType):
            ratio = share(F.count_if(c.rlike(CLEAN_TEXT)), F.count(c))
        else:
            ratio = F.when(F.count(c) > 0, F.lit(1.0))
        return F.coalesce(ratio, F.lit(0.0))

    rows = [F.struct(F.lit(c).alias("column"), score(c).alias("validity")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def validity_score(df: DataFrame) -> DataFrame:
    return validity_by_column(df).agg(F.coalesce(F.avg("validity"), F.lit(1.0)).alias("validity_score"))


def encoding_issues(df: DataFrame) -> DataFrame:
    """Number of string columns that hold any non-ASCII character."""
    hits = [F.coalesce(F.bool_or(F.col(quoted(c)).rlike(NON_ASCII)), F.lit(False)).cast("int") for c in string_columns(df)]
    total = functools.reduce(lambda a, b: a + b, hits) if hits else F.lit(0)
    return df.agg(total.cast("long").alias("encoding_issues"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, small_rows: int | None = None) -> DataFrame:
    """count, mean, sample std, min, linear quartiles, max per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    base = per_column(
        df,
        columns,
        filled=F.count,
        mean=lambda c: F.avg(c.cast("double")),
        std=lambda c: F.stddev_samp(c.cast("double")),
        min=lambda c: F.min(c.cast("double")),
        max=lambda c: F.max(c.cast("double")),
    )
    cuts = [0.25, 0.5, 0.75]
    if approximate:
        quartiles = df.agg(*[F.percentile_approx(F.col(quoted(c)).cast("double"), cuts).alias(c) for c in columns])
    else:
        quartiles = exact_quantiles(df, columns, cuts, **({} if small_rows is None else {"small_rows": small_rows}))
    long = quartiles.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("q")) for c in columns]))
    )
    # both sides hold one row per column
    joined = base.join(F.broadcast(long), "column")
    return joined.select(
        "column", "filled", "mean", "std", "min",
        F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max",
    )


def _number(name: str) -> Column:
    """The column as double with NaN read as missing."""
    return F.nanvl(F.col(quoted(name)).cast("double"), F.lit(None).cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over the rows where both are filled, null where either does not vary.

    (The built-in ``corr`` fails on a constant column under ANSI arithmetic.)
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every column pair (a before b) over the rows where both are filled; null for a constant column.

    Columns without gaps share their sums, taken around the column means, so k
    columns need k * (k + 3) / 2 plain sums; only pairs with a gap get sums of their own.
    """
    columns = numeric_columns(df) if columns is None else columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.range(0).select(F.lit("").alias("column_a"), F.lit("").alias("column_b"), F.lit(0.0).alias("r"))
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(_number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("c", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))],
    ).first()
    at = {c: i for i, c in enumerate(columns)}
    constant = {c for c in columns if first[f"lo{at[c]}"] == first[f"hi{at[c]}"]}
    whole = {c for c in columns if first[f"c{at[c]}"] == first["n"]}
    # centred once per column, so that the sums below only multiply columns
    centred = df.select(*[(_number(c) - F.lit(first[f"m{i}"]).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    shared = [at[c] for c in columns if c in whole and c not in constant]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in shared] + [F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in shared]
    pieces, n = [], float(first["n"])
    for j, (a, b) in enumerate(pairs):
        i, k = at[a], at[b]
        if a in constant or b in constant:
            r = "cast(null as double)"
        elif a in whole and b in whole:
            sums.append(F.sum(F.col(f"x{i}") * F.col(f"x{k}")).alias(f"p{j}"))
            r = f"(p{j} - s{i} * s{k} / {n!r}D) / nullif(sqrt((q{i} - s{i} * s{i} / {n!r}D) * (q{k} - s{k} * s{k} / {n!r}D)), 0D)"
        else:
            sums.append(pearson(F.col(f"x{i}"), F.col(f"x{k}")).alias(f"p{j}"))
            r = f"p{j}"
        pieces.append(f"named_struct('a', {i}, 'b', {k}, 'r', {r})")
    measured = centred.agg(*sums) if sums else df.sparkSession.range(1)
    names = F.lit(list(columns))
    return measured.select(F.expr(f"inline(array({', '.join(pieces)}))")).select(
        F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"), "r"
    )


def schema_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Position, column, type, nulls, distinct non-null values and rows.  Exact counts group (position, value), columns of one type together."""
    types = dict(df.dtypes)
    if approximate:
        rows = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("type"),
                F.count_if(F.col(quoted(c)).isNull()).alias("nulls"),
                F.approx_count_distinct(F.col(quoted(c))).alias("distinct_values"),
                F.count(F.lit(1)).alias("total_rows"),
            )
            for i, c in enumerate(df.columns)
        ]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    parts = []
    for kind in dict.fromkeys(types.values()):
        cells = [F.struct(F.lit(i).alias("position"), F.col(quoted(c)).alias("value")) for i, c in enumerate(df.columns) if types[c] == kind]
        values = df.select(F.inline(F.array(*cells))).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.groupBy("position").agg(F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("distinct_values"), F.sum("n").alias("total_rows")))
    zero = F.lit(0).cast("long")
    columns = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("type")) for i, c in enumerate(df.columns)]
    listed = df.sparkSession.range(1).select(F.inline(F.array(*columns)))  # a table without rows has its columns too
    counted = F.broadcast(functools.reduce(DataFrame.unionByName, parts))  # a row a column
    return listed.join(counted, "position", "left").select("position", "column", "type", *[F.coalesce(c, zero).alias(c) for c in ("nulls", "distinct_values", "total_rows")])


def quality_report(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness, duplicates, encoding, summary and correlations as (metric, column, value)."""

    def long(part: DataFrame, column: Column, *metrics: str) -> DataFrame:
        return part.select(
            F.inline(
                F.array(*[F.struct(F.lit(m).alias("metric"), column.alias("column"), F.col(m).cast("double").alias("value")) for m in metrics])
            )
        )

    name, overall = F.col("column"), F.lit("*")
    parts = [
        long(completeness(df), name, "completeness"),
        long(uniqueness_by_column(df), name, "uniqueness"),
        long(duplicate_rows(df), overall, "duplicate_rows", "duplicate_ratio"),
        long(encoding_issues(df), overall, "encoding_issues"),
    ]
    if numeric_columns(df):
        parts.append(long(describe_numeric(df), name, "filled", "mean", "std", "min", "q25", "q50", "q75", "max"))
    if len(numeric_columns(df)) > 1:
        parts.append(long(correlation_pairs(df), F.concat_ws("~", "column_a", "column_b"), "r"))
    return functools.reduce(DataFrame.unionByName, parts)


def _stat(name: str) -> Column:
    return F.col(f"_stats.{quoted(name)}")


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row; per column a struct of mean and population std."""
    number = lambda c: F.col(quoted(c)).cast("double")
    return df.agg(*[F.struct(F.avg(number(c)).alias("m"), F.stddev_pop(number(c)).alias("s")).alias(c) for c in columns])


def _outlier_rows(df: DataFrame, stats: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """Rows (keys, column, value) of the cells whose test holds; one pass, no shuffle."""
    cells = F.array(
        *[
            F.when(test, F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("double").alias("value")))
            for c, test in tests.items()
        ]
    )
    hits = with_stats(df, stats).select(*[F.col(quoted(k)) for k in keys], cells.alias("cells")).select(*keys, F.explode_outer("cells").alias("cell"))
    return hits.where("cell is not null").select(*keys, "cell.column", "cell.value")


def outliers_iqr(df: DataFrame, keys: list[str], columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Cells outside quartile 1 - 1.5 IQR .. quartile 3 + 1.5 IQR."""
    columns = [c for c in numeric_columns(df) if c not in keys] if columns is None else columns
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], rows)
    tests = {}
    for c in columns:
        low, high = F.get(_stat(c), F.lit(0)), F.get(_stat(c), F.lit(1))
        value = F.col(quoted(c)).cast("double")
        tests[c] = (value < low - (high - low) * 1.5) | (value > high + (high - low) * 1.5)
    return _outlier_rows(df, quartiles, keys, tests)


def outliers_zscore(df: DataFrame, keys: list[str], columns: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Cells more than ``threshold`` population standard deviations from the mean."""
    columns = [c for c in numeric_columns(df) if c not in keys] if columns is None else columns
    tests = {}
    for c in columns:
        distance = F.abs(F.col(quoted(c)).cast("double") - _stat(c)["m"])
        tests[c] = (_stat(c)["s"] > 0) & (distance > F.lit(threshold) * _stat(c)["s"])
    return _outlier_rows(df, _moments(df, columns), keys, tests)


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean and upper median (element n div 2) of text length over the non-empty texts."""
    lengths = (
        df.select(F.length(F.col(quoted(column))).cast("long").alias("value"))
        .where("value > 0")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(0).alias("key"), "value", "n")
    )
    ranked = running_totals(lengths, "key", "value", ["n"], {})
    return ranked.groupBy(F.lit(column).alias("column")).agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.min(F.when(F.col("upto_n") > F.floor(F.col("all_n") / 2), F.col("value"))).alias("median_length"),
    )


def counts_by_key(df: DataFrame, dimensions: dict[str, Column], missing: str = "unknown") -> DataFrame:
    """(dimension, key, n) for several keys in one pass; a missing key counts as ``missing``."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.coalesce(key.cast("string"), F.lit(missing)).alias("key"))
            for name, key in dimensions.items()
        ]
    )
    return df.select(F.inline(pairs)).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def avg_list_size(df: DataFrame, column: str) -> DataFrame:
    """Mean list length; a missing list counts as empty."""
    return df.agg(F.avg(F.coalesce(F.size(F.col(quoted(column))), F.lit(0)).cast("double")).alias("avg_size"))


def histogram_density(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Density-normalised equal-width histogram of each column over its own range; empty bins included."""
    edges = df.agg(
        *[
            F.struct(
                F.min(F.col(quoted(c)).cast("double")).alias("lo"),
                F.max(F.col(quoted(c)).cast("double")).alias("hi"),
                F.count(F.col(quoted(c))).alias("n"),
            ).alias(c)
            for c in columns
        ]
    )
    cells = []
    for c in columns:
        span = _stat(c)
        flat = span["lo"] == span["hi"]  # a constant column gets a range of width one
        lo = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
        width = F.when(flat, F.lit(1.0)).otherwise(span["hi"] - span["lo"])
        value = F.col(quoted(c)).cast("double")
        bin_no = F.least(F.floor((value - lo) / width * float(bins)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), bin_no.alias("bin")))
    placed = with_stats(df, edges).select(F.inline_outer(F.array(*cells)))
    counted = placed.where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("span")) for c in columns]))
    ).select("column", "span", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    flat = F.col("span.lo") == F.col("span.hi")
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("span.hi") - F.col("span.lo")) / float(bins)
    # grid and counts hold at most columns x bins rows
    return grid.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.when(flat, F.col("span.lo") - 0.5).otherwise(F.col("span.lo")) + F.col("bin") * width).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("span.n") * width)).alias("density"),
    )
