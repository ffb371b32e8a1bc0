"""Statistical tests of one column and comparison of two tables.

Numeric columns of both tables are reduced to counts per distinct value first
(partial aggregation absorbs hot values), then one bucketed running sum serves
Kolmogorov-Smirnov and Wasserstein at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profile import correlation_pairs, pearson, per_column, share
from plumbline.operators.ranks import bucket_count, numeric_bounds, running_totals
from plumbline.session import numeric_columns, quoted, wide_numeric_columns

# Significance level, correlation tolerance, smallest range, allowed relative gap of totals.
P_LEVEL = 0.05
CORRELATION_TOLERANCE = 0.1
SMALLEST_RANGE = 1e-10
TOTALS_GAP = 1.4901161193847656e-08


def normality_p(n: Column, skew: Column, kurtosis: Column) -> tuple[Column, Column]:
    """K-squared and its p-value (exact for 2 degrees of freedom) from population skewness and kurtosis."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (F.lit(6.0) * (n - 2)))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    b2 = F.lit(3.0) * (n * n + F.lit(27.0) * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(F.lit(2.0) * (b2 - 1)) - 1
    delta = F.lit(1.0) / F.sqrt(F.log(w2) * 0.5)
    alpha = F.sqrt(F.lit(2.0) / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt(F.pow(y / alpha, F.lit(2.0)) + 1))
    mean = F.lit(3.0) * (n - 1) / (n + 1)
    var = F.lit(24.0) * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis - mean) / F.sqrt(var)
    root_beta = F.lit(6.0) * (n * n - F.lit(5.0) * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        F.lit(6.0) * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = F.lit(6.0) + F.lit(8.0) / root_beta * (F.lit(2.0) / root_beta + F.sqrt(F.lit(1.0) + F.lit(4.0) / (root_beta * root_beta)))
    d = F.lit(1.0) + x * F.sqrt(F.lit(2.0) / (a - 4))
    cube = F.signum(d) * F.cbrt((F.lit(1.0) - F.lit(2.0) / a) / F.nullif(F.abs(d), F.lit(0.0)))
    z2 = (F.lit(1.0) - F.lit(2.0) / (F.lit(9.0) * a) - cube) / F.sqrt(F.lit(2.0) / (F.lit(9.0) * a))
    k2 = z1 * z1 + z2 * z2
    return k2, F.exp(k2 * -0.5)


def normality_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, statistic, p_value, valid) from one aggregate; null below 8 values or for a constant column."""
    columns = numeric_columns(df) if columns is None else columns
    moments = per_column(
        df,
        columns,
        n=F.count,
        skew=lambda c: F.nanvl(F.skewness(c.cast("double")), F.lit(None).cast("double")),
        kurt=lambda c: F.nanvl(F.kurtosis(c.cast("double")), F.lit(None).cast("double")),
    )
    enough = F.when(F.col("n") >= 8, F.col("n"))
    k2, p = normality_p(enough, F.col("skew"), F.col("kurt") + 3.0)
    tested = moments.select("column", "n", k2.alias("statistic"), p.alias("p_value"))
    return tested.withColumn("valid", F.coalesce(F.col("p_value") > P_LEVEL, F.lit(False)))


def kolmogorov_p(n: Column, d: Column) -> Column:
    """Asymptotic two-sided p-value; a 100-term alternating series, clamped to [0, 1]."""
    x = n.cast("double") * d * d
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(k.cast("double") * k.cast("double") * x * -2.0),
    )
    # for tiny x the truncated series has not settled; the distribution function is 0 there
    return F.when(x < 1e-3, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def _cells(df: DataFrame, columns: list[str], flags: dict[str, int]) -> DataFrame:
    """(column number, value) of every filled cell with constant counters."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("c"), F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")).alias("value")) for i, c in enumerate(columns)]
    )
    long = df.select(F.inline(cells)).where("value is not null")
    return long.select("c", (F.col("value") + 0.0).alias("value"), *[F.lit(v).cast("long").alias(k) for k, v in flags.items()])


def _name(columns: list[str]) -> Column:
    return F.get(F.lit(columns), F.col("c")).alias("column")


def uniformity_test(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against U(0, 1)."""
    rows = df.count() if rows is None else rows
    bounds = numeric_bounds(df, columns, bucket_count(rows), rows)
    counts = _cells(df, columns, {"n": 1}).groupBy("c", "value").agg(F.sum("n").alias("n"))
    ranked = running_totals(counts, "c", "value", ["n"], {i: bounds[c] for i, c in enumerate(columns)})
    cdf = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))
    above = F.col("upto_n") / F.col("all_n") - cdf
    below = cdf - (F.col("upto_n") - F.col("n")) / F.col("all_n")
    tested = ranked.groupBy("c").agg(F.max("all_n").alias("n"), F.max(F.greatest(above, below)).alias("statistic"))
    tested = tested.select(_name(columns), "n", "statistic", kolmogorov_p(F.col("n"), F.col("statistic")).alias("p_value"))
    return tested.withColumn("valid", F.col("p_value") > P_LEVEL)


def correlation_check(df: DataFrame, expected: dict[tuple[str, str], float]) -> DataFrame:
    """(column_a, column_b, expected, actual, valid) of the listed pairs whose columns exist."""
    present = {k: v for k, v in expected.items() if set(k) <= set(df.columns)}
    if not present:
        raise ValueError("no expected pair has both columns in the table")
    rows = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.lit(float(r)).alias("expected"),
            pearson(F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")).alias("actual"),
        )
        for (a, b), r in present.items()
    ]
    found = df.agg(F.array(*rows).alias("x")).select(F.inline("x"))
    # a correlation that cannot be computed is not out of tolerance
    return found.withColumn("valid", ~F.coalesce(F.abs(F.col("actual") - F.col("expected")) > CORRELATION_TOLERANCE, F.lit(False)))


def common_columns(synthetic: DataFrame, reference: DataFrame) -> list[str]:
    return [c for c in synthetic.columns if c in set(reference.columns)]


def comparable_numeric(synthetic: DataFrame, reference: DataFrame) -> list[str]:
    wide = set(wide_numeric_columns(reference))
    return [c for c in wide_numeric_columns(synthetic) if c in wide]


def ecdf_distances(synthetic: DataFrame, reference: DataFrame, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Per column: KS distance, Wasserstein distance, the reference range, both similarities and their mean."""
    columns = comparable_numeric(synthetic, reference) if columns is None else columns
    both = synthetic.select(*[quoted(c) for c in columns]).unionByName(reference.select(*[quoted(c) for c in columns]))
    rows = both.count() if rows is None else rows
    bounds = numeric_bounds(both, columns, bucket_count(rows), rows)
    cells = _cells(synthetic, columns, {"s": 1, "r": 0}).unionByName(_cells(reference, columns, {"s": 0, "r": 1}))
    counts = cells.groupBy("c", "value").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    cuts = {i: bounds[c] for i, c in enumerate(columns)}
    ranked = running_totals(counts, "c", "value", ["s", "r"], cuts).where("all_s > 0 and all_r > 0")
    gap = F.abs(F.col("upto_s") / F.col("all_s") - F.col("upto_r") / F.col("all_r"))
    in_reference = F.when(F.col("r") > 0, F.col("value"))
    tested = ranked.groupBy("c").agg(
        F.max(gap).alias("ks_distance"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("wasserstein_distance"),
        (F.max(in_reference) - F.min(in_reference)).alias("reference_range"),
    )
    scaled = F.col("wasserstein_distance") / F.greatest(F.col("reference_range"), F.lit(SMALLEST_RANGE))
    return tested.select(
        _name(columns),
        "ks_distance",
        "wasserstein_distance",
        "reference_range",
        (F.lit(1.0) - F.col("ks_distance")).alias("ks_similarity"),
        (F.lit(1.0) - F.least(scaled, F.lit(1.0))).alias("wasserstein_similarity"),
    ).withColumn("similarity", (F.col("ks_similarity") + F.col("wasserstein_similarity")) / 2.0)


def chi_square_similarity(synthetic: DataFrame, reference: DataFrame, columns: list[str] | None = None, rescale: bool = False) -> DataFrame:
    """Per column max(0, 1 - chi2 / k) over the aligned categories.

    Zero for fewer than two categories, a category missing from the reference, or
    unequal totals (with ``rescale`` the reference counts are scaled to the synthetic total instead).
    """
    if columns is None:
        numeric = set(comparable_numeric(synthetic, reference))
        columns = [c for c in common_columns(synthetic, reference) if c not in numeric]

    def cells(df: DataFrame, s: int, r: int) -> DataFrame:
        long = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
        return df.select(F.inline(long)).where("value is not null").select(
            "column", "value", F.lit(s).cast("long").alias("s"), F.lit(r).cast("long").alias("r")
        )

    counts = cells(synthetic, 1, 0).unionByName(cells(reference, 0, 1)).groupBy("column", "value").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    # chi2 for a common scale f of the reference counts: sum(s^2 / r) / f - 2 * sum(s) + f * sum(r), over categories with r > 0
    present = F.col("r") > 0
    tested = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(~present).alias("missing"),
        F.sum("s").cast("double").alias("total_s"),
        F.sum("r").cast("double").alias("total_r"),
        F.sum(F.when(present, F.pow(F.col("s") - F.col("r"), F.lit(2.0)) / F.col("r"))).alias("plain"),
        F.sum(F.when(present, F.col("s") * F.col("s") / F.col("r"))).alias("ratio"),
    ).where("total_s > 0 and total_r > 0")
    factor = F.col("total_s") / F.col("total_r")
    chi2 = F.col("ratio") / factor - F.col("total_s") if rescale else F.col("plain")
    unequal = F.abs(F.col("total_s") - F.col("total_r")) / F.least("total_s", "total_r") > TOTALS_GAP
    zero = (F.col("categories") < 2) | (F.col("missing") > 0)
    if not rescale:
        zero = zero | unequal
    return tested.select(
        "column",
        "categories",
        F.when(zero, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - chi2 / F.col("categories"))).alias("similarity"),
    )


def distribution_similarity(synthetic: DataFrame, reference: DataFrame, rows: int | None = None) -> DataFrame:
    """(column, similarity): distances for 64-bit numbers in both tables, chi-square for every other common column."""
    numeric = comparable_numeric(synthetic, reference)
    rest = [c for c in common_columns(synthetic, reference) if c not in numeric]
    parts = []
    if numeric:
        parts.append(ecdf_distances(synthetic, reference, numeric, rows).select("column", "similarity"))
    if rest:
        parts.append(chi_square_similarity(synthetic, reference, rest).select("column", "similarity"))
    out = parts[0] if parts else synthetic.sparkSession.range(0).select(F.lit("").alias("column"), F.lit(0.0).alias("similarity"))
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def correlation_preservation(synthetic: DataFrame, reference: DataFrame) -> DataFrame:
    """Pearson r between the two tables' pair correlations, floor 0.

    Fewer than two common numeric columns: 1.  One pair, or any undefined correlation: 0.
    """
    numbers = set(numeric_columns(reference))
    columns = [c for c in numeric_columns(synthetic) if c in numbers]
    if len(columns) < 2:
        return synthetic.sparkSession.range(1).select(F.lit(1.0).alias("correlation_preservation"))
    ours = correlation_pairs(synthetic, columns)
    theirs = correlation_pairs(reference, columns).withColumnRenamed("r", "r_reference")
    paired = ours.join(theirs, ["column_a", "column_b"])
    undefined = F.count_if(F.col("r").isNull() | F.col("r_reference").isNull()) > 0
    r = pearson(F.col("r"), F.col("r_reference"))
    return paired.agg(
        F.when(undefined | (F.count(F.lit(1)) < 2), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(r, F.lit(0.0)))).alias("correlation_preservation")
    )


def statistical_fidelity(synthetic: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean over columns of max(0, 1 - |difference of means| / |reference mean|); a zero reference mean is skipped."""
    columns = comparable_numeric(synthetic, reference)
    if not columns:
        return synthetic.sparkSession.range(1).select(F.lit(0.0).alias("statistical_fidelity"))
    ours = per_column(synthetic, columns, ours=lambda c: F.avg(c.cast("double")))
    theirs = per_column(reference, columns, theirs=lambda c: F.avg(c.cast("double")))
    gap = F.abs(F.col("ours") - F.col("theirs")) / F.nullif(F.abs("theirs"), F.lit(0.0))
    score = F.when(F.col("theirs") == 0, F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.lit(1.0) - gap, F.lit(0.0))))
    return ours.join(theirs, "column").agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("statistical_fidelity"))


# Weight of each score in the overall score.
OVERALL_WEIGHTS = {
    "completeness_score": 0.2,
    "consistency_score": 0.15,
    "uniqueness_score": 0.15,
    "validity_score": 0.15,
    "statistical_fidelity": 0.15,
    "ml_utility_score": 0.2,
}

# Score, threshold below which it is flagged, advice.
ADVICE = [
    ("completeness_score", 0.9, "Consider improving data completeness by reducing missing values"),
    ("consistency_score", 0.8, "Review data consistency and standardize data formats"),
    ("uniqueness_score", 0.7, "Address duplicate records and improve data uniqueness"),
    ("validity_score", 0.9, "Validate data formats and fix invalid entries"),
    ("statistical_fidelity", 0.8, "Improve statistical similarity to reference data"),
    ("ml_utility_score", 0.7, "Enhance machine learning utility through better feature representation"),
    ("overall_quality_score", 0.8, "Overall data quality needs improvement across multiple dimensions"),
]


def overall_score(metrics: DataFrame) -> DataFrame:
    """The metrics with ``overall_quality_score`` added."""
    total = F.lit(0.0)
    for name, weight in OVERALL_WEIGHTS.items():
        total = total + F.col(name) * F.lit(weight)
    return metrics.withColumn("overall_quality_score", total)


def recommendations(metrics: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per score below its threshold, in fixed order."""
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("score"), F.col(name).alias("value"), F.lit(limit).alias("threshold"), F.lit(text).alias("recommendation")
        )
        for i, (name, limit, text) in enumerate(ADVICE)
    ]
    return metrics.select(*(keep or []), F.inline(F.array(*rows))).where("value < threshold").drop("threshold")
