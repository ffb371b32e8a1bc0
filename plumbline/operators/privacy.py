"""Disclosure risk and anonymity measures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.compare import common_columns
from plumbline.operators.profile import share
from plumbline.session import quoted


def _keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with NaN read as missing: a missing cell never matches."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.nanvl(F.col(quoted(c)), F.lit(None).cast(kinds[c])).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(quoted(c))
            for c in columns
        ]
    )


def disclosure_risk(synthetic: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of synthetic rows that occur in the reference on all common columns, over all rows.

    A semi join by grouping: both tables are counted per distinct row in one
    shuffle, partial counts first, so a row repeated millions of times is one
    entry per task.  A row with a missing cell matches nothing.
    """
    columns = common_columns(synthetic, reference)
    kinds = [dict(df.dtypes) for df in (synthetic, reference)]
    comparable = all((kinds[0][c] == "string") == (kinds[1][c] == "string") for c in columns)
    if not columns or not comparable:
        one = synthetic.sparkSession.range(1)
        return one.select(F.lit(0).cast("long").alias("matches"), F.lit(0.0).alias("disclosure_risk"), F.lit(1.0).alias("privacy_score"))
    names = [F.col(quoted(c)) for c in columns]
    ours = _keys(synthetic, columns).select(*names, F.lit(1).cast("long").alias("_s"), F.lit(False).alias("_r"))
    known = _keys(reference, columns).dropna().select(*names, F.lit(0).cast("long").alias("_s"), F.lit(True).alias("_r"))
    rows = ours.unionByName(known).groupBy(*names).agg(F.sum("_s").alias("_s"), F.bool_or("_r").alias("_r"))
    risk = rows.agg(F.coalesce(F.sum(F.when(F.col("_r"), F.col("_s"))), F.lit(0)).alias("matches"), F.sum("_s").alias("_n"))
    share_matched = F.coalesce(share(F.col("matches"), F.col("_n")), F.lit(0.0))
    return risk.select("matches", share_matched.alias("disclosure_risk"), (F.lit(1.0) - share_matched).alias("privacy_score"))


def k_anonymity(df: DataFrame, quasi_identifiers: list[str], k: int) -> DataFrame:
    """Smallest group over the quasi-identifiers, number of groups below k and of rows in them."""
    groups = df.groupBy(*[F.col(quoted(c)) for c in quasi_identifiers]).agg(F.count(F.lit(1)).alias("n"))
    below = F.col("n") < k
    return groups.agg(
        F.min("n").alias("smallest_group"),
        F.count_if(below).alias("groups_below_k"),
        F.coalesce(F.sum(F.when(below, F.col("n"))), F.lit(0)).alias("rows_below_k"),
    ).withColumn("k_anonymous", F.col("smallest_group") >= k)


def l_diversity(df: DataFrame, quasi_identifiers: list[str], sensitive: str, l: int) -> DataFrame:
    """Fewest distinct sensitive values in any group, and the number of groups below l."""
    groups = df.groupBy(*[F.col(quoted(c)) for c in quasi_identifiers]).agg(F.count_distinct(F.col(quoted(sensitive))).alias("n"))
    return groups.agg(F.min("n").alias("fewest_values"), F.count_if(F.col("n") < l).alias("groups_below_l")).withColumn(
        "l_diverse", F.col("fewest_values") >= l
    )
