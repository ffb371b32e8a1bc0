"""Shared pieces of the registered queries: loading, rounding, derived inputs and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import table

load = table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r6(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def text_time(c: Column) -> Column:
    """A local timestamp as text with six decimals, whatever the session's zone."""
    s = c.cast("string")
    return F.concat(F.substring(s, 1, 19), F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0"))


def gappy_events(spark, d) -> DataFrame:
    """events with missing cells: no value on errors, no props on signups, a text column with odd characters."""
    e = load(spark, d, "events")
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("props"),
        F.when(F.col("event_type") == "view", F.concat(F.col("event_type"), F.lit("\t"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.col("event_type"), F.lit("\n")))
        .otherwise(F.col("event_type"))
        .alias("note"),
        F.lit(None).cast("double").alias("nothing"),
    )


GAPPY_EVENTS = """g AS (SELECT event_id, user_id, event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'signup' THEN props END AS props,
  CASE WHEN event_type = 'view' THEN event_type || chr(9) || CAST(user_id AS VARCHAR)
       WHEN event_type = 'click' THEN event_type || chr(10) ELSE event_type END AS note,
  CAST(NULL AS DOUBLE) AS nothing FROM events)"""
GAPPY_COLUMNS = ["event_id", "user_id", "event_type", "value", "props", "note", "nothing"]

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
