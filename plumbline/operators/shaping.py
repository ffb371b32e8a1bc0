"""Row-wise shaping of tables: casts, filters, imputation, encoding, paging, sampling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.draws import Draws
from plumbline.operators.ranks import dense_ranks, smallest_k_cutoffs
from plumbline.session import numeric_columns, quoted, written, string_columns, with_stats

# Fixed value: share of distinct values below which a text column is a category.
CATEGORY_SHARE = 0.5
# Text that reads as a number; tested by pattern because a failing cast to double is slow.
WHOLE = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, list and map cells as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, nested) else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def inferred_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, inferred): number when all texts cast to number, else timestamp, else category or text."""
    columns = string_columns(df) if columns is None else columns

    def kind(name: str) -> Column:
        c = F.col(quoted(name))
        filled = F.count(c)
        return (
            F.when(F.count(F.when(c.rlike(WHOLE), c.try_cast("bigint"))) == filled, F.lit("bigint"))
            .when(F.count_if(c.rlike(DECIMAL)) == filled, F.lit("double"))
            .when(F.count(c.try_cast("timestamp_ntz")) == filled, F.lit("timestamp_ntz"))
            .when(F.count_distinct(c) / F.count(F.lit(1)) < CATEGORY_SHARE, F.lit("category"))
            .otherwise(F.lit("string"))
        )

    rows = [F.struct(F.lit(c).alias("column"), kind(c).alias("inferred")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def infer_types(df: DataFrame) -> DataFrame:
    """The table with every text column cast to its inferred type; one row per column reaches the driver."""
    found = {r["column"]: r["inferred"] for r in inferred_types(df).collect()} if string_columns(df) else {}
    casts = {c: k for c, k in found.items() if k not in ("category", "string")}
    return df.select(
        *[F.col(quoted(c)).try_cast(casts[c]).alias(c) if c in casts else F.col(quoted(c)) for c in df.columns]
    )


def downcast_plan(df: DataFrame) -> DataFrame:
    """(column, target): the smallest whole-number type for the range; float only if every value survives it."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType))]

    def target(f: T.StructField) -> Column:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.DoubleType):
            lossless = F.coalesce(F.bool_and(F.isnan(c) | (c.cast("float").cast("double") == c)), F.lit(True))
            return F.when(lossless, F.lit("float")).otherwise(F.lit("double"))
        low, high = F.min(c), F.max(c)
        return (
            F.when((low >= -128) & (high <= 127), F.lit("tinyint"))
            .when((low >= -32768) & (high <= 32767), F.lit("smallint"))
            .when((low >= -2147483648) & (high <= 2147483647), F.lit("int"))
            .otherwise(F.lit("bigint"))
        )

    rows = [F.struct(F.lit(f.name).alias("column"), target(f).alias("target")) for f in fields]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def downcast_types(df: DataFrame) -> DataFrame:
    targets = {r["column"]: r["target"] for r in downcast_plan(df).collect()}
    return df.select(*[F.col(quoted(c)).cast(targets[c]).alias(c) if c in targets else F.col(quoted(c)) for c in df.columns])


def filter_where(df: DataFrame, condition: str | None) -> DataFrame:
    return df.filter(condition) if condition else df


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the column mean."""
    columns = numeric_columns(df) if columns is None else columns
    number = lambda c: F.col(quoted(c)).cast("double")
    means = df.agg(*[F.avg(number(c)).alias(c) for c in columns])
    filled = {c: F.coalesce(number(c), F.col(f"_stats.{quoted(c)}")).alias(c) for c in columns}
    return with_stats(df, means).select(*[filled.get(c, F.col(quoted(c))) for c in df.columns])


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column is divided by one."""
    columns = numeric_columns(df) if columns is None else columns
    number = lambda c: F.col(quoted(c)).cast("double")
    moments = df.agg(*[F.struct(F.avg(number(c)).alias("m"), F.stddev_pop(number(c)).alias("s")).alias(c) for c in columns])
    scaled = {}
    for c in columns:
        stats = F.col(f"_stats.{quoted(c)}")
        std = F.when(stats["s"] == 0, F.lit(1.0)).otherwise(stats["s"])
        scaled[c] = ((number(c) - stats["m"]) / std).alias(c)
    return with_stats(df, moments).select(*[scaled.get(c, F.col(quoted(c))) for c in df.columns])


def label_encode(df: DataFrame, column: str, output: str, rows: int | None = None) -> DataFrame:
    """Sorted distinct texts to 0..k-1; a missing cell is the text ``nan``."""
    text = F.coalesce(F.col(quoted(column)).cast("string"), F.lit("nan"))
    keyed = df.withColumn("_label", text)
    # Written, so that the join has plain exchanges on both sides and a popular text can be split over tasks.
    ranks = written(dense_ranks(keyed, "_label", rows).select(F.col("value").alias("_label"), F.col("rank").alias(output)), "label-ranks")
    return keyed.join(ranks, "_label", "left").drop("_label")


def preview_rows(df: DataFrame, order: list[str], rows: int = 5, width: int = 50) -> DataFrame:
    """First rows by key, every cell as text cut at ``width`` characters plus dots."""

    def cell(c: str) -> Column:
        text = F.col(quoted(c)).cast("string")
        cut = F.concat(F.substring(text, 1, width), F.lit("..."))
        return F.when(F.length(text) > width, cut).otherwise(text).alias(c)

    first = df.orderBy(*[F.col(quoted(c)) for c in order]).limit(rows)
    return first.select(*[cell(c) for c in df.columns])


def page_rows(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*[F.col(quoted(c)) for c in order]).offset(offset).limit(limit)


def mask_middle(value: Column) -> Column:
    """Up to 8 characters: all stars; else the first and last four stay."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4)))
    )


def sample_rows(df: DataFrame, row_id: str, size: int, seed: int = 42, rows: int | None = None) -> DataFrame:
    """Exactly ``size`` rows without replacement (all when fewer): those of smallest draw, by cutoff, without a sort."""
    rows = df.count() if rows is None else rows
    if rows <= size:
        return df
    if size <= 0:
        return df.limit(0)
    draw = Draws(seed, "sample", F.col(quoted(row_id))).bits("pick")
    cutoff = smallest_k_cutoffs(df.select(quoted(row_id)), {"pick": draw}, size, rows)["pick"]
    return df.where(draw <= F.lit(cutoff).cast("long"))
