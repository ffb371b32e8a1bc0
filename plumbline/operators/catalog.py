"""Datasets as catalog tables: append, query, statistics, generation into a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import quoted


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)


def align_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """The target's columns and types: missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(quoted(f.name)) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def append_rows(df: DataFrame, table: str, path: str | None = None) -> str:
    """Create the table with the first rows, append after; returns the sanitised name."""
    spark = df.sparkSession
    name = ".".join(safe_name(p) for p in table.split("."))
    options = {"path": path} if path else {}
    if spark.catalog.tableExists(name):
        align_to(df, spark.table(name)).write.mode("append").format("parquet").saveAsTable(name)
    else:
        df.write.format("parquet").options(**options).saveAsTable(name)
    return name


def sql_query(spark: SparkSession, text: str, args: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """Any SELECT with ``?`` or ``:name`` parameters; keyword tables can be named in braces."""
    return spark.sql(text, args=args, **tables) if args is not None else spark.sql(text, **tables)


def table_stats(tables: dict[str, DataFrame], columns: int = 5) -> DataFrame:
    """(table, rows, first columns) of each table."""
    parts = [
        df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(", ".join(df.columns[:columns])).alias("columns"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_stats(spark: SparkSession, database: str | None = None) -> DataFrame:
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return table_stats({n: spark.table(f"{database}.{n}" if database else n) for n in names})


Generator = Callable[[SparkSession, dict], DataFrame]


class GeneratorRegistry:
    """User-defined generators by name: ``fn(spark, parameters) -> DataFrame`` with declared parameters."""

    def __init__(self):
        self._entries: dict[str, tuple[Generator, dict]] = {}

    def register(self, name: str, fn: Generator, parameters: dict | None = None) -> None:
        """``parameters`` is the JSON schema of the accepted parameters."""
        self._entries[name] = (fn, parameters or {"type": "object"})

    def load_entry_points(self, group: str) -> None:
        """Generators that installed packages advertise under ``group``."""
        from importlib.metadata import entry_points

        for point in entry_points(group=group):
            self.register(point.name, point.load())

    def names(self) -> list[str]:
        return sorted(self._entries)

    def schema(self, name: str) -> dict:
        return self._entry(name)[1]

    def _entry(self, name: str):
        if name not in self._entries:
            raise ValueError(f"unknown strategy: {name}; known: {', '.join(self.names())}")
        return self._entries[name]

    def run(self, spark: SparkSession, name: str, parameters: dict) -> DataFrame:
        fn, schema = self._entry(name)
        missing = [p for p in schema.get("required", []) if p not in parameters]
        if missing:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        return fn(spark, parameters)


def generate_to_table(
    spark: SparkSession, registry: GeneratorRegistry, strategy: str, parameters: dict, table: str, order: list[str], path: str | None = None, sample: int = 3
) -> tuple[str, int, DataFrame]:
    """Run a strategy, append to its table (tagged with the strategy on creation); name, rows added, first rows."""
    made = registry.run(spark, strategy, parameters)
    existed = spark.catalog.tableExists(".".join(safe_name(p) for p in table.split(".")))
    added = Observation()  # counts what this call writes, whatever others append meanwhile
    name = append_rows(made.observe(added, F.count(F.lit(1)).alias("n")), table, path)
    if not existed:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('strategy' = '{safe_name(strategy)}')")
    return name, added.get["n"], made.orderBy(*[F.col(quoted(c)) for c in order]).limit(sample)


def map_with_model(df: DataFrame, fn: Callable[[list], list], column: str, output: str = "reply", retries: int = 2) -> DataFrame:
    """Call ``fn`` (a batch of inputs to a batch of texts) on each Arrow batch; a failure becomes text, not an exception.

    A failing batch is retried whole, then row by row, so one bad input costs only itself.
    """
    import pandas as pd

    def attempt(values: list) -> list:
        problem = None
        for _ in range(retries + 1):
            try:
                return list(fn(values))
            except Exception as e:  # noqa: BLE001 - reported as text
                problem = e
        if len(values) == 1:
            return [f"Error generating content: {problem}"]
        return [attempt([v])[0] for v in values]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{output: attempt(pdf[column].tolist()) if len(pdf) else pd.Series([], dtype=object)})

    kept = [f for f in df.schema.fields if f.name != output]
    return df.select(*[F.col(quoted(f.name)) for f in kept]).mapInPandas(run, T.StructType([*kept, T.StructField(output, T.StringType())]))
