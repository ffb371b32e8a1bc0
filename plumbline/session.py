"""Session-level helpers: shared work folder, table loading, schema lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (local tests) a temporary folder is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext.getCheckpointDir()
    if not folder and not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    if folder and not known:
        spark.sparkContext.setCheckpointDir(folder)
    return folder or known


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, for tables that are costly and read several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# HotSpot leaves methods above this many bytes of bytecode uncompiled.
COMPILED_METHOD_BYTES = 8000
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def prefer_compiled_methods(spark: SparkSession) -> None:
    """Let stages whose fused method would be too large for the JIT run as split projections.

    Wide generated tables run several times faster that way.  A limit the user set is left alone.
    """
    if spark.conf.get(METHOD_LIMIT, None) in (None, "65535"):
        spark.conf.set(METHOD_LIMIT, str(COMPILED_METHOD_BYTES))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Compute once, keep as Parquet in the shared folder and go on from there: plans begin with a plain scan."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def wide_numeric_columns(df: DataFrame) -> list[str]:
    """Only 64-bit columns: the types the distribution and mean comparisons treat as numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_stats(df: DataFrame, stats: DataFrame, name: str = "_stats") -> DataFrame:
    """The rows with a one-row table beside them as a struct column: a scalar subquery, run once."""
    return df.withColumn(name, stats.select(F.struct(*[F.col(quoted(c)) for c in stats.columns])).scalar())
