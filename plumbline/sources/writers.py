"""Exports: JSON lines, CSV, Parquet, split files, checksums, manifests, batches."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.draws import Draws
from plumbline.operators.profile import quality_report, schema_profile, share
from plumbline.session import numeric_columns, quoted, string_columns

# Accepted settings and the cell size that draws a warning.
FORMATS = ("json", "jsonl", "csv", "parquet")
QUOTING = ("minimal", "all", "nonnumeric", "none")
PARQUET_CODECS = ("snappy", "gzip", "brotli", "lz4", "zstd", None)
LARGE_CELL = 1_000_000

CELL_BYTES = 64 << 20  # longer files are hashed in parts of HASHED_BYTES
HASHED_BYTES = 4 << 20


class ExportError(ValueError):
    """A table or setting that cannot be exported."""


@dataclass
class ExportConfig:
    format: str = "json"
    compression: str | None = None
    chunk_size: int = 10_000
    include_profile: bool = True
    nested_json_as_string: bool = False
    decimal_precision: int = 6
    parquet_compression: str | None = "snappy"
    row_group_bytes: int = 128 * 1024 * 1024
    csv_separator: str = ","
    csv_quoting: str = "minimal"
    csv_encoding: str = "UTF-8"
    validate_schema: bool = True
    create_checksums: bool = True
    split_large_files: bool = False
    max_records_per_file: int = 0  # 0: one file per task, however large

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ExportError(f"unsupported format: {self.format}")
        if self.csv_quoting not in QUOTING:
            raise ExportError(f"unsupported quoting: {self.csv_quoting}")
        if self.csv_encoding.upper() not in _LINE_ENDS:
            raise ExportError(f"unsupported encoding: {self.csv_encoding}")
        if self.parquet_compression not in PARQUET_CODECS:
            raise ExportError(f"unsupported codec: {self.parquet_compression}")
        if not 0 <= self.decimal_precision <= 15:
            raise ExportError("decimal_precision must lie in 0..15")


def json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON object, missing cells written as null."""
    return df.select(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))


def _csv_cells(df: DataFrame, config: ExportConfig) -> list[Column]:
    """Text of every cell under the quoting rule; numbers get a fixed number of decimals."""
    sep = config.csv_separator
    cells = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text, number = F.format_string(f"%.{config.decimal_precision}f", c.cast("double")), True
        else:
            if isinstance(f.dataType, T.BooleanType):
                text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
            else:
                text = c.cast("string")
            number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        text = F.coalesce(F.when(c.isNotNull(), text), F.lit(""))
        inner = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        if config.csv_quoting == "all":
            text = inner
        elif config.csv_quoting == "nonnumeric" and not number:
            text = inner
        elif config.csv_quoting == "minimal":
            special = text.contains(sep) | text.contains('"') | text.contains("\n") | text.contains("\r")
            text = F.when(special, inner).otherwise(text)
        cells.append(text)
    return cells


def csv_lines(df: DataFrame, config: ExportConfig | None = None) -> DataFrame:
    config = config or ExportConfig(format="csv")
    return df.select(F.concat_ws(config.csv_separator, *_csv_cells(df, config)).alias("line"))


def csv_header(df: DataFrame, config: ExportConfig) -> str:
    """The first line of every file, quoted by the rule that text cells follow."""
    names = []
    for c in df.columns:
        special = any(x in c for x in (config.csv_separator, '"', "\n", "\r"))
        quote = config.csv_quoting in ("all", "nonnumeric") or (config.csv_quoting == "minimal" and special)
        names.append('"' + c.replace('"', '""') + '"' if quote else c)
    return config.csv_separator.join(names)


# The line end of an encoding, without its last byte (which the text writer adds) and the mark that begins a file.
_LINE_ENDS = {"UTF-8": (b"", b""), "US-ASCII": (b"", b""), "ISO-8859-1": (b"", b""), "UTF-16BE": (b"\x00", b""), "UTF-16LE": (b"\n", b""), "UTF-16": (b"\x00", b"\xfe\xff")}


def _write_csv(df: DataFrame, path: str, config: ExportConfig, packed: dict) -> None:
    """The lines of csv_lines() in files that each begin with the header.

    A task's rows are numbered from 0, and the writer begins a new file after every max_records_per_file of them, so the
    header goes in front of the rows that begin one.
    """
    inner, mark = _LINE_ENDS[config.csv_encoding.upper()]
    charset = "UTF-16BE" if config.csv_encoding.upper() == "UTF-16" else config.csv_encoding.upper()
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    most = config.max_records_per_file
    begins = number % most == 0 if most else number == 0
    raw = lambda c: F.concat(F.encode(c, charset), F.lit(inner))
    end = F.lit(b"\x00" if charset == "UTF-16LE" else b"\n")
    head = F.concat(F.lit(mark), raw(F.lit(csv_header(df, config))), end)
    lines = csv_lines(df, config).select(F.when(begins, F.concat(head, raw(F.col("line")))).otherwise(raw(F.col("line"))).cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", most).text(path, lineSep="\x00" if charset == "UTF-16LE" else "\n", **packed)


def file_count(rows: int, chunk_size: int) -> int:
    return rows // chunk_size + 1 if rows > chunk_size else 1


def split_evenly(df: DataFrame, rows: int, chunk_size: int, row_id: str | None = None) -> DataFrame:
    """``rows // chunk + 1`` near-equal parts: hashed on the row id, or round robin without one."""
    parts = file_count(rows, chunk_size)
    if row_id is None:
        return df.repartition(parts)
    return df.repartition(parts, Draws(0, "part", F.col(quoted(row_id))).bits("x"))


def preflight(df: DataFrame) -> DataFrame:
    """(column, longest_cell, oversized) of the text columns; empty tables and repeated names are errors."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) != len(lowered):
        raise ExportError("the table has duplicate column names")
    if df.isEmpty():
        raise ExportError("cannot export an empty table")
    rows = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.max(F.length(F.col(quoted(c)))), F.lit(0)).cast("long").alias("longest_cell"))
        for c in string_columns(df)
    ]
    if not rows:
        return df.sparkSession.range(0).select(F.lit("").alias("column"), F.lit(0).cast("long").alias("longest_cell"), F.lit(False).alias("oversized"))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("oversized", F.col("longest_cell") > LARGE_CELL)


def write_table(df: DataFrame, path: str, config: ExportConfig | None = None) -> None:
    """Write in the configured format; every task writes its own file."""
    config = config or ExportConfig()
    out = df
    limited = lambda frame: frame.write.option("maxRecordsPerFile", config.max_records_per_file)
    if config.nested_json_as_string:
        from plumbline.operators.shaping import nested_to_json

        out = nested_to_json(out)
    packed = {"compression": config.compression} if config.compression else {}
    if config.format in ("json", "jsonl"):
        limited(out).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path, ignoreNullFields=False, **packed)
    elif config.format == "csv":
        _write_csv(out, path, config, packed)
    else:
        writer = limited(out).option("parquet.block.size", str(config.row_group_bytes))
        writer.parquet(path, compression=config.parquet_compression or "none")


def _hashed_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as fs

    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            local = path.startswith(("file:", "/"))  # Spark tells paths without escapes
            system, place = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
            md5, sha256 = hashlib.md5(), hashlib.sha256()
            with system.open_input_stream(place, compression=None) as stream:
                while part := stream.read(HASHED_BYTES):
                    md5.update(part), sha256.update(part)
            sums.append((md5.hexdigest(), sha256.hexdigest()))
        columns = [pa.array([s[i] for s in sums], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), *columns], ["path", "bytes", "md5", "sha256"])


def file_checksums(spark: SparkSession, folder: str, pattern: str = "part-*", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(file, bytes, md5, sha256) of every output file, hashed where the file is read.

    Files of up to ``cell_bytes`` are read as one cell each, longer ones part by part in constant memory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    size = F.col("length").alias("bytes")
    cells = files.filter(F.col("length") <= cell_bytes).select("path", size, F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    long = files.filter(F.col("length") > cell_bytes).select("path", size).mapInArrow(_hashed_in_parts, "path string, bytes long, md5 string, sha256 string")
    return cells.unionByName(long).select(F.element_at(F.split("path", "/"), F.lit(-1)).alias("file"), "bytes", "md5", "sha256")


def memory_bytes(df: DataFrame) -> Column:
    """Aggregate: bytes of the decoded cells (text length plus a pointer, fixed width otherwise)."""
    width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    parts = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            parts.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) + F.count(F.lit(1)) * 8)
        else:
            parts.append(F.count(F.lit(1)) * width.get(type(f.dataType), 8))
    return functools.reduce(lambda a, b: a + b, parts)


def export_dataset(df: DataFrame, path: str, config: ExportConfig | None = None, name: str = "dataset") -> DataFrame:
    """Write and return one manifest row: records, files, bytes, ratio, schema, settings, checksums, profile."""
    config = config or ExportConfig()
    spark = df.sparkSession
    oversized = F.lit(None).cast("string")
    if config.validate_schema:
        long_cells = preflight(df).filter("oversized")
        oversized = long_cells.agg(F.to_json(F.collect_list(F.struct("column", "longest_cell")))).scalar()
    if config.split_large_files:
        df = split_evenly(df, df.count(), config.chunk_size)
    write_table(df, path, config)
    files = file_checksums(spark, path)
    # one row per written file; bounded by the number of write tasks
    sums = F.to_json(F.collect_list(F.struct("file", "md5", "sha256"))) if config.create_checksums else F.lit(None).cast("string")
    written = files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"), sums.alias("checksums"))
    if config.format == "parquet" and not config.nested_json_as_string:
        df = spark.read.schema(df.schema).parquet(path)  # what was written is cheaper to read than to make again
    stored = _stored_records(spark, df, path, config, written)
    counted = df.agg(F.count(F.lit(1)).alias("source_records"), memory_bytes(df).alias("memory_bytes"))
    schema = F.lit(df.schema.simpleString())
    profile = F.lit(None).cast("string")
    if config.include_profile:
        rows = quality_report(df).agg(F.to_json(F.collect_list(F.struct("metric", "column", "value"))).alias("p"))
        profile = rows.scalar()
    return written.select(
        F.lit(name).alias("dataset"),
        stored.alias("total_records"),
        "file_count",
        "total_size_bytes",
        share(counted.select("memory_bytes").scalar(), F.col("total_size_bytes")).alias("compression_ratio"),
        schema.alias("schema"),
        F.lit(str(asdict(config))).alias("settings"),
        "checksums",
        profile.alias("profile"),
        oversized.alias("oversized_cells"),
    )


def _stored_records(spark: SparkSession, df: DataFrame, path: str, config: ExportConfig, written: DataFrame) -> Column:
    """The records that the written files hold, counted there."""
    count = F.count(F.lit(1)).alias("n")
    if config.format == "parquet":
        return spark.read.parquet(path).agg(count).scalar()
    if config.format in ("json", "jsonl"):
        return spark.read.text(path).agg(count).scalar()
    cells = spark.read.csv(path, header=True, sep=config.csv_separator, encoding=config.csv_encoding, escape='"', multiLine=config.csv_quoting != "none", quote="" if config.csv_quoting == "none" else '"')
    if config.csv_quoting != "none":
        return cells.agg(count).scalar()
    # Without quotes a cell may hold line feeds: lines are counted, less those inside cells and the headers.
    inside = F.sum(sum((F.coalesce(F.length(F.col(quoted(c))) - F.length(F.replace(F.col(quoted(c)), F.lit("\n"))), F.lit(0)) for c in string_columns(df)), F.lit(0)))
    lines = spark.read.text(path, lineSep="\n").agg(count).scalar()
    return lines - df.agg(F.coalesce(inside, F.lit(0)).alias("n")).scalar() - written.select("file_count").scalar()


def export_many(
    tables: dict[str, DataFrame], folder: str, configs: dict[str, ExportConfig] | None = None, default: ExportConfig | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """Export every table; (manifests of the successful ones, one summary row)."""
    configs, manifests, errors = configs or {}, [], {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        config = configs.get(name) or default or ExportConfig()
        try:
            manifests.append(export_dataset(df, f"{folder.rstrip('/')}/{name}", config, name))
        except Exception as problem:  # noqa: BLE001 - reported in the summary
            errors[name] = str(problem).splitlines()[0]
    failed = F.lit("; ".join(f"{k}: {v}" for k, v in sorted(errors.items())))
    head = [F.lit(len(tables)).cast("long").alias("datasets"), F.lit(len(manifests)).cast("long").alias("succeeded"), F.lit(len(errors)).cast("long").alias("failed")]
    if not manifests:
        zero = F.lit(0).cast("long")
        return None, spark.range(1).select(*head, zero.alias("total_records"), zero.alias("total_files"), zero.alias("total_size_bytes"), failed.alias("errors"))
    every = functools.reduce(DataFrame.unionByName, manifests)
    summary = every.agg(
        F.sum("total_records").alias("total_records"), F.sum("file_count").alias("total_files"), F.sum("total_size_bytes").alias("total_size_bytes")
    )
    return every, summary.select(*head, "total_records", "total_files", "total_size_bytes", failed.alias("errors"))


def write_lines(df: DataFrame, path: str, column: str = "line", compression: str | None = None) -> None:
    df.select(F.col(quoted(column)).alias("value")).write.text(path, **({"compression": compression} if compression else {}))
