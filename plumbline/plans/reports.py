"""Reports composed of the single measures: benchmark, suite, comparison, validation, dataset creation."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import compare as C
from plumbline.operators import profile as P
from plumbline.operators.learn import default_target, detect_anomalies, ml_utility
from plumbline.operators.privacy import disclosure_risk
from plumbline.operators.records import validate_table, validation_score
from plumbline.plans.generate import generate
from plumbline.plans.spec import DatasetSpec
from plumbline.plans.templates import template
from plumbline.session import numeric_columns, quoted
from plumbline.sources.readers import nan_to_null
from plumbline.sources.writers import ExportConfig, export_dataset


@dataclass
class BenchmarkConfig:
    sample_size: int | None = None
    ml_evaluation: bool = True
    trees: int = 50
    depth: int = 30


def _sampled(df: DataFrame, size: int | None) -> DataFrame:
    """About ``size`` rows without replacement when there are more."""
    rows = df.count() if size else 0
    return df.sample(size / rows, seed=42) if size and rows > size else df


def benchmark_dataset(
    synthetic: DataFrame, reference: DataFrame | None = None, target: str | None = None, config: BenchmarkConfig | None = None
) -> DataFrame:
    """One row with every score of a synthetic table, against a reference where one is given.

    Each score is a one-row aggregate; they enter the row as scalar subqueries.
    """
    config = config or BenchmarkConfig()
    synthetic = _sampled(nan_to_null(synthetic), config.sample_size)
    reference = _sampled(nan_to_null(reference), config.sample_size) if reference is not None else None
    spark = synthetic.sparkSession
    zero = F.lit(0.0)
    scores: dict[str, Column] = {
        "completeness_score": P.completeness(synthetic).where("column = '*'").select("completeness").scalar(),
        "consistency_score": P.consistency_score(synthetic).scalar(),
        "uniqueness_score": P.uniqueness_score(synthetic).select("uniqueness_score").scalar(),
        "validity_score": P.validity_score(synthetic).scalar(),
        "correlation_preservation": zero,
        "statistical_fidelity": zero,
        "ml_utility_score": zero,
        "privacy_score": F.lit(1.0),
        "disclosure_risk": zero,
    }
    similar = F.lit(None).cast("string")
    if reference is not None:
        by_column = C.distribution_similarity(synthetic, reference)
        # one entry per common column
        listed = by_column.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "similarity"))))).alias("m"))
        similar = listed.scalar()
        scores["correlation_preservation"] = C.correlation_preservation(synthetic, reference).scalar()
        scores["statistical_fidelity"] = C.statistical_fidelity(synthetic, reference).scalar()
        risk = disclosure_risk(synthetic, reference)
        scores["privacy_score"] = risk.select("privacy_score").scalar()
        scores["disclosure_risk"] = risk.select("disclosure_risk").scalar()
    if config.ml_evaluation and target and target in synthetic.columns:
        utility = ml_utility(synthetic, target, trees=config.trees, depth=config.depth)
        scores["ml_utility_score"] = utility.select("utility_score").scalar()
    one = spark.range(1).select(*[c.alias(n) for n, c in scores.items()], similar.alias("distribution_similarity"))
    return C.overall_score(one)


def benchmark_suite(
    datasets: dict[str, DataFrame], reference: DataFrame | None = None, targets: dict[str, str] | None = None, config: BenchmarkConfig | None = None,
    benchmarks: dict[str, BenchmarkConfig] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every dataset under every benchmark: (comparison rows, summary statistics of the scores)."""
    benchmarks = benchmarks or {"comprehensive": config or BenchmarkConfig()}
    rows = []
    for name, df in datasets.items():
        for label, settings in benchmarks.items():
            scored = benchmark_dataset(df, reference, (targets or {}).get(name), settings)
            rows.append(scored.select(F.lit(f"{name}_{label}").alias("dataset_benchmark"), "*"))
    every = functools.reduce(DataFrame.unionByName, rows)
    return every, P.describe_numeric(every, [c for c in numeric_columns(every)])


def comparison_summary(scored: DataFrame, name: str = "dataset_name", score: str = "overall_quality", rows: str = "num_rows", position: str = "position") -> DataFrame:
    """Datasets, average score, best dataset (the first of equal ones by ``position``), total rows."""
    s, p = F.col(quoted(score)), F.col(quoted(position))
    return scored.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.avg(s).alias("avg_quality_score"),
        F.max_by(F.col(quoted(name)), F.struct(s, -p)).alias("best_dataset"),
        F.sum(F.col(quoted(rows))).alias("total_rows"),
    )


def validation_report(
    df: DataFrame, row_id: str, schema: dict | None = None, quality: bool = True, statistics: bool = True, anomalies: bool = True
) -> DataFrame:
    """(section, column, metric, value): schema validity, quality, normality, anomalies and the overall score.

    The overall score is the mean of schema score, completeness and 1 - anomaly share, over those asked for.
    """
    parts, scores = [], []

    def long(section: str, part: DataFrame, column: Column, *metrics: str) -> DataFrame:
        cells = [F.struct(F.lit(section).alias("section"), column.alias("column"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return part.select(F.inline(F.array(*cells)))

    name, overall = F.col("column"), F.lit("*")
    body = df.drop(row_id)
    if schema is not None:
        scored = validation_score(validate_table(df, schema))
        parts.append(long("schema", scored, overall, "valid_records", "total_records", "validation_score"))
        scores.append(scored.select("validation_score").scalar())
    if quality:
        filled = P.completeness(body)
        parts.append(long("quality", filled, name, "completeness"))
        parts.append(long("quality", P.uniqueness_by_column(body), name, "uniqueness"))
        parts.append(long("quality", P.string_consistency(body), name, "avg_length", "length_std", "format_consistency"))
        parts.append(long("quality", P.numeric_consistency(body), name, "mean", "std", "coefficient_of_variation"))
        outside = P.outliers_iqr(df, [row_id], numeric_columns(body)).groupBy("column").agg(F.count(F.lit(1)).alias("outliers"))
        parts.append(long("quality", outside, name, "outliers"))
        scores.append(filled.where("column = '*'").select("completeness").scalar())
    if statistics:
        parts.append(long("statistics", C.normality_test(body), name, "statistic", "p_value", "valid"))
    if anomalies and numeric_columns(body):
        found = detect_anomalies(df, row_id, numeric_columns(body))
        counted = found.agg(F.count_if("is_anomaly").alias("anomalies"), P.share(F.count_if("is_anomaly"), F.count(F.lit(1))).alias("share"))
        counted = counted.withColumn("score", F.lit(1.0) - F.col("share"))
        parts.append(long("anomalies", counted, overall, "anomalies", "share", "score"))
        scores.append(counted.select("score").scalar())
    if scores:
        total = functools.reduce(lambda a, b: a + b, scores) / float(len(scores))
        one = df.sparkSession.range(1).select(total.alias("overall_score"))
        parts.append(long("overall", one, overall, "overall_score"))
    return functools.reduce(DataFrame.unionByName, parts)


def benchmark_report(metrics: DataFrame, synthetic: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One JSON document: sizes of both tables, the metrics and the recommendations in order."""
    advice = C.recommendations(metrics).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "recommendation"))), lambda r: r["recommendation"]).alias("r")
    )
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    none = F.lit(None).cast("long")
    info = F.struct(
        rows(synthetic).alias("synthetic_records"),
        F.lit(len(synthetic.columns)).alias("synthetic_features"),
        (rows(reference) if reference is not None else none).alias("reference_records"),
        (F.lit(len(reference.columns)) if reference is not None else F.lit(None).cast("int")).alias("reference_features"),
    )
    scores = F.struct(*[F.col(quoted(c)) for c in metrics.columns])
    built = metrics.select(info.alias("dataset_info"), scores.alias("quality_metrics"), advice.scalar().alias("recommendations"))
    return built.select(F.to_json(F.struct(*built.columns), {"ignoreNullFields": "false"}).alias("report"))


@dataclass
class CreatedDataset:
    table: DataFrame
    metadata: DataFrame
    benchmark: DataFrame | None
    export: DataFrame | None


def create_dataset(
    spark: SparkSession, config: DatasetSpec | str, name: str = "default", rows: DataFrame | None = None, benchmark: bool = True,
    reference: DataFrame | None = None, export: ExportConfig | None = None, path: str | None = None, benchmark_config: BenchmarkConfig | None = None, **settings,
) -> CreatedDataset:
    """Spec or template name -> table, metadata row, optional scores, optional export manifest."""
    spec = template(config, **settings) if isinstance(config, str) else config
    df = generate(spark, spec, rows)
    metadata = df.agg(
        F.lit(name).alias("dataset"),
        F.lit(datetime.now().isoformat(sep=" ")).alias("generated_at"),
        F.count(F.lit(1)).alias("num_rows"),
        F.lit(len(df.columns)).alias("num_columns"),
    )
    scored = benchmark_dataset(df, reference, default_target(df), benchmark_config) if benchmark else None
    manifest = export_dataset(df, path, export, name) if export is not None and path is not None else None
    return CreatedDataset(df, metadata, scored, manifest)
