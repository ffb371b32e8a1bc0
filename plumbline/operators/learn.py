"""Learning-based measures: random-forest utility and isolation-forest anomalies."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.draws import Draws
from plumbline.operators.forests import forest_predictions
from plumbline.operators.profile import share
from plumbline.operators.ranks import exact_quantiles
from plumbline.operators.shaping import impute_mean, label_encode, standardize
from plumbline.session import numeric_columns, quoted, settle

# Forest sizes, split share, contamination.
UTILITY_TREES = 50
TEST_SHARE = 0.2
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
CONTAMINATION = 0.1
# A forest's statistics grow with nodes x features x classes: a text with more values than this is a name, not a class.
MOST_CLASSES = 1000
EULER = 0.5772156649


def held_out(row_id: Column, share_of_rows: float = TEST_SHARE, seed: int = 42) -> Column:
    return Draws(seed, "split", row_id).unit("x") < F.lit(float(share_of_rows))


def train_test_split(df: DataFrame, row_id: str, test_share: float = TEST_SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Deterministic split by row id."""
    flag = held_out(F.col(quoted(row_id)), test_share, seed)
    return df.where(~flag), df.where(flag)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2 (0 when the labels do not vary)."""
    y, p = F.col(quoted(label)).cast("double"), F.col(quoted(prediction)).cast("double")
    sums = df.agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("spread")
    )
    r2 = F.when(F.col("spread") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("mse") / F.nullif("spread", F.lit(0.0)))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision, recall, f1; an undefined ratio counts 0."""
    confusion = df.groupBy(F.col(quoted(label)).alias("y"), F.col(quoted(prediction)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("y").cast("string").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").cast("string").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    classes = confusion.select(F.inline(roles)).groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    scored = classes.select(
        "*", F.coalesce(share(F.col("hits"), F.col("predicted")), zero).alias("pr"), F.coalesce(share(F.col("hits"), F.col("support")), zero).alias("re")
    ).withColumn("f", F.coalesce(F.lit(2.0) * F.col("pr") * F.col("re") / F.nullif(F.col("pr") + F.col("re"), zero), zero))
    n = F.sum("support")
    return scored.agg(
        share(F.sum("hits"), n).alias("accuracy"),
        share(F.sum(F.col("pr") * F.col("support")), n).alias("precision"),
        share(F.sum(F.col("re") * F.col("support")), n).alias("recall"),
        share(F.sum(F.col("f") * F.col("support")), n).alias("f1"),
    )


def content_id(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(quoted(c)).cast("string") for c in df.columns])


def default_target(df: DataFrame) -> str | None:
    """First text column, else first numeric column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = numeric_columns(df)
    return texts[0] if texts else (numbers[0] if numbers else None)


def ml_utility(df: DataFrame, target: str, seed: int = 42, trees: int = UTILITY_TREES, depth: int = 30, rows: int | None = None) -> DataFrame:
    """One row: task, utility_score and the metrics of a random forest on a held-out fifth.

    Text features and a text target become ranks of their sorted values; dates are
    left out.  ``depth`` bounds the trees.  Without features, and for a text
    target of more than MOST_CLASSES values, the task is unknown and the score 0: nothing is fitted.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema.fields}
    classify = isinstance(kinds[target], T.StringType)
    empty = ["accuracy", "precision", "recall", "f1", "mse", "rmse", "mae", "r2"]

    def result(task: str, score: Column, have: dict[str, Column], base: DataFrame) -> DataFrame:
        return base.select(
            F.lit(task).alias("task"), score.alias("utility_score"), *[have.get(m, F.lit(None).cast("double")).alias(m) for m in empty]
        )

    work = df.withColumn("_row", content_id(df))
    features = []
    for name, kind in kinds.items():
        if name == target:
            continue
        if isinstance(kind, T.StringType):
            work = label_encode(work, name, f"_f_{name}", rows)
        elif isinstance(kind, T.BooleanType):
            work = work.withColumn(f"_f_{name}", F.col(quoted(name)).cast("double"))
        elif isinstance(kind, T.NumericType):
            work = work.withColumn(f"_f_{name}", F.nanvl(F.col(quoted(name)).cast("double"), F.lit(None).cast("double")))
        else:
            continue
        features.append(f"_f_{name}")
    if classify:
        work = label_encode(work, target, "_y", rows)
        classes = (work.agg(F.max("_y")).first()[0] or 0) + 1
        if classes > MOST_CLASSES:
            return result("unknown", F.lit(0.0), {}, spark.range(1))
        label = F.col("_y").cast("double").alias("label")
    else:
        work = work.where(F.col(quoted(target)).isNotNull())
        label = F.col(quoted(target)).cast("double").alias("label")
    if not features:
        return result("unknown", F.lit(0.0), {}, spark.range(1))
    numbered = {f: f"_x{i}" for i, f in enumerate(features)}
    work = work.select("_row", label, *[F.col(quoted(f)).alias(n) for f, n in numbered.items()])
    features = list(numbered.values())
    work = impute_mean(work, features)
    predicted = forest_predictions(work, features, held_out(F.col("_row"), TEST_SHARE, seed), classify, trees, depth, seed)
    if classify:
        m = classification_metrics(predicted)
        return result("classification", F.col("f1"), {c: F.col(c) for c in ("accuracy", "precision", "recall", "f1")}, m)
    m = regression_metrics(predicted).withColumn("r2", F.greatest(F.lit(0.0), F.col("r2")))
    return result("regression", F.col("r2"), {c: F.col(c) for c in ("mse", "rmse", "mae", "r2")}, m)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    out = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def fit_tree(values: np.ndarray, seed: int, depth_limit: int) -> list[tuple[int, int, float, float]]:
    """Nodes (number, feature or -1, threshold, path adjustment) of one isolation tree; children 2i+1, 2i+2."""
    rng = np.random.default_rng(seed)
    nodes, stack = [], [(0, np.arange(len(values)), 0)]
    while stack:
        number, index, depth = stack.pop()
        part = values[index]
        spread = np.ptp(part, axis=0) if len(index) > 1 else np.zeros(values.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= depth_limit or len(index) <= 1 or not len(usable):
            nodes.append((number, -1, 0.0, float(average_path(len(index)))))
            continue
        feature = int(rng.choice(usable))
        column = part[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        left = column <= cut
        nodes.append((number, feature, cut, 0.0))
        stack.append((2 * number + 1, index[left], depth + 1))
        stack.append((2 * number + 2, index[~left], depth + 1))
    return nodes


def isolation_scores(
    df: DataFrame, row_id: str, columns: list[str] | None = None, seed: int = 42, rows: int | None = None
) -> DataFrame:
    """The table with ``anomaly_score`` in (0, 1]; higher is more anomalous.

    Trees are fitted in parallel, each from its own fixed-size sample drawn by row id,
    so neither fitting nor the broadcast model grows with the table.
    """
    spark = df.sparkSession
    columns = [c for c in numeric_columns(df) if c != row_id] if columns is None else columns
    rows = df.count() if rows is None else rows
    ready = standardize(impute_mean(df.select(quoted(row_id), *[quoted(c) for c in columns]), columns), columns)
    pool_size = ISOLATION_TREES * ISOLATION_SAMPLE
    pool = ready.where(Draws(seed, "pool", F.col(quoted(row_id))).unit("x") < min(1.0, pool_size / max(rows, 1)))
    expected = min(rows, pool_size)
    sample = min(ISOLATION_SAMPLE, rows)
    keep = min(1.0, 3.0 * ISOLATION_SAMPLE / max(expected, 1))
    # pool rows meet each tree with a small probability; a tree then takes its 256 smallest draws
    trees = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(ISOLATION_TREES - 1))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("tree"), F.col(quoted(row_id))), 12).cast("double") / F.lit(float(2**52))
    trees = trees.withColumn("_draw", draw).where(F.col("_draw") < F.lit(keep))
    limit = max(1, math.ceil(math.log2(max(2, sample))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", row_id]).head(sample)
        tree = int(pdf["tree"].iloc[0])
        nodes = fit_tree(pdf[columns].to_numpy(dtype=float), seed * 1000 + tree, limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "path"])

    nodes = trees.groupBy("tree").applyInPandas(fit, "tree int, node int, feature int, cut double, path double").collect()
    # at most 100 trees x 511 nodes
    width = 2 ** (limit + 1)
    feature = np.full((ISOLATION_TREES, width), -1, dtype=np.int32)
    cut = np.zeros((ISOLATION_TREES, width))
    path = np.zeros((ISOLATION_TREES, width))
    for r in nodes:
        feature[r["tree"], r["node"]] = r["feature"]
        cut[r["tree"], r["node"]] = r["cut"]
        path[r["tree"], r["node"]] = r["path"]
    model = spark.sparkContext.broadcast((feature, cut, path))
    norm = float(average_path(sample)) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        feature, cut, path = model.value
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for t in range(len(feature)):
            node = np.zeros(len(x), dtype=np.int64)
            depth = np.zeros(len(x))
            for _ in range(limit):
                f = feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(f, 0)] > cut[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            total += depth + path[t, node]
        return pd.Series(np.power(2.0, -(total / len(feature)) / norm))

    return ready.select(quoted(row_id), score(*[F.col(quoted(c)) for c in columns]).alias("anomaly_score"))


def detect_anomalies(
    df: DataFrame, row_id: str, columns: list[str] | None = None, contamination: float = CONTAMINATION, seed: int = 42, rows: int | None = None
) -> DataFrame:
    """(row_id, anomaly_score, is_anomaly): the most isolated ``contamination`` share of the rows is flagged."""
    rows = df.count() if rows is None else rows
    # scoring is the costly part: the cut and the result both read the settled scores
    scored = settle(isolation_scores(df, row_id, columns, seed, rows))
    cut = exact_quantiles(scored, ["anomaly_score"], [1.0 - contamination], rows)
    limit = F.get(cut.scalar(), F.lit(0))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > limit)
