"""Order statistics against brute force, with parameters that force many buckets and rounds."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.draws import Draws
from plumbline.operators import ranks as R


def frame(spark, values, name="x"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"id long, {name} double")


def skewed(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.lognormal(0, 3, n)
    values[: n // 3] = 1.0  # one value holds a third of the rows
    values[n // 3 : n // 2] = np.round(values[n // 3 : n // 2], 1)
    return values


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("sample, fetch", [(300, 40), (2000, 500)])
def test_selected_ranks_are_exact(spark, seed, sample, fetch):
    values = skewed(seed=seed)
    df = frame(spark, values)
    probabilities = [0.0, 0.01, 0.25, 0.3334, 0.5, 0.75, 0.999, 1.0]
    got = R._select_ranks(df, ["x"], probabilities, sample, fetch)["x"]
    assert got == pytest.approx(np.quantile(values, probabilities), rel=1e-12)


def test_selection_ignores_gaps_and_empty_columns(spark):
    df = frame(spark, [None, 1, 2, float("nan"), 3, None]).withColumn("y", F.lit(None).cast("double"))
    got = R._select_ranks(df, ["x", "y"], [0.5], 10, 1)
    assert got == {"x": [2.0], "y": []}


def test_both_quantile_paths_agree(spark):
    values = skewed(3000)
    df = frame(spark, values)
    small = R.exact_quantiles(df, ["x"], [0.25, 0.5], small_rows=10_000).first()["x"]
    large = R.exact_quantiles(df, ["x"], [0.25, 0.5], small_rows=10).first()["x"]
    assert small == pytest.approx(large)
    assert small == pytest.approx(list(np.quantile(values, [0.25, 0.5])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60), cuts=st.lists(st.integers(-50, 50), max_size=9, unique=True))
def test_running_totals_with_any_bounds(spark, values, cuts):
    counts = frame(spark, values).groupBy(F.lit(0).alias("c"), F.col("x").alias("value")).agg(F.count("*").alias("n"))
    got = R.running_totals(counts, "c", "value", ["n"], {0: sorted(float(c) for c in cuts)}).collect()
    distinct = sorted(set(values))
    assert sorted(r["value"] for r in got) == distinct
    for r in got:
        assert r["upto_n"] == sum(v <= r["value"] for v in values)
        assert r["all_n"] == len(values)
        later = [v for v in distinct if v > r["value"]]
        assert r["next_value"] == (later[0] if later else None)


def test_dense_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(R, "bucket_count", lambda rows, per=7: max(1, -(-rows // 7)))
    words = [f"w{(i * 37) % 101:03d}" for i in range(500)] + ["é", "Z", "a b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["value"]: r["rank"] for r in R.dense_ranks(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("k", [1, 17, 500, 1999, 2000])
def test_cutoffs_pick_exactly_k_rows(spark, k):
    df = spark.range(2000)
    draws = {"a": Draws(1, "a", "id").bits("x"), "b": Draws(2, "b", "id").bits("x")}
    cutoffs = R.smallest_k_cutoffs(df, draws, k, 2000, fetch_rows=50)
    for name, draw in draws.items():
        assert df.where(draw <= F.lit(cutoffs[name]).cast("long")).count() == k


def test_cutoffs_survive_a_wrong_row_number(spark):
    df = spark.range(1000)
    draw = Draws(1, "a", "id").bits("x")
    got = R.smallest_k_cutoffs(df, {"a": draw}, 300, 100_000)["a"]
    assert df.where(draw <= F.lit(got).cast("long")).count() == 300


def test_cutoffs_with_repeated_draws(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit(5)).otherwise(F.col("id")).alias("id"))
    draw = Draws(1, "a", "id").bits("x")
    values = sorted(r[0] for r in df.select(draw).collect())
    for k in (1, 450, 900):
        assert R.smallest_k_cutoffs(df, {"a": draw}, k, 900, fetch_rows=20)["a"] == values[k - 1]


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 9).cast("string")).alias("g"))
    got = R.top_per_group(df, ["g"], [F.col("id").desc()], 5, "id").collect()
    expected = {}
    for i in range(2999, -1, -1):
        g = "hot" if i % 3 else str(i % 9)
        expected.setdefault(g, []).append(i)
    assert {(r["g"], r["id"], r["place"]) for r in got} == {(g, i, p + 1) for g, ids in expected.items() for p, i in enumerate(ids[:5])}
