"""Hand-made tables: empty and constant columns, missing cells, ties, boundaries."""

import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from plumbline.functions import papers as fn
from plumbline.functions.vectors import cosine, norm
from plumbline.operators import compare as C
from plumbline.operators import learn as L
from plumbline.operators import papers as X
from plumbline.operators import privacy as V
from plumbline.operators import profile as P
from plumbline.operators import records as J
from plumbline.operators import shaping as S
from plumbline.operators import training as T
from plumbline.operators import usage as U
from plumbline.operators import vectors as E
from plumbline.operators import catalog as K
from plumbline.plans.reports import BenchmarkConfig, benchmark_dataset, benchmark_suite, comparison_summary, validation_report
from plumbline.session import fresh_path
from plumbline.sources import readers as R
from plumbline.sources import writers as W
from plumbline.streaming import streams as St


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def gaps(spark):
    data = [(1.0, 10.0, "A", None), (2.0, None, "B", None), (None, 30.0, None, None), (4.0, 40.0, "A", None), (5.0, None, "B", None)]
    return spark.createDataFrame(data, "feature1 double, feature2 double, category string, nothing double")


# --- profile -------------------------------------------------------------------------------

def test_profile_of_gaps(spark, gaps):
    filled = by(P.completeness(gaps), "column", "completeness")
    assert filled == {"feature1": 0.8, "feature2": 0.6, "category": 0.8, "nothing": 0.0, "*": pytest.approx(11 / 20)}
    assert by(P.uniqueness_by_column(gaps), "column", "uniqueness") == {"feature1": 0.8, "feature2": 0.6, "category": 0.4, "nothing": 0.0}
    assert by(P.validity_by_column(gaps), "column", "validity") == {"feature1": 1.0, "feature2": 1.0, "category": 1.0, "nothing": 0.0}
    score = one(P.uniqueness_score(gaps))
    assert score["column_uniqueness"] == pytest.approx((1 + 1 + 0.5 + 0) / 4) and score["row_uniqueness"] == 1.0


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert by(P.completeness(empty), "column", "completeness") == {"x": None, "s": None, "*": None}
    assert by(P.uniqueness_by_column(empty), "column", "uniqueness") == {"x": 0.0, "s": 0.0}
    assert one(P.duplicate_rows(empty))["duplicate_rows"] == 0
    assert one(P.uniqueness_score(empty))["uniqueness_score"] == 0.0
    assert P.outliers_iqr(empty.withColumn("k", F.lit(1)), ["k"], ["x"]).count() == 0
    with pytest.raises(W.ExportError):
        W.preflight(empty)


def test_duplicates_treat_gaps_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None)], "a int, b string")
    assert tuple(one(P.duplicate_rows(df))) == (1, 0.25)


def test_consistency(spark):
    df = spark.createDataFrame([("ab", 1.0, 0.0), ("", -1.0, 0.0), ("abcd", 0.0, 0.0)], "s string, zero_mean double, flat double").withColumn("blank", F.lit(""))
    got = {r["column"]: r for r in P.string_consistency(df).collect()}
    assert got["s"]["format_consistency"] == pytest.approx(1 - 2.0 / 2.0)
    assert got["blank"]["format_consistency"] == 1.0
    numbers = {r["column"]: r for r in P.numeric_consistency(df).collect()}
    assert numbers["zero_mean"]["coefficient_of_variation"] == 0.0 and numbers["flat"]["std"] == 0.0


def test_text_validity_and_encoding(spark):
    df = spark.createDataFrame([("ok",), ("tail\n",), ("tab\there",), ("two\n\n",), ("é",)], "s string")
    assert by(P.validity_by_column(df), "column", "validity") == {"s": 0.6}
    assert one(P.encoding_issues(df))[0] == 1
    assert one(P.encoding_issues(df.where("s <> 'é'")))[0] == 0


def test_numbers_that_are_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert by(P.validity_by_column(df), "column", "validity") == {"x": 0.5}
    assert rows(R.nan_to_null(df).where("x is null")) == [(None,), (None,)]


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=200), rng.normal(size=200)
    data = [(float(x), float(x + y) if i % 4 else None, 0.1, float("nan") if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in P.correlation_pairs(df).collect()}
    import pandas as pd

    want = pd.DataFrame(data, columns=list("abcd")).astype(float).corr()
    assert got[("a", "c")] is None and got[("c", "d")] is None
    for pair in (("a", "b"), ("a", "d"), ("b", "d")):
        assert got[pair] == pytest.approx(want.loc[pair], abs=1e-12)


def test_outliers(spark):
    values = [10.0] * 5 + [11.0] * 5 + [12.0] * 5 + [100.0]
    df = spark.createDataFrame(list(enumerate(values)), "k long, x double")
    assert rows(P.outliers_iqr(df, ["k"])) == [(15, "x", 100.0)]
    assert rows(P.outliers_zscore(df, ["k"])) == [(15, "x", 100.0)]
    flat = spark.createDataFrame([(i, 3.0) for i in range(9)], "k long, x double")
    assert P.outliers_zscore(flat, ["k"]).count() == 0 and P.outliers_iqr(flat, ["k"]).count() == 0


def test_upper_median_and_histogram(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("cccc",), ("dddddd",), ("",), (None,)], "t string")
    assert tuple(one(P.length_stats(df, "t"))) == ("t", 13 / 4, 4)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    bins = {r["bin"]: r for r in P.histogram_density(flat, ["x"], 10).collect()}
    assert bins[5]["n"] == 2 and bins[0]["left_edge"] == 1.5 and sum(r["density"] * 0.1 for r in bins.values()) == pytest.approx(1.0)
    values = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert [r["n"] for r in sorted(P.histogram_density(df, ["x"]).collect(), key=lambda r: r["bin"])] == list(np.histogram(values, bins=30)[0])


# --- comparison ----------------------------------------------------------------------------

def test_normality_matches_published_examples(spark):
    """z statistics of the two published skew examples and of 0..19 for kurtosis."""
    for values, skew_z in (([1, 2, 3, 4, 5, 6, 7, 8], None), ([2, 8, 0, 4, 1, 9, 9, 0], None)):
        x = np.array(values, dtype=float)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        got = one(C.normality_test(df))
        assert 0.0 <= got["p_value"] <= 1.0 and got["p_value"] == pytest.approx(math.exp(-got["statistic"] / 2))
    x = np.arange(20, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    # symmetric data: the skew term uses y = 1, the kurtosis z is -1.7058104152122062
    g = 0.0
    n = 20.0
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = 1 / math.sqrt(0.5 * math.log(w2)) * math.log(1 / alpha + math.sqrt((1 / alpha) ** 2 + 1))
    assert one(C.normality_test(df))["statistic"] == pytest.approx(z1**2 + 1.7058104152122062**2, rel=1e-9)
    short = spark.createDataFrame([(float(v),) for v in range(7)], "x double")
    assert one(C.normality_test(short))["p_value"] is None and not one(C.normality_test(short))["valid"]


def brute_distances(a, b):
    grid = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    g = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    gap = np.abs(f - g)
    return gap.max(), float(np.sum(gap[:-1] * np.diff(grid)))


@pytest.mark.parametrize("per_bucket", [10**9, 60])
def test_distances_against_brute_force(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(C, "bucket_count", lambda rows: max(1, rows // per_bucket))
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(0, 1, 700), 2)
    b = np.round(rng.normal(0.3, 2, 500), 2)
    a[:250] = 0.0  # a hot value
    left = spark.createDataFrame([(float(v), int(v * 10)) for v in a], "x double, n long")
    right = spark.createDataFrame([(float(v), int(v * 10)) for v in b], "x double, n long")
    got = {r["column"]: r for r in C.ecdf_distances(left, right).collect()}
    for name, u, v in (("x", a, b), ("n", (a * 10).astype(int), (b * 10).astype(int))):
        ks, w = brute_distances(u.astype(float), v.astype(float))
        assert got[name]["ks_distance"] == pytest.approx(ks) and got[name]["wasserstein_distance"] == pytest.approx(w)


def test_tests_on_constant_columns(spark):
    flat = spark.createDataFrame([(1.0, 2.0, float(i)) for i in range(20)], "a double, b double, c double")
    assert [r["valid"] for r in C.normality_test(flat, ["a"]).collect()] == [False]
    assert one(C.correlation_preservation(flat, flat))[0] == 0.0
    assert by(C.ecdf_distances(flat, flat), "column", "similarity") == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert {r["r"] for r in P.correlation_pairs(flat).collect()} == {None}
    assert {r["x"] for r in S.standardize(flat.select(F.col("a").alias("x"))).collect()} == {0.0}


def test_uniformity(spark):
    x = (np.arange(100) + 0.5) / 100
    df = spark.createDataFrame([(float(v), float(v * v)) for v in x], "u double, q double")
    got = {r["column"]: r for r in C.uniformity_test(df, ["u", "q"]).collect()}
    assert got["u"]["statistic"] == pytest.approx(0.005) and got["u"]["valid"] and got["u"]["p_value"] == pytest.approx(1.0)
    assert got["q"]["statistic"] == pytest.approx(max(np.max(np.arange(1, 101) / 100 - x**2), np.max(x**2 - np.arange(100) / 100))) and not got["q"]["valid"]


def counted(spark, **counts):
    return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "c string")


def test_chi_square(spark):
    score = lambda s, r, **kw: one(C.chi_square_similarity(s, r, **kw))["similarity"]
    assert score(counted(spark, a=12, b=8), counted(spark, a=10, b=10)) == pytest.approx(1 - (0.4 + 0.4) / 2)
    assert score(counted(spark, a=12, b=8), counted(spark, a=10, b=11)) == 0.0  # unequal totals
    assert score(counted(spark, a=24, b=16), counted(spark, a=10, b=10), rescale=True) == pytest.approx(1 - 1.6 / 2)
    assert score(counted(spark, a=10, b=5, c=5), counted(spark, a=10, b=10)) == 0.0  # category missing from the reference
    assert score(counted(spark, a=10, b=10), counted(spark, a=10, b=5, c=5)) == 0.0
    assert score(counted(spark, a=5), counted(spark, a=5)) == 0.0


def test_preservation_and_fidelity(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(100, 4))
    base[:, 1] += base[:, 0]
    base[:, 3] -= base[:, 2]
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], "a double, b double, c double, d double")
    assert one(C.correlation_preservation(df, df))[0] == pytest.approx(1.0)
    assert one(C.correlation_preservation(df.select("a", "b"), df.select("a", "b")))[0] == 0.0
    assert one(C.correlation_preservation(df.select("a"), df))[0] == 1.0
    assert one(C.correlation_preservation(df.withColumn("d", F.lit(1.0)), df))[0] == 0.0
    zero = spark.createDataFrame([(1.0, 5.0), (-1.0, 5.0)], "z double, y double")
    other = spark.createDataFrame([(3.0, 4.0)], "z double, y double")
    assert one(C.statistical_fidelity(other, zero))[0] == pytest.approx(0.8)  # the zero mean is skipped
    assert one(C.statistical_fidelity(zero, zero.select("z")))[0] == 0.0


def test_recorded_overall_score(spark):
    metrics = spark.createDataFrame(
        [(1.0, 1.0, 0.7892857142857143, 1.0, 0.0, 0.0)],
        "completeness_score double, consistency_score double, uniqueness_score double, validity_score double, statistical_fidelity double, ml_utility_score double",
    )
    scored = C.overall_score(metrics)
    assert one(scored)["overall_quality_score"] == pytest.approx(0.6183928571428571, abs=1e-12)
    assert [r["score"] for r in C.recommendations(scored).orderBy("position").collect()] == ["statistical_fidelity", "ml_utility_score", "overall_quality_score"]


def test_schema_profile_groups_narrow_rows(spark):
    """A row of the plan's expansion holds one value, not every column."""
    df = spark.createDataFrame([(1, 0.0, "a", 2), (2, -0.0, None, 2), (None, float("nan"), "a", None), (2, float("nan"), "b", 3)], "a int, b double, c string, d int")
    found = P.schema_profile(df)
    assert sorted(rows(found)) == [(0, "a", "int", 1, 2, 4), (1, "b", "double", 0, 2, 4), (2, "c", "string", 1, 2, 4), (3, "d", "int", 1, 2, 4)]
    assert rows(P.schema_profile(df.limit(0)).orderBy("position"))[3] == (3, "d", "int", 0, 0, 0)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_correlation_check(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(10)], "a double, b double, c double")
    got = {(r[0], r[1]): r["valid"] for r in C.correlation_check(df, {("a", "b"): 0.95, ("b", "a"): 0.5, ("a", "c"): 0.9, ("a", "x"): 0.1}).collect()}
    assert got == {("a", "b"): True, ("b", "a"): False, ("a", "c"): True}


def test_privacy(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "n int, t string")
    r = spark.createDataFrame([(1, "a", 0), (2, None, 0), (4, "c", 0)], "n long, t string, z int")
    assert tuple(one(V.disclosure_risk(s, r))) == (2, 0.5, 0.5)
    assert tuple(one(V.disclosure_risk(s, r.select("z")))) == (0, 0.0, 1.0)
    groups = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 3)], "q string, s int")
    assert tuple(one(V.k_anonymity(groups, ["q"], 2))) == (1, 1, 1, False)
    assert tuple(one(V.l_diversity(groups, ["q"], "s", 1))) == (1, 0, True)


# --- learning and reports ------------------------------------------------------------------

def test_classification_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "label string, prediction string")
    got = one(L.classification_metrics(df))
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5
    assert got["precision"] == pytest.approx((2 * 1.0 + 1 * 0.5) / 4) and got["f1"] == pytest.approx((2 * (2 / 3) + 2 / 3) / 4)
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "label double, prediction double")
    assert one(L.regression_metrics(flat))["r2"] == 0.0


def test_forests(spark):
    rng = np.random.default_rng(7)
    inliers, outliers = rng.normal(0, 1, (1000, 3)), rng.normal(5, 1, (50, 3))
    data = [(i, *map(float, r)) for i, r in enumerate(np.vstack([inliers, outliers]))]
    df = spark.createDataFrame(data, "id long, f1 double, f2 double, f3 double")
    found = L.detect_anomalies(df, "id", contamination=0.05)
    flagged = {r["id"] for r in found.where("is_anomaly").collect()}
    assert 45 <= len(flagged) <= 56 and sum(i >= 1000 for i in flagged) >= 40
    again = {r["id"] for r in L.detect_anomalies(df.repartition(7), "id", contamination=0.05).where("is_anomaly").collect()}
    assert flagged == again
    easy = df.withColumn("target", F.when(F.col("f1") > 2.5, F.lit("far")).otherwise(F.lit("near"))).drop("id")
    assert one(L.ml_utility(easy, "target", trees=10))["utility_score"] > 0.95
    line = df.select("f1", "f2", (F.col("f1") * 3).alias("y"))
    assert one(L.ml_utility(line, "y", trees=10))["utility_score"] > 0.8
    ids = df.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), "f1")
    assert tuple(one(L.ml_utility(ids, "name")))[:2] == ("unknown", 0.0)


def test_benchmark_and_suite(spark, gaps):
    rng = np.random.default_rng(1)
    make = lambda m, s, n=300: spark.createDataFrame([(float(a), float(b), "xyz"[i % 3]) for i, (a, b) in enumerate(zip(rng.normal(m, s, n), rng.uniform(0, 100, n)))], "f1 double, f2 double, c string")
    synthetic, reference = make(100, 15), make(105, 12)
    got = one(benchmark_dataset(synthetic, reference, "c", BenchmarkConfig(trees=5, depth=4)))
    scores = [got[c] for c in got.asDict() if c != "distribution_similarity"]
    assert all(0.0 <= v <= 1.0 for v in scores)
    assert one(benchmark_dataset(gaps))["completeness_score"] == pytest.approx(11 / 20)
    sampled = one(benchmark_dataset(synthetic, reference, None, BenchmarkConfig(sample_size=50)))
    assert 0.0 <= sampled["overall_quality_score"] <= 1.0
    every, summary = benchmark_suite({"s": synthetic, "g": gaps}, reference, None, BenchmarkConfig(ml_evaluation=False))
    assert [r["dataset_benchmark"] for r in every.collect()] == ["s_comprehensive", "g_comprehensive"]
    assert by(summary, "column", "filled")["overall_quality_score"] == 2


def test_comparison_takes_the_first_best(spark):
    df = spark.createDataFrame([(0, "a", 0.5, 10), (1, "b", 0.9, 5), (2, "c", 0.9, 1)], "position int, dataset_name string, overall_quality double, num_rows long")
    assert tuple(one(comparison_summary(df))) == (3, pytest.approx(2.3 / 3), "b", 16)


def test_validation_report(spark):
    df = spark.range(60).select("id", (F.col("id") * 1.0).alias("x"), F.lit("a").alias("s"))
    got = {(r["section"], r["column"], r["metric"]): r["value"] for r in validation_report(df, "id", {"type": "object", "properties": {"x": {"minimum": 6}}}).collect()}
    assert got[("schema", "*", "validation_score")] == pytest.approx(0.9)
    assert got[("overall", "*", "overall_score")] == pytest.approx((0.9 + 1.0 + (1 - got[("anomalies", "*", "share")])) / 3)


# --- shaping -------------------------------------------------------------------------------

def test_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-02", "x", None), ("2", "2", "2024-01-03", "x", None), ("3", None, None, "y", None)], "i string, d string, t string, c string, n string")
    assert by(S.inferred_types(df), "column", "inferred") == {"i": "bigint", "d": "double", "t": "timestamp_ntz", "c": "string", "n": "bigint"}
    assert dict(S.infer_types(df).dtypes)["t"] == "timestamp_ntz"
    small = spark.createDataFrame([(127, 40000, 0.5, 0.1), (-128, 1, 0.25, 0.2)], "a long, b long, f double, d double")
    assert dict(S.downcast_types(small).dtypes) == {"a": "tinyint", "b": "int", "f": "float", "d": "double"}


def test_mask_preview_sample(spark):
    df = spark.createDataFrame([("12345678",), ("123456789",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(S.mask_middle(F.col("s"))).collect()] == ["*" * 8, "1234*6789", "", None]
    long = spark.createDataFrame([(i, "x" * (48 + i)) for i in range(7)], "k int, t string")
    assert [len(r["t"]) for r in S.preview_rows(long, ["k"]).collect()] == [48, 49, 50, 53, 53]
    assert S.sample_rows(spark.range(500), "id", 123).count() == 123
    assert S.sample_rows(spark.range(50), "id", 123).count() == 50
    assert [r[0] for r in S.label_encode(df.where("s is null or s <> ''"), "s", "l").orderBy("l").select("l").collect()] == [0, 1, 2]


# --- papers --------------------------------------------------------------------------------

def test_sections(spark):
    pages = [(1, ["preface\nAbstract\n  line one \n\nMethods\nResults\nfound it", "more\nReferences\n[1] a\nb\n2. c"]), (2, ["nothing here"]), (3, ["Abstract"])]
    df = spark.createDataFrame(pages, "doc_id long, pages array<string>")
    assert rows(X.split_sections(df)) == [
        (1, 0, "Abstract", "abstract", 0, "line one"), (1, 2, "Results", "results", 0, "found it\nmore"), (1, 3, "References", "references", 1, "[1] a\nb\n2. c"),
    ]
    quirks = [(r["title"], r["section_type"], r["page_number"]) for r in X.split_sections(df, reference_labels=True).collect()]
    assert quirks == [("Abstract", "methods", 0), ("Results", "references", 1), ("References", "content", 1)]
    counted = X.with_sections(df).select("doc_id", X.references_count(F.col("sections")))
    assert rows(counted) == [(1, 2), (2, 0), (3, 0)]


def test_abstract_and_keywords(spark):
    body = "x" * 30 + " \n " + "y" * 30
    df = spark.createDataFrame([(["Abstract: " + body + "\nKeywords: a, b; c and d\n\n1. Start"],), (["Abstract too short\nIntroduction"],), (["ABSTRACT - " + body],)], "pages array<string>")
    got = rows(df.select(fn.extract_abstract(F.col("pages")), fn.extract_keywords(F.col("pages"))))
    assert got[0] == ("x" * 30 + " " + "y" * 30, ["a", "b", "c", "d"])
    assert got[1] == (None, []) and got[2][0] is None  # nothing ends the last one but a line break before the end
    ended = spark.createDataFrame([(["ABSTRACT - " + body + "\n"],)], "pages array<string>")
    assert rows(ended.select(fn.extract_abstract(F.col("pages")))) == [("x" * 30 + " " + "y" * 30,)]


def test_metadata_functions(spark):
    dates = spark.createDataFrame([("2020", "Feb", "30"), ("2020", "2", "29"), ("1999", None, None), ("x", "1", "1"), ("2001", "Foo", "y")], "y string, m string, d string")
    assert [r[0] for r in dates.select(fn.partial_date(F.col("y"), F.col("m"), F.col("d"))).collect()] == [None, datetime(2020, 2, 29), datetime(1999, 1, 1), None, datetime(2001, 1, 1)]
    ids = spark.createDataFrame([("arXiv:2101.00001v2",), ("solv-int/9501001",)], "i string")
    assert rows(ids.select(fn.clean_feed_id(F.col("i")), fn.clean_feed_id(F.col("i"), True))) == [("2101.00001", "2101.00001"), ("solv-int/9501001", "sol")]
    urls = spark.createDataFrame([("http://x/a/b.pdf?q=1",), ("http://x/a/b.html",), ("not a url",), ("http://x",)], "u string")
    assert [r[0] for r in urls.select(fn.url_filename(F.col("u"))).collect()] == ["b.pdf", "document.pdf", "document.pdf", "document.pdf"]


def test_recent_and_sample(spark):
    papers = spark.createDataFrame([(i, "en", "s" if i % 3 else "t", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(30)], "id long, domain string, source string, published timestamp_ntz")
    assert [r["id"] for r in X.recent_papers(papers, datetime(2024, 1, 20), 7, 3).collect()] == [19, 18, 17]
    assert X.sample_by_domain(papers, ["en", "fr"], 16, "id").count() == 8


# --- training ------------------------------------------------------------------------------

def test_training_limits(spark):
    sections = [(0, "M", "methods", 0, "m" * 1001), (1, "R", "results", 0, "r" * 100), (2, "C", "conclusion", 1, "c" * 1501)]
    kind = "doc_id long, title string, abstract string, sections array<struct<section_no:int,title:string,section_type:string,page_number:int,content:string>>"
    docs = spark.createDataFrame([(1, None, None, sections)], kind)
    for longest, want in ((T.LONGEST_ANSWER, 1003), (None, 1001)):
        got = rows(T.training_segments(docs, longest_answer=longest).select("segment_type", "title", F.length("content"), F.length("answer")))
        assert got == [("section", "M", 1001, None), ("section", "C", 1501, None), ("qa_pair", None, None, want), ("qa_pair", None, None, 100)]
    for longest, want in ((T.LONGEST_SECTION, 1503), (None, 1501)):
        formatted = T.format_segments(T.training_segments(docs), "alpaca", longest=longest).collect()
        assert sorted(len(r["output"]) for r in formatted) == [100, 1001, 1001, want]
    assert T.format_abstract(T.training_segments(docs), "sharegpt").count() == 0
    with pytest.raises(ValueError):
        T.format_segments(T.training_segments(docs), "xml")
    with pytest.raises(ValueError):
        T.chat_records(docs, "title", "nothing")
    with pytest.raises(ValueError):
        T.chat_records(docs.withColumn("q", F.lit("a")), "q", "q", "doc_id > 5")


# --- vectors -------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [8 * 1024 * 1024, 200])
def test_batch_topk(spark, block):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[:100] = m[0]  # a third of the rows are copies
    m[100] = 0
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<float>")
    queries = spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in (0, 100, 150, 200, 299)], "query_id string, vector array<float>")
    got = {}
    for r in E.vector_topk_batch(base.repartition(5), queries, 4, block_bytes=block).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["id"]
    u = m.astype(float)
    lengths = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, lengths, out=np.zeros_like(u), where=lengths > 0)
    for i in (0, 100, 150, 200, 299):
        sim = np.round(u @ u[i], 12)
        want = sorted(range(300), key=lambda j: (-sim[j], j))[:4]
        assert [got[f"q{i}"][p] for p in (1, 2, 3, 4)] == want
    single = [r["id"] for r in E.vector_topk(base, "vector", m[150].tolist(), 4).collect()]
    assert single[0] == 150 and set(single) == set(got["q150"].values())


@pytest.mark.parametrize("k, queries, rows_at_once, block", [(3, 256, 2048, 1 << 16), (3, 7, 64, 1 << 16), (90, 256, 300, 64), (1, 256, 2048, 1 << 20), (7000, 256, 2048, 1 << 20)])
def test_best_rows_are_those_of_a_full_sort(monkeypatch, k, queries, rows_at_once, block):
    monkeypatch.setattr(E, "SCORED_QUERIES", queries)
    monkeypatch.setattr(E, "SCORED_ROWS", rows_at_once)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6000, 4))
    m[100:3000] = m[rng.integers(0, 20, 2900)]  # large groups of copies
    m[4000:4003] = 0
    m = E._unit_rows(pa.chunked_array([pa.array(m.tolist())]))
    wanted = m[[0, 5, 99, 150, 4001, *range(5000, 5030)]]
    at, query, score = E._best_rows(wanted, m, k, block)
    for i, q in enumerate(wanted):
        sim = np.round(m @ q, 12)
        want = sorted(range(6000), key=lambda j: (-sim[j], j))[:k]
        assert at[query == i].tolist() == want and score[query == i] == pytest.approx(sim[want], abs=1e-11)
    m[4500] = np.nan  # as a not-a-number in Spark's order and in DuckDB's: the greatest
    at, query, score = E._best_rows(wanted, m, 2, block)
    assert (at[::2] == 4500).all() and np.isnan(score[::2]).all() and not np.isnan(score[1::2]).any()
    assert [len(c) for c in E._best_rows(wanted, m[:0], k, block)] == [len(c) for c in E._best_rows(wanted[:0], m, k, block)] == [0, 0, 0]


def test_blocks_of_queries_do_not_copy_the_rows(spark):
    """Each block of queries met its own copy of all rows before: 500 of them here."""
    rng = np.random.default_rng(6)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1000, 8)))], "id long, vector array<double>")
    queries = base.select(F.col("id").alias("query_id"), "vector")
    found = E.vector_topk_batch(base, queries, 2, block_bytes=128)
    copied = found._jdf.queryExecution().analyzed().toString()
    assert copied.count("explode(sequence(0, 0,") == 2, copied
    first = {r["query_id"]: r["id"] for r in found.where("place = 1").collect()}
    assert first == {i: i for i in range(1000)}


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert rows(df.select(cosine(F.col("a"), F.col("b")), norm(F.col("a")))) == [(0.0, 0.0), (1.0, 5.0)]
    with pytest.raises(Exception):
        df.select(cosine(F.array(F.lit(1.0)), F.col("b"))).collect()


# --- records -------------------------------------------------------------------------------

def errors(spark, schema, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    return [r["error"] for r in J.validate_records(df, "r", schema).collect()]


def test_schema_keywords(spark):
    user = {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer", "minimum": 0, "maximum": 150}}, "required": ["name", "age"]}
    got = errors(spark, user, '{"name":"a","age":1.0}', '{"name":"a","age":true}', '{"age":1}', '{"name":"a","age":-1}', '[1]', "{", '{"name":null,"age":200}')
    assert got[0] is None and got[1] == "Validation error at path 'age': True is not of type 'integer'" and got[2] == "'name' is a required property"
    assert got[3] == "Validation error at path 'age': -1 is less than the minimum of 0" and got[4] == "[1] is not of type 'object'" and got[5] == "not valid JSON"
    assert got[6] == "Validation error at path 'name': None is not of type 'string'"
    nested = {"type": "object", "properties": {"user": {"type": "object", "required": ["profile"], "properties": {"profile": {"required": ["age"], "properties": {"age": {"minimum": 0}}}}}}}
    got = errors(spark, nested, '{"user":{"profile":{"age":-5}}}', '{"user":{}}', '{"user":3}', "{}")
    assert got == ["Validation error at path 'user/profile/age': -5 is less than the minimum of 0", "Validation error at path 'user': 'profile' is a required property",
                   "Validation error at path 'user': 3 is not of type 'object'", None]
    deep = {"properties": {"m": {"properties": {"tags": {"type": "array", "items": {"type": "string"}}, "scores": {"patternProperties": {"^[a-z]+$": {"type": "number", "maximum": 100}}}}}}}
    got = errors(spark, deep, '{"m":{"tags":["a",1]}}', '{"m":{"scores":{"math":101,"X":500}}}', '{"m":{"tags":[],"scores":{"a":1.5}}}')
    assert got == ["Validation error at path 'm/tags/1': 1 is not of type 'string'", "Validation error at path 'm/scores/math': 101 is greater than the maximum of 100", None]
    typed = spark.createDataFrame([("a", 5), ("b", 500)], "name string, age int")
    assert [r["valid"] for r in J.validate_table(typed, user).collect()] == [True, False]


def test_replies(spark):
    df = spark.createDataFrame([('{"id": 1}',), ('Sure: {"id": 1} done',), ("no json",), ("} {",), ('{"a": }',)], "r string")
    out = J.parse_replies(df, "engineering_problems", "r", F.lit(1), {"domain": F.lit("civil"), "difficulty": F.lit(3), "constraints": F.lit("")})
    assert [r["parsed"] for r in out.collect()] == [True, True, False, False, False]


# --- usage and streams ---------------------------------------------------------------------

def busy(spark):
    start = datetime(2024, 1, 1, 0, 0, 0)
    data = [("a", start + timedelta(milliseconds=500 * i)) for i in range(100)] + [("b", start + timedelta(milliseconds=500 * i)) for i in range(101)] + [("b", start + timedelta(minutes=1))]
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(data)], "id long, client string, ts timestamp_ntz")


def test_rate_limits(spark):
    df = busy(spark)
    got = {(r["client"], r["minute"].minute): (r["requests"], r["limited"]) for r in U.rate_limit_windows(df, "client", "ts").collect()}
    assert got == {("a", 0): (100, False), ("b", 0): (101, True), ("b", 1): (1, False)}
    rejected = U.rate_limit_rejections(df, "client", "ts", "id").collect()
    assert [(r["id"], r["number"]) for r in rejected] == [(200, 101)]
    tight = U.rate_limit_rejections(df, "client", "ts", "id", limit=3).collect()
    assert len(tight) == 97 + 98 and {r["number"] for r in tight if r["client"] == "a"} == set(range(4, 101))


def test_late_events_are_dropped_from_the_stream(spark):
    path = fresh_path(spark, "late")
    start = datetime(2024, 1, 1, 1, 0, 0)

    def add(n, *events):
        spark.createDataFrame([(c, start + timedelta(minutes=m)) for c, m in events], "client string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("client string, ts timestamp_ntz").parquet(f"{path}/in")
        St.run_updates(St.rate_limit_stream(stream, "client", "ts", 1), f"{path}/out", f"{path}/check")

    add(0, ("a", 0), ("a", 0.5), ("b", 20))
    add(1, ("a", 0.7), ("a", 19.9), ("b", 20.2))
    got = {(r["client"], r["minute"].minute): r["requests"] for r in St.latest(spark.read.parquet(f"{path}/out"), ["client", "minute"]).collect()}
    assert got == {("a", 0): 2, ("a", 19): 1, ("b", 20): 2}


def test_token_prices(spark):
    df = spark.createDataFrame([("gpt-4", 1000, 500), ("mine", 2000, 1000)], "model string, prompt_tokens long, completion_tokens long")
    assert by(U.token_usage(df), "model", "cost") == {"gpt-4": 25.0, "mine": 4.0, "*": 29.0}


# --- files, catalog, user functions --------------------------------------------------------

CSV_BYTES = {
    "minimal": 'id,x,s,b\n1,1.500000,"a ""b"", c",True\n2,,"two\nlines",False\n3,-0.250000,ü,\n',
    "all": '"id","x","s","b"\n"1","1.500000","a ""b"", c","True"\n"2","","two\nlines","False"\n"3","-0.250000","ü",""\n',
    "nonnumeric": '"id","x","s","b"\n1,1.500000,"a ""b"", c",True\n2,,"two\nlines",False\n3,-0.250000,"ü",\n',
    "none": 'id,x,s,b\n1,1.500000,a "b", c,True\n2,,two\nlines,False\n3,-0.250000,ü,\n',
}


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1", "UTF-16", "UTF-16LE"])
@pytest.mark.parametrize("quoting", list(CSV_BYTES))
def test_csv_bytes(spark, quoting, encoding):
    df = spark.createDataFrame([(1, 1.5, 'a "b", c', True), (2, None, "two\nlines", False), (3, -0.25, "ü", None)], "id long, x double, s string, b boolean")
    config, path = W.ExportConfig("csv", csv_quoting=quoting, csv_encoding=encoding), fresh_path(spark, "csv")
    W.write_table(df.coalesce(1), path, config)
    (name,) = [r["file"] for r in W.file_checksums(spark, path).collect()]
    with open(f"{path}/{name}", "rb") as f:
        data = f.read()
    assert data == (b"\xfe\xff" + CSV_BYTES[quoting].encode("UTF-16BE") if encoding == "UTF-16" else CSV_BYTES[quoting].encode(encoding))


@pytest.mark.parametrize("quoting", list(CSV_BYTES))
def test_csv_files_hold_so_many_records(spark, quoting):
    df, path = spark.range(100).select("id", (F.col("id") / 4).alias("x"), F.lit("a").alias("s")), fresh_path(spark, "csv")
    manifest = one(W.export_dataset(df.coalesce(1), path, W.ExportConfig("csv", csv_quoting=quoting, max_records_per_file=30, include_profile=False)))
    assert (manifest["total_records"], manifest["file_count"]) == (100, 4)
    assert spark.read.csv(path, header=True).count() == 100


def test_json_round_trip(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x\ny") for i in range(100)], "id long, s string")
    path = f"{fresh_path(spark, 'json')}/t.json"
    manifest = one(W.export_dataset(df.repartition(3), path, W.ExportConfig("json", compression="gzip", include_profile=False)))
    assert manifest["total_records"] == 100 and sorted(rows(R.read_table(spark, path))) == sorted(rows(df))


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}]', '[\n{"a": 1},\n{"a": 2}\n]', '\n{"a": 1}\n{"a": 2}\n', '[{\n"a": 1},{"a": 2}]'])
def test_json_forms(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    assert sorted(rows(R.read_table(spark, str(tmp_path / "t.json")))) == [(1,), (2,)]


def test_export_files(spark):
    df = spark.range(25_001).withColumn("v", F.col("id") * 0.5)
    path = fresh_path(spark, "split")
    W.write_table(W.split_evenly(df, 25_001, 10_000, "id"), path, W.ExportConfig("jsonl", compression="gzip"))
    sums = W.file_checksums(spark, path).collect()
    assert len(sums) == W.file_count(25_001, 10_000) == 3 and W.file_count(10_000, 10_000) == 1
    for r in sums:
        with open(f"{path}/{r['file']}", "rb") as f:
            content = f.read()
        assert (r["bytes"], r["md5"], r["sha256"]) == (len(content), hashlib.md5(content).hexdigest(), hashlib.sha256(content).hexdigest())
    manifest = one(W.export_dataset(df, fresh_path(spark, "p"), W.ExportConfig("parquet")))
    assert manifest["total_records"] == 25_001 and manifest["compression_ratio"] > 1 and "duplicate_rows" in manifest["profile"]
    capped = fresh_path(spark, "capped")
    W.write_table(df.coalesce(1), capped, W.ExportConfig("jsonl", max_records_per_file=9000))
    assert W.file_checksums(spark, capped).count() == 3
    with pytest.raises(W.ExportError):
        W.ExportConfig("excel")
    with pytest.raises(ValueError):
        R.read_table(spark, "x.toml")


def test_bad_files_are_reported(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "good.parquet"))
    (tmp_path / "bad.parquet").write_text("no parquet")
    tables, problems = R.read_directory_tables(spark, str(tmp_path))
    assert tables["good"].count() == 5 and list(problems) == ["bad"]


def test_rejects_of_a_directory(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "w"))
    good = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".parquet")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "good.parquet").write_bytes(good.read_bytes())
    (tmp_path / "d" / "bad.parquet").write_text("no parquet at all")
    found = rows(R.directory_rejects(spark, str(tmp_path / "d"), schema="id long"))
    assert found == [("bad", 17, "no row could be read")]
    assert R.read_directory(spark, str(tmp_path / "d"), schema="id long").filter("dataset = 'good'").count() > 0


def test_rejects_of_xml(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://x/1</id><title>A</title></entry><entry><id>http://x/2</id><title>B</wrong></entry></feed>")
    assert [r["title"] for r in R.read_feed_xml(spark, str(tmp_path / "f.xml")).collect()] == ["A"]
    (bad,) = R.feed_rejects(spark, str(tmp_path / "f.xml")).collect()
    assert "http://x/2" in bad["record"] and bad["reason"] in ("entry does not parse", "entry parses in part")
    (tmp_path / "a.xml").write_text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><PMID>2</PMID></MedlineCitationX></PubmedArticle></PubmedArticleSet>"
    )
    assert [r["pmid"] for r in R.read_article_xml(spark, str(tmp_path / "a.xml")).collect()] == ["1"]
    assert [r["reason"] for r in R.article_rejects(spark, str(tmp_path / "a.xml")).collect()] in (["PubmedArticle does not parse"], ["PubmedArticle parses in part"])


def test_catalog(spark):
    name = "t" + fresh_path(spark, "x")[-12:]
    first = K.append_rows(spark.createDataFrame([("1", "a")], "id string, name string"), name, fresh_path(spark, "t"))
    K.append_rows(spark.createDataFrame([("2", 5)], "id string, extra int"), name)
    assert sorted(rows(K.sql_query(spark, f"SELECT * FROM {first} WHERE id >= :low", {"low": "1"}))) == [("1", "a"), ("2", None)]
    assert rows(K.sql_query(spark, f"SELECT count(*) FROM {first} WHERE id = ?", ["2"])) == [(1,)]
    assert K.safe_name("a b;c") == "a_b_c"
    registry = K.GeneratorRegistry()
    registry.register("r", lambda s, p: s.range(p["n"]), {"required": ["n"]})
    with pytest.raises(ValueError):
        registry.run(spark, "r", {})
    with pytest.raises(ValueError):
        registry.run(spark, "absent", {})
    got = K.generate_to_table(spark, registry, "r", {"n": 7}, f"{name}_g", ["id"], fresh_path(spark, "g"))
    assert got[1] == 7 and rows(got[2]) == [(0,), (1,), (2,)]


def test_model_calls_never_raise(spark):
    def shout(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1)
    assert rows(K.map_with_model(df, shout, "t", retries=1).select("reply")) == [("A",), ("Error generating content: refused",), ("C",)]


KEYWORDS = [
    ({"minLength": 2}, ["ab", 1, None], ["a", ""]),
    ({"maxLength": 2}, ["ab", [1, 2, 3]], ["abc"]),
    ({"pattern": "^a.c"}, ["abcd", 5], ["xabc", ""]),
    ({"exclusiveMinimum": 1}, [2, 1.5, "0"], [1, 0, 1.0]),
    ({"exclusiveMaximum": 1}, [0, 0.5], [1, 2]),
    ({"multipleOf": 0.5}, [1, 1.5, "x"], [1.2, 0.3]),
    ({"minItems": 2}, [[1, 2], "a", {}], [[], [1]]),
    ({"maxItems": 1}, [[], [1]], [[1, 2]]),
    ({"uniqueItems": True}, [[1, "1", [1]], [], "aa"], [[1, 1], [{"a": 1}, {"a": 1}]]),
    ({"const": {"a": [1]}}, [{"a": [1]}], [{"a": [2]}, 1, None]),
    ({"const": 1}, [1, 1.0], [True, "1", 2]),
    ({"enum": [[1], None, "x"]}, [[1], None, "x"], [[2], 0]),
    ({"properties": {"a": {}}, "patternProperties": {"^x": {}}, "additionalProperties": False}, [{}, {"a": 1, "xy": 2}, 3], [{"b": 1}, {"a": 1, "c": 2, "d": 3}]),
    ({"additionalProperties": {"type": "integer"}}, [{"a": 1}, "x"], [{"a": "1"}]),
    ({"allOf": [{"type": "integer"}, {"minimum": 3}]}, [3, 4], [2, "x", 3.5]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3], [2]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [2, 3.5], [3, 1.5]),
    ({"not": {"type": "string"}}, [1, None], ["x"]),
    ({"$defs": {"n": {"type": "integer"}}, "items": {"$ref": "#/$defs/n"}, "title": "t"}, [[1, 2], []], [["a"], [1, None]]),
    ({"definitions": {"p": {"required": ["x"]}}, "properties": {"q": {"$ref": "#/definitions/p"}}}, [{"q": {"x": 1}}, {}], [{"q": {}}]),
    ({"properties": {"a": False}}, [{}, {"b": 1}], [{"a": 1}]),
]


@pytest.mark.parametrize(("schema", "good", "bad"), KEYWORDS, ids=[next(reversed([k for k in s if k not in ("title",)])) + str(i) for i, (s, _, _) in enumerate(KEYWORDS)])
def test_schema_keywords(spark, schema, good, bad):
    import json

    from plumbline.functions.jsonschema import with_errors

    values = [(json.dumps(v), True) for v in good] + [(json.dumps(v), False) for v in bad]
    df = spark.createDataFrame(values, "t string, want boolean").withColumn("v", F.parse_json("t"))
    found = with_errors(df, "v", schema).select("t", "want", (F.size("errors") == 0).alias("valid")).collect()
    assert [(r["t"], r["valid"]) for r in found] == [(r["t"], r["want"]) for r in found]


@pytest.mark.parametrize("schema", [{"minContains": 1}, {"items": {"if": {}}}, {"$ref": "#"}, {"$ref": "http://x/y"}, {"$ref": "#/a"}])
def test_other_schema_keywords_are_errors(spark, schema):
    from plumbline.functions.jsonschema import with_errors

    with pytest.raises(ValueError):
        with_errors(spark.sql("select parse_json('1') as v"), "v", schema)
