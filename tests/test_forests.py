import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import one, rows

from plumbline.operators import forests as T
from plumbline.operators import learn as L


def test_no_tree_passes_the_driver(spark, monkeypatch):
    """Labels without a pattern make a leaf for nearly each row: Spark's own forest holds all nodes in the driver."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    def fail(*a, **k):
        raise AssertionError("a whole forest reaches the driver")

    for forest in (RandomForestClassifier, RandomForestRegressor):
        monkeypatch.setattr(forest, "fit", fail)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), int(b), "xyz"[c], float(d)) for a, b, c, d in zip(rng.normal(size=2000), rng.integers(0, 1000, 2000), rng.integers(0, 3, 2000), rng.normal(size=2000))], "a double, b int, c string, d double")
    assert 0.2 < one(L.ml_utility(df, "c", trees=5))["accuracy"] < 0.45
    assert one(L.ml_utility(df, "d", trees=5))["r2"] == 0.0


@pytest.mark.parametrize("classify", [True, False])
def test_large_nodes_are_split_alike_by_spark(spark, classify):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=1500), rng.integers(0, 9, 1500), rng.normal(size=1500)
    label = np.floor(np.abs(a * 2 + b / 3)) if classify else a * 5 + b
    df = spark.createDataFrame([(i, float(l), *map(float, r)) for i, (l, r) in enumerate(zip(label, zip(a, b, c)))], "_row long, label double, f0 double, f1 double, f2 double")
    held_out = F.col("_row") % 5 == 0
    made = [sorted((l, round(p, 6)) for l, p in rows(T.forest_predictions(df.repartition(n), ["f0", "f1", "f2"], held_out, classify, 4, 12, 1, node_rows=size))) for n, size in ((3, 10_000), (5, 100), (2, 1))]
    assert made[0] == made[1] == made[2] and len(made[0]) == 300
    near = [l == p if classify else abs(l - p) < 2 for l, p in made[0]]
    assert sum(near) > 200


def test_best_cut_is_that_of_all_cuts():
    rng = np.random.default_rng(2)
    for classify in (True, False):
        at, b, w = rng.integers(0, 4, 300), rng.integers(0, 12, 300), rng.integers(1, 4, 300)
        at[:4] = range(4)
        y = rng.integers(0, 3, 300) if classify else rng.normal(size=300) * w
        best, cut, none = T.best_bins(at, b, y, w, classify)
        for node in range(4):
            def squares(on):
                on = on & (at == node)
                return (sum(w[on & (y == c)].sum() ** 2 for c in range(3)) if classify else y[on].sum() ** 2) / w[on].sum()

            cuts = {k: squares(b <= k) + squares(b > k) for k in range(b[at == node].min(), b[at == node].max())}
            assert best[node] == pytest.approx(max(cuts.values())) == cuts[cut[node]] and none[node] == pytest.approx(squares(b >= 0))


def test_bootstrap_of_equal_rows():
    keys = np.arange(20_000)
    for n in (1, 3, 200):
        w = T.repeats(np.full(len(keys), n), 4, 1, keys)
        assert abs(w.mean() - n) < 0.05 * n and abs(w.var() - n) < 0.1 * n


def test_bounds_of_many_equal_rows(spark, monkeypatch):
    """One draw for all copies of a row left most tables of few different rows without a bound, so without a split."""
    monkeypatch.setattr(T, "BOUND_ROWS", 60)
    a = F.col("id") % 40
    df = spark.range(40_000).select(a.cast("double").alias("a"), F.when(a < 20, "x").otherwise("y").alias("c"))
    assert one(L.ml_utility(df, "c", trees=5))["accuracy"] > 0.8
    hot = spark.range(3000).select(F.greatest(F.col("id"), F.lit(2000)).alias("_row")).withColumn("f", F.col("_row").cast("double"))
    fetched = []
    frame = type(hot)
    read = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda df: fetched.append(read(df)) or fetched[-1])
    # 2001 of 3000 rows are one
    (bounds,) = T._bounds(hot, ["f"], 3000)
    assert len(fetched[0]) < 60 and fetched[0].set_index("f")["_drawn"][2000.0] in (40, 41)
    assert len(bounds) == len(fetched[0]) - 1 and min(bounds) > 2000
