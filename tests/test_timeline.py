"""Order-dependent operators, range joins, differences and mergeable states on small tables: ties, missing cells, hot keys."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from plumbline.operators import differences as D
from plumbline.operators import intervals as I
from plumbline.operators import ordered as O
from plumbline.operators import states as M
from plumbline.operators import usage as U
from plumbline.registry.timeline import MEANS
from plumbline.session import fresh_path
from plumbline.streaming import streams as S


# --- range join ----------------------------------------------------------------------------

def spans_and_points(seed):
    rng = random.Random(seed)
    points = [(i, rng.choice("ab"), rng.randrange(-500, 1500)) for i in range(300)] + [(900, "a", None), (901, None, 5), (5, "a", 10), (5, "a", 10)]
    spans = [(i, rng.choice("ab"), b, b + rng.choice([0, 1, 3, 10, 40, 1000, 100_000])) for i, b in enumerate(rng.randrange(-600, 1500) for _ in range(80))]
    return points, [*spans, (200, "a", 5, None), (201, "a", None, 5), (202, None, 0, 9), (203, "b", 9, 0), (80, "a", 3, 30), (80, "a", 3, 30)]


@pytest.mark.parametrize(("keys", "closed", "hot"), [([], False, 10**6), (["k"], True, 10**6), (["k"], False, 5), ([], True, 20)])
def test_range_join(spark, keys, closed, hot):
    points, spans = spans_and_points(1)
    found = I.range_join(spark.createDataFrame(points, "id int, k string, x long"), spark.createDataFrame(spans, "id int, k string, b long, e long"), "x", "b", "e", keys, closed, hot)
    inside = lambda x, b, e: None not in (x, b, e) and (b <= x <= e if closed else b <= x < e)
    want = [(i, j) for i, k, x in points for j, k2, b, e in spans if inside(x, b, e) and (not keys or (k == k2 and k))]
    assert sorted((r["id"], r["interval"]["id"]) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_range_join_of_one_bin(spark):
    """All points in one place: the bin is cut into slices."""
    points = spark.range(3000).select("id", F.lit(7.5).alias("x"))
    spans = spark.createDataFrame([(0, 7.0, 8.0), (1, 7.5, 7.6), (2, 0.0, 7.5), (3, 7.4, 7.5)], "id int, b double, e double")
    found = I.range_join(points, spans, "x", "b", "e", hot=100)
    assert rows(found.groupBy("interval.id").count().orderBy("id")) == [(0, 3000), (1, 3000)]
    assert I.range_join(points.limit(0), spans, "x", "b", "e").count() == 0 == I.range_join(points, spans.limit(0), "x", "b", "e").count()


@pytest.mark.parametrize(("keys", "closed"), [([], True), (["k"], False)])
def test_range_join_in_parts_and_slices(spark, keys, closed):
    """Numbers go on over the parts of an order, a run that many intervals reach is copied; points and bounds meet at equal times."""
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), rng.randrange(30) / 2) for i in range(400)] + [(900, "a", float("nan")), (901, "b", float("inf"))]
    spans = [(i, rng.choice("ab"), b / 2, (b + rng.randrange(9)) / 2) for i, b in enumerate(rng.randrange(30) for _ in range(120))] + [(200, "b", 3.0, float("inf"))]
    tables = spark.createDataFrame(points, "id int, k string, x double"), spark.createDataFrame(spans, "id int, k string, b double, e double")
    found = I.range_join(*tables, "x", "b", "e", keys, closed, hot=7, part_rows=50, hot_intervals=4)
    want = [(i, j) for i, k, x in points for j, l, b, e in spans if (b <= x <= e if closed else b <= x < e) and (not keys or k == l)]
    assert sorted((r["id"], r["interval"]["id"]) for r in found.collect()) == sorted(want)


def test_range_join_compares_no_pairs(spark):
    """Intervals met all points of their bins, two to eight times those they hold, and bins of up to a million points: each pair was compared."""
    points = spark.range(20_000).select("id", F.col("id").alias("x"))
    spans = spark.range(200).select("id", (F.col("id") * 97).alias("b"), (F.col("id") * 97 + 700).alias("e"))
    found = I.range_join(points, spans, "x", "b", "e")
    assert found.count() == sum(min(700, 20_000 - 97 * i) for i in range(200))
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and all("<=" not in line and " < " not in line for line in joins) and "BroadcastHashJoin" not in plan, plan


@pytest.mark.parametrize(("keys", "closed"), [([], True), (["k"], False)])
def test_range_join_by_tiles(spark, monkeypatch, keys, closed):
    """Runs of several blocks, met by several chunks, and copied because of their pairs."""
    for name, value in (("BLOCK", 3), ("CHUNK", 2), ("HOT_PAIRS", 40)):
        monkeypatch.setattr(I, name, value)
    points, spans = spans_and_points(2)
    found = I.range_join(spark.createDataFrame(points, "id int, k string, x long"), spark.createDataFrame(spans, "id int, k string, b long, e long"), "x", "b", "e", keys, closed)
    inside = lambda x, b, e: None not in (x, b, e) and (b <= x <= e if closed else b <= x < e)
    want = [(i, j) for i, k, x in points for j, k2, b, e in spans if inside(x, b, e) and (not keys or (k == k2 and k))]
    assert sorted((r["id"], r["interval"]["id"]) for r in found.collect()) == sorted(want)


def test_range_join_of_dense_points_takes_little_disk(spark, tmp_path):
    """Pairs came in an order that column files keep badly: 1.10 bytes each, now 0.28."""
    points = spark.range(60_000).select(F.xxhash64("id").alias("id"), F.col("id").alias("x"))
    spans = spark.range(150).select(F.xxhash64("id").alias("id"), (F.col("id") * 131).alias("b"), (F.col("id") * 131 + 40_000 + F.col("id") * 7 % 31).alias("e"))
    found = I.range_join(points, spans, "x", "b", "e").select(F.col("interval.id").alias("span"), "id")
    found.write.parquet(str(tmp_path / "pairs"))
    n = sum(40_000 + i * 7 % 31 for i in range(150))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.5 * n, size / n


# --- as-of join ----------------------------------------------------------------------------

@pytest.mark.parametrize(("strict", "within", "part_rows", "n_keys"), [(False, None, 1000, 3), (True, None, 20, 3), (False, 15, 7, 1), (True, 15, 7, 1)])
def test_asof_join(spark, strict, within, part_rows, n_keys):
    rng = random.Random(2)
    left = [(i, rng.randrange(n_keys), rng.randrange(200)) for i in range(150)] + [(900, None, 5), (901, 0, None), (3, 0, 50), (3, 0, 50)]
    right = [(i, k, t) for i, (k, t) in enumerate({(rng.randrange(n_keys), rng.randrange(20, 200)) for _ in range(60)})] + [(900, None, 1), (901, 0, None)]
    found = O.asof_join(spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame(right, "id int, k int, u long"), ["k"], "t", "u", strict, within, part_rows)
    want = []
    for i, k, t in left:
        known = [(u, j) for j, k2, u in right if None not in (k, t, u) and k == k2 and (u < t if strict else u <= t) and (within is None or t - u <= within)]
        want.append((i, max(known)[1] if known else -1))
    assert sorted((r["id"], r["last"]["id"] if r["last"] else -1) for r in found.collect()) == sorted(want)


def test_asof_join_of_times_and_ties(spark):
    at = datetime(2024, 3, 31, 1, 59)
    left = spark.createDataFrame([(1, at + timedelta(minutes=5)), (2, at)], "id int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at), (2, at), (3, at + timedelta(minutes=4))], "v int, t timestamp_ntz")
    first, second = O.asof_join(left, right, [], "t").orderBy("id").collect()
    assert first["last"]["v"] == 3 and second["last"]["v"] in (1, 2)
    assert [r["last"] for r in O.asof_join(left, right.limit(0), [], "t").collect()] == [None, None] and O.asof_join(left.limit(0), right, [], "t").count() == 0


# --- sessions, sliding totals, frames ------------------------------------------------------

def timed(seed, n, keys):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), rng.randrange(-300, 3000), rng.randrange(10)) for i in range(n)] + [(n, keys[0], None, 1), (n + 1, None, 4, 1), (n + 2, None, 5, None)]


@pytest.mark.parametrize("part_rows", [10_000, 9])
def test_sessions(spark, part_rows):
    data = timed(3, 200, ["a", "b", "b", "b", "b", "b"])
    found = O.sessions(spark.createDataFrame(data, "id int, k string, t long, v int"), ["k"], "t", 20, {"total": F.col("v")}, part_rows)
    want = []
    for k in ("a", "b", None):
        run = []
        for t, v in sorted((t, v or 0) for _, k2, t, v in data if k2 == k and t is not None):
            if run and t - run[-1][0] >= 20:
                want.append((k, run[0][0], run[-1][0], len(run), sum(x for _, x in run)))
                run = []
            run.append((t, v))
        want.append((k, run[0][0], run[-1][0], len(run), sum(x for _, x in run)))
    key = lambda r: (r[0] or "", r[1])
    assert sorted(rows(found), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("part_rows", [10_000, 9])
def test_sliding_totals(spark, part_rows):
    data = timed(4, 200, ["a", "b", "b", "b"])
    found = O.sliding_totals(spark.createDataFrame(data, "id int, k string, t long, v int"), ["k"], "t", 25, 4, part_rows=part_rows)
    panes = {}
    for _, k, t, _ in data:
        if t is not None:
            panes[k, t // 25] = panes.get((k, t // 25), 0) + 1
    want = {(k, p, n, sum(panes.get((k, q), 0) for q in range(p - 3, p + 1))) for (k, p), n in panes.items()}
    assert set(rows(found)) == want and found.count() == len(want)
    assert "_from" not in found.columns


@pytest.mark.parametrize("part_rows", [10_000, 9])
def test_time_frames(spark, part_rows):
    data = timed(5, 150, ["a", "b", "b", "b"]) + [(1000 + i, "b", 777, i) for i in range(100)]
    found = O.time_frames(spark.createDataFrame(data, "id int, k string, t long, v int"), ["k"], "t", 60, {"n": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "m": ("avg", "v")}, part_rows)
    want = {}
    for i, k, t, _ in data:
        near = [v for _, k2, u, v in data if k2 == k and None not in (t, u, v) and t - 60 <= u <= t]
        want[i] = (len(near) if t is not None else None, sum(near) if near else None, min(near, default=None), pytest.approx(sum(near) / len(near)) if near else None)
    got = {r["id"]: (r["n"], r["s"], r["low"], r["m"]) for r in found.collect()}
    assert got == want
    assert found.columns == ["id", "k", "t", "v", "n", "s", "low", "m"]


def test_orders_of_empty_tables(spark):
    none = spark.createDataFrame([], "id int, k string, t long, v int")
    assert O.sessions(none, ["k"], "t", 5).count() == 0 and O.sliding_totals(none, ["k"], "t", 5, 3).count() == 0 and O.time_frames(none, ["k"], "t", 5, {"n": ("count", "v")}).count() == 0


def test_one_key_is_many_parts(spark):
    """A key that has all rows is dealt over ranges of about the wanted size."""
    at = O.ranged(spark.range(10_000).select(F.lit("k").alias("k"), F.col("id").alias("t")), ["k"], [F.col("t")], 1000)
    sizes = [r["count"] for r in at.rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3000
    assert one(at.total(F.lit(1), "n").rows.agg(F.sum((F.col("n") == F.col("t") + 1).cast("int")).alias("ok")))["ok"] == 10_000


# --- differences ---------------------------------------------------------------------------

def test_row_difference(spark):
    kind = "a int, b string, x double"
    left = [(1, "x", 1.0), (1, "x", 1.0), (1, "x", 1.0), (2, None, 2.0), (None, "2", 2.0), (3, "y", None), (4, "same", float("nan")), (5, "", 0.0)]
    right = [(1, "x", 1.0), (2, None, 2.0), (2, None, 2.0), (3, "y", 3.0), (4, "same", float("nan")), (5, None, 0.0)]
    l, r = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    found = D.row_difference(l, r.select("x", "b", "a"))
    assert set(rows(found)) == {(1, "x", 1.0, "left", 2), (None, "2", 2.0, "left", 1), (3, "y", None, "left", 1), (5, "", 0.0, "left", 1), (2, None, 2.0, "right", 1), (3, "y", 3.0, "right", 1), (5, None, 0.0, "right", 1)}
    expanded = found.filter("side = 'left'").select("a", "b", "x", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).count()
    assert expanded == l.exceptAll(r).count() and D.row_difference(l, l).count() == 0 and D.row_difference(l.limit(0), r.limit(0)).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        D.row_difference(l, r.drop("x"))


def test_cell_difference(spark):
    l = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4), (None, "n", 1)], "k int, s string, left int")
    r = spark.createDataFrame([(1, "a", 1), (2, "c", 2), (3, "x", 30), (5, "e", 5), (None, "n", 2)], "k int, s string, left int")
    assert set(rows(D.cell_difference(l, r, ["k"]))) == {(2, "cell", "s", "b", "c"), (3, "cell", "s", None, "x"), (3, "cell", "left", "3", "30"), (4, "removed", None, None, None), (5, "added", None, None, None), (None, "cell", "left", "1", "2")}


# --- states --------------------------------------------------------------------------------

def test_profile_sets(spark):
    rng = np.random.default_rng(1)
    data = [(rng.choice(["a", "b", None]), int(rng.integers(3)), float(x) if i % 7 else None, None) for i, x in enumerate(rng.normal(1e9, 1, 600))]
    df = spark.createDataFrame([(None if g is None else str(g), h, x, n) for g, h, x, n in data], "g string, h int, x double, nothing double")
    got = {(r["level"], r["g"], r["h"], r["column"]): r for r in M.profile_sets(df, ["g", "h"], ["x", "nothing"]).collect()}
    assert {k[0] for k in got} == {0, 1, 2, 3} and len(got) == 2 * (9 + 3 + 3 + 1)
    for (level, g, h, column), r in got.items():
        some = [x for g2, h2, x, _ in data if (level >= 2 or (None if g2 is None else str(g2)) == g) and (level % 2 or h2 == h)]
        filled = [x for x in some if x is not None] if column == "x" else []
        assert (r["rows"], r["filled"]) == (len(some), len(filled))
        if filled:
            assert r["mean"] == pytest.approx(np.mean(filled), rel=1e-12) and r["std"] == pytest.approx(np.std(filled, ddof=1), rel=1e-6) and (r["low"], r["high"]) == (min(filled), max(filled))
            assert r["distinct"] == pytest.approx(len(set(filled)), rel=0.05)
        else:
            assert r["mean"] is None and r["std"] is None and r["distinct"] == 0


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_sketches_are_within_their_bounds(spark, n):
    df = spark.range(n).select((F.col("id") % 10).alias("day"), (F.col("id") % 2).alias("side"), (F.pmod(F.xxhash64("id"), F.lit(n)) * F.when(F.col("id") % 2 == 1, 1.2).otherwise(1.0)).alias("x"))
    stored = M.sketches(df, ["day", "side"], ["x"])
    whole = M.merged(stored, [])
    values = np.sort([r[0] for r in df.select("x").collect()])
    for r in M.sketched_quantiles(whole, [0.01, 0.3, 0.5, 0.99]).collect():
        low, high = np.searchsorted(values, r["value"], "left") / n, np.searchsorted(values, r["value"], "right") / n
        assert low - M.RANK_ERROR <= r["share"] <= high + M.RANK_ERROR and r["n"] == n
        assert r["distinct"] == pytest.approx(len(set(values.tolist())), rel=0.05)
    sides = [M.merged(stored.filter(F.col("side") == i), []) for i in (0, 1)]
    found = one(M.sketched_ks(*sides))
    a, b = (np.sort([r[0] for r in df.filter(F.col("side") == i).select("x").collect()]) for i in (0, 1))
    exact = max(abs(np.searchsorted(a, values, "right") / len(a) - np.searchsorted(b, values, "right") / len(b)))
    assert abs(found["statistic"] - exact) <= found["bound"] and found["bound"] < 0.02
    assert M.sketched_ks(sides[0], sides[1].limit(0)).count() == 0


def test_sketches_of_gaps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), (None, 2.0)], "k string, x double")
    stored = M.sketches(df, ["k"], ["x"])
    assert {(r["k"], r["n"]) for r in stored.collect()} == {("a", 1), ("b", 0), (None, 1)}
    assert {(r["k"], r["value"]) for r in M.sketched_quantiles(stored, [0.5]).collect()} == {("a", 1.0), (None, 2.0)}


@pytest.mark.parametrize(("most", "fan"), [(50_000, 64), (1, 3)])
def test_aggregated(spark, most, fan):
    """A key with most rows, missing keys and cells, and states that are given out early."""
    df = spark.range(4000).repartition(7).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).when(F.col("id") % 501 != 0, F.lit(99)).alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 13).cast("double")).alias("x"))
    got = {r["k"]: r for r in M.aggregated(df, ["k"], ["x"], MEANS, most, fan).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.count_if(F.col("x") > 0).alias("n"), F.exp(F.avg(F.when(F.col("x") > 0, F.ln("x")))).alias("g")).collect()}
    assert set(got) == set(want) and all(got[k]["values"] == want[k]["n"] and got[k]["geometric"] == pytest.approx(want[k]["g"]) for k in want)
    assert one(M.aggregated(df, [], ["x"], MEANS, most, fan))["values"] == sum(r["n"] for r in want.values())
    assert M.aggregated(df.limit(0), ["k"], ["x"], MEANS).count() == 0


# --- token buckets -------------------------------------------------------------------------

def bucket_by_hand(events, capacity, rate):
    out, state = {}, {}
    for client, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        tokens, at = state.get(client, (capacity, t))
        tokens = min(capacity, tokens + (t - at) * rate / 1e6)
        out[i] = tokens >= 1
        state[client] = (tokens - out[i], t)
    return out


def requests(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b"]), rng.randrange(60_000_000), i) for i in range(n)]


def test_token_bucket(spark):
    events = requests(6, 300)
    df = spark.createDataFrame(events, "client string, t long, id long")
    got = {r["id"]: r["allowed"] for r in U.token_bucket(df, "client", "t", "id", 5, 2.0).collect()}
    assert got == bucket_by_hand(events, 5, 2.0) and 50 < sum(got.values()) < 250
    odd = spark.createDataFrame([(None, 1, 1), (None, None, 2), ("a", 1, 3)], "client string, t long, id long")
    assert {r["id"]: r["allowed"] for r in U.token_bucket(odd, "client", "t", "id", 1, 1.0).collect()} == {1: True, 2: False, 3: True}


def test_token_bucket_stream(spark, tmp_path):
    """Several batches: a client's bucket goes on from batch to batch, late events are dropped, an idle client's state is forgotten."""
    at = datetime(2024, 1, 1)
    kind = "client string, ts timestamp_ntz, id long"
    first = [(c, at + timedelta(microseconds=t), i) for c, t, i in requests(7, 200)]
    second = [("a", at + timedelta(seconds=60 + i), 1000 + i) for i in range(5)] + [("c", at + timedelta(minutes=30), 2000)]
    third = [("a", at + timedelta(seconds=1), 3000), ("a", at + timedelta(minutes=31), 3001), ("b", at + timedelta(minutes=32), 3002)]
    path = str(tmp_path / "in")
    for i, part in enumerate((first, second, third)):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kind).parquet(path)
        S.run_to_table(S.token_bucket_stream(stream, "client", "ts", "id", 5, 2.0, "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = bucket_by_hand([(c, (t - at) // timedelta(microseconds=1), i) for c, t, i in [*first, *second, *third[1:]]], 5, 2.0)
    assert 3000 not in got and got == want
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "bucket").load()
    assert {r["key"]["client"] for r in state.collect()} <= {"a", "b", "c"}


def test_session_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    times = [("a", 0), ("a", 5), ("b", 7), ("a", 30), ("a", 200), (None, 3)]
    spark.createDataFrame([(k, at + timedelta(seconds=t)) for k, t in times], "k string, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    S.run_to_table(S.session_stream(stream, ["k"], "ts", "10 seconds", "20 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["k"], (r["begin"] - at).seconds, r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, 2), ("b", 7, 1), ("a", 30, 1), (None, 3, 1)}


def test_time_frames_of_dense_rows(spark):
    """Frames of thousands of instants each: every row costs the same."""
    n = 60_000
    df = spark.range(n).select("id", F.col("id").alias("t"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    began = time.time()
    found = O.time_frames(df, [], "t", 20_000, {"n": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "m": ("avg", "v")}, 1000).toPandas().sort_values("id")
    seconds = time.time() - began
    v = df.toPandas().sort_values("id")["v"]
    near = v.rolling(20_001, min_periods=1)
    for name, want in (("n", near.count()), ("s", near.sum()), ("low", near.min()), ("high", near.max()), ("m", near.mean())):
        assert np.allclose(found[name].to_numpy(float), want.to_numpy(float))
    assert seconds < 60  # with sliding frames the test did not end in 110 s


def test_time_frames_of_no_width(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 2), (3, 5.5, 4), (4, None, 8), (5, 5.5, None)], "id int, t double, v int")
    got = {r["id"]: (r["n"], r["s"], r["m"]) for r in O.time_frames(df, [], "t", 0, {"n": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v")}).collect()}
    assert got == {1: (2, 3, 1.5), 2: (2, 3, 1.5), 3: (1, 4, 4.0), 5: (1, 4, 4.0), 4: (None, None, None)}
