"""Queries of the order-dependent operators, the range joins and the differences of tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import differences as D
from plumbline.operators import intervals as I
from plumbline.operators import ordered as O
from plumbline.operators import states as M
from plumbline.operators.usage import token_bucket
from plumbline.registry.base import load, rounded, text_time, union
from plumbline.session import fresh_path, written
from plumbline.streaming import streams as S

SECOND = 1_000_000
HOUR = 3600 * SECOND


def validity(s, d, unit: str):
    """A key for each purchase, valid for as many units as its value."""
    n = F.floor("value").cast("int")
    for_long = F.make_dt_interval(n if unit == "DAY" else F.lit(0), F.lit(0), n if unit == "MINUTE" else F.lit(0), F.lit(0))
    bought = load(s, d, "events").filter("event_type = 'purchase'")
    return bought.select(F.col("event_id").alias("key_id"), "user_id", F.col("ts").alias("valid_from"), (F.col("ts") + for_long).alias("valid_to"))


def valid_requests(s, d):
    pairs = I.range_join(load(s, d, "events").select("event_id", "ts"), validity(s, d, "MINUTE"), "ts", "valid_from", "valid_to")
    return pairs.select("interval.key_id", "event_id")


def valid_requests_by_user(s, d):
    pairs = I.range_join(load(s, d, "events"), validity(s, d, "DAY"), "ts", "valid_from", "valid_to", ["user_id"], hot=50)
    return pairs.groupBy("interval.key_id").agg(F.count("*").alias("requests"), F.max("event_id").alias("newest"))


def last_views(s, d):
    e = load(s, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("price"))
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return O.asof_join(bought, views, ["user_id"], "ts").select("event_id", "last.view_id", "last.price")


def dated_prices(s, d):
    """Orders with the dearest line shipped on the latest day up to their own; all rows are of one key."""
    days = load(s, d, "lineitem").groupBy("l_shipdate").agg(F.max("l_extendedprice").alias("price"))
    found = O.asof_join(load(s, d, "orders"), days, [], "o_orderdate", "l_shipdate", part_rows=5000)
    return found.select("o_orderkey", F.col("last.l_shipdate").cast("string").alias("shipped"), "last.price")


def session_rows(s, d, keys, gap, part_rows):
    found = O.sessions(load(s, d, "events"), keys, "ts", gap, {"cents": F.round(F.col("value") * 100).cast("long")}, part_rows)
    return found.withColumn("begin", text_time(F.col("begin"))).withColumn("end", text_time(F.col("end")))


def sessions_streamed(s, d):
    events = load(s, d, "events")
    path = fresh_path(s, "sessions")
    S.run_to_table(S.session_stream(S.table_stream(s, d, "events", events.schema), ["user_id"], "ts", "6 hours", "1 hour"), f"{path}/rows", f"{path}/checkpoint")
    return s.read.parquet(f"{path}/rows").select("user_id", text_time(F.col("begin")).alias("begin"), "events")


def frames(s, d, keys, width, part_rows):
    found = O.time_frames(load(s, d, "events"), keys, "ts", width, {"n": ("count", "value"), "total": ("sum", "value"), "highest": ("max", "value"), "mean": ("avg", "value")}, part_rows)
    return rounded(found.select("event_id", "n", "total", "highest", "mean"))


def edited_orders(s, d):
    """Orders with some prices raised, some rows left out, and some twice."""
    o = load(s, d, "orders")
    k = F.col("o_orderkey")
    kept = o.filter(k % 97 != 0).withColumn("o_totalprice", F.when(k % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.withColumn("o_orderpriority", F.when(k % 31 != 0, F.col("o_orderpriority")))


def differing_rows(s, d):
    o, e = load(s, d, "orders"), edited_orders(s, d)
    found = D.row_difference(o, e.unionByName(e.filter("o_orderkey % 101 = 0")))
    return found.select("o_orderkey", "o_totalprice", "o_orderpriority", "side", F.col("times").cast("long").alias("times"))


def buckets(s, d):
    return token_bucket(load(s, d, "events"), "event_type", "ts", "event_id", capacity=3, per_second=1 / 1800).select("event_id", "allowed")


def buckets_streamed(s, d):
    events = load(s, d, "events")
    path = fresh_path(s, "buckets")
    S.run_to_table(S.token_bucket_stream(S.table_stream(s, d, "events", events.schema), "event_type", "ts", "event_id", 3, 1 / 1800), f"{path}/rows", f"{path}/checkpoint")
    return s.read.parquet(f"{path}/rows").select("event_id", "allowed")


def summed(state: bytes) -> np.ndarray:
    return np.frombuffer(state, np.float64)


# Geometric and harmonic means of the positive values.
MEANS = M.Aggregate(
    init=lambda: np.zeros(3).tobytes(),
    update=lambda state, rows: (summed(state) + _means_of(rows.column(0))).tobytes(),
    merge=lambda a, b: (summed(a) + summed(b)).tobytes(),
    finish=lambda state: dict(zip(("values", "geometric", "harmonic"), _finished(*summed(state)), strict=True)),
    result="values long, geometric double, harmonic double",
)


def _means_of(column) -> np.ndarray:
    x = column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x[x > 0]
    return np.array([len(x), np.log(x).sum(), (1 / x).sum()])


def _finished(n, logs, inverses):
    return (int(n), float(np.exp(logs / n)), float(n / inverses)) if n else (0, None, None)


def means(s, d):
    of_types = M.aggregated(load(s, d, "events"), ["event_type"], ["value"], MEANS)
    return rounded(of_types.unionByName(M.aggregated(load(s, d, "events"), [], ["value"], MEANS).withColumn("event_type", F.lit(None).cast("string"))))


def flag_profile(s, d):
    lines = load(s, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return rounded(M.profile_sets(lines, ["l_returnflag", "l_linestatus", "year"], ["l_quantity", "l_extendedprice", "l_discount"], distinct=False))


def profile_rolled_up(s, d):
    o = edited_orders(s, d)
    return rounded(M.profile_sets(o, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], distinct=False))


def daily_sketches(s, d):
    """Sketches by day, stored, merged to event types; how far quantiles and distinct counts are from the exact ones, as a verdict."""
    e = load(s, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    path = fresh_path(s, "sketches")
    M.sketches(e, ["day", "event_type"], ["value"]).write.parquet(path)
    told = M.sketched_quantiles(M.merged(s.read.parquet(path), ["event_type"]), [0.05, 0.25, 0.5, 0.75, 0.95])
    told = written(told.withColumnRenamed("event_type", "of"), "quantiles")
    values = e.select("event_type", F.col("value").alias("x")).join(told, F.col("event_type") == F.col("of"))
    ranks = values.groupBy("event_type", "share").agg(
        F.avg((F.col("x") <= F.col("value")).cast("int")).alias("upto"), F.avg((F.col("x") < F.col("value")).cast("int")).alias("below"),
        F.count_distinct("x").alias("exact"), F.max("distinct").alias("distinct"),
    )
    good = (F.col("below") <= F.col("share") + M.RANK_ERROR) & (F.col("upto") >= F.col("share") - M.RANK_ERROR)
    return ranks.select("event_type", "share", good.alias("rank_within"), (F.abs(F.col("distinct") / F.col("exact") - 1) < 0.05).alias("distinct_within"))


def sketched_distance(s, d):
    """KS statistics of event values between even and odd users from stored sketches, beside the exact ones."""
    e = load(s, d, "events")
    sides = [M.merged(M.sketches(e.filter(F.col("user_id") % 2 == i), ["event_type", "user_id"], ["value"]), ["event_type"]) for i in (0, 1)]
    return M.sketched_ks(*sides).select("event_type", "statistic", "bound")


def near_exact_distance(s, d):
    e = load(s, d, "events")
    told = sketched_distance(s, d).withColumnRenamed("event_type", "of")
    n = e.groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("n0"), F.count_if(F.col("user_id") % 2 == 1).alias("n1"))
    steps = e.groupBy("event_type", "value").agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    upto = O.ranged(steps, ["event_type"], [F.col("value")]).total(F.col("a"), "sa").total(F.col("b"), "sb").rows
    exact = upto.join(n, "event_type").groupBy("event_type").agg(F.max(F.abs(F.col("sa") / F.col("n0") - F.col("sb") / F.col("n1"))).alias("exact"))
    return exact.join(told, F.col("event_type") == F.col("of")).select("event_type", F.round("exact", 9).alias("exact"), (F.abs(F.col("statistic") - F.col("exact")) <= F.col("bound")).alias("within"))


QUERIES = {
    "range_join": valid_requests,
    "range_join_by_key": valid_requests_by_user,
    "asof_join": last_views,
    "asof_join_one_key": dated_prices,
    "session_windows": lambda s, d: session_rows(s, d, ["user_id"], 6 * HOUR, 2000),
    "session_windows_one_key": lambda s, d: session_rows(s, d, [], 600 * SECOND, 2000),
    "session_stream": sessions_streamed,
    "sliding_totals": lambda s, d: O.sliding_totals(load(s, d, "events"), ["event_type"], "ts", 600 * SECOND, 36, part_rows=2000),
    "time_frames": lambda s, d: frames(s, d, ["user_id"], 24 * HOUR, 100_000),
    "time_frames_one_key": lambda s, d: frames(s, d, [], HOUR, 1000),
    "row_difference": differing_rows,
    "cell_difference": lambda s, d: D.cell_difference(load(s, d, "orders").drop("o_orderdate"), edited_orders(s, d).drop("o_orderdate"), ["o_orderkey"]),
    "profile_cube": flag_profile,
    "profile_rollup": profile_rolled_up,
    "sketched_quantiles": daily_sketches,
    "sketched_ks": near_exact_distance,
    "caller_aggregate": means,
    "token_bucket": buckets,
    "token_bucket_stream": buckets_streamed,
}


def _sessions_sql(key: str, gap: str, columns: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    first = f"{key}, " if key else ""
    return f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({part} ORDER BY ts) < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER ({part} ORDER BY ts, event_id) AS island FROM g)
SELECT {first}{columns} FROM i GROUP BY {first}island"""


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_SESSION = f"{_TIME.format('min(ts)')} AS \"begin\", {_TIME.format('max(ts)')} AS \"end\", count(*) AS events, CAST(sum(round(value * 100)) AS BIGINT) AS cents"


def _frames_sql(part: str, width: str) -> str:
    over = f"OVER ({part} ORDER BY ts RANGE BETWEEN INTERVAL {width} PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, count(value) {over} AS n, round(sum(value) {over}, 6) + 0.0 AS total, round(max(value) {over}, 6) + 0.0 AS highest, round(avg(value) {over}, 6) + 0.0 AS mean FROM events"


def _profile_sql(source: str, dims: list[str], columns: list[str], sets: str) -> str:
    names = ", ".join(dims)
    return union([
        f"""SELECT CAST(GROUPING_ID({names}) AS INTEGER) AS level, {names}, '{c}' AS "column", count(*) AS rows, count({c}) AS filled, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std,
  round(min({c}), 6) + 0.0 AS low, round(max({c}), 6) + 0.0 AS high FROM {source} GROUP BY {sets}""" for c in columns])


_EDITED = """e AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0),
r AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE o_orderkey % 101 = 0),
l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"""
_times = lambda a, b, side: f"SELECT o_orderkey, o_totalprice, o_orderpriority, '{side}' AS side, count(*) AS times FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) GROUP BY ALL"
_cell = lambda c: f"SELECT l.o_orderkey, 'cell' AS change, '{c}' AS \"column\", CAST(l.{c} AS VARCHAR) AS \"left\", CAST(e.{c} AS VARCHAR) AS \"right\" FROM l JOIN e USING (o_orderkey) WHERE l.{c} IS DISTINCT FROM e.{c}"
# The bucket of each event type, event by event: refilled since the event before, at most full, and one token taken where there is one.
_BUCKET = """WITH RECURSIVE o AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT event_type, event_id, ts, k, 2.0::DOUBLE AS tokens, true AS allowed FROM o WHERE k = 1
  UNION ALL SELECT event_type, event_id, ts, k, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (
    SELECT o.event_type, o.event_id, o.ts, o.k, least(3.0::DOUBLE, b.tokens + (epoch_us(o.ts) - epoch_us(b.ts))::DOUBLE * ((1.0::DOUBLE / 1800) / 1000000)) AS t
    FROM b JOIN o ON o.event_type = b.event_type AND o.k = b.k + 1))
SELECT event_id, allowed FROM b"""

ORACLE = {
    "range_join": "SELECT k.event_id AS key_id, e.event_id FROM events e JOIN events k ON k.event_type = 'purchase' AND e.ts >= k.ts AND e.ts < k.ts + CAST(floor(k.value) AS INT) * INTERVAL 1 MINUTE",
    "range_join_by_key": """SELECT k.event_id AS key_id, count(*) AS requests, max(e.event_id) AS newest FROM events e JOIN events k
ON k.event_type = 'purchase' AND e.user_id = k.user_id AND e.ts >= k.ts AND e.ts < k.ts + CAST(floor(k.value) AS INT) * INTERVAL 1 DAY GROUP BY 1""",
    "asof_join": """SELECT p.event_id, v.event_id AS view_id, v.value AS price FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "asof_join_one_key": """SELECT o.o_orderkey, CAST(l.l_shipdate AS VARCHAR) AS shipped, l.price FROM orders o
ASOF LEFT JOIN (SELECT l_shipdate, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) l ON o.o_orderdate >= l.l_shipdate""",
    "session_windows": _sessions_sql("user_id", "6 HOUR", _SESSION),
    "session_windows_one_key": _sessions_sql("", "10 MINUTE", _SESSION),
    "session_stream": _sessions_sql("user_id", "6 HOUR", f"{_TIME.format('min(ts)')} AS \"begin\", count(*) AS events")
    + " HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)",
    "sliding_totals": """WITH p AS (SELECT event_type, epoch_us(ts) // 600000000 AS pane, count(*) AS total FROM events GROUP BY ALL)
SELECT event_type, pane, total, CAST(sum(total) OVER (PARTITION BY event_type ORDER BY pane RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM p""",
    "time_frames": _frames_sql("PARTITION BY user_id", "24 HOUR"),
    "time_frames_one_key": _frames_sql("", "1 HOUR"),
    "row_difference": f"WITH {_EDITED} " + union([_times("l", "r", "left"), _times("r", "l", "right")]),
    "cell_difference": f"WITH {_EDITED} " + union([*map(_cell, ("o_totalprice", "o_orderpriority")), "SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM l ANTI JOIN e USING (o_orderkey)"]),
    "profile_cube": _profile_sql("(SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)", ["l_returnflag", "l_linestatus", "year"], ["l_quantity", "l_extendedprice", "l_discount"], "CUBE (l_returnflag, l_linestatus, year)"),
    "profile_rollup": f"WITH {_EDITED} " + _profile_sql("e", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "ROLLUP (o_orderstatus, o_orderpriority)"),
    "sketched_quantiles": "SELECT event_type, share, true AS rank_within, true AS distinct_within FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share)",
    "sketched_ks": """WITH n AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS n0, count(*) FILTER (WHERE user_id % 2 = 1) AS n1 FROM events GROUP BY 1),
v AS (SELECT event_type, value, sum(count(*) FILTER (WHERE user_id % 2 = 0)) OVER w AS a, sum(count(*) FILTER (WHERE user_id % 2 = 1)) OVER w AS b FROM events GROUP BY 1, 2 WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, round(max(abs(a / n0 - b / n1)), 9) AS exact, true AS within FROM v JOIN n USING (event_type) GROUP BY 1""",
    "caller_aggregate": """SELECT event_type, count(*) AS values, round(exp(avg(ln(value))), 6) + 0.0 AS geometric, round(count(*) / sum(1 / value), 6) + 0.0 AS harmonic FROM events WHERE value > 0 GROUP BY event_type
UNION ALL SELECT NULL, count(*), round(exp(avg(ln(value))), 6) + 0.0, round(count(*) / sum(1 / value), 6) + 0.0 FROM events WHERE value > 0""",
    "token_bucket": _BUCKET,
    "token_bucket_stream": _BUCKET,
}
