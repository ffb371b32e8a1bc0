"""Comparison, privacy and learning queries.

Two-sided queries compare the open with the finished line items, or a table
generated over the order keys with the orders themselves (equal row numbers).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.operators import compare as C
from plumbline.operators import learn as L
from plumbline.operators import privacy as V
from plumbline.plans.generate import generate
from plumbline.plans.reports import benchmark_dataset, benchmark_report, benchmark_suite, comparison_summary, validation_report
from plumbline.plans.spec import ColumnSpec, DatasetSpec, Distribution
from plumbline.registry.base import LINE_NUMBERS, load, r6, rounded, union
from plumbline.registry.sqldraws import SqlDraws

LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]
WIDE = ["l_orderkey", "l_partkey", "l_suppkey", *LINE_NUMBERS]


def sides(s, d):
    df = load(s, d, "lineitem")
    return df.where("l_linestatus = 'O'"), df.where("l_linestatus = 'F'")


STATUS = Distribution(categories=["F", "O", "P"], weights=[0.48, 0.48, 0.04])
PRIORITY = Distribution(categories=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
SHOP = Distribution(categories=["web", "store"])


def order_spec(n: int) -> DatasetSpec:
    return DatasetSpec(
        columns=[
            ColumnSpec("o_totalprice", distribution=Distribution("uniform", min_value=1000.0, max_value=500000.0)),
            ColumnSpec("o_orderstatus", "categorical", STATUS),
            ColumnSpec("o_orderpriority", "categorical", PRIORITY),
            ColumnSpec("shop", "categorical", SHOP),
        ],
        num_rows=n,
        consistency_level=1.0,
        as_of=datetime(2024, 1, 1),
    )


def order_pair(s, d):
    """Generated orders and the orders, both with a shop column that differs in its categories."""
    orders = load(s, d, "orders")
    made = generate(s, order_spec(orders.count()), orders.select("o_orderkey"), "o_orderkey")
    real = orders.select("o_totalprice", "o_orderstatus", "o_orderpriority", F.lit("web").alias("shop"))
    return made, real


def _d(name):
    return SqlDraws(42, f"{name}/value", "o_orderkey")


def _cat(name, dist):
    cuts = dist.cumulative_weights()
    cats = dist.category_list()
    return f"list_transform([{_d(name).unit('x')}], lambda v: CASE " + " ".join(
        f"WHEN v < {c!r}::DOUBLE THEN '{k}'" for k, c in zip(cats[:-1], cuts[:-1])
    ) + f" ELSE '{cats[-1]}' END)[1]"


MADE = f"""made AS (SELECT least(greatest({_d('o_totalprice').uniform('x', 1000.0, 500000.0)}, 1000.0), 500000.0) AS o_totalprice, {_cat('o_orderstatus', STATUS)} AS o_orderstatus,
{_cat('o_orderpriority', PRIORITY)} AS o_orderpriority, {_cat('shop', SHOP)} AS shop FROM orders), ord AS (SELECT o_totalprice, o_orderstatus, o_orderpriority, 'web' AS shop FROM orders)"""


def segment_scores(s, d):
    """Scores per market segment, as shares measured on the customers."""
    c = load(s, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("dataset_name")).agg(
        F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 4).alias("completeness_score"),
        F.round(F.avg((F.col("c_acctbal") > 3000).cast("double")), 4).alias("consistency_score"),
        F.round(F.avg((F.col("c_nationkey") > 7).cast("double")), 4).alias("uniqueness_score"),
        F.round(F.avg((F.col("c_nationkey") > 2).cast("double")), 4).alias("validity_score"),
        F.round(F.avg((F.col("c_acctbal") < 8000).cast("double")), 4).alias("statistical_fidelity"),
        F.round(F.avg((F.col("c_nationkey") < 20).cast("double")), 4).alias("ml_utility_score"),
        F.count(F.lit(1)).alias("num_rows"),
    )


SCORES = """sc AS (SELECT c_mktsegment AS dataset_name, round(avg((c_acctbal > 0)::INT), 4) AS completeness_score, round(avg((c_acctbal > 3000)::INT), 4) AS consistency_score,
round(avg((c_nationkey > 7)::INT), 4) AS uniqueness_score, round(avg((c_nationkey > 2)::INT), 4) AS validity_score, round(avg((c_acctbal < 8000)::INT), 4) AS statistical_fidelity,
round(avg((c_nationkey < 20)::INT), 4) AS ml_utility_score, count(*) AS num_rows FROM customer GROUP BY 1),
ov AS (SELECT *, completeness_score * 0.2 + consistency_score * 0.15 + uniqueness_score * 0.15 + validity_score * 0.15 + statistical_fidelity * 0.15 + ml_utility_score * 0.2 AS overall_quality_score FROM sc)"""
SCORE_NAMES = ["completeness_score", "consistency_score", "uniqueness_score", "validity_score", "statistical_fidelity", "ml_utility_score", "overall_quality_score"]


def comparison(s, d):
    scored = C.overall_score(segment_scores(s, d)).withColumn("overall_quality", F.round("overall_quality_score", 1))
    return comparison_summary(scored.withColumn("position", -F.ascii("dataset_name")))


def one_score(s, d):
    """One metrics row for all customers, rounded so that its JSON text is short."""
    m = segment_scores(s, d).agg(*[F.round(F.min(c), 2).alias(c) for c in SCORE_NAMES[:-1]])
    return C.overall_score(m).withColumn("overall_quality_score", F.round("overall_quality_score", 3))


def risky(s, d):
    def part(status):
        return load(s, d, "lineitem").where(F.col("l_linestatus") == status).select(
            "l_quantity", "l_returnflag", "l_linenumber", "l_suppkey", F.when(F.col("l_tax") < 0.08, F.col("l_discount")).alias("l_discount")
        )

    return part("O"), part("F")


def order_groups(s, d):
    return load(s, d, "orders").select("o_orderstatus", "o_orderpriority", F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"), "o_custkey")


def customer_like(s, d):
    """A generated table with the customers' columns and size."""
    c = load(s, d, "customer")
    spec = DatasetSpec(
        columns=[
            ColumnSpec("c_acctbal", distribution=Distribution("uniform", min_value=-999.0, max_value=9999.0)),
            ColumnSpec("c_mktsegment", "categorical", Distribution(categories=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])),
            ColumnSpec("score", distribution=Distribution("normal", mean=5.0, std=2.0)),
        ],
        num_rows=c.count(), consistency_level=1.0,
    )
    made = generate(s, spec, c.select("c_custkey"), "c_custkey")
    real = c.select("c_acctbal", "c_mktsegment", (F.col("c_nationkey") / 3.0).alias("score"))
    return made, real


def benchmark(s, d):
    made, real = customer_like(s, d)
    return benchmark_dataset(made, real, "c_mktsegment")


def suite(s, d):
    made, real = customer_like(s, d)
    rows, summary = benchmark_suite({"made": made, "real": real}, real, {"real": "c_mktsegment"})
    return summary


def predicted_prices(s, d):
    return load(s, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))


def predicted_status(s, d):
    guess = F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 50000, "O").otherwise("X")
    return load(s, d, "orders").select(F.col("o_orderstatus").alias("label"), guess.alias("prediction"))


def split(s, d):
    train, test = L.train_test_split(load(s, d, "orders"), "o_orderkey")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(test.select("o_orderkey", F.lit("test").alias("part")))


def validated(s, d):
    events = load(s, d, "events").select("event_id", "user_id", "value", "event_type")
    schema = {"type": "object", "required": ["user_id", "value"], "properties": {"value": {"type": "number", "minimum": 5}, "event_type": {"enum": ["click", "view", "purchase", "signup"]}}}
    return rounded(validation_report(events, "event_id", schema))


SCORED_SCHEMA = {"type": "object", "required": ["user_id", "value"], "properties": {"value": {"type": "number", "minimum": 5}, "event_type": {"enum": ["click", "view", "purchase", "signup"]}}}


def validated_scores(s, d):
    """The report's parts that SQL can tell too: all but the forest and the normality test."""
    events = load(s, d, "events").select("event_id", "user_id", "value", "event_type", "props")
    return rounded(validation_report(events, "event_id", SCORED_SCHEMA, statistics=False, anomalies=False))


def distances(s, d):
    made, real = sides(s, d)
    return C.ecdf_distances(made, real, WIDE)


QUERIES = {
    "normality_test": lambda s, d: rounded(C.normality_test(load(s, d, "lineitem"), LINE_NUMBERS), 4),
    "uniformity_test": lambda s, d: rounded(C.uniformity_test(
        load(s, d, "lineitem").select((F.col("l_quantity") / 50.0).alias("q"), (F.col("l_extendedprice") / 100000.0).alias("p"), (F.col("l_tax") * 12.0).alias("t")), ["q", "p", "t"])),
    "correlation_check": lambda s, d: rounded(C.correlation_check(load(s, d, "lineitem"), {
        ("l_quantity", "l_extendedprice"): 0.9, ("l_discount", "l_tax"): 0.0, ("l_quantity", "l_tax"): 0.5, ("l_quantity", "absent"): 0.1})),
    "ks_two_sample": lambda s, d: rounded(distances(s, d).select("column", "ks_distance", "ks_similarity")),
    "wasserstein_distance": lambda s, d: rounded(distances(s, d).select("column", "wasserstein_distance", "reference_range", "wasserstein_similarity"), 5),
    "numeric_similarity": lambda s, d: rounded(distances(s, d).select("column", "similarity")),
    "chi_square_similarity": lambda s, d: rounded(
        C.chi_square_similarity(*order_pair(s, d), ["o_orderstatus", "o_orderpriority", "shop"]).withColumnRenamed("similarity", "plain").join(
            C.chi_square_similarity(*order_pair(s, d), ["o_orderstatus", "o_orderpriority", "shop"], rescale=True).select("column", F.col("similarity").alias("rescaled")), "column")),
    "distribution_similarity": lambda s, d: rounded(C.distribution_similarity(*order_pair(s, d))),
    "correlation_preservation": lambda s, d: rounded(C.correlation_preservation(*sides(s, d))),
    "statistical_fidelity": lambda s, d: rounded(C.statistical_fidelity(*sides(s, d))),
    "overall_score": lambda s, d: rounded(C.overall_score(segment_scores(s, d))),
    "recommendations": lambda s, d: rounded(C.recommendations(C.overall_score(segment_scores(s, d)), ["dataset_name"])),
    "benchmark_dataset": lambda s, d: rounded(benchmark(s, d)),
    "benchmark_suite": lambda s, d: rounded(suite(s, d)),
    "comparison_summary": lambda s, d: rounded(comparison(s, d)),
    "validation_report": validated,
    "validation_report_scores": validated_scores,
    "benchmark_report": lambda s, d: benchmark_report(one_score(s, d), load(s, d, "customer"), load(s, d, "supplier")),
    "disclosure_risk": lambda s, d: rounded(V.disclosure_risk(*risky(s, d))),
    "k_anonymity": lambda s, d: V.k_anonymity(order_groups(s, d), ["o_orderstatus", "o_orderpriority", "month"], 5),
    "l_diversity": lambda s, d: V.l_diversity(order_groups(s, d), ["o_orderstatus", "o_orderpriority"], "month", 60),
    "train_test_split": split,
    "regression_metrics": lambda s, d: rounded(L.regression_metrics(predicted_prices(s, d)), 3),
    "classification_metrics": lambda s, d: rounded(L.classification_metrics(predicted_status(s, d))),
    "ml_utility": lambda s, d: rounded(L.ml_utility(load(s, d, "customer"), "c_mktsegment")),
    "ml_utility_regression": lambda s, d: rounded(L.ml_utility(load(s, d, "part"), "p_retailprice")),
    "isolation_forest": lambda s, d: rounded(L.detect_anomalies(load(s, d, "events").select("event_id", "user_id", "value"), "event_id")),
}


def _ecdf(columns: list[str], left: str, right: str) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS col, max(gap) AS ks, coalesce(sum(gap * (nxt - v)), 0) AS w, max(CASE WHEN r > 0 THEN v END) - min(CASE WHEN r > 0 THEN v END) AS rng FROM (
 SELECT v, r, abs(sum(s) OVER o / sum(s) OVER () - sum(r) OVER o / sum(r) OVER ()) AS gap, lead(v) OVER (ORDER BY v) AS nxt FROM (
  SELECT v, sum(s) AS s, sum(r) AS r FROM (SELECT {c}::DOUBLE AS v, 1.0::DOUBLE AS s, 0.0::DOUBLE AS r FROM {left} UNION ALL SELECT {c}::DOUBLE, 0.0, 1.0 FROM {right}) GROUP BY v)
 WINDOW o AS (ORDER BY v))""")
    return f"""e AS (SELECT *, 1 - ks AS ks_sim, 1 - least(w / greatest(rng, 1e-10), 1) AS w_sim FROM ({union(parts)}))"""


SIDES = "o_side AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'), f_side AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')"


def _chi(columns: list[str], left: str, right: str) -> str:
    parts = [f"""SELECT '{c}' AS col, count(*) AS k, count(*) FILTER (WHERE r = 0) AS missing, sum(s) AS ts, sum(r) AS tr, sum((s - r) * (s - r) / nullif(r, 0)) AS plain,
 sum(pow(s - r * f, 2) / nullif(r * f, 0)) AS scaled FROM (SELECT v, s, r, sum(s) OVER () / sum(r) OVER () AS f FROM (SELECT coalesce(a.v, b.v) AS v, coalesce(s, 0) AS s, coalesce(r, 0) AS r
 FROM (SELECT {c} AS v, count(*)::DOUBLE AS s FROM {left} GROUP BY 1) a FULL OUTER JOIN (SELECT {c} AS v, count(*)::DOUBLE AS r FROM {right} GROUP BY 1) b ON a.v = b.v))""" for c in columns]
    return f"""x AS (SELECT col, CASE WHEN k < 2 OR missing > 0 OR ts <> tr THEN 0.0 ELSE greatest(0.0, 1 - plain / k) END AS plain,
 CASE WHEN k < 2 OR missing > 0 THEN 0.0 ELSE greatest(0.0, 1 - scaled / k) END AS scaled FROM ({union(parts)}))"""


def _normal(c: str) -> str:
    return f"""SELECT '{c}' AS col, n, (m3 / pow(m2, 1.5)) AS g, m4 / (m2 * m2) AS b FROM (
 SELECT count({c})::DOUBLE AS n, avg(pow({c} - mu, 2)) AS m2, avg(pow({c} - mu, 3)) AS m3, avg(pow({c} - mu, 4)) AS m4 FROM lineitem, (SELECT avg({c}) AS mu FROM lineitem))"""


NORMALITY = f"""WITH m AS ({union([_normal(c) for c in LINE_NUMBERS])}),
a AS (SELECT *, CASE WHEN g = 0 THEN 1 ELSE g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) END AS y,
 sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
 (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM m),
z AS (SELECT *, (1 / sqrt(0.5 * ln(w2))) * ln(y / sqrt(2 / (w2 - 1)) + sqrt(pow(y / sqrt(2 / (w2 - 1)), 2) + 1)) AS z1, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM a),
q AS (SELECT *, 1 + x * sqrt(2 / (aa - 4)) AS dd FROM z),
k AS (SELECT *, pow(z1, 2) + pow((1 - 2 / (9 * aa) - sign(dd) * cbrt((1 - 2 / aa) / abs(dd))) / sqrt(2 / (9 * aa)), 2) AS k2 FROM q)
SELECT col AS "column", CAST(n AS BIGINT) AS n, {r6('k2', 4)} AS statistic, {r6('exp(-k2 / 2)', 4)} AS p_value, exp(-k2 / 2) > 0.05 AS valid FROM k"""


def _uniform(name: str, e: str) -> str:
    return f"""SELECT '{name}' AS col, count(*) AS n, max(greatest(hi / n - least(greatest(v, 0), 1), least(greatest(v, 0), 1) - lo / n)) AS st FROM (
 SELECT v, count(*) OVER () AS n, count(*) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS hi, rank() OVER (ORDER BY v) - 1 AS lo FROM (SELECT {e} AS v FROM lineitem))"""


_kolmogorov = "least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * n * st * st))), 0.0), 1.0)"

def _report() -> str:
    columns, texts, numbers = ["user_id", "value", "event_type", "props"], ["event_type", "props"], ["user_id", "value"]
    row = lambda section, column, metric, value, rest="FROM events": f"""SELECT '{section}' AS section, '{column}' AS "column", '{metric}' AS metric, {r6(f'({value})::DOUBLE')} AS value {rest}"""
    valid = "count(*) FILTER (WHERE user_id IS NOT NULL AND value >= 5 AND event_type IN ('click', 'view', 'purchase', 'signup'))"
    filled = f"({' + '.join(f'count({c})' for c in columns)}) / (4 * count(*))"
    parts = [row("schema", "*", "valid_records", valid), row("schema", "*", "total_records", "count(*)"), row("schema", "*", "validation_score", f"{valid} / count(*)")]
    parts += [row("quality", c, "completeness", f"count({c}) / count(*)") for c in columns] + [row("quality", "*", "completeness", filled)]
    parts += [row("quality", c, "uniqueness", f"count(DISTINCT {c}) / count(*)") for c in columns]
    for c in texts:
        parts += [row("quality", c, "avg_length", f"avg(length({c}))"), row("quality", c, "length_std", f"stddev_samp(length({c}))"), row("quality", c, "format_consistency", f"1 - stddev_samp(length({c})) / avg(length({c}))")]
    for c in numbers:
        parts += [row("quality", c, "mean", f"avg({c})"), row("quality", c, "std", f"stddev_samp({c})"), row("quality", c, "coefficient_of_variation", f"stddev_samp({c}) / avg({c})")]
        cuts = f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM events)"
        parts.append(row("quality", c, "outliers", "count(*)", f"FROM events, {cuts} WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) HAVING count(*) > 0"))
    return union(parts + [row("overall", "*", "overall_score", f"({valid} / count(*) + {filled}) / 2")])


ORACLE = {
    "validation_report_scores": _report(),
    "normality_test": NORMALITY,
    "uniformity_test": f"""WITH u AS ({union([_uniform('q', 'l_quantity / 50.0::DOUBLE'), _uniform('p', 'l_extendedprice / 100000.0::DOUBLE'), _uniform('t', 'l_tax * 12.0::DOUBLE')])}),
p AS (SELECT *, {_kolmogorov} AS p FROM u) SELECT col AS "column", n, {r6('st')} AS statistic, {r6('p')} AS p_value, p > 0.05 AS valid FROM p""",
    "correlation_check": union([f"""SELECT '{a}' AS column_a, '{b}' AS column_b, {e}::DOUBLE AS expected, {r6(f'corr({a}, {b})')} AS actual, abs(corr({a}, {b}) - {e}) <= 0.1 AS valid FROM lineitem"""
                                for a, b, e in (("l_quantity", "l_extendedprice", 0.9), ("l_discount", "l_tax", 0.0), ("l_quantity", "l_tax", 0.5))]),
    "ks_two_sample": f"""WITH {SIDES}, {_ecdf(WIDE, 'o_side', 'f_side')} SELECT col AS "column", {r6('ks')} AS ks_distance, {r6('ks_sim')} AS ks_similarity FROM e""",
    "wasserstein_distance": f"""WITH {SIDES}, {_ecdf(WIDE, 'o_side', 'f_side')} SELECT col AS "column", {r6('w', 5)} AS wasserstein_distance, {r6('rng', 5)} AS reference_range, {r6('w_sim', 5)} AS wasserstein_similarity FROM e""",
    "numeric_similarity": f"""WITH {SIDES}, {_ecdf(WIDE, 'o_side', 'f_side')} SELECT col AS "column", {r6('(ks_sim + w_sim) / 2')} AS similarity FROM e""",
    "chi_square_similarity": f"""WITH {MADE}, {_chi(['o_orderstatus', 'o_orderpriority', 'shop'], 'made', 'ord')}
SELECT x.col AS "column", categories, {r6('plain')} AS plain, {r6('scaled')} AS rescaled FROM x JOIN (SELECT 'o_orderstatus' AS col, count(DISTINCT v) AS categories FROM (SELECT o_orderstatus AS v FROM made UNION ALL SELECT o_orderstatus FROM ord)
UNION ALL SELECT 'o_orderpriority', count(DISTINCT v) FROM (SELECT o_orderpriority AS v FROM made UNION ALL SELECT o_orderpriority FROM ord)
UNION ALL SELECT 'shop', count(DISTINCT v) FROM (SELECT shop AS v FROM made UNION ALL SELECT shop FROM ord)) n ON n.col = x.col""",
    "distribution_similarity": f"""WITH {MADE}, {_chi(['o_orderstatus', 'o_orderpriority', 'shop'], 'made', 'ord')}, {_ecdf(['o_totalprice'], 'made', 'ord')}
SELECT col AS "column", {r6('plain')} AS similarity FROM x UNION ALL SELECT col, {r6('(ks_sim + w_sim) / 2')} FROM e""",
    "correlation_preservation": f"""WITH {SIDES}, p AS ({union([f"SELECT (SELECT corr({a}, {b}) FROM o_side) AS a, (SELECT corr({a}, {b}) FROM f_side) AS b" for i, a in enumerate(LINE_NUMERIC) for b in LINE_NUMERIC[i + 1:]])})
SELECT {r6('greatest(0, corr(a, b))')} AS correlation_preservation FROM p""",
    "statistical_fidelity": f"""WITH {SIDES}, p AS ({union([f"SELECT (SELECT avg({c}) FROM o_side) AS a, (SELECT avg({c}) FROM f_side) AS b" for c in WIDE])})
SELECT {r6('avg(greatest(0, 1 - abs(a - b) / abs(b)))')} AS statistical_fidelity FROM p WHERE b <> 0""",
    "overall_score": f"WITH {SCORES} SELECT dataset_name, {', '.join(f'{r6(c)} AS {c}' for c in SCORE_NAMES)}, num_rows FROM ov",
    "recommendations": f"WITH {SCORES} " + union([f"SELECT dataset_name, {i} AS position, '{n}' AS score, {r6(n)} AS value, '{t}' AS recommendation FROM ov WHERE {n} < {l}" for i, (n, l, t) in enumerate(C.ADVICE)]),
    "comparison_summary": f"""WITH {SCORES}, q AS (SELECT *, round(overall_quality_score, 1) AS oq FROM ov) SELECT count(*) AS total_datasets, {r6('avg(oq)')} AS avg_quality_score,
first(dataset_name ORDER BY oq DESC, -ascii(dataset_name)) AS best_dataset, CAST(sum(num_rows) AS BIGINT) AS total_rows FROM q""",
    "benchmark_report": f"""WITH {SCORES}, m AS (SELECT {', '.join(f'round(min({c}), 2) AS {c}' for c in SCORE_NAMES[:-1])} FROM sc),
o AS (SELECT *, round(completeness_score * 0.2 + consistency_score * 0.15 + uniqueness_score * 0.15 + validity_score * 0.15 + statistical_fidelity * 0.15 + ml_utility_score * 0.2, 3) AS overall_quality_score FROM m)
SELECT '{{"dataset_info":{{"synthetic_records":' || (SELECT count(*) FROM customer) || ',"synthetic_features":5,"reference_records":' || (SELECT count(*) FROM supplier) || ',"reference_features":4}},"quality_metrics":{{'
|| {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:' || {c}" for c in SCORE_NAMES)} || '}},"recommendations":[' ||
array_to_string(list_filter([{', '.join(f"CASE WHEN {n} < {l} THEN '{chr(34)}{t}{chr(34)}' END" for n, l, t in C.ADVICE)}], lambda r: r IS NOT NULL), ',') || ']}}' AS report FROM o""",
    "disclosure_risk": f"""WITH k AS (SELECT l_linestatus, l_quantity, l_returnflag, l_linenumber, l_suppkey, CASE WHEN l_tax < 0.08 THEN l_discount END AS l_discount FROM lineitem),
f AS (SELECT DISTINCT * FROM k WHERE l_linestatus = 'F'),
h AS (SELECT count(f.l_linestatus) AS m, count(*) AS n FROM k LEFT JOIN f ON k.l_quantity = f.l_quantity AND k.l_returnflag = f.l_returnflag AND k.l_linenumber = f.l_linenumber AND k.l_suppkey = f.l_suppkey AND k.l_discount = f.l_discount WHERE k.l_linestatus = 'O')
SELECT m AS matches, {r6('m / n')} AS disclosure_risk, {r6('1 - m / n')} AS privacy_score FROM h""",
    "k_anonymity": """WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m'))
SELECT min(n) AS smallest_group, count(*) FILTER (WHERE n < 5) AS groups_below_k, CAST(coalesce(sum(n) FILTER (WHERE n < 5), 0) AS BIGINT) AS rows_below_k, min(n) >= 5 AS k_anonymous FROM g""",
    "l_diversity": """WITH g AS (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)
SELECT min(n) AS fewest_values, count(*) FILTER (WHERE n < 60) AS groups_below_l, min(n) >= 60 AS l_diverse FROM g""",
    "train_test_split": f"SELECT o_orderkey, CASE WHEN {SqlDraws(42, 'split', 'o_orderkey').unit('x')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders",
    "regression_metrics": f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem), m AS (SELECT avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM p)
SELECT {r6('mse', 3)} AS mse, {r6('sqrt(mse)', 3)} AS rmse, {r6('mae', 3)} AS mae, {r6('1 - mse / v', 3)} AS r2 FROM m""",
    "classification_metrics": f"""WITH p AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 50000 THEN 'O' ELSE 'X' END AS p FROM orders),
c AS (SELECT y AS c, count(*) AS sup, count(*) FILTER (WHERE y = p) AS hit, (SELECT count(*) FROM p q WHERE q.p = p.y) AS pred FROM p GROUP BY y),
s AS (SELECT *, coalesce(hit / nullif(pred, 0), 0) AS pr, hit / sup AS re FROM c)
SELECT {r6('sum(hit) / sum(sup)')} AS accuracy, {r6('sum(pr * sup) / sum(sup)')} AS precision, {r6('sum(re * sup) / sum(sup)')} AS recall,
{r6('sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * sup) / sum(sup)')} AS f1 FROM s""",
}
