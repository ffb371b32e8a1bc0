"""Generation queries.  The row ids are the order keys (0 .. n-1), so every table has one row per order.

The SQL twins draw the same hashes (see ``sqldraws``); doubles are compared at 6 digits.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from plumbline.plans import generate as G
from plumbline.plans.spec import ColumnSpec, DatasetSpec, Distribution
from plumbline.plans.templates import customer_data, iot_sensor_data, sales_data
from plumbline.plans.reports import create_dataset
from plumbline.registry.base import load, r6, rounded, text_time, union
from plumbline.registry.sqldraws import SqlDraws, signed_order_sql

AS_OF = datetime(2024, 1, 1)
ID = "o_orderkey"


def rows(s, d):
    return load(s, d, "orders").select(ID)


def build(s, d, spec: DatasetSpec, keep=True):
    base = rows(s, d)
    spec.num_rows = base.count()
    return G.generate(s, spec, base, ID, keep_id=keep)


def plain_spec(*columns: ColumnSpec, **settings) -> DatasetSpec:
    settings.setdefault("consistency_level", 1.0)
    return DatasetSpec(columns=list(columns), as_of=AS_OF, **settings)


def numbers(**kinds: Distribution) -> list[ColumnSpec]:
    return [ColumnSpec(n, distribution=dist) for n, dist in kinds.items()]


def sql_draws(name: str, purpose: str = "value") -> SqlDraws:
    return SqlDraws(42, f"{name}/{purpose}", ID)


def sql_clip(e: str, low=None, high=None) -> str:
    if low is not None:
        e = f"greatest({e}, {low}::DOUBLE)"
    if high is not None:
        e = f"least({e}, {high}::DOUBLE)"
    return e


def sql_category(name: str, dist: Distribution) -> str:
    cats, cuts = dist.category_list(), dist.cumulative_weights()
    whens = " ".join(f"WHEN v < {cut!r}::DOUBLE THEN '{cat}'" for cat, cut in zip(cats[:-1], cuts[:-1]))
    return f"list_transform([{sql_draws(name).unit('x')}], lambda v: CASE {whens} ELSE '{cats[-1]}' END)[1]"


def sql_instant(name: str, start: datetime, end: datetime) -> str:
    micros = float((end - start).total_seconds() * 1e6)
    return f"(TIMESTAMP '{start}' + to_microseconds(CAST(floor({sql_draws(name).unit('x')} * {micros!r}::DOUBLE) AS BIGINT)))"


def sql_variant(name: str, e: str, share: float) -> str:
    return f"CASE WHEN {sql_draws(name, 'variant').unit('x')} < {share!r}::DOUBLE THEN {e} || '_var' ELSE {e} END"


def sql_outliers(name: str, source: str, probability: float) -> tuple[str, str]:
    """CTE that ranks the pick draw and measures moments, and the expression of the disturbed value."""
    d = sql_draws(name, "outlier")
    order = signed_order_sql(42, f"{name}/outlier", "pick", ID)
    cte = (
        f"{name}_o AS (SELECT {ID}, row_number() OVER (ORDER BY {order}) AS pick, {d.uniform('size', 3.0, 5.0)} AS size, {d.unit('side')} AS side,"
        f" {source} AS v FROM base), {name}_m AS (SELECT avg(v) AS m, stddev_pop(v) AS s, CAST(floor(count(*) * {probability!r}::DOUBLE) AS BIGINT) AS k FROM {name}_o),"
        f" {name}_f AS (SELECT {ID}, CASE WHEN pick <= k THEN CASE WHEN side > 0.5 THEN m + size * s ELSE m - size * s END ELSE v END AS {name} FROM {name}_o, {name}_m)"
    )
    return cte, name


def sql_mix(x: str, x_stats: str, y: str, y_stats: str, r: float) -> str:
    return f"(({r!r}::DOUBLE * (({x} - {x_stats}.m) / {x_stats}.s) + {math.sqrt(1 - r * r)!r}::DOUBLE * (({y} - {y_stats}.m) / {y_stats}.s)) * {y_stats}.s + {y_stats}.m)"


NORMAL = Distribution("normal", mean=100.0, std=15.0)
UNIFORM = Distribution("uniform", min_value=-5.0, max_value=20.0)
EXPONENTIAL = Distribution("exponential", {"scale": 3.0})
GAMMAS = {
    "whole": Distribution("gamma", {"shape": 2.0, "scale": 50.0}),
    "half": Distribution("gamma", {"shape": 1.5, "scale": 2.0}),
    "general": Distribution("gamma", {"shape": 2.3, "scale": 1.5}),
    "small": Distribution("gamma", {"shape": 0.7, "scale": 4.0}),
}
BETAS = {"even": Distribution("beta", {"alpha": 2.0, "beta": 2.0}), "skewed": Distribution("beta", {"alpha": 3.0, "beta": 1.5})}
LOGNORMAL = Distribution("lognormal", mean=10.5, std=0.8)
CLIPPED = Distribution("normal", mean=35.0, std=12.0, min_value=18.0, max_value=80.0)
CATEGORY = Distribution(categories=["alpha", "beta", "gamma"], weights=[5.0, 3.0, 2.0])
START, END = datetime(2021, 6, 1), datetime(2023, 6, 1, 12)
SEASON_CYCLES = {"daily": ("hour(t)", 24), "weekly": ("(isodow(t) - 1)", 7), "monthly": ("day(t)", 30), "yearly": ("dayofyear(t)", 365)}


def seasons(s, d):
    df = build(s, d, plain_spec(ColumnSpec("t", "datetime", datetime_start=START, datetime_end=END)))
    return rounded(df.select(ID, *[G.seasonal_factor(F.col("t"), x).alias(x) for x in SEASON_CYCLES]))


def trends(s, d):
    base = rows(s, d)
    n = base.count()
    return rounded(base.select(ID, *[G.trend_factor(F.col(ID), n, t).alias(t) for t in ("increasing", "decreasing", "cyclical")]))


def datetimes(s, d):
    spec = plain_spec(ColumnSpec("t", "datetime", datetime_start=START, datetime_end=END), ColumnSpec("last_year", "datetime"))
    df = build(s, d, spec)
    return df.select(ID, text_time(F.col("t")).alias("t"), text_time(F.col("last_year")).alias("last_year"))


def rule_rows(s, d):
    from plumbline.plans.rules import apply_rules

    df = load(s, d, "orders").select(ID, "o_totalprice", "o_orderpriority", (F.col("o_custkey") > 1000000).alias("flag"), F.col("o_custkey").alias("n"))
    return apply_rules(
        df,
        ["if o_totalprice > 300000 then flag = yes", "if o_totalprice > 400000 then o_orderpriority = 'TOP'", "if o_totalprice > 450000.5 then n = -1", "if n < 0 then n = 5"],
        lenient=True,
    ).select(ID, "flag", "o_orderpriority", "n")


def checked(s, d):
    """Findings on line items read as if generated: order key declared unique, half of the prices blanked."""
    df = load(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"),
        F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).alias("price"),
        F.col("l_linenumber").alias("line"),
    )
    spec = plain_spec(ColumnSpec("key", "id", unique=True), ColumnSpec("price"), ColumnSpec("line"))
    return rounded(G.check_generated(df, spec))


def many(s, d):
    base = rows(s, d)
    n = base.count()
    specs = {
        "customers": customer_data(n, as_of=AS_OF),
        "sales": sales_data(n, as_of=AS_OF),
        "sensors": iot_sensor_data(n, as_of=AS_OF),
    }
    ids = {k: base.withColumnRenamed(ID, "id") for k in specs}
    tables, errors = G.generate_many(s, specs, ids)
    parts = [t.agg(F.lit(k).alias("dataset"), F.count(F.lit(1)).alias("n"), F.lit(len(t.columns)).alias("n_columns")) for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def template_view(df, times: list[str]):
    return rounded(df.select(*[text_time(F.col(c)).alias(c) if c in times else F.col(c) for c in df.columns]), 4)


def dataset_creation(s, d):
    base = rows(s, d).withColumnRenamed(ID, "id")
    made = create_dataset(s, "sales_data", name="sales", rows=base, num_rows=base.count(), as_of=AS_OF, benchmark=False, export=None)
    return made.metadata.drop("generated_at")


QUERIES = {
    "generate_dataset": lambda s, d: template_view(
        build(s, d, DatasetSpec(
            columns=[
                ColumnSpec("code", "id", unique=True, id_prefix="TEST"),
                ColumnSpec("value", distribution=NORMAL, nullable=True, null_probability=0.1),
                ColumnSpec("linked", distribution=UNIFORM, correlation_with="value", correlation_strength=0.8),
                ColumnSpec("category", "categorical", CATEGORY, nullable=True, null_probability=0.05),
                ColumnSpec("note", "text", text_pattern="row {} of many"),
            ],
            as_of=AS_OF,
            business_rules=["if value > 130 then category = 'high'"],
        )), []),
    "gen_normal": lambda s, d: rounded(build(s, d, plain_spec(*numbers(x=NORMAL)))),
    "gen_uniform": lambda s, d: rounded(build(s, d, plain_spec(*numbers(x=UNIFORM)))),
    "gen_exponential": lambda s, d: rounded(build(s, d, plain_spec(*numbers(x=EXPONENTIAL)))),
    "gen_gamma": lambda s, d: rounded(build(s, d, plain_spec(*numbers(**GAMMAS)))),
    "gen_beta": lambda s, d: rounded(build(s, d, plain_spec(*numbers(**BETAS)))),
    "gen_lognormal": lambda s, d: rounded(build(s, d, plain_spec(*numbers(x=LOGNORMAL))), 3),
    "clip_bounds": lambda s, d: rounded(build(s, d, plain_spec(*numbers(x=CLIPPED)))),
    "gen_categorical": lambda s, d: build(s, d, plain_spec(ColumnSpec("c", "categorical", CATEGORY), ColumnSpec("plain", "categorical"))),
    "gen_datetime": datetimes,
    "gen_text_pattern": lambda s, d: build(s, d, plain_spec(ColumnSpec("a", "text"), ColumnSpec("b", "text", text_pattern="100% of {:05d}"))),
    "gen_text_words": lambda s, d: build(s, d, plain_spec(ColumnSpec("t", "text", text_words=True, text_length_range=(5, 50)))),
    "gen_boolean": lambda s, d: build(s, d, plain_spec(ColumnSpec("b", "boolean", Distribution(parameters={"prob_true": 0.3})), ColumnSpec("even", "boolean"))),
    "gen_id_unique": lambda s, d: build(s, d, plain_spec(ColumnSpec("i", "id", unique=True), ColumnSpec("j", "id", unique=True, id_prefix="T", id_format="{prefix}_{:03d}"))),
    "gen_id_repeating": lambda s, d: build(s, d, plain_spec(ColumnSpec("i", "id", id_prefix="CUST", id_format="{prefix}_{:08d}"))),
    "correlate_numeric": lambda s, d: rounded(build(s, d, plain_spec(
        ColumnSpec("x", distribution=NORMAL), ColumnSpec("y", distribution=Distribution("exponential", {"scale": 2.0}), correlation_with="x", correlation_strength=0.8),
        ColumnSpec("z", distribution=UNIFORM, correlation_with="x", correlation_strength=-0.3))), 5),
    "correlate_categorical": lambda s, d: build(s, d, plain_spec(
        ColumnSpec("c", "categorical", CATEGORY), ColumnSpec("x", distribution=UNIFORM),
        ColumnSpec("level", "categorical", Distribution(categories=["low", "high"]), correlation_with="c", correlation_strength=0.7),
        ColumnSpec("grade", "categorical", Distribution(categories=["p", "q", "r", "s"]), correlation_with="x", correlation_strength=-0.5),
        ColumnSpec("free", "categorical", Distribution(categories=["low", "high"]), correlation_with="c", correlation_strength=0.3))).select(ID, "c", "level", "grade", "free"),
    "inject_outliers": lambda s, d: rounded(build(s, d, plain_spec(*numbers(value=NORMAL), add_outliers=True, outlier_probability=0.05)), 5),
    "inject_noise": lambda s, d: rounded(build(s, d, plain_spec(*numbers(value=UNIFORM), add_noise=True, noise_level=0.1)), 5),
    "inject_nulls": lambda s, d: rounded(build(s, d, plain_spec(
        ColumnSpec("x", distribution=UNIFORM, nullable=True, null_probability=0.25), ColumnSpec("c", "categorical", CATEGORY, nullable=True, null_probability=0.5),
        ColumnSpec("kept", "categorical", CATEGORY, nullable=False, null_probability=0.5)))),
    "inject_inconsistency": lambda s, d: build(s, d, plain_spec(
        ColumnSpec("i", "id", unique=True), ColumnSpec("c", "categorical", CATEGORY, nullable=True, null_probability=0.2), consistency_level=0.8)),
    "apply_business_rules": rule_rows,
    "seasonal_factor": seasons,
    "trend_factor": trends,
    "check_generated": checked,
    "template_customer": lambda s, d: template_view(build(s, d, customer_data(as_of=AS_OF)), ["registration_date"]),
    "template_sales": lambda s, d: template_view(build(s, d, sales_data(as_of=AS_OF)), ["transaction_date"]),
    "template_iot": lambda s, d: template_view(build(s, d, iot_sensor_data(as_of=AS_OF)), ["timestamp"]),
    "gen_tabular_random": lambda s, d: G.tabular_random(rows(s, d), ID, 7),
    "generate_many": many,
    "create_dataset": dataset_creation,
}


def select(columns: dict[str, str], ctes: str = "", source: str = "orders") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"{'WITH ' + ctes if ctes else ''} SELECT {ID}, {body} FROM {source}"


def _nullable(name: str, e: str, p: float) -> str:
    return f"CASE WHEN {sql_draws(name, 'null').unit('x')} >= {p!r}::DOUBLE THEN {e} END"


def sql_kind(name: str, dist: Distribution) -> str:
    d, p = sql_draws(name), dist.parameters
    e = {
        "normal": lambda: d.normal("x", dist.mean, dist.std),
        "uniform": lambda: d.uniform("x", dist.min_value, dist.max_value),
        "exponential": lambda: d.exponential("x", p["scale"]),
        "gamma": lambda: d.gamma("x", p["shape"], p["scale"]),
        "beta": lambda: d.beta("x", p["alpha"], p["beta"]),
        "lognormal": lambda: d.lognormal("x", dist.mean, dist.std),
    }[dist.kind]()
    return sql_clip(e, dist.min_value, dist.max_value)


BASE = f"base AS (SELECT {ID} FROM orders)"
TEXT_WORDS = 50 // 4 + 1
_FILLER = "[" + ", ".join(f"'{w}'" for w in G.FILLER_WORDS) + "]"


def _words_sql() -> str:
    word = SqlDraws(42, "t/value", f"({ID} * {TEXT_WORDS} + k)").unit("word")
    return f"""WITH w AS (SELECT {ID}, string_agg({_FILLER}[CAST(floor({word} * {float(len(G.FILLER_WORDS))!r}) AS INTEGER) + 1], ' ' ORDER BY k) AS prose
FROM orders, (SELECT unnest(range({TEXT_WORDS})) AS k) GROUP BY {ID})
SELECT {ID}, substr(prose, 1, 5 + CAST(floor({sql_draws('t').unit('len')} * 46.0) AS INTEGER)) AS t FROM w"""


def _moments(name: str, source: str, columns: list[str]) -> str:
    return ", ".join(f"{c}_s AS (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source})" for c in columns)


def _customer_sql() -> str:
    age, _ = sql_outliers("age", sql_clip(sql_draws("age").normal("x", 35.0, 12.0), 18.0, 80.0), 0.02)
    income, _ = sql_outliers("income", sql_clip(sql_draws("income").lognormal("x", 10.5, 0.8), 20000.0), 0.02)
    t = customer_data(as_of=AS_OF)
    mixed = sql_mix("age", "age_s", "income", "income_s", 0.3)
    return f"""WITH {BASE}, {age}, {income}, own AS (SELECT * FROM age_f JOIN income_f USING ({ID})), {_moments('', 'own', ['age', 'income'])},
t AS (SELECT {ID}, age, {mixed} AS income FROM own, age_s, income_s)
SELECT {ID}, {sql_variant('customer_id', f"'CUST_' || lpad(CAST({ID} AS VARCHAR), 8, '0')", 1 - 0.9)} AS customer_id, {r6('age', 4)} AS age,
{sql_variant('gender', sql_category('gender', t.column('gender').distribution), 1 - 0.9)} AS gender,
{sql_variant('region', sql_category('region', t.column('region').distribution), 1 - 0.9)} AS region,
strftime({sql_instant('registration_date', t.column('registration_date').datetime_start, AS_OF)}, '%Y-%m-%d %H:%M:%S.%f') AS registration_date,
{r6('income', 4)} AS income, (age > 65 OR income > 100000 OR {sql_draws('is_premium').unit('x')} < 0.3) AS is_premium FROM t"""


def _sales_sql() -> str:
    t = sales_data(as_of=AS_OF)
    own = f"own AS (SELECT {ID}, {sql_kind('amount', t.column('amount').distribution)} AS amount, {sql_kind('quantity', t.column('quantity').distribution)} AS quantity, {sql_instant('transaction_date', t.column('transaction_date').datetime_start, AS_OF)} AS td FROM orders)"
    return f"""WITH {own}, {_moments('', 'own', ['amount', 'quantity'])}, n AS (SELECT count(*) AS n FROM orders),
t AS (SELECT {ID}, td, amount, {sql_mix('amount', 'amount_s', 'quantity', 'quantity_s', 0.6)} AS quantity, n FROM own, amount_s, quantity_s, n)
SELECT {ID}, {sql_variant('transaction_id', f"'TXN_' || lpad(CAST({ID} AS VARCHAR), 10, '0')", 1 - 0.9)} AS transaction_id,
{sql_variant('customer_id', f"'CUST_' || lpad(CAST(CAST(floor({sql_draws('customer_id').unit('x')} * floor(n * 0.8)) AS BIGINT) AS VARCHAR), 8, '0')", 1 - 0.9)} AS customer_id,
{sql_variant('product_category', sql_category('product_category', t.column('product_category').distribution), 1 - 0.9)} AS product_category, {r6('amount', 4)} AS amount,
strftime(td, '%Y-%m-%d %H:%M:%S.%f') AS transaction_date, {sql_variant('payment_method', sql_category('payment_method', t.column('payment_method').distribution), 1 - 0.9)} AS payment_method,
(amount > 500 OR quantity > 10 OR {sql_draws('discount_applied').unit('x')} < 0.25) AS discount_applied, {r6('quantity', 4)} AS quantity,
{r6('sin(2 * pi() * day(td) / 30)', 4)} AS transaction_date_seasonal_factor, {r6(f'{ID} / (n - 1)', 4)} AS transaction_date_trend_factor FROM t"""


def _iot_sql() -> str:
    t = iot_sensor_data(as_of=AS_OF)
    names = ["temperature", "humidity", "pressure", "light_level", "battery_level"]
    parts, noisy = [], []
    for n in names:
        cte, _ = sql_outliers(n, sql_kind(n, t.column(n).distribution), 0.01)
        d = sql_draws(n, "noise")
        z = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {d.unit('x.a')})) * cos({2 * math.pi!r}::DOUBLE * {d.unit('x.b')})"
        parts.append(cte + f", {n}_n AS (SELECT {ID}, {n} + 0.05::DOUBLE * (SELECT stddev_pop({n}) FROM {n}_f) * {z} AS {n} FROM {n}_f)")
        noisy.append(f"{n}_n")
    joined = noisy[0] + "".join(f" JOIN {x} USING ({ID})" for x in noisy[1:])
    mixed = sql_mix("temperature", "temperature_s", "humidity", "humidity_s", -0.3)
    status = sql_variant("status", sql_category("status", t.column("status").distribution), 1 - 0.9)
    return f"""WITH {BASE}, {', '.join(parts)}, own AS (SELECT * FROM {joined}), {_moments('', 'own', ['temperature', 'humidity'])},
t AS (SELECT {ID}, temperature, pressure, light_level, battery_level, {mixed} AS humidity, {sql_instant('timestamp', t.column('timestamp').datetime_start, AS_OF)} AS ts,
 (SELECT count(*) FROM orders) AS n FROM own, temperature_s, humidity_s)
SELECT {ID}, {sql_variant('sensor_id', f"'SENSOR_' || printf('%04d', CAST(floor({sql_draws('sensor_id').unit('x')} * floor(n * 0.8)) AS BIGINT))", 1 - 0.9)} AS sensor_id,
strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", {r6('temperature', 4)} AS temperature, {r6('pressure', 4)} AS pressure, {r6('light_level', 4)} AS light_level,
{r6('battery_level', 4)} AS battery_level, CASE WHEN temperature > 40 THEN 'Error' ELSE {status} END AS status, {r6('humidity', 4)} AS humidity,
{r6('sin(2 * pi() * hour(ts) / 24)', 4)} AS timestamp_seasonal_factor FROM t"""


def _pipeline_sql() -> str:
    own = f"own AS (SELECT {ID}, {sql_draws('value').normal('x', 100.0, 15.0)} AS value, {sql_kind('linked', UNIFORM)} AS linked FROM orders)"
    cat = sql_variant("category", _nullable("category", sql_category("category", CATEGORY), 0.05), 1 - 0.9)
    return f"""WITH {own}, {_moments('', 'own', ['value', 'linked'])}, t AS (SELECT {ID}, {_nullable('value', 'value', 0.1)} AS value,
{sql_mix('value', 'value_s', 'linked', 'linked_s', 0.8)} AS linked, {cat} AS category FROM own, value_s, linked_s)
SELECT {ID}, {sql_variant('code', f"'TEST_' || lpad(CAST({ID} AS VARCHAR), 6, '0')", 1 - 0.9)} AS code, {r6('value', 4)} AS value, {r6('linked', 4)} AS linked,
CASE WHEN value > 130 THEN 'high' ELSE category END AS category, {sql_variant('note', f"'row ' || {ID} || ' of many'", 1 - 0.9)} AS note FROM t"""


_outlier_cte, _ = sql_outliers("value", sql_draws("value").normal("x", 100.0, 15.0), 0.05)
_rank = lambda c, k: f"(dense_rank() OVER (ORDER BY {c}) - 1) % {k} + 1"

ORACLE = {
    "generate_dataset": _pipeline_sql(),
    "gen_normal": select({"x": r6(sql_kind("x", NORMAL))}),
    "gen_uniform": select({"x": r6(sql_kind("x", UNIFORM))}),
    "gen_exponential": select({"x": r6(sql_kind("x", EXPONENTIAL))}),
    "gen_gamma": select({n: r6(sql_kind(n, g)) for n, g in GAMMAS.items()}),
    "gen_beta": select({n: r6(sql_kind(n, g)) for n, g in BETAS.items()}),
    "gen_lognormal": select({"x": r6(sql_kind("x", LOGNORMAL), 3)}),
    "clip_bounds": select({"x": r6(sql_kind("x", CLIPPED))}),
    "gen_categorical": select({"c": sql_category("c", CATEGORY), "plain": sql_category("plain", Distribution())}),
    "gen_datetime": select({
        "t": f"strftime({sql_instant('t', START, END)}, '%Y-%m-%d %H:%M:%S.%f')",
        "last_year": f"strftime({sql_instant('last_year', datetime(2023, 1, 1), AS_OF)}, '%Y-%m-%d %H:%M:%S.%f')"}),
    "gen_text_pattern": select({"a": f"'text_' || {ID}", "b": f"'100% of ' || printf('%05d', {ID})"}),
    "gen_text_words": _words_sql(),
    "gen_boolean": select({"b": f"({sql_draws('b').unit('x')} < 0.3)", "even": f"({sql_draws('even').unit('x')} < 0.5)"}),
    "gen_id_unique": select({"i": f"'ID_' || printf('%06d', {ID})", "j": f"'T_' || printf('%03d', {ID})"}),
    "gen_id_repeating": f"SELECT {ID}, 'CUST_' || printf('%08d', CAST(floor({sql_draws('i').unit('x')} * floor(n * 0.8)) AS BIGINT)) AS i FROM orders, (SELECT count(*) AS n FROM orders)",
    "correlate_numeric": f"""WITH own AS (SELECT {ID}, {sql_kind('x', NORMAL)} AS x, {sql_draws('y').exponential('x', 2.0)} AS y, {sql_kind('z', UNIFORM)} AS z FROM orders), {_moments('', 'own', ['x', 'y', 'z'])}
SELECT {ID}, {r6('x', 5)} AS x, {r6(sql_mix('x', 'x_s', 'y', 'y_s', 0.8), 5)} AS y, {r6(sql_mix('x', 'x_s', 'z', 'z_s', -0.3), 5)} AS z FROM own, x_s, y_s, z_s""",
    "correlate_categorical": f"""WITH own AS (SELECT {ID}, {sql_category('c', CATEGORY)} AS c, {sql_kind('x', UNIFORM)} AS x, {sql_category('free', Distribution(categories=['low', 'high']))} AS free FROM orders)
SELECT {ID}, c, ['low', 'high'][{_rank('c', 2)}] AS level, ['p', 'q', 'r', 's'][{_rank('x', 4)}] AS grade, free FROM own""",
    "inject_outliers": f"WITH {BASE}, {_outlier_cte} SELECT {ID}, {r6('value', 5)} AS value FROM value_f",
    "inject_noise": f"""WITH own AS (SELECT {ID}, {sql_kind('value', UNIFORM)} AS value FROM orders)
SELECT {ID}, {r6(f"value + (0.1::DOUBLE * (SELECT stddev_pop(value) FROM own)) * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_draws('value', 'noise').unit('x.a')})) * cos({2 * math.pi!r}::DOUBLE * {sql_draws('value', 'noise').unit('x.b')})", 5)} AS value FROM own""",
    "inject_nulls": select({"x": r6(_nullable("x", sql_kind("x", UNIFORM), 0.25)), "c": _nullable("c", sql_category("c", CATEGORY), 0.5), "kept": sql_category("kept", CATEGORY)}),
    "inject_inconsistency": select({
        "i": sql_variant("i", f"'ID_' || printf('%06d', {ID})", 1 - 0.8),
        "c": sql_variant("c", _nullable("c", sql_category("c", CATEGORY), 0.2), 1 - 0.8)}),
    "apply_business_rules": f"""SELECT {ID}, (o_totalprice > 300000 OR o_custkey > 1000000) AS flag, CASE WHEN o_totalprice > 400000 THEN 'TOP' ELSE o_orderpriority END AS o_orderpriority,
CASE WHEN o_totalprice > 450000.5 THEN -1 ELSE o_custkey END AS n FROM orders""",
    "seasonal_factor": f"WITH x AS (SELECT {ID}, {sql_instant('t', START, END)} AS t FROM orders) SELECT {ID}, "
    + ", ".join(f"{r6(f'sin(2 * pi() * {e} / {k})')} AS {n}" for n, (e, k) in SEASON_CYCLES.items()) + " FROM x",
    "trend_factor": f"""SELECT {ID}, {r6(f'{ID} / (n - 1)')} AS increasing, {r6(f'1 - {ID} / (n - 1)')} AS decreasing, {r6(f'sin(2 * pi() * {ID} / (n / 3))')} AS cyclical
FROM orders, (SELECT count(*) AS n FROM orders)""",
    "check_generated": f"""SELECT 'duplicates' AS kind, 'key' AS "column", CAST(count(*) - count(DISTINCT l_orderkey) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'low_completeness', '*', {r6('(2 * count(*) + count(CASE WHEN l_quantity > 25 THEN 1 END)) / (3 * count(*))')} FROM lineitem
UNION ALL SELECT 'type_mismatch', 'line', 1.0""",
    "template_customer": _customer_sql(),
    "template_sales": _sales_sql(),
    "template_iot": _iot_sql(),
    "gen_tabular_random": "SELECT o_orderkey + 1 AS id, " + ", ".join(
        {0: f"CAST(1 + floor({SqlDraws(42, f'col_{j + 1}', ID).unit('x')} * 100.0) AS INTEGER)",
         1: f"['alpha', 'beta', 'gamma', 'delta'][CAST(floor({SqlDraws(42, f'col_{j + 1}', ID).unit('x')} * 4.0) AS INTEGER) + 1]",
         2: r6(SqlDraws(42, f"col_{j + 1}", ID).unit("x"), 3)}[j % 3] + f" AS col_{j + 1}" for j in range(6)) + " FROM orders",
    "generate_many": """SELECT 'customers' AS dataset, count(*) AS n, 7 AS n_columns FROM orders UNION ALL SELECT 'sales', count(*), 10 FROM orders UNION ALL SELECT 'sensors', count(*), 9 FROM orders""",
    "create_dataset": "SELECT 'sales' AS dataset, count(*) AS num_rows, 10 AS num_columns FROM orders",
}
