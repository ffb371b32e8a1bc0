import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from plumbline import ColumnSpec, DatasetSpec, Distribution, compile_spec, generate
from plumbline.plans.generate import check_generated, format_with_id, generate_many
from plumbline.plans.reports import create_dataset
from plumbline.plans.rules import apply_rules
from plumbline.plans.spec import SpecError
from plumbline.plans.templates import TEMPLATES, customer_data, iot_sensor_data, sales_data, template
from plumbline.streaming.streams import generate_stream, run_to_table
from plumbline.session import fresh_path

AS_OF = datetime(2024, 1, 1)


def basic(**more):
    columns = [
        ColumnSpec("id", "id", unique=True, id_prefix="TEST"),
        ColumnSpec("value", distribution=Distribution("normal", mean=100.0, std=15.0)),
        ColumnSpec("category", "categorical", Distribution(categories=["A", "B", "C"], weights=[0.5, 0.3, 0.2])),
    ]
    return DatasetSpec(columns=columns, num_rows=100, consistency_level=1.0, as_of=AS_OF, **more)


def column(spark, spec, name="x"):
    return np.array([r[0] for r in generate(spark, spec).select(name).collect()], dtype=float)


def spec_of(dist, n=20000, **more):
    return DatasetSpec(columns=[ColumnSpec("x", distribution=dist)], num_rows=n, consistency_level=1.0, **more)


def test_basic_table(spark):
    df = generate(spark, basic())
    assert df.columns == ["id", "value", "category"]
    got = rows(df)
    assert len(got) == 100 and len({r[0] for r in got}) == 100
    assert {r[2] for r in got} <= {"A", "B", "C"}
    assert min(r[0] for r in got) == "TEST_000000"


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_same_rows_on_any_partitioning(spark, name):
    spec = TEMPLATES[name](num_rows=400, as_of=AS_OF)

    def made(parts):
        ids = spark.range(0, 400, 1, parts).withColumnRenamed("id", "n")
        df = compile_spec(spark, spec, ids, "n").apply(keep_id=True)
        return {r[0]: [round(v, 9) if isinstance(v, float) else v for v in r[1:]] for r in df.collect()}

    assert made(1) == made(8)


def test_seeds_differ(spark):
    assert rows(generate(spark, basic(seed=1))) != rows(generate(spark, basic(seed=2)))


# (distribution, mean, standard deviation)
MOMENTS = [
    (Distribution("normal", mean=100.0, std=15.0), 100.0, 15.0),
    (Distribution("uniform", min_value=2.0, max_value=8.0), 5.0, 6.0 / math.sqrt(12)),
    (Distribution("exponential", {"scale": 3.0}), 3.0, 3.0),
    (Distribution("gamma", {"shape": 2.0, "scale": 50.0}), 100.0, math.sqrt(2) * 50),
    (Distribution("gamma", {"shape": 1.5, "scale": 2.0}), 3.0, math.sqrt(1.5) * 2),
    (Distribution("gamma", {"shape": 0.7, "scale": 1.0}), 0.7, math.sqrt(0.7)),
    (Distribution("gamma", {"shape": 40.3, "scale": 1.0}), 40.3, math.sqrt(40.3)),
    (Distribution("beta", {"alpha": 2.0, "beta": 2.0}), 0.5, math.sqrt(0.05)),
    (Distribution("beta", {"alpha": 3.0, "beta": 1.5}), 2 / 3, math.sqrt(4.5 / (4.5**2 * 5.5))),
    (Distribution("lognormal", mean=0.0, std=0.5), math.exp(0.125), math.sqrt((math.exp(0.25) - 1) * math.exp(0.25))),
]


@pytest.mark.parametrize("dist, mean, std", MOMENTS)
def test_moments(spark, dist, mean, std):
    x = column(spark, spec_of(dist))
    assert abs(x.mean() - mean) < 4.5 * std / math.sqrt(len(x))
    assert abs(x.std() - std) < 0.06 * std


def test_correlation_and_chain(spark):
    columns = [
        ColumnSpec("x", distribution=Distribution("normal", mean=0.0, std=1.0)),
        ColumnSpec("y", distribution=Distribution("normal", mean=5.0, std=2.0), correlation_with="x", correlation_strength=0.8),
        ColumnSpec("z", distribution=Distribution("normal", mean=1.0, std=3.0), correlation_with="y", correlation_strength=-0.6),
    ]
    df = generate(spark, DatasetSpec(columns=columns, num_rows=20000))
    got = one(df.agg(F.corr("x", "y"), F.corr("y", "z"), F.corr("x", "z")))
    assert got[0] == pytest.approx(0.8, abs=0.02)
    assert got[1] == pytest.approx(-0.6, abs=0.02)
    assert got[2] == pytest.approx(-0.48, abs=0.03)


def test_outliers_are_counted_exactly_and_lie_outside(spark):
    plain = column(spark, spec_of(Distribution("normal", mean=100.0, std=10.0), 1000))
    odd = column(spark, spec_of(Distribution("normal", mean=100.0, std=10.0), 1000, add_outliers=True, outlier_probability=0.05))
    changed = odd[plain != odd]
    assert len(changed) == 50
    distance = np.abs(changed - plain.mean()) / plain.std()
    assert distance.min() >= 3.0 - 1e-9 and distance.max() <= 5.0 + 1e-9


def test_noise_scales_with_the_column(spark):
    plain = column(spark, spec_of(Distribution("uniform", min_value=0.0, max_value=10.0)))
    noisy = column(spark, spec_of(Distribution("uniform", min_value=0.0, max_value=10.0), add_noise=True, noise_level=0.5))
    assert np.std(noisy - plain) == pytest.approx(0.5 * plain.std(), rel=0.03)


def test_bounds_hold_unless_later_steps_move_values(spark):
    dist = Distribution("normal", mean=35.0, std=12.0, min_value=18.0, max_value=80.0)
    x = column(spark, spec_of(dist))
    assert x.min() == 18.0 and x.max() <= 80.0
    assert column(spark, spec_of(dist, add_outliers=True)).min() < 18.0
    assert column(spark, spec_of(dist, add_outliers=True, clip_last=True)).min() >= 18.0


def test_explicit_zero_is_kept(spark):
    assert set(column(spark, spec_of(Distribution("normal", mean=0.0, std=0.0), 50))) == {0.0}


def test_category_follows_sorted_reference_values(spark):
    columns = [
        ColumnSpec("g", "categorical", Distribution(categories=["b", "a", "c"])),
        ColumnSpec("level", "categorical", Distribution(categories=["low", "high"]), correlation_with="g", correlation_strength=0.5),
        ColumnSpec("flag", "boolean", correlation_with="g", correlation_strength=0.9),
    ]
    got = set(rows(generate(spark, DatasetSpec(columns=columns, num_rows=300, consistency_level=1.0)).select("g", "level")))
    assert got == {("a", "low"), ("b", "high"), ("c", "low")}


def test_nulls_and_variants(spark):
    columns = [ColumnSpec("c", "categorical", nullable=True, null_probability=0.3), ColumnSpec("d", "categorical", null_probability=0.9), ColumnSpec("x")]
    df = generate(spark, DatasetSpec(columns=columns, num_rows=10000, consistency_level=0.8))
    got = one(df.agg(F.avg(F.col("c").isNull().cast("int")), F.avg(F.col("c").endswith("_var").cast("int")), F.count_if(F.col("d").isNull()), F.count_if(F.col("c") == "None_var")))
    assert got[0] == pytest.approx(0.3, abs=0.02) and got[1] == pytest.approx(0.2, abs=0.02)
    assert got[2] == 0 and got[3] == 0


def test_id_width_grows_past_its_padding(spark):
    columns = [ColumnSpec("i", "id", unique=True, id_format="{prefix}-{:02d}"), ColumnSpec("p", "id")]
    df = generate(spark, DatasetSpec(columns=columns, num_rows=120, consistency_level=1.0))
    assert one(df.agg(F.max(F.length("i"))))[0] == len("ID-119")
    assert one(df.agg(F.max("p")))[0] <= "ID_000095"
    single = generate(spark, DatasetSpec(columns=[ColumnSpec("p", "id")], num_rows=1, consistency_level=1.0))
    assert rows(single) == [("ID_000000",)]


def test_patterns(spark):
    df = spark.range(2).select(format_with_id("100% {} of {:03d}", F.col("id")).alias("t"))
    assert rows(df) == [("100% 0 of 000",), ("100% 1 of 001",)]
    with pytest.raises(SpecError):
        format_with_id("{unknown}", F.lit(1))


def test_rules(spark):
    df = spark.createDataFrame([(10.0, True, "x", 1), (70.0, False, "y", 2), (None, False, "z", 3)], "age double, flag boolean, name string, n int")
    ruled = apply_rules(df, ["if age > 65 then flag = on", "if age > 5 then n = 7", "if n > 6 then name = 'late'"])
    assert rows(ruled) == [(10.0, True, "late", 7), (70.0, True, "late", 7), (None, False, "z", 3)]
    for bad in ("if age < 5 then flag = true", "if age >= 5 then flag = true", "if nothing > 1 then flag = true", "age > 5"):
        with pytest.raises(SpecError):
            apply_rules(df, [bad])
        assert rows(apply_rules(df, [bad], lenient=True)) == rows(df)
    with pytest.raises(Exception):
        apply_rules(df, ["if age > 5 then n = seven"]).collect()


def test_template_shapes(spark):
    assert generate(spark, customer_data(50, as_of=AS_OF)).columns == ["customer_id", "age", "gender", "region", "registration_date", "income", "is_premium"]
    sales = generate(spark, sales_data(50, as_of=AS_OF))
    assert sales.columns[-3:] == ["quantity", "transaction_date_seasonal_factor", "transaction_date_trend_factor"]
    iot = generate(spark, iot_sensor_data(50, as_of=AS_OF))
    assert iot.columns == ["sensor_id", "timestamp", "temperature", "pressure", "light_level", "battery_level", "status", "humidity", "timestamp_seasonal_factor"]
    assert dict(iot.dtypes)["timestamp"] == "timestamp_ntz"
    with pytest.raises(SpecError):
        template("weather")


def test_spec_errors_and_json():
    with pytest.raises(SpecError):
        DatasetSpec(columns=[ColumnSpec("a", correlation_with="b", correlation_strength=0.5), ColumnSpec("b", correlation_with="a")])
    with pytest.raises(SpecError):
        Distribution("poisson")
    with pytest.raises(SpecError):
        DatasetSpec(columns=[ColumnSpec("a"), ColumnSpec("a")])
    spec = customer_data(10, as_of=AS_OF)
    again = DatasetSpec.from_json(spec.to_json())
    assert json.loads(again.to_json()) == json.loads(spec.to_json())


def test_findings(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, x double")
    spec = DatasetSpec(columns=[ColumnSpec("k", "id", unique=True), ColumnSpec("x")])
    got = {r["kind"]: r["value"] for r in check_generated(df, spec).collect()}
    assert got["duplicates"] == 1.0 and got["low_completeness"] == pytest.approx(4 / 6)
    assert check_generated(generate(spark, basic()), basic()).count() == 0


def test_many_and_create(spark):
    broken = DatasetSpec(columns=[ColumnSpec("a", distribution=Distribution("normal", std=0.0)), ColumnSpec("b", correlation_with="a", correlation_strength=0.5)], num_rows=10)
    tables, errors = generate_many(spark, {"good": basic(), "broken": broken})
    assert list(tables) == ["good"] and "broken" in errors
    made = create_dataset(spark, "customer_data", name="c", num_rows=60, benchmark=False, as_of=AS_OF)
    assert one(made.metadata)["num_rows"] == 60 and one(made.metadata)["num_columns"] == 7


def test_stream_gives_the_batch_rows(spark):
    spec = sales_data(200, as_of=AS_OF)
    compiled = compile_spec(spark, spec)
    path = fresh_path(spark, "ids")
    spark.range(200).write.parquet(path)
    ids = spark.readStream.schema("id long").parquet(path)
    run_to_table(generate_stream(compiled, ids, keep_id=True), f"{path}-out", f"{path}-check")
    assert sorted(rows(spark.read.parquet(f"{path}-out"))) == sorted(rows(compiled.apply(keep_id=True)))
