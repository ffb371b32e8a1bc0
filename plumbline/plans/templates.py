"""The three ready-made dataset specs."""

from __future__ import annotations

from datetime import datetime, timedelta

from plumbline.plans.spec import ColumnSpec, DatasetSpec, Distribution, SpecError

# Fixed values below: names, weights, bounds, formats and rules of the three tables.


def _now(as_of: datetime | None) -> datetime:
    return as_of or datetime.now().replace(microsecond=0)


def customer_data(num_rows: int = 1000, seed: int = 42, as_of: datetime | None = None) -> DatasetSpec:
    end = _now(as_of)
    return DatasetSpec(
        num_rows=num_rows,
        seed=seed,
        as_of=end,
        columns=[
            ColumnSpec("customer_id", "id", unique=True, id_prefix="CUST", id_format="{prefix}_{:08d}"),
            ColumnSpec("age", distribution=Distribution("normal", mean=35.0, std=12.0, min_value=18.0, max_value=80.0)),
            ColumnSpec("income", distribution=Distribution("lognormal", mean=10.5, std=0.8, min_value=20000.0),
                       correlation_with="age", correlation_strength=0.3),
            ColumnSpec("gender", "categorical",
                       Distribution(categories=["Male", "Female", "Other"], weights=[0.48, 0.48, 0.04])),
            ColumnSpec("region", "categorical",
                       Distribution(categories=["North", "South", "East", "West", "Central"],
                                    weights=[0.2, 0.25, 0.15, 0.25, 0.15])),
            ColumnSpec("registration_date", "datetime", datetime_start=end - timedelta(days=365 * 3), datetime_end=end),
            ColumnSpec("is_premium", "boolean", Distribution(parameters={"prob_true": 0.3}),
                       correlation_with="income", correlation_strength=0.4),
        ],
        add_outliers=True,
        outlier_probability=0.02,
        business_rules=["if age > 65 then is_premium = True", "if income > 100000 then is_premium = True"],
    )


def sales_data(num_rows: int = 5000, seed: int = 42, as_of: datetime | None = None) -> DatasetSpec:
    end = _now(as_of)
    return DatasetSpec(
        num_rows=num_rows,
        seed=seed,
        as_of=end,
        columns=[
            ColumnSpec("transaction_id", "id", unique=True, id_prefix="TXN", id_format="{prefix}_{:010d}"),
            ColumnSpec("customer_id", "id", id_prefix="CUST", id_format="{prefix}_{:08d}"),
            ColumnSpec("product_category", "categorical",
                       Distribution(categories=["Electronics", "Clothing", "Books", "Home", "Sports", "Beauty"],
                                    weights=[0.25, 0.20, 0.15, 0.15, 0.15, 0.10])),
            ColumnSpec("amount", distribution=Distribution(
                "gamma", parameters={"shape": 2.0, "scale": 50.0}, min_value=10.0, max_value=2000.0)),
            ColumnSpec("quantity", distribution=Distribution(
                "gamma", parameters={"shape": 1.5, "scale": 2.0}, min_value=1.0, max_value=20.0),
                correlation_with="amount", correlation_strength=0.6),
            ColumnSpec("transaction_date", "datetime", datetime_start=end - timedelta(days=365), datetime_end=end),
            ColumnSpec("payment_method", "categorical",
                       Distribution(categories=["Credit Card", "Debit Card", "PayPal", "Cash", "Bank Transfer"],
                                    weights=[0.35, 0.25, 0.20, 0.10, 0.10])),
            ColumnSpec("discount_applied", "boolean", Distribution(parameters={"prob_true": 0.25})),
        ],
        add_temporal_patterns=True,
        seasonality="monthly",
        trend="increasing",
        business_rules=["if amount > 500 then discount_applied = True", "if quantity > 10 then discount_applied = True"],
    )


def iot_sensor_data(num_rows: int = 10000, seed: int = 42, as_of: datetime | None = None) -> DatasetSpec:
    end = _now(as_of)
    return DatasetSpec(
        num_rows=num_rows,
        seed=seed,
        as_of=end,
        columns=[
            ColumnSpec("sensor_id", "id", id_prefix="SENSOR", id_format="{prefix}_{:04d}"),
            ColumnSpec("timestamp", "datetime", datetime_start=end - timedelta(days=30), datetime_end=end),
            ColumnSpec("temperature", distribution=Distribution(
                "normal", mean=22.0, std=5.0, min_value=-10.0, max_value=50.0)),
            ColumnSpec("humidity", distribution=Distribution(
                "beta", parameters={"alpha": 2.0, "beta": 2.0}, min_value=0.0, max_value=100.0),
                correlation_with="temperature", correlation_strength=-0.3),
            ColumnSpec("pressure", distribution=Distribution(
                "normal", mean=1013.25, std=20.0, min_value=950.0, max_value=1050.0)),
            ColumnSpec("light_level", distribution=Distribution(
                "gamma", parameters={"shape": 2.0, "scale": 200.0}, min_value=0.0, max_value=2000.0)),
            ColumnSpec("battery_level", distribution=Distribution(
                "beta", parameters={"alpha": 3.0, "beta": 1.5}, min_value=0.0, max_value=100.0)),
            ColumnSpec("status", "categorical",
                       Distribution(categories=["Online", "Offline", "Maintenance", "Error"],
                                    weights=[0.85, 0.10, 0.03, 0.02])),
        ],
        add_temporal_patterns=True,
        seasonality="daily",
        add_noise=True,
        noise_level=0.05,
        add_outliers=True,
        outlier_probability=0.01,
        # the first rule has no supported form and never fires
        business_rules=["if battery_level < 10 then status = 'Error'", "if temperature > 40 then status = 'Error'"],
        lenient_rules=True,
    )


TEMPLATES = {"customer_data": customer_data, "sales_data": sales_data, "iot_sensor_data": iot_sensor_data}


def template(name: str, **settings) -> DatasetSpec:
    if name not in TEMPLATES:
        raise SpecError(f"unknown template: {name}")
    return TEMPLATES[name](**settings)
