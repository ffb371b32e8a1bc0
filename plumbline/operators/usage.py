"""Usage accounting: tokens and cost, rate-limit windows, key status."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ordered import micros
from plumbline.session import quoted

# Price per 1000 prompt and completion tokens by model.
PRICES = {
    "gpt-4o": (5.0, 15.0),
    "gpt-4": (10.0, 30.0),
    "gpt-3.5-turbo": (0.5, 1.5),
}
DEFAULT_PRICE = (1.0, 2.0)
RATE_LIMIT = 100
STATE_MINUTES = 10


def token_usage(df: DataFrame, model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens",
                prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Calls, tokens and cost per model, and in the row ``*`` overall; unlisted models get the default price."""
    prices = PRICES if prices is None else prices
    grouped = df.groupBy(F.col(quoted(model)).alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col(quoted(prompt))).alias("prompt_tokens"), F.sum(F.col(quoted(completion))).alias("completion_tokens")
    )
    # one row per priced model
    listed = df.sparkSession.createDataFrame(
        [(m, float(p), float(c)) for m, (p, c) in prices.items()], "model string, prompt_price double, completion_price double"
    )
    priced = grouped.join(F.broadcast(listed), "model", "left")
    cost = F.col("prompt_tokens") / 1000.0 * F.coalesce("prompt_price", F.lit(DEFAULT_PRICE[0])) + F.col("completion_tokens") / 1000.0 * F.coalesce(
        "completion_price", F.lit(DEFAULT_PRICE[1])
    )
    by_model = priced.select(
        "model", "calls", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), cost.alias("cost")
    )
    measures = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "cost"]
    overall = by_model.agg(*[F.sum(m).alias(m) for m in measures]).select(F.lit("*").alias("model"), *measures)
    return by_model.unionByName(overall)


def whole_minute(ts: Column) -> Column:
    """The start of the minute, without going through a time zone."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), ts))


def whole_millisecond(ts: Column) -> Column:
    thousandths = F.extract(F.lit("SECOND"), ts) * 1000
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (thousandths - F.floor(thousandths)) / 1000)


def rate_limit_windows(events: DataFrame, client: str, ts: str, limit: int = RATE_LIMIT) -> DataFrame:
    """Requests per client and epoch minute, with ``limited`` when above the limit."""
    counted = events.groupBy(F.col(quoted(client)), F.window(F.col(quoted(ts)), "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(client, F.col("w.start").alias("minute"), "requests", (F.col("requests") > limit).alias("limited"))


def rate_limit_rejections(events: DataFrame, client: str, ts: str, event_id: str, limit: int = RATE_LIMIT) -> DataFrame:
    """The rejected events: those after the first ``limit`` of their client and minute.

    A minute with no more than ``limit`` requests rejects none, so only events of
    busy minutes are numbered; these are numbered millisecond by millisecond, with the
    count of the earlier ones added, so one busy second spreads over tasks.
    """
    minute, piece = whole_minute(F.col(quoted(ts))), whole_millisecond(F.col(quoted(ts)))
    keyed = events.withColumn("_minute", minute).withColumn("_piece", piece)
    pieces = keyed.groupBy(F.col(quoted(client)).alias("_client"), "_minute", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_client", "_minute")
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_client", "_minute", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"), "_n"
    )
    # milliseconds whose last request is still within the limit reject nothing
    busy = offsets.where((F.col("_all") > limit) & (F.col("_before") + F.col("_n") > limit)).drop("_all", "_n", "_minute")
    kept = keyed.join(busy, (keyed[quoted(client)] == busy["_client"]) & (keyed["_piece"] == busy["_piece"])).drop(busy["_piece"])
    order = Window.partitionBy(client, "_piece").orderBy(F.col(quoted(ts)), F.col(quoted(event_id)))
    numbered = kept.withColumn("number", (F.row_number().over(order) + F.col("_before")).cast("long"))
    return numbered.where(F.col("number") > limit).select(*events.columns, F.col("_minute").alias("minute"), "number")


def key_usage_stats(audit: DataFrame, keys: DataFrame, as_of: datetime, key: str, ts: str, failed: Column) -> DataFrame:
    """Requests in the last day and month, failed requests of the last day, active and total keys."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    t = F.col(quoted(ts))
    day = (t > now - F.expr("INTERVAL 1 DAY")) & (t <= now)
    month = (t > now - F.expr("INTERVAL 30 DAY")) & (t <= now)
    used = audit.agg(F.count_if(day).alias("requests_today"), F.count_if(month).alias("requests_month"), F.count_if(day & failed).alias("failed_requests"))
    counted = keys.agg(F.count_if(F.col("status") == "active").alias("a"), F.count(F.lit(1)).alias("t"))
    return used.select(
        "requests_today", "requests_month", counted.select("a").scalar().alias("active_keys"), "failed_requests", counted.select("t").scalar().alias("total_keys")
    )


def key_status(keys: DataFrame, audit: DataFrame, as_of: datetime, key: str, ts: str) -> DataFrame:
    """(key, usage_24h, verdict): revoked, expired, rate_limited (24 x the hourly limit) or ok.

    ``keys`` has (key, status, expires_at, rate_limit); requests are counted before they meet the keys.
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    t = F.col(quoted(ts))
    recent = audit.where((t > now - F.expr("INTERVAL 1 DAY")) & (t <= now)).groupBy(F.col(quoted(key))).agg(F.count(F.lit(1)).alias("usage_24h"))
    joined = keys.join(recent, key, "left").withColumn("usage_24h", F.coalesce("usage_24h", F.lit(0)))
    verdict = (
        F.when(F.col("status") != "active", F.col("status"))
        .when(F.col("expires_at").isNotNull() & (F.col("expires_at") < now), F.lit("expired"))
        .when((F.coalesce("rate_limit", F.lit(0)) > 0) & (F.col("usage_24h") >= F.col("rate_limit") * 24), F.lit("rate_limited"))
        .otherwise(F.lit("ok"))
    )
    return joined.select(key, "usage_24h", verdict.alias("verdict"))


class Bucket:
    """A client's tokens: refilled by time up to the capacity, one taken by each allowed request."""

    def __init__(self, capacity: float, per_second: float, tokens: float | None = None, at: int | None = None):
        self.capacity, self.rate, self.tokens, self.at = float(capacity), per_second / 1_000_000, float(capacity) if tokens is None else tokens, at

    def take(self, now: int) -> bool:
        """Whether a request at that microsecond is allowed; a time before the last one's refills nothing."""
        if self.at is not None and now > self.at:
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now if self.at is None else max(now, self.at)
        allowed = self.tokens >= 1
        self.tokens -= allowed
        return allowed

    def full_after(self) -> int:
        """Microseconds until it is as good as new."""
        return int((self.capacity - self.tokens) / self.rate) + 1


def token_bucket(events: DataFrame, client: str, ts: str, event_id: str, capacity: float, per_second: float) -> DataFrame:
    """The events and whether each is allowed: a client's bucket holds capacity tokens at most, gets per_second of them, and gives one an event.

    Events of a client are taken in the order of time and id.  One event's outcome rests on all before it, so a client's events go through one task, in
    sorted batches with nothing kept but the bucket; clients are spread.  Events without a time are not allowed, a null client is a client.
    """
    kind = dict(events.dtypes)[ts]
    timed = events.withColumn("_t", micros(F.col(quoted(ts)), kind)).withColumn("_client", F.xxhash64(F.coalesce(F.col(quoted(client)).cast("string"), F.lit("\0null"))))
    dealt = timed.repartition("_client").sortWithinPartitions("_client", quoted(client), F.col("_t"), F.col(quoted(event_id)))

    def run(batches):
        last, bucket = object(), None
        for batch in batches:
            names, times = batch.column(batch.schema.get_field_index(client)).to_pylist(), batch.column(batch.schema.get_field_index("_t")).to_pylist()
            allowed = []
            for name, t in zip(names, times, strict=True):
                if name != last:
                    last, bucket = name, Bucket(capacity, per_second)
                allowed.append(t is not None and bucket.take(t))
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_t", "_client")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(allowed, pa.bool_())], [*[batch.schema.names[i] for i in keep], "allowed"])

    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    return dealt.mapInArrow(run, schema)
