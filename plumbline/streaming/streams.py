"""Streaming forms of the generator, the rate limiter and the quality profile."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from plumbline.operators.profile import completeness, validity_by_column
from plumbline.operators.usage import RATE_LIMIT, STATE_MINUTES, Bucket
from plumbline.plans.generate import CompiledSpec
from plumbline.session import quoted


def rate_ids(spark: SparkSession, rows_per_second: int = 1000) -> DataFrame:
    """An unbounded stream of row ids 0, 1, 2, ..."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("id"))


def generate_stream(compiled: CompiledSpec, ids: DataFrame, keep_id: bool = False) -> DataFrame:
    """Rows for a stream of ids: the same rows a batch run gives for these ids.

    What the spec measures (moments, cutoffs) comes from the rows it was compiled over.
    """
    return compiled.apply(ids, keep_id=keep_id)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A parquet table of the folder read as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _instant(events: DataFrame, ts: str) -> Column:
    """A watermark needs an instant: local times are read as UTC, whatever the session's zone."""
    if dict(events.dtypes)[ts] != "timestamp_ntz":
        return F.col(quoted(ts))
    return F.expr("TIMESTAMP'1970-01-01 00:00:00Z'") + (F.col(quoted(ts)) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def _local(instant: Column, local: bool) -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + (instant - F.expr("TIMESTAMP'1970-01-01 00:00:00Z'")) if local else instant


def session_stream(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """(keys, begin, events) of the runs of a key's events less than gap apart, for output mode append.

    A session is given out when the watermark, late behind the newest event, has passed its last event by gap; events older than the watermark are dropped.
    """
    local = dict(events.dtypes)[ts] == "timestamp_ntz"
    timed = events.withColumn("_ts", _instant(events, ts)).withWatermark("_ts", late)
    found = timed.groupBy(*[F.col(quoted(k)) for k in keys], F.session_window("_ts", gap).alias("_w")).agg(F.count("*").alias("events"))
    return found.select(*[F.col(quoted(k)) for k in keys], _local(F.col("_w.start"), local).alias("begin"), "events")


class _Buckets(StatefulProcessor):
    """A bucket of tokens for each client; a timer forgets it when it would be full again."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.rate = capacity, per_second

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["at", "event"])
        known = self.bucket.get() if self.bucket.exists() else None
        bucket = Bucket(self.capacity, self.rate, *(known or ()))
        batch["allowed"] = [bucket.take(int(t)) for t in batch["at"]]
        self.bucket.update((bucket.tokens, bucket.at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((bucket.at + bucket.full_after()) // 1000 + 1)
        yield batch[["event", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def token_bucket_stream(events: DataFrame, client: str, ts: str, event_id: str, capacity: float, per_second: float, late: str = f"{STATE_MINUTES} minutes") -> DataFrame:
    """(event_id, allowed) as token_bucket() tells, for output mode append; events more than late behind the newest are dropped.

    A micro-batch's events of a client are put in order in memory; between batches a client's state is two numbers, dropped by a timer when the bucket
    would be full again.  Events without a time are left out.  Keyed state with timers needs the RocksDB store, which is set for the session.
    """
    events.sparkSession.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.filter(F.col(quoted(ts)).isNotNull()).withColumn("_ts", _instant(events, ts)).withWatermark("_ts", late)
    # Columns that begin with an underscore lose their names on the way to a processor.
    client_name = F.coalesce(F.col(quoted(client)).cast("string"), F.lit("\0null")).alias("client")
    slim = timed.select(client_name, F.col(quoted(event_id)).alias("event"), F.col("_ts").alias("instant"), F.unix_micros("_ts").alias("at"))
    kind = T.StructType([T.StructField("event", events.schema[event_id].dataType), T.StructField("allowed", T.BooleanType())])
    return slim.groupBy("client").transformWithStateInPandas(_Buckets(capacity, per_second), kind, "Append", "EventTime").withColumnRenamed("event", event_id)


def rate_limit_stream(events: DataFrame, client: str, ts: str, limit: int = RATE_LIMIT) -> DataFrame:
    """Requests per client and minute; state more than 10 minutes behind the newest event is dropped."""
    local = dict(events.dtypes)[ts] == "timestamp_ntz"
    timed = events.withColumn("_ts", _instant(events, ts)).withWatermark("_ts", f"{STATE_MINUTES} minutes")
    counted = timed.groupBy(F.col(quoted(client)), F.window("_ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(client, _local(F.col("w.start"), local).alias("minute"), "requests", (F.col("requests") > limit).alias("limited"))


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is available to a parquet table, then stop."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write each micro-batch's updated rows with its ``batch_id``; rewriting a batch replaces its own folder only."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of a table written by ``run_updates``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = updates.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.max_by(F.struct(*[F.col(quoted(c)) for c in rest]), F.col("batch_id")).alias("_v"))
    return newest.select(*keys, "_v.*")


def quality_stream(events: DataFrame, path: str, checkpoint: str) -> None:
    """Completeness and validity of every micro-batch, kept as rows (batch_id, metric, column, value)."""

    def save(batch: DataFrame, batch_id: int) -> None:
        filled = completeness(batch).select(F.lit("completeness").alias("metric"), "column", F.col("completeness").alias("value"))
        valid = validity_by_column(batch).select(F.lit("validity").alias("metric"), "column", F.col("validity").alias("value"))
        filled.unionByName(valid).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
