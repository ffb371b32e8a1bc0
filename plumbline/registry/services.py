"""Vector, catalog, usage, streaming and user-function queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from plumbline.functions.vectors import cosine, norm
from plumbline.operators import catalog as C
from plumbline.operators import usage as U
from plumbline.operators import vectors as E
from plumbline.operators.laterals import generate_rows
from plumbline.plans.generate import compile_spec
from plumbline.plans.spec import ColumnSpec, DatasetSpec, Distribution
from plumbline.registry.base import load, r6, rounded, text_time, union
from plumbline.registry.sqldraws import SqlDraws
from plumbline.session import fresh_path
from plumbline.streaming import streams as S

AS_OF = datetime(2024, 1, 20, 12)


def vectors(s, d):
    """embeddings with the label as source type; label 3 has zero vectors."""
    e = load(s, d, "embeddings")
    zero = F.transform("embedding", lambda x: (x * F.lit(0)).cast("float"))
    return e.select("vec_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("source_type"), F.when(F.col("label") == 3, zero).otherwise(F.col("embedding")).alias("vector"))


VECTORS = "v AS (SELECT vec_id, 'label_' || label AS source_type, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS vector FROM embeddings)"


def sql_cosine(a: str, b: str) -> str:
    return f"CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) = 0 OR list_sum(list_transform({b}, lambda x: x * x)) = 0 THEN 0.0::DOUBLE ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"


def query_vector(s, d):
    return load(s, d, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


def stored(s, d):
    path = fresh_path(s, "vectors")
    rows = E.embedding_rows(vectors(s, d), "vector", F.col("source_type"), F.col("vec_id"), "toy", F.to_json(F.struct("vec_id")))
    E.store_embeddings(rows, path)
    return s.read.parquet(path).groupBy("source_type").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("n"), F.max("dimensions").alias("dimensions"))


def topk_batch(s, d):
    base = vectors(s, d)
    queries = base.groupBy(F.col("source_type").alias("query_id")).agg(F.min_by("vector", "vec_id").alias("vector"))
    found = E.vector_topk_batch(base, queries, 5, "vector", "vec_id")
    return rounded(found.withColumn("place", F.col("place").cast("long")))


def topk_of_every_row(s, d):
    """Every vector as a query, its own row among the found."""
    base = vectors(s, d)
    found = E.vector_topk_batch(base, base.select(F.col("vec_id").alias("query_id"), "vector"), 3, "vector", "vec_id", block_bytes=1 << 16)
    return rounded(found.withColumn("place", F.col("place").cast("long")))


def usage_rows(s, d):
    e = load(s, d, "events")
    models = F.create_map(*[F.lit(x) for pair in {"click": "gpt-4o", "view": "gpt-4", "purchase": "gpt-3.5-turbo", "error": "other"}.items() for x in pair])
    return e.select(
        F.coalesce(F.try_element_at(models, F.col("event_type")), F.lit("unlisted")).alias("model"),
        (F.col("event_id") % 1000).alias("prompt_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("completion_tokens"),
    )


def windows(s, d):
    return U.rate_limit_windows(load(s, d, "events"), "event_type", "ts", 1).withColumn("minute", text_time(F.col("minute")))


def rejections(s, d):
    out = U.rate_limit_rejections(load(s, d, "events"), "event_type", "ts", "event_id", 1)
    return out.select("event_id", "event_type", text_time(F.col("minute")).alias("minute"), "number")


def windows_streamed(s, d):
    events = load(s, d, "events")
    stream = S.table_stream(s, d, "events", events.schema)
    path = fresh_path(s, "windows")
    S.run_updates(S.rate_limit_stream(stream, "event_type", "ts", 1), f"{path}/rows", f"{path}/checkpoint")
    return S.latest(s.read.parquet(f"{path}/rows"), ["event_type", "minute"]).withColumn("minute", text_time(F.col("minute")))


def quality_streamed(s, d):
    events = load(s, d, "events")
    path = fresh_path(s, "quality")
    S.quality_stream(S.table_stream(s, d, "events", events.schema), f"{path}/rows", f"{path}/checkpoint")
    return s.read.parquet(f"{path}/rows").drop("batch_id")


STREAM_SPEC = DatasetSpec(
    columns=[ColumnSpec("x", distribution=Distribution("normal", mean=10.0, std=2.0)), ColumnSpec("c", "categorical", Distribution(categories=["a", "b"], weights=[0.7, 0.3]))],
    consistency_level=1.0,
)


def generated_stream(s, d):
    orders = load(s, d, "orders")
    spec = DatasetSpec(columns=STREAM_SPEC.columns, num_rows=orders.count(), consistency_level=1.0)
    compiled = compile_spec(s, spec, orders.select("o_orderkey"), "o_orderkey")
    ids = S.table_stream(s, d, "orders", orders.schema).select("o_orderkey")
    path = fresh_path(s, "stream")
    S.run_to_table(S.generate_stream(compiled, ids, keep_id=True), f"{path}/rows", f"{path}/checkpoint")
    return rounded(s.read.parquet(f"{path}/rows"))


def keys_table(s, d):
    """One key per user, with states that follow the user number."""
    u = load(s, d, "events").select("user_id").distinct()
    n = F.col("user_id")
    return u.select(
        "user_id",
        F.when(n % 7 == 0, F.lit("revoked")).otherwise(F.lit("active")).alias("status"),
        F.when(n % 5 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).when(n % 3 == 0, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).alias("expires_at"),
        F.when(n % 2 == 0, F.lit(0.1)).alias("rate_limit"),
    )


KEYS = """k AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-01-15' WHEN user_id % 3 = 0 THEN TIMESTAMP '2025-01-01' END AS expires_at,
CASE WHEN user_id % 2 = 0 THEN 0.1 END AS rate_limit FROM (SELECT DISTINCT user_id FROM events))"""


def appended(s, d):
    """Two appends with differing columns, read back."""
    c = load(s, d, "customer")
    path = fresh_path(s, "table")
    name = f"t {uuid.uuid4().hex}"
    first = C.append_rows(c.select("c_custkey", "c_name", "c_acctbal"), name, path)
    C.append_rows(c.select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal")), name)
    s.sql(f"DROP TABLE {first}")
    return rounded(s.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count("c_name").alias("names"), F.sum("c_acctbal").alias("balance"), F.count_distinct("c_custkey").alias("ids")), 2)


def generated_table(s, d):
    orders = load(s, d, "orders")
    registry = C.GeneratorRegistry()

    def priced(spark, parameters):
        spec = DatasetSpec(columns=[ColumnSpec("price", distribution=Distribution("uniform", min_value=0.0, max_value=parameters["top"]))], num_rows=orders.count())
        from plumbline.plans.generate import generate

        return generate(spark, spec, orders.select("o_orderkey"), "o_orderkey", keep_id=True)

    registry.register("priced", priced, {"type": "object", "required": ["top"]})
    path = fresh_path(s, "generated")
    name, added, first = C.generate_to_table(s, registry, "priced", {"top": 50.0}, f"g_{uuid.uuid4().hex}", ["o_orderkey"], path)
    s.sql(f"DROP TABLE {name}")
    return rounded(first.withColumn("rows_added", F.lit(added).cast("long")))


def turn_replies(wanted):
    """A user-defined generator: one message for each wanted turn."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = lambda c: wanted[c].combine_chunks().cast(pa.string())
    message = pc.binary_join_element_wise("conversation ", text("conv_id"), " turn ", text("row_no"), "")
    return {"turn_no": wanted["row_no"].combine_chunks().cast(pa.int32()), "message": message}


def replied(s, d):
    requests = load(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return generate_rows(requests, turn_replies, "turn_no int, message string", "turns").drop("row_no", "error")


def steps(wanted):
    """Values that rise from low by the row's number over the rows wanted."""
    import pyarrow.compute as pc

    n = pc.cast(wanted["copies"], "double")
    return {"reading": pc.add(wanted["low"], pc.divide(pc.cast(wanted["row_no"], "double"), n)).combine_chunks()}


def stepped(s, d):
    """Events as requests, of which some break the generator's parameter schema."""
    requests = load(s, d, "events").select("event_id", "event_type", (F.col("event_id") % 4).alias("copies"), F.col("value").alias("low"))
    schema = {"type": "object", "required": ["low"], "properties": {"low": {"type": "number", "minimum": 5}, "event_type": {"enum": ["click", "view", "purchase", "signup"]}}}
    made = generate_rows(requests, steps, "reading double", "copies", schema, slice_rows=2)
    return rounded(made.withColumn("valid", F.col("error").isNull()).drop("error", "low"))


def modelled(s, d):
    def summarize(texts):
        if any(len(t) % 10 == 0 for t in texts):
            raise ValueError("length divisible by ten")
        return [f"{len(t)} characters" for t in texts]

    docs = load(s, d, "documents").select("doc_id", "text")
    out = C.map_with_model(docs, summarize, "text", retries=0)
    return out.select("doc_id", "reply")


JOINED = """SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS n, round(sum(o.o_totalprice), 2) AS total, CAST(max(r.r) AS BIGINT) AS best
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) r ON r.o_orderkey = o.o_orderkey
WHERE o.o_totalprice > :floor GROUP BY c.c_mktsegment, o.o_orderstatus"""

QUERIES = {
    "store_embeddings": stored,
    "cosine_similarity": lambda s, d: rounded(vectors(s, d).select("vec_id", cosine(F.col("vector"), F.reverse("vector")).alias("similarity"))),
    "vector_topk": lambda s, d: rounded(
        E.vector_topk(vectors(s, d), "vector", query_vector(s, d), 10, "vec_id", F.col("source_type") != "label_1").select("vec_id", "source_type", "similarity")),
    "vector_topk_batch": topk_batch,
    "vector_topk_every_row": topk_of_every_row,
    "vector_norm": lambda s, d: rounded(vectors(s, d).select("vec_id", norm(F.col("vector")).alias("norm"))),
    "append_rows": appended,
    "sql_query": lambda s, d: C.sql_query(s, JOINED, {"floor": 100000}, orders=load(s, d, "orders"), customer=load(s, d, "customer")),
    "table_stats": lambda s, d: C.table_stats({t: load(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")}),
    "generate_to_dataset": generated_table,
    "token_usage": lambda s, d: rounded(U.token_usage(usage_rows(s, d)), 4),
    "rate_limit_windows": windows,
    "rate_limit_rejections": rejections,
    "rate_limit_stream": windows_streamed,
    "key_usage_stats": lambda s, d: U.key_usage_stats(load(s, d, "events"), keys_table(s, d), AS_OF, "user_id", "ts", F.col("event_type") == "error"),
    "key_status": lambda s, d: U.key_status(keys_table(s, d), load(s, d, "events"), AS_OF, "user_id", "ts"),
    "quality_stream": quality_streamed,
    "generate_stream": generated_stream,
    "generator_udtf": replied,
    "generator_requests": stepped,
    "map_with_model": modelled,
}

_models = "CASE event_type WHEN 'click' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-4' WHEN 'purchase' THEN 'gpt-3.5-turbo' WHEN 'error' THEN 'other' ELSE 'unlisted' END"
_WINDOWS = "SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS minute, count(*) AS requests, count(*) > 1 AS limited FROM events GROUP BY 1, 2"
_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_day = "ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
_d = lambda n: SqlDraws(42, f"{n}/value", "o_orderkey")

ORACLE = {
    "store_embeddings": f"WITH {VECTORS} SELECT source_type, count(DISTINCT vec_id) AS ids, count(*) AS n, CAST(max(len(vector)) AS INTEGER) AS dimensions FROM v GROUP BY source_type",
    "cosine_similarity": f"WITH {VECTORS} SELECT vec_id, {r6(sql_cosine('vector', 'list_reverse(vector)'))} AS similarity FROM v",
    "vector_topk": f"""WITH {VECTORS}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id, source_type, {sql_cosine('vector', 'q')} AS sim FROM v, q WHERE source_type <> 'label_1')
SELECT vec_id, source_type, {r6('sim')} AS similarity FROM c ORDER BY sim DESC, vec_id LIMIT 10""",
    "vector_topk_batch": f"""WITH {VECTORS}, q AS (SELECT source_type AS query_id, arg_min(vector, vec_id) AS q FROM v GROUP BY 1), c AS (SELECT query_id, vec_id, round({sql_cosine('vector', 'q')}, 12) AS sim FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM c) SELECT query_id, vec_id, {r6('sim')} AS similarity, place FROM r WHERE place <= 5""",
    "vector_topk_every_row": f"""WITH {VECTORS}, q AS (SELECT vec_id AS query_id, vector AS q FROM v), c AS (SELECT query_id, vec_id, round({sql_cosine('vector', 'q')}, 12) AS sim FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM c) SELECT query_id, vec_id, {r6('sim')} AS similarity, place FROM r WHERE place <= 3""",
    "vector_norm": f"WITH {VECTORS} SELECT vec_id, {r6('sqrt(list_sum(list_transform(vector, lambda x: x * x)))')} AS norm FROM v",
    "append_rows": f"SELECT 2 * count(*) AS n, count(*) AS names, {r6('sum(c_acctbal) * 2', 2)} AS balance, count(*) AS ids FROM customer",
    "sql_query": JOINED.replace("{orders}", "orders").replace("{customer}", "customer").replace(":floor", "100000"),
    "table_stats": union([f"""SELECT '{t}' AS "table", count(*) AS rows, '{c}' AS columns FROM {t}""" for t, c in {
        "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
        "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal", "part": "p_partkey, p_name, p_brand, p_type, p_size", "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate",
        "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity", "events": "event_id, ts, user_id, event_type, value", "documents": "doc_id, text, lang, source, n_chars"}.items()]),
    "token_usage": f"""WITH x AS (SELECT {_models} AS model, event_id % 1000 AS p, CAST(floor(value * 10) AS BIGINT) AS c FROM events),
g AS (SELECT model, count(*) AS calls, CAST(sum(p) AS BIGINT) AS p, CAST(sum(c) AS BIGINT) AS c FROM x GROUP BY model),
k AS (SELECT *, p / 1000 * CASE model WHEN 'gpt-4o' THEN 5.0 WHEN 'gpt-4' THEN 10.0 WHEN 'gpt-3.5-turbo' THEN 0.5 ELSE 1.0 END + c / 1000 * CASE model WHEN 'gpt-4o' THEN 15.0 WHEN 'gpt-4' THEN 30.0 WHEN 'gpt-3.5-turbo' THEN 1.5 ELSE 2.0 END AS cost FROM g)
SELECT model, calls, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, {r6('cost', 4)} AS cost FROM k
UNION ALL SELECT '*', CAST(sum(calls) AS BIGINT), CAST(sum(p) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(p + c) AS BIGINT), {r6('sum(cost)', 4)} FROM k""",
    "rate_limit_windows": _WINDOWS,
    "rate_limit_rejections": """SELECT event_id, event_type, strftime(m, '%Y-%m-%d %H:%M:%S.%f') AS minute, number FROM (SELECT *, date_trunc('minute', ts) AS m, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS number FROM events) WHERE number > 1""",
    "rate_limit_stream": _WINDOWS,
    "key_usage_stats": f"""WITH {KEYS} SELECT count(*) FILTER (WHERE {_day}) AS requests_today, count(*) FILTER (WHERE ts > TIMESTAMP '2023-12-21 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS requests_month,
(SELECT count(*) FILTER (WHERE status = 'active') FROM k) AS active_keys, count(*) FILTER (WHERE event_type = 'error' AND {_day}) AS failed_requests, (SELECT count(*) FROM k) AS total_keys FROM events""",
    "key_status": f"""WITH {KEYS}, u AS (SELECT user_id, count(*) AS n FROM events WHERE {_day} GROUP BY 1) SELECT k.user_id, coalesce(u.n, 0) AS usage_24h,
CASE WHEN status <> 'active' THEN status WHEN expires_at < TIMESTAMP '2024-01-20 12:00:00' THEN 'expired' WHEN rate_limit > 0 AND coalesce(u.n, 0) >= rate_limit * 24 THEN 'rate_limited' ELSE 'ok' END AS verdict FROM k LEFT JOIN u USING (user_id)""",
    "quality_stream": union([f"""SELECT 'completeness' AS metric, '{c}' AS "column", count({c}) / count(*) AS value FROM events""" for c in _EVENT_COLUMNS]
        + [f"SELECT 'completeness', '*', ({' + '.join(f'count({c})' for c in _EVENT_COLUMNS)}) / ({len(_EVENT_COLUMNS)} * count(*)) FROM events"]
        + [f"SELECT 'validity', '{c}', CASE WHEN count({c}) = 0 THEN 0.0 ELSE 1.0 END FROM events" for c in ("event_id", "ts", "user_id")]
        + ["SELECT 'validity', 'value', count(CASE WHEN isfinite(value) THEN 1 END) / count(value) FROM events"]
        + [f"SELECT 'validity', '{c}', count(CASE WHEN regexp_matches({c}, '^[^\\x00-\\x1f]*\\n?$') THEN 1 END) / count({c}) FROM events" for c in ("event_type", "props")]),
    "generate_to_dataset": f"""SELECT o_orderkey, {r6(f"least(greatest({SqlDraws(42, 'price/value', 'o_orderkey').uniform('x', 0.0, 50.0)}, 0.0), 50.0)")} AS price, (SELECT count(*) FROM orders) AS rows_added FROM orders ORDER BY o_orderkey LIMIT 3""",
    "generate_stream": f"SELECT o_orderkey, {r6(_d('x').normal('x', 10.0, 2.0))} AS x, CASE WHEN {_d('c').unit('x')} < 0.7::DOUBLE THEN 'a' ELSE 'b' END AS c FROM orders",
    "generator_udtf": "SELECT conv_id, turns, CAST(i AS INTEGER) AS turn_no, 'conversation ' || conv_id || ' turn ' || i AS message FROM (SELECT conv_id, count(*) AS turns, unnest(range(count(*))) AS i FROM conversations GROUP BY conv_id)",
    "generator_requests": f"""WITH r AS (SELECT event_id, event_type, event_id % 4 AS copies, value AS low, value >= 5 AND event_type IN ('click', 'view', 'purchase', 'signup') AS valid FROM events)
SELECT event_id, event_type, copies, i AS row_no, {r6('low + i / copies')} AS reading, valid FROM (SELECT *, unnest(range(copies)) AS i FROM r WHERE valid)
UNION ALL SELECT event_id, event_type, copies, NULL, NULL, false FROM r WHERE NOT valid""",
    "map_with_model": "SELECT doc_id, CASE WHEN length(text) % 10 = 0 THEN 'Error generating content: length divisible by ten' ELSE length(text) || ' characters' END AS reply FROM documents",
}
