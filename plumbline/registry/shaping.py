"""Shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import shaping as S
from plumbline.registry.base import gappy_events, GAPPY_EVENTS, load, r6, rounded, text_time, union


def as_text(s, d):
    """events with every column as text, the way a schema-less record list arrives."""
    return load(s, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("value").cast("string").alias("value"),
        text_time(F.col("ts")).alias("ts"),
        "event_type",
        F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("label"),
    )


def inferred_summary(s, d):
    df = S.infer_types(as_text(s, d))
    return df.agg(
        F.sum("event_id").alias("id_sum"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        text_time(F.min("ts")).alias("first_ts"),
        F.count("label").alias("labels"),
    )


def downcast_summary(s, d):
    df = S.downcast_types(load(s, d, "lineitem"))
    kinds = dict(df.dtypes)
    return df.agg(
        F.sum(F.col("l_linenumber").cast("long")).alias("line_sum"),
        F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity_sum"),
        F.lit(kinds["l_linenumber"]).alias("line_type"),
        F.lit(kinds["l_quantity"]).alias("quantity_type"),
        F.lit(kinds["l_extendedprice"]).alias("price_type"),
        F.max(F.col("l_orderkey").cast("long")).alias("max_order"),
    )


QUERIES = {
    "nested_to_json": lambda s, d: S.nested_to_json(
        load(s, d, "events").select("event_id", F.struct("user_id", "event_type").alias("who"), F.array("user_id", "event_id").alias("ids"))
    ),
    "infer_types": lambda s, d: S.inferred_types(as_text(s, d)),
    "infer_types_cast": inferred_summary,
    "downcast_types": lambda s, d: S.downcast_plan(load(s, d, "lineitem")),
    "downcast_types_cast": downcast_summary,
    "filter_where": lambda s, d: rounded(
        S.filter_where(load(s, d, "lineitem"), "l_quantity < 10 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00'")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    ),
    "impute_mean": lambda s, d: rounded(S.impute_mean(gappy_events(s, d).select("event_id", "value"), ["value"])),
    "standardize": lambda s, d: rounded(
        S.standardize(load(s, d, "orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("constant")), ["o_totalprice", "constant"])
    ),
    "label_encode": lambda s, d: S.label_encode(gappy_events(s, d).select("event_id", "props"), "props", "label"),
    "preview_rows": lambda s, d: S.preview_rows(load(s, d, "documents").select("doc_id", "text", "lang"), ["doc_id"]),
    "page_rows": lambda s, d: S.page_rows(load(s, d, "customer"), ["c_acctbal", "c_custkey"], 25, 50).select("c_custkey", "c_name"),
    "mask_middle": lambda s, d: load(s, d, "customer").select(
        "c_custkey", S.mask_middle(F.col("c_name")).alias("masked_name"), S.mask_middle(F.col("c_mktsegment")).alias("masked_segment"),
        S.mask_middle(F.substring("c_name", 1, 6)).alias("masked_short"),
    ),
    "sample_rows": lambda s, d: S.sample_rows(load(s, d, "events"), "event_id", 777).select("event_id", "user_id"),
}

from plumbline.registry.sqldraws import signed_order_sql  # noqa: E402

ORACLE = {
    "nested_to_json": """SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS who, '[' || user_id || ',' || event_id || ']' AS ids FROM events""",
    "infer_types": """SELECT 'event_id' AS "column", 'bigint' AS inferred WHERE (SELECT bool_and(TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT) IS NOT NULL) FROM events)
UNION ALL SELECT 'value', 'double' WHERE (SELECT bool_and(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL) AND NOT bool_and(regexp_matches(CAST(value AS VARCHAR), '^[0-9]+$')) FROM events)
UNION ALL SELECT 'ts', 'timestamp_ntz' WHERE (SELECT bool_and(TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) IS NOT NULL) FROM events)
UNION ALL SELECT 'event_type', CASE WHEN (SELECT count(DISTINCT event_type) / count(*) FROM events) < 0.5 THEN 'category' ELSE 'string' END
UNION ALL SELECT 'label', CASE WHEN (SELECT count(DISTINCT event_type || '-' || event_id) / count(*) FROM events) < 0.5 THEN 'category' ELSE 'string' END""",
    "infer_types_cast": f"""SELECT CAST(sum(event_id) AS BIGINT) AS id_sum, {r6('sum(value)', 4)} AS value_sum, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, count(*) AS labels FROM events""",
    "downcast_types": union(
        [f"""SELECT '{c}' AS "column", CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS target FROM lineitem""" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
        + [f"SELECT '{c}', CASE WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float' ELSE 'double' END FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]),
    "downcast_types_cast": f"""SELECT CAST(sum(l_linenumber) AS BIGINT) AS line_sum, {r6('sum(l_quantity)', 2)} AS quantity_sum, 'tinyint' AS line_type, 'float' AS quantity_type, 'double' AS price_type, max(l_orderkey) AS max_order FROM lineitem""",
    "filter_where": f"""SELECT l_orderkey, l_linenumber, l_partkey, {r6('l_quantity')} AS l_quantity, {r6('l_extendedprice')} AS l_extendedprice FROM lineitem
WHERE l_quantity < 10 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'""",
    "impute_mean": f"WITH {GAPPY_EVENTS} SELECT event_id, {r6('coalesce(value, (SELECT avg(value) FROM g))')} AS value FROM g",
    "standardize": f"SELECT o_orderkey, {r6('(o_totalprice - m) / s')} AS o_totalprice, 0.0::DOUBLE AS constant FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)",
    "label_encode": f"WITH {GAPPY_EVENTS}, t AS (SELECT event_id, props, coalesce(props, 'nan') AS p FROM g) SELECT event_id, props, dense_rank() OVER (ORDER BY p) - 1 AS label FROM t",
    "preview_rows": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS text, lang FROM documents ORDER BY documents.doc_id LIMIT 5""",
    "page_rows": "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 50",
    "mask_middle": "SELECT c_custkey, " + ", ".join(
        f"CASE WHEN length({e}) <= 8 THEN repeat('*', length({e})) ELSE substr({e}, 1, 4) || repeat('*', length({e}) - 8) || substr({e}, length({e}) - 3, 4) END AS {n}"
        for e, n in (("c_name", "masked_name"), ("c_mktsegment", "masked_segment"), ("substr(c_name, 1, 6)", "masked_short"))) + " FROM customer",
    "sample_rows": f"SELECT event_id, user_id FROM events ORDER BY {signed_order_sql(42, 'sample', 'pick', 'event_id')} LIMIT 777",
}
