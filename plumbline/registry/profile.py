"""Profile queries on events, line items, orders, documents, customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.registry.base import GAPPY_COLUMNS, GAPPY_EVENTS, LINE_NUMBERS, gappy_events, load, r6, rounded, union

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMERIC = LINE_COLUMNS[:8]
LINE_TYPES = ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


def lineitem(s, d):
    return load(s, d, "lineitem")


def orders(s, d):
    return load(s, d, "orders")


def papers_like(s, d):
    """documents with a word list, a source that is sometimes missing, and a year from the id."""
    docs = load(s, d, "documents")
    return docs.select(
        "doc_id",
        "text",
        F.when(F.col("lang") != "fr", F.col("source")).alias("source"),
        F.col("lang").alias("domain"),
        (F.lit(2000) + F.col("n_chars") % 25).cast("int").alias("year"),
        F.when(F.col("lang") != "de", F.split("source", "r")).alias("authors"),
    )


QUERIES = {
    "completeness": lambda s, d: rounded(P.completeness(gappy_events(s, d))),
    "null_counts": lambda s, d: P.null_counts(gappy_events(s, d)),
    "uniqueness_by_column": lambda s, d: rounded(P.uniqueness_by_column(lineitem(s, d))),
    "uniqueness_score": lambda s, d: rounded(P.uniqueness_score(gappy_events(s, d))),
    "duplicate_rows": lambda s, d: rounded(P.duplicate_rows(lineitem(s, d).select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))),
    "string_consistency": lambda s, d: rounded(P.string_consistency(load(s, d, "documents"))),
    "numeric_consistency": lambda s, d: rounded(P.numeric_consistency(lineitem(s, d))),
    "consistency_score": lambda s, d: rounded(
        P.consistency_score(
            orders(s, d).select("o_orderstatus", F.split("o_orderpriority", "-")[0].alias("priority"), F.col("o_totalprice").cast("string").alias("price"), "o_orderdate"),
            {"o_orderstatus": "int", "priority": "int", "price": "smallint"},
        )
    ),
    "validity_score": lambda s, d: rounded(P.validity_by_column(gappy_events(s, d))),
    "encoding_issues": lambda s, d: P.encoding_issues(load(s, d, "documents")),
    "describe_numeric": lambda s, d: rounded(P.describe_numeric(lineitem(s, d), LINE_NUMBERS), 4),
    "correlation_matrix": lambda s, d: rounded(P.correlation_pairs(lineitem(s, d), LINE_NUMERIC)),
    "schema_profile": lambda s, d: P.schema_profile(lineitem(s, d)),
    "quality_report": lambda s, d: rounded(P.quality_report(orders(s, d)), 4),
    "outliers_iqr": lambda s, d: rounded(P.outliers_iqr(lineitem(s, d).withColumn("skewed", F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "skewed"])),
    "outliers_zscore": lambda s, d: rounded(P.outliers_zscore(lineitem(s, d).withColumn("skewed", F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_extendedprice", "skewed"])),
    "length_stats": lambda s, d: rounded(P.length_stats(load(s, d, "documents"), "text")),
    "counts_by_key": lambda s, d: P.counts_by_key(papers_like(s, d), {"source": F.col("source"), "domain": F.col("domain"), "year": F.col("year")}),
    "avg_list_size": lambda s, d: rounded(P.avg_list_size(papers_like(s, d), "authors")),
    "histogram_density": lambda s, d: rounded(
        P.histogram_density(lineitem(s, d), LINE_NUMBERS).withColumn("left_edge", F.round("left_edge", 4)), 8
    ),
}

LENGTHS = "length(text) > 0"
ORACLE = {
    "completeness": f"""WITH {GAPPY_EVENTS}, c AS ({union([f"SELECT '{c}' AS column_, count({c}) AS filled, count(*) AS cells FROM g" for c in GAPPY_COLUMNS])})
SELECT column_ AS "column", filled, cells, {r6('filled / cells')} AS completeness FROM c
UNION ALL SELECT '*', CAST(sum(filled) AS BIGINT), CAST(sum(cells) AS BIGINT), {r6('sum(filled) / sum(cells)')} FROM c""",
    "null_counts": f"""WITH {GAPPY_EVENTS} {union([f'SELECT {chr(39)}{c}{chr(39)} AS "column", count(*) - count({c}) AS nulls FROM g' for c in GAPPY_COLUMNS])}""",
    "uniqueness_by_column": union([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, {r6(f'count(DISTINCT {c}) / count(*)')} AS uniqueness FROM lineitem""" for c in LINE_COLUMNS]),
    "uniqueness_score": f"""WITH {GAPPY_EVENTS}, u AS ({union([f"SELECT coalesce(count(DISTINCT {c}) / nullif(count({c}), 0), 0) AS u FROM g" for c in GAPPY_COLUMNS])}),
x AS (SELECT (SELECT avg(u) FROM u) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) / (SELECT count(*) FROM g) AS b)
SELECT {r6('a')} AS column_uniqueness, {r6('b')} AS row_uniqueness, {r6('(a + b) / 2')} AS uniqueness_score FROM x""",
    "duplicate_rows": f"""WITH n AS (SELECT count(*) AS n FROM lineitem), k AS (SELECT count(*) AS k FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem))
SELECT n - k AS duplicate_rows, {r6('(n - k) / n')} AS duplicate_ratio FROM n, k""",
    "string_consistency": union([f"""SELECT '{c}' AS "column", {r6(f'avg(length({c}))')} AS avg_length, {r6(f'stddev_samp(length({c}))')} AS length_std,
{r6(f'1 - stddev_samp(length({c})) / avg(length({c}))')} AS format_consistency FROM documents""" for c in ("text", "lang", "source")]),
    "numeric_consistency": union([f"""SELECT '{c}' AS "column", {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
CASE WHEN avg({c}) = 0 THEN 0.0 ELSE {r6(f'stddev_samp({c}) / avg({c})')} END AS coefficient_of_variation FROM lineitem""" for c in LINE_NUMERIC]),
    "consistency_score": f"""SELECT {r6('''(count(TRY_CAST(o_orderstatus AS INTEGER)) / count(*) + count(TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER)) / count(*)
 + count(CASE WHEN regexp_matches(CAST(o_totalprice AS VARCHAR), '^[0-9]+$') AND o_totalprice <= 32767 THEN 1 END) / count(*) + 1) / 4''')} AS consistency_score FROM orders""",
    "validity_score": f"""WITH {GAPPY_EVENTS}
{union([f'''SELECT '{c}' AS "column", 1.0::DOUBLE AS validity FROM (SELECT 1)''' for c in ("event_id", "user_id")])}
UNION ALL SELECT 'value', {r6("count(CASE WHEN isfinite(value) THEN 1 END) / count(value)")} FROM g
UNION ALL SELECT 'nothing', 0.0
UNION ALL {union([f"SELECT '{c}', {r6(f'count(CASE WHEN regexp_matches({c}, {chr(39)}^[^' + chr(92) + 'x00-' + chr(92) + 'x1f]*' + chr(92) + 'n?$' + chr(39) + ') THEN 1 END) / count(' + c + ')')} FROM g" for c in ("event_type", "props", "note")])}""",
    "encoding_issues": """SELECT CAST(CAST(bool_or(regexp_matches(text, '[^\\x00-\\x7F]')) AS INTEGER) + CAST(bool_or(regexp_matches(lang, '[^\\x00-\\x7F]')) AS INTEGER)
 + CAST(bool_or(regexp_matches(source, '[^\\x00-\\x7F]')) AS INTEGER) AS BIGINT) AS encoding_issues FROM documents""",
    "describe_numeric": union([f"""SELECT '{c}' AS "column", count({c}) AS filled, {r6(f'avg({c})', 4)} AS mean, {r6(f'stddev_samp({c})', 4)} AS std, {r6(f'min({c})', 4)} AS min,
{r6(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r6(f'quantile_cont({c}, 0.5)', 4)} AS q50, {r6(f'quantile_cont({c}, 0.75)', 4)} AS q75, {r6(f'max({c})', 4)} AS max FROM lineitem""" for c in LINE_NUMBERS]),
    "correlation_matrix": union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS r FROM lineitem"
                                 for i, a in enumerate(LINE_NUMERIC) for b in LINE_NUMERIC[i + 1:]]),
    "schema_profile": union([f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) AS total_rows FROM lineitem"""
                             for i, (c, t) in enumerate(zip(LINE_COLUMNS, LINE_TYPES))]),
    "quality_report": union(
        [f"""SELECT 'completeness' AS metric, '{c}' AS "column", {r6(f'count({c}) / count(*)', 4)} AS value FROM orders""" for c in ORDER_COLUMNS]
        + [f"SELECT 'completeness', '*', {r6('(' + ' + '.join(f'count({c})' for c in ORDER_COLUMNS) + f') / (count(*) * {len(ORDER_COLUMNS)})', 4)} FROM orders"]
        + [f"SELECT 'uniqueness', '{c}', {r6(f'count(DISTINCT {c}) / count(*)', 4)} FROM orders" for c in ORDER_COLUMNS]
        + [f"SELECT 'duplicate_rows', '*', CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE)"]
        + [f"SELECT 'duplicate_ratio', '*', {r6('((SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))) / (SELECT count(*) FROM orders)', 4)}"]
        + ["SELECT 'encoding_issues', '*', CAST(CAST(bool_or(regexp_matches(o_orderstatus, '[^\\x00-\\x7F]')) AS INTEGER) + CAST(bool_or(regexp_matches(o_orderpriority, '[^\\x00-\\x7F]')) AS INTEGER) AS DOUBLE) FROM orders"]
        + [f"SELECT '{m}', '{c}', {r6(e.format(c=c), 4)} FROM orders" for c in ORDER_NUMERIC for m, e in
           [("filled", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)"),
            ("q25", "quantile_cont(CAST({c} AS DOUBLE), 0.25)"), ("q50", "quantile_cont(CAST({c} AS DOUBLE), 0.5)"), ("q75", "quantile_cont(CAST({c} AS DOUBLE), 0.75)"), ("max", "CAST(max({c}) AS DOUBLE)")]]
        + [f"SELECT 'r', '{a}~{b}', {r6(f'corr({a}, {b})', 4)} FROM orders" for i, a in enumerate(ORDER_NUMERIC) for b in ORDER_NUMERIC[i + 1:]]
    ),
    "outliers_iqr": "WITH x AS (SELECT *, l_extendedprice * l_discount * l_tax AS skewed FROM lineitem) " + union([
        f"""SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS "column", {r6(c)} AS value FROM x, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM x) q
WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)""" for c in ("l_quantity", "l_extendedprice", "skewed")]),
    "outliers_zscore": "WITH x AS (SELECT *, l_extendedprice * l_discount * l_tax AS skewed FROM lineitem) " + union([
        f"""SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS "column", {r6(c)} AS value FROM x, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM x) q
WHERE abs({c} - m) > 3.0 * s""" for c in ("l_extendedprice", "skewed")]),
    "length_stats": f"""SELECT 'text' AS "column", {r6('avg(length(text))')} AS avg_length, CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS BIGINT) AS median_length FROM documents WHERE {LENGTHS}""",
    "counts_by_key": """SELECT 'source' AS dimension, CASE WHEN lang <> 'fr' THEN source ELSE 'unknown' END AS key, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'domain', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'year', CAST(2000 + n_chars % 25 AS VARCHAR), count(*) FROM documents GROUP BY 2""",
    "avg_list_size": f"""SELECT {r6("avg(CASE WHEN lang <> 'de' THEN len(string_split(source, 'r')) ELSE 0 END)")} AS avg_size FROM documents""",
    "histogram_density": union([f"""SELECT '{c}' AS "column", CAST(g.b AS INTEGER) AS bin, {r6('lo + g.b * (hi - lo) / 30', 4)} AS left_edge, coalesce(k.n, 0) AS n, {r6('coalesce(k.n, 0) / (m.n * ((hi - lo) / 30))', 8)} AS density
FROM (SELECT unnest(range(30)) AS b) g CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM lineitem) m
LEFT JOIN (SELECT least(CAST(floor(({c} - lo) / (hi - lo) * 30.0) AS INTEGER), 29) AS b, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) k ON k.b = g.b""" for c in LINE_NUMBERS]),
}
