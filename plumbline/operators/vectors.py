"""Vector storage and exact cosine top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import cosine
from plumbline.session import quoted

# A task of the batch search holds so many bytes of rows and, as a share, of queries; a share is scored in blocks of so many bytes.
QUERY_BLOCK_BYTES = 4 * 1024 * 1024
ROW_PART_BYTES = 16 * 1024 * 1024
QUERY_SHARE_BYTES = 16 * 1024 * 1024
# Smaller shares where a part and a share would have more pairs than this.
GROUP_PAIRS = 1 << 29
# Scores are held for so many queries and rows at a time, and compared at this many digits so that equal vectors tie.
SCORED_QUERIES = 256
SCORED_ROWS = 2048
SCORE_DIGITS = 12


def embedding_rows(df: DataFrame, vector: str, source_type: Column, source_id: Column, model: str, metadata: Column | None = None) -> DataFrame:
    """Storage form: content-hash id, source, model, dimensions, metadata, vector."""
    v = F.col(quoted(vector))
    meta = F.lit("{}") if metadata is None else metadata
    key = F.concat_ws("|", source_type, source_id.cast("string"), F.lit(model), F.to_json(v))
    return df.select(
        F.sha2(key, 256).alias("id"),
        source_type.alias("source_type"),
        source_id.cast("string").alias("source_id"),
        F.lit(model).alias("model"),
        F.size(v).alias("dimensions"),
        meta.alias("metadata"),
        v.cast("array<float>").alias("vector"),
    )


def store_embeddings(rows: DataFrame, path: str) -> None:
    """Append; the source type is the directory level, so a search by source type reads only its files."""
    rows.write.mode("append").partitionBy("source_type").parquet(path)


def vector_topk(
    df: DataFrame, vector: str, query: list[float], k: int = 10, key: str = "id", where: Column | None = None
) -> DataFrame:
    """The k most similar rows, best first (ties by key); planned as take-ordered, never a full sort."""
    given = F.lit([float(x) for x in query])
    kept = df if where is None else df.where(where)
    scored = kept.withColumn("similarity", cosine(F.col(quoted(vector)), given))
    return scored.orderBy(F.col("similarity").desc(), F.col(quoted(key))).limit(k)


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero.  All have one length."""
    sizes = pc.list_value_length(vectors).to_numpy()
    if vectors.null_count or (len(sizes) and (sizes != sizes[0]).any()):
        raise ValueError("vectors are null or differ in length")
    entries = pc.list_flatten(vectors).to_numpy().astype(float)
    m = entries.reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=~(n <= 0))


def _best_rows(queries: np.ndarray, rows: np.ndarray, k: int, block_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k best rows of each query by inner product, earlier rows first among equals.

    Each query has a bound, its k-th best score so far; only what is above it is looked at, and none of the rest is sorted.
    """
    digit, out = 10.0**-SCORE_DIGITS, []
    odd = not (np.isfinite(queries).all() and np.isfinite(rows).all())
    step = min(SCORED_QUERIES, max(1, block_bytes // (8 * max(1, queries.shape[1]))))
    for a in range(0, len(queries) if len(rows) else 0, step):
        block = queries[a : a + step]
        own = np.repeat(np.arange(len(block)), k)
        score, at = np.full((len(block), k), -np.inf), np.full((len(block), k), len(rows))
        for b in range(0, len(rows), SCORED_ROWS):
            scores = block @ rows[b : b + SCORED_ROWS].T
            if odd:
                scores[np.isnan(scores)] = np.inf
            bound = score[:, -1] + digit / 4
            groups = max(64, 4 * k)
            if b == 0 and scores.shape[1] >= 2 * groups:
                # The k-th largest of the largest of groups of rows is no more than the k-th largest of all.
                tops = scores[:, : scores.shape[1] // groups * groups].reshape(len(block), -1, groups).max(axis=1)
                bound = np.minimum(np.partition(tops, groups - k, axis=1)[:, groups - k] - 2 * digit, np.finfo(float).max)
            above = np.flatnonzero(scores > bound[:, None])
            if not len(above):
                continue
            query, row = np.divmod(above, scores.shape[1])
            found = np.concatenate([score.ravel(), np.round(scores.ravel()[above], SCORE_DIGITS)])
            where, whose = np.concatenate([at.ravel(), row + b]), np.concatenate([own, query])
            order = np.lexsort((where, -found, whose))
            ranked = whose[order]
            first = order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]
            score, at = found[first].reshape(score.shape), where[first].reshape(at.shape)
        met = (at < len(rows)).ravel()
        out.append((at.ravel()[met], own[met] + a, score.ravel()[met]))
    at, query, score = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (int, int, float)]
    score[np.isinf(score)] = np.nan
    return at, query, score


def vector_topk_batch(
    df: DataFrame, queries: DataFrame, k: int, vector: str = "vector", key: str = "id", query_key: str = "query_id", query_vector: str = "vector",
    block_bytes: int = QUERY_BLOCK_BYTES, part_bytes: int = ROW_PART_BYTES,
) -> DataFrame:
    """(query_key, key, similarity, place) of the k best rows of every query, exactly.

    Rows are dealt into parts and queries into shares, both of bounded size; each pair of a part and a share meets in one
    task, which scores it by matrix products, a block of queries at a time, and hands on its own best k per query.  A row is
    copied once for each share and a query once for each part, whatever the blocks.  No query passes through the driver, and
    what is merged grows with queries x k x parts.  A similarity that is not a number is the greatest.
    """
    kinds = dict(df.dtypes)
    (n, d), (asked, e) = [side.agg(F.count(F.lit(1)), F.max(F.size(F.col(quoted(c))))).first() for side, c in ((df, vector), (queries, query_vector))]
    parts = max(1, -(-n * max(d or 1, 1) * 8 // part_bytes))
    shares = max(1, -(-asked * max(e or 1, 1) * 8 // max(block_bytes, QUERY_SHARE_BYTES)), -(-n * asked // (parts * GROUP_PAIRS)))
    sizes = {"part": parts, "share": shares}

    def entries(side: DataFrame, c: str) -> Column:
        kind = dict(side.dtypes)[c]
        return F.col(quoted(c)).cast(kind if kind == "array<float>" else "array<double>").alias("v")

    q = queries.select(F.col(quoted(query_key)).cast("string").alias("q"), entries(queries, query_vector))
    rows = df.select(F.col(quoted(key)).alias("k"), entries(df, vector))

    def dealt(side: DataFrame, own: str, column: str, other: str) -> DataFrame:
        of = F.pmod(F.xxhash64(column, "v"), F.lit(sizes[own])).cast("int")
        return side.select(column, "v", of.alias(own), F.explode(F.sequence(F.lit(0), F.lit(sizes[other] - 1))).alias(other)).groupBy("part", "share")

    def best(part: pa.Table, share: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part["k"], null_placement="at_start"))
        at, query, similarity = _best_rows(_unit_rows(share["v"]), _unit_rows(part["v"]), k, block_bytes)
        return pa.table({"q": share["q"].take(pa.array(query)), "k": part["k"].take(pa.array(at)), "similarity": pa.array(similarity)})

    local = dealt(rows, "part", "k", "share").cogroup(dealt(q, "share", "q", "part")).applyInArrow(best, f"q string, k {kinds[key]}, similarity double")
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("k"))
    placed = local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select(F.col("q").cast(dict(queries.dtypes)[query_key]).alias(query_key), F.col("k").alias(key), "similarity", "place")
