"""Nearest neighbours by vantage-point trees.

A node's vantage point parts the vectors below it at the median of their distances to it.  By the triangle inequality
a side can hold nothing nearer than the gap between the query's distance and the side's range; it is skipped if the gap
exceeds factor times the distance of the worst neighbour found so far.  Factor 1 is exact search, a smaller one skips
more and may miss neighbours.

The first levels are fitted on a bounded sample and part all vectors into leaves; a leaf of too many rows is dealt into
several shards, copies of one row included, and each shard gets a tree of its own, written once, as one row.  Queries
search the leaf that they fall into; the worst neighbour found there tells which other leaves they can't skip.  A task
is a shard and a block of queries of bounded size; the best of all shards are merged by query.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

NEIGHBOURS = 10
FACTOR = 1.0
SHARD_ROWS = 20_000
SHARD_BYTES = 64 << 20
BLOCK_QUERIES = 1_000
LEAF = 128
SAMPLE_BYTES = 16 << 20  # of vectors that the first levels are fitted on
SAMPLE_ROWS = 16_384
LEVELS = 12


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, squares added in the order of the components."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for j in range(x.shape[-1]):
        d = x[..., j] - y[..., j]
        total += d * d
    return np.sqrt(total)


class Tree:
    """Nodes in arrays: the vectors lie so that a node's are those from begin to end, its vantage point first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.nodes: list[tuple] = []  # begin, end, split, inner, outer and the ranges of both sides' distances
        rng = np.random.default_rng(5)
        places = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        links: list[list] = []
        while todo:
            a, b, parent, side = todo.pop()
            me = len(links)
            if parent >= 0:
                links[parent][3 + side] = me
            if b - a <= LEAF:
                links.append([a, b, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
                continue
            pick = a + int(rng.integers(b - a))
            places[[a, pick]] = places[[pick, a]]
            rest = places[a + 1 : b]
            far = distances(self.vectors[rest], self.vectors[places[a]][None])
            by = np.argsort(far, kind="stable")
            places[a + 1 : b], far = rest[by], far[by]
            half = len(far) // 2
            links.append([a, b, a + 1 + half, -1, -1, far[0], far[half - 1], far[half], far[-1]])
            todo += [(a + 1 + half, b, me, 1), (a + 1, a + 1 + half, me, 0)]
        self.nodes = [tuple(x) for x in links]
        self.ids, self.vectors = self.ids[places], np.ascontiguousarray(self.vectors[places])
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, nodes=np.array(self.nodes, np.float64).reshape(-1, 9))
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        tree, found = cls.__new__(cls), np.load(io.BytesIO(raw))
        tree.ids, tree.vectors = found["ids"], found["vectors"]
        tree.nodes = [(*map(int, n[:5]), *n[5:]) for n in found["nodes"].tolist()]
        tree.squares = np.einsum("ij,ij->i", tree.vectors, tree.vectors)
        return tree

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest, nearest first, ties by id; rows of the query's own id are left out.

        Those farther than worst are not looked for; a place without a neighbour has a greater distance than that.
        """
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        beyond = np.full(len(queries), np.inf) if worst is None else np.nextafter(worst, np.inf)
        best = np.repeat(beyond[:, None], k, axis=1)
        squares = np.einsum("ij,ij->i", queries, queries)

        def offer(a: int, b: int, qs: np.ndarray) -> None:
            x = self.vectors[a:b]
            size = squares[qs, None] + self.squares[None, a:b]
            rough = size - 2 * (queries[qs] @ x.T)
            worst = best[qs, -1]
            may = (rough <= (worst * worst)[:, None] + 1e-9 * size) & (self.ids[None, a:b] != own[qs, None])
            row, col = np.nonzero(may)
            if not len(row):
                return
            exact = np.full(may.shape, np.inf)
            exact[row, col] = distances(queries[qs[row]], x[col])
            all_d = np.concatenate([best[qs], exact], axis=1)
            all_i = np.concatenate([ids[qs], np.broadcast_to(self.ids[a:b], may.shape)], axis=1)
            all_i[:, k:][~may] = np.iinfo(np.int64).max
            order = np.lexsort((all_i, all_d), axis=-1)[:, :k]
            best[qs], ids[qs] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

        def visit(node: int, qs: np.ndarray, gap: np.ndarray) -> None:
            on = gap * (1 - 1e-12) <= factor * best[qs, -1]
            qs = qs[on]
            if not len(qs):
                return
            a, b, split, inner, outer, in_low, in_high, out_low, out_high = self.nodes[node]
            if split < 0:
                offer(a, b, qs)
                return
            offer(a, a + 1, qs)
            d = distances(queries[qs], self.vectors[a][None])
            to_inner = np.maximum(np.maximum(d - in_high, in_low - d), 0)
            to_outer = np.maximum(np.maximum(d - out_high, out_low - d), 0)
            near = d <= (in_high + out_low) / 2
            visit(inner, qs[near], to_inner[near])
            visit(outer, qs[~near], to_outer[~near])
            visit(outer, qs[near], to_outer[near])
            visit(inner, qs[~near], to_inner[~near])

        if len(self.ids) and len(queries):
            visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return ids, best


class Top:
    """The first levels of the tree of all vectors of one length: node n has the nodes 2n + 1 (not farther than its cut) and 2n + 2."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.points, self.cuts = np.zeros((2**levels - 1, sample.shape[1])), np.full(2**levels - 1, np.inf)
        rng = np.random.default_rng(11)
        below = [np.arange(len(sample))]
        for n in range(2**levels - 1):
            rest = below[n]
            if len(rest):
                self.points[n] = sample[rest[rng.integers(len(rest))]]
                far = distances(sample[rest], self.points[n][None])
                self.cuts[n] = np.median(far)
                below += [rest[far <= self.cuts[n]], rest[far > self.cuts[n]]]
            else:
                below += [rest, rest]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (distances(x, self.points[node]) > self.cuts[node])
        return node - (2**self.levels - 1)

    def reached(self, x: np.ndarray, worst: np.ndarray) -> list[np.ndarray]:
        """For each row the leaves that may hold a vector not farther than worst."""
        row, node, gap = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for _ in range(self.levels):
            d, cut = distances(x[row], self.points[node]), self.cuts[node]
            row, node, gap = np.tile(row, 2), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([np.maximum(gap, d - cut), np.maximum(gap, cut - d)])
            on = gap * (1 - 1e-12) <= worst[row]
            row, node, gap = row[on], node[on], gap[on]
        order = np.argsort(row, kind="stable")
        return np.split((node - (2**self.levels - 1))[order], np.searchsorted(row[order], np.arange(1, len(x))))


def _usable(c: Column) -> Column:
    """Not null, not empty, every component a finite number, not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _built(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    tree = Tree(rows["vec_id"].to_numpy(), _matrix(rows["vector"]))
    return pa.table({"dim": [key[0].as_py()], "leaf": [key[1].as_py()], "part": [key[2].as_py()], "tree": [tree.pack()]}, pa.schema([("dim", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32()), ("tree", pa.binary())]))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _matrix(pa.chunked_array([batch.column("vector").take(pa.array(rows))]))


def _leaves(tops: dict[int, Top]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in _by_length(batch):
                if dim in tops:
                    leaf[rows] = tops[dim].leaf(x)
            yield batch.append_column("leaf", pa.array(leaf))

    return run


def _others(tops: dict[int, Top], factor: float):
    """The leaves that a query must still search, its own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, worst = batch.column("leaf").to_numpy(), batch.column("worst").to_numpy()
            leaves: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for dim, rows, x in _by_length(batch):
                if dim in tops:
                    for row, found in zip(rows.tolist(), tops[dim].reached(x, factor * worst[rows]), strict=True):
                        leaves[row] = found[found != home[row]]
            yield batch.append_column("leaves", pa.array(leaves, pa.list_(pa.int32())))

    return run


def _with_leaf(rows: DataFrame, tops: dict[int, Top]) -> DataFrame:
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_leaves(tops), f"{types}, leaf int")


def _tops(rows: DataFrame, shard_rows: int) -> dict[int, Top]:
    """First levels by length of vector, from a sample of at most SAMPLE_BYTES; lengths that it misses have one leaf."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return {}
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))
    share = min(1.0, 1.2 * size / n)
    sample: dict[int, list] = {}
    for dim, vector in (rows.sample(share, seed=3) if share < 1 else rows).select("dim", "vector").limit(size).collect():
        sample.setdefault(dim, []).append(vector)
    sampled = sum(map(len, sample.values()))
    out = {}
    for dim, vectors in sample.items():
        wanted = n * len(vectors) / sampled / min(shard_rows, max(1, SHARD_BYTES // (8 * dim)))
        levels = min(LEVELS, int(np.ceil(np.log2(max(1.0, wanted)))), int(np.log2(max(1, len(vectors) // 16))))
        if levels > 0:
            out[dim] = Top(np.array(vectors, np.float64), levels)
    return out


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, Top]]:
    """(dim, leaf, part, tree) of usable (vec_id, vector) rows, written once, and the first levels; every row is in one tree."""
    rows = vectors.select("vec_id", "vector", F.size("vector").alias("dim"))
    tops = _tops(rows, shard_rows)
    salted = _with_leaf(rows, tops).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = written(salted, "leaves")  # with the salt: a task that runs again finds it
    parts = F.ceil(F.greatest(F.col("n") / shard_rows, F.col("n") * F.col("dim") * 8 / F.lit(SHARD_BYTES)))
    counts = dealt.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).select("dim", "leaf", parts.alias("parts"))
    part = F.pmod("salt", F.col("parts")).cast("int").alias("part")
    built = dealt.join(counts, ["dim", "leaf"]).select("dim", "leaf", part, "vec_id", "vector").groupBy("dim", "leaf", "part").applyInArrow(_built, "dim int, leaf int, part int, tree binary")
    return written(built, "vantage-trees"), tops


def _searched(k: int, factor: float):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        ids, score, query = [], [], queries["query_id"].to_numpy() if len(queries) else np.zeros(0, np.int64)
        if len(trees) and len(queries):
            tree = Tree.unpack(trees["tree"][0].as_py())
            worst = queries["worst"].to_numpy()
            ids, score = tree.search(query, _matrix(queries["vector"]), k, factor, worst)
            found = np.isfinite(score) & (score <= worst[:, None])
            query = np.repeat(query, found.sum(axis=1))
            ids, score = ids[found], score[found]
        else:
            query = query[:0]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _met(trees: DataFrame, asked: DataFrame, k: int, factor: float, block: int) -> DataFrame:
    """The best of each shard of a leaf for (dim, leaf, query_id, vector, worst), block by block of queries."""
    leaf = ["dim", "leaf"]
    blocks = asked.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    parts = trees.select(*[F.col(c).alias(c) for c in (*leaf, "part")])
    spread = asked.join(blocks, leaf).join(parts, leaf).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("blocks")).cast("int"))
    repeated = trees.join(blocks, leaf).select(*leaf, "part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "tree")
    key = [*leaf, "part", "block"]
    rows = spread.select(*key, "query_id", "vector", "worst")
    return repeated.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_searched(k, factor), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query by Euclidean distance, rows of its own id left out.

    Ties go to the smaller id.  Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part on either side; vectors of another length than the query's are no candidates.  Equal query
    rows count once; repeated vectors are candidates each.  Other columns are not read.  Empty in, empty out.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))

    trees, tops = index(usable(vectors), shard_rows)
    distinct = usable(queries).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim")).distinct()
    asked = written(_with_leaf(distinct, tops), "queries")
    at_home = written(_met(trees, asked.withColumn("worst", F.lit(float("inf"))), k, factor, block), "neighbours-at-home")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    at_home = at_home.withColumn("rank", best).filter(F.col("rank") <= k).drop("rank")
    worst = at_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("worst"))
    known = asked.join(worst, "query_id", "left").fillna({"worst": float("inf")})
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    left = written(known.mapInArrow(_others(tops, factor), f"{types}, leaves array<int>"), "leaves-to-search")
    elsewhere = _met(trees, left.select("dim", F.explode("leaves").alias("leaf"), "query_id", "vector", "worst"), k, factor, block)
    found = at_home.unionByName(elsewhere).withColumn("rank", best)
    return found.filter(F.col("rank") <= k).select("query_id", F.col("rank"), "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
  sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= {NEIGHBOURS}"""
