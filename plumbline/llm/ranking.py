"""Ranked lexical search over trees of shared term paths.

Of every document only the terms that the items ask for are kept, with their frequencies, and ordered from the term that most
documents have to the rarest.  Documents in the order of these paths lie as in a prefix tree: a node is a run of documents
that share a path so far.  Each node knows the largest frequency of every term among its documents and their smallest
length part m; as a term adds more the more often it occurs and the smaller m is, these bound the score of every document below.
Items go down the tree depth first, the child of the highest bound before the others, and leave out what can't reach
their last rank.

Paths are dealt out by range, so a shard is a slice of the tree of all documents; equal paths are parted by a hash and may
go to several shards.  A shard takes up at most SHARD_ROWS documents or SHARD_TERMS terms at a time.  Items are read in blocks of
bounded size, and each block is one pass over the documents.  Terms are compared by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.wordhash import parts, span_hashes, text_bytes, word_spans

RANKS = 20
SHARD_ROWS = 16_384
SHARD_TERMS = 1 << 22
LEAF = 64
DEEP = 200
KEY_TERMS = 8
ITEM_CELLS = 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Contributions of a term: SCALE * tf div (1000 * tf + 12 * m), where m = 75 + 25 * n * N div L.
SCALE = 1_000_000_000
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all terms of an array of texts, and the text each is in, a part at a time."""
    data, at = text_bytes(texts)
    for a, b, first, inside in parts(data, at, BETWEEN):
        part = data[a:b]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        starts, ends, before = word_spans(part, inside, BETWEEN)
        yield span_hashes(part, starts, ends), np.repeat(np.arange(first, first + len(inside) - 1), np.diff(before))


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, the hashes of all their terms in order, and for each item the places of its terms and how often it has them."""

    ids: list
    terms: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> Items:
        hashes, text = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *terms_of(pa.array([t for _, t in rows], pa.string())), strict=True))
        terms, place = np.unique(hashes, return_inverse=True)
        return cls([i for i, _ in rows], terms, [np.unique(place[text == q], return_counts=True) for q in range(len(rows))])


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items in blocks: about ITEM_CELLS of items times bytes of text, one item at least."""
    rows, size = [], 0
    for i, t in items.select(F.col(item_id).cast("long"), F.col(text)).filter(F.col(text).rlike(TERM)).distinct().toLocalIterator():
        if rows and (len(rows) + 1) * (size + len(t) // 4) > ITEM_CELLS:
            yield Items.of(rows)
            rows, size = [], 0
        rows.append((i, t))
        size += len(t) // 4
    if rows:
        yield Items.of(rows)


def _restricted(terms: np.ndarray):
    """(doc_id, n, terms, tf): n counts all terms of a text, the lists only those asked for, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys = counts = np.zeros(0, np.int64)
            for hashes, text in terms_of(batch.column(1)):
                n += np.bincount(text, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                asked = terms[at] == hashes
                found, often = np.unique(text[asked] * len(terms) + at[asked], return_counts=True)
                keys, counts = np.concatenate([keys, found]), np.concatenate([counts, often])
            keys, counts = _counted(keys, counts)
            text, place = np.divmod(keys, len(terms))
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (place, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return run


def _pathed(rank: np.ndarray):
    """Terms become ranks in falling document frequency; frequencies follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            path = rank[lists.flatten().to_numpy()]
            order = np.lexsort((path, row))
            offsets = pa.array(lists.offsets.to_numpy() - lists.offsets.to_numpy()[0], pa.int32())
            tf = batch.column(3).flatten().to_numpy()[order]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(path[order], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                ["doc_id", "n", "path", "tf"],
            )

    return run


def added(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds."""
    return SCALE * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


@dataclass
class Node:
    begin: int
    end: int
    children: list[Node]
    terms: np.ndarray  # of the documents below, in order, with the most that each adds in any of them
    most: np.ndarray


class Tree:
    """The prefix tree of the paths of some documents, which are put in the order of their paths."""

    def __init__(self, offsets: np.ndarray, path: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        texts = [path[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        # Big-endian bytes sort as their numbers do, and a path before those that go on from it.
        self.order = np.array(sorted(range(len(texts)), key=[t.astype(">u4").tobytes() for t in texts].__getitem__), np.int64)
        self.paths = [texts[i] for i in self.order]
        self.tfs = [tf[offsets[i] : offsets[i + 1]] for i in self.order]
        self.m = m[self.order]
        self.root = self._node(0, len(self.paths), 0)[0] if len(self.paths) else None

    def _maxima(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some documents and their largest frequencies."""
        terms, tf = np.concatenate(self.paths[begin:end]), np.concatenate(self.tfs[begin:end])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
        return terms[first], np.maximum.reduceat(tf[order], first) if len(first) else tf

    def _node(self, begin: int, end: int, depth: int, level: int = 0) -> tuple[Node, np.ndarray]:
        """The node of documents that share depth terms, and its terms' largest frequencies."""
        if end - begin <= self.leaf:
            terms, tf = self._maxima(begin, end)
            return Node(begin, end, [], terms, added(tf, self.m[begin:end].min())), tf
        first, last = self.paths[begin], self.paths[end - 1]
        while depth < min(len(first), len(last)) and first[depth] == last[depth]:
            depth += 1  # sorted paths share what the first and the last share
        runs, a = [], begin
        if level >= DEEP:  # paths that leave each other one by one are halved instead
            half = (begin + end) // 2
            runs, a = [(begin, half), (half, end)], end
        while a < end and len(self.paths[a]) <= depth:
            a += 1
        if not runs:
            runs = [(x, min(x + self.leaf, a)) for x in range(begin, a, self.leaf)]  # whole paths end here
        while a < end:
            b = self._run_end(a, end, depth)
            # Small neighbours are bounded together.
            if runs and runs[-1][1] == a and b - runs[-1][0] <= self.leaf:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
            a = b
        found = [self._node(a, b, depth, level + 1) for a, b in runs]
        terms, tf = np.concatenate([n.terms for n, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
        tf = np.maximum.reduceat(tf[order], starts) if len(starts) else tf
        return Node(begin, end, [n for n, _ in found], terms[starts], added(tf, self.m[begin:end].min())), tf

    def _run_end(self, a: int, end: int, depth: int) -> int:
        """The end of the documents from a on that have the same term at that depth; steps double, then halve."""
        term, step = self.paths[a][depth], 1
        while a + step < end and self.paths[a + step][depth] == term:
            step *= 2
        low, high = a + step // 2, min(a + step, end)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.paths[mid][depth] == term else (low, mid)
        return high

    def search(self, weights: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For items' weights (a row each, a column a term): places in ids and scores of the k best, best first, 0 for none, and
        how many scores were worked out.  ids tell the order of documents of equal score."""
        best = np.zeros((len(weights), k), weights.dtype)
        place = np.full((len(weights), k), np.iinfo(np.int64).max)
        worked = 0

        def bounds(nodes: list[Node], items: np.ndarray) -> np.ndarray:
            return np.stack([weights[np.ix_(items, n.terms)] @ n.most.astype(weights.dtype) for n in nodes])

        def offer(node: Node, items: np.ndarray) -> None:
            nonlocal worked
            worked += len(items) * (node.end - node.begin)
            dense = np.zeros((len(node.terms), node.end - node.begin), weights.dtype)
            for d in range(node.begin, node.end):
                dense[np.searchsorted(node.terms, self.paths[d]), d - node.begin] = added(self.tfs[d], self.m[d])
            scores = weights[np.ix_(items, node.terms)] @ dense
            some = np.flatnonzero((scores >= np.maximum(best[items, -1], 1)[:, None]).any(axis=1))
            items, scores = items[some], scores[some]
            own = np.where(scores > 0, ids[self.order[node.begin : node.end]][None], np.iinfo(np.int64).max)
            all_scores, all_places = np.concatenate([best[items], np.maximum(scores, 0)], axis=1), np.concatenate([place[items], own], axis=1)
            top = np.lexsort((all_places, -all_scores), axis=-1)[:, :k]
            best[items], place[items] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_places, top, 1)

        def visit(node: Node, items: np.ndarray, bound: np.ndarray) -> None:
            on = bound >= np.maximum(best[items, -1], 1)
            items = items[on]
            if not len(items):
                return
            if not node.children:
                offer(node, items)
                return
            below = bounds(node.children, items)
            first = below.argmax(axis=0)
            for c in np.unique(first).tolist():
                mine = first == c
                visit(node.children[c], items[mine], below[c, mine])
            for c in np.argsort(-below.max(axis=1), kind="stable").tolist():
                others = first != c
                visit(node.children[c], items[others], below[c, others])

        if self.root is not None and len(weights):
            every = np.arange(len(weights))
            visit(self.root, every, bounds([self.root], every)[0])
        return place, best, worked


def _length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
    return 75 + 25 * n * docs // total


def _ranked(items: Items, weights: list[tuple[np.ndarray, np.ndarray]], terms: int, docs: int, total: int, k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Products of whole numbers are exact in doubles while their sums stay below 2**53.
        exact = max(int(w.sum()) for _, w in weights) * (SCALE // 1000) < 1 << 53
        table = np.zeros((len(weights), terms), np.float64 if exact else np.int64)
        for q, (at, w) in enumerate(weights):
            table[q, at] = w

        def shard(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks()
            doc, path, tf = (whole[c].combine_chunks() for c in ("doc_id", "path", "tf"))
            offsets = path.offsets.to_numpy() - path.offsets.to_numpy()[0]
            tree = Tree(offsets, path.flatten().to_numpy(), tf.flatten().to_numpy(), _length_part(whole["n"].to_numpy(), docs, total))
            by_id = pc.sort_indices(doc, null_placement="at_end").to_numpy()
            order = np.empty(len(by_id), np.int64)
            order[by_id] = np.arange(len(by_id))
            place, score, _ = tree.search(table, order, k)
            item, col = np.nonzero(score > 0)
            ids = pa.array(items.ids, pa.int64()).take(pa.array(item))
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, doc.take(pa.array(by_id[place[item, col].astype(np.int64)])), pa.array(score[item, col].astype(np.int64))], ["item", "item_id", "doc_id", "score"])

        some, n, size = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                some.append(part)
                n, size = n + part.num_rows, size + len(part.column(2).flatten())
                if n >= rows or size >= SHARD_TERMS:
                    yield shard(some)
                    some, n, size = [], 0, 0
        if some:
            yield shard(some)

    return run


def _block(docs: DataFrame, items: Items, k: int, rows: int) -> DataFrame:
    """(item, item_id, doc_id, score) of the best k documents of each shard for each item of a block."""
    vectors = written(docs.mapInArrow(_restricted(items.terms), "doc_id long, n long, terms array<int>, tf array<int>"), "term-vectors")
    n_docs, total, asked = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    df = np.zeros(len(items.terms), np.int64)
    for t, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = n
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    weights = [(rank[at], weight[at] * often) for at, often in items.asked]
    paths = vectors.filter(F.size("terms") > 0).mapInArrow(_pathed(rank), "doc_id long, n long, path array<int>, tf array<int>")
    shards = max(1, -(-asked // rows))
    placed = written(paths, "term-paths").repartitionByRange(shards, F.slice("path", 1, KEY_TERMS), F.xxhash64("doc_id", "path"))
    return placed.mapInArrow(_ranked(items, weights, len(df), n_docs, total, k, rows), "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = RANKS, rows: int = SHARD_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending id, null ids last.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z read as a-z.  N documents have a term, and L terms in all;
    a term in df documents weighs floor(1000 ln((2N + 2) / (2df + 1))), and adds weight * (1e9 tf div (1000 tf + 12 m)) for each time that the item
    has it, with m = 75 + 25 n N div L for a document of n terms.  Null texts and texts without terms are no documents and no
    items.  Equal (id, text) rows of items are one item; other rows are items of their own, also with a null or repeated id.
    Repeated rows of docs are documents each.  Other columns are not read.  Empty in, empty out.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for b, block in enumerate(_blocks(items, item_id, item_text)):
        part = _block(slim, block, k, rows).withColumn("block", F.lit(b))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def query(spark, folder: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
docs AS MATERIALIZED (SELECT r, doc_id, w, len(w)::HUGEINT AS n FROM d WHERE len(w) > 0),
total AS MATERIALIZED (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS words FROM docs),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, t, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // words AS m FROM docs, total),
s AS (SELECT q, item_id, r, doc_id, sum(c * w * (({SCALE} * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {RANKS}"""
