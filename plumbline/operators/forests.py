"""Random forests whose trees never meet in one place.

Features are binned once and equal rows counted together.  Nodes of very many rows are split round by round from sums that Spark
groups; below them the rows of a tree's node are one group, and a task grows all that hangs from it.  Held-out rows go through
the same groups, so that what leaves a task are votes.  Only the splits of large nodes reach the driver, a few for each NODE_ROWS rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

BINS = 32
# Bounds of bins come from so many rows, about.
BOUND_ROWS = 10_000
# A node of more training rows than this is split by Spark; one task grows smaller ones.
NODE_ROWS = 200_000
# Rows that a task holds at a time when it deals them over the trees.
DEALT_ROWS = 100_000


def mixed(*parts) -> np.ndarray:
    """64 well-mixed bits of whole numbers; arrays broadcast."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.atleast_1d(np.asarray(p)).astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def unit(*parts) -> np.ndarray:
    return (mixed(*parts) >> np.uint64(11)).astype(float) * 2.0**-53


def repeats(n: np.ndarray, seed: int, tree: int, key: np.ndarray) -> np.ndarray:
    """How often a bootstrap takes each of n equal rows, all together: a Poisson draw of mean n (beyond 50 by its normal limit)."""
    u = unit(seed, tree, key)
    out, many = np.zeros(len(n), np.int64), n > 50
    left = np.flatnonzero(~many)
    p = np.exp(-n[left].astype(float))
    upto, k = p.copy(), 0
    while len(left) and k < 200:
        over = u[left] > upto
        left, p, upto, k = left[over], p[over], upto[over], k + 1
        out[left] = k
        p = p * n[left] / k
        upto = upto + p
    if many.any():
        z = np.sqrt(-2.0 * np.log1p(-u[many])) * np.cos(2.0 * np.pi * unit(seed, tree, key[many], 1))
        out[many] = np.maximum(0, np.rint(n[many] + np.sqrt(n[many]) * z)).astype(np.int64)
    return out


def drawn_features(seed: int, tree: int, nodes: np.ndarray, features: int, m: int) -> np.ndarray:
    """The m features that each node may split on."""
    draws = np.column_stack([mixed(seed, tree, nodes, f + 2) for f in range(features)])
    return np.argsort(draws, axis=1, kind="stable")[:, :m]


def best_bins(at: np.ndarray, b: np.ndarray, y: np.ndarray, w: np.ndarray, classify: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node 0..max(at): the score of its best cut, the bin it is behind, and the score without one; no cut: -inf.

    Scores are sums of squares over counts, whose rise is the gain in Gini impurity or in variance.  y is the class, or the sum of labels.
    """
    place = at * BINS + b
    order = np.argsort(place)
    a, c = at[order], place[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[first, len(a)])

    def upto(v: np.ndarray) -> np.ndarray:
        s = np.cumsum(v[order])
        return s - np.repeat(np.r_[0, s[first[1:] - 1]].astype(s.dtype), sizes)

    def whole(s: np.ndarray) -> np.ndarray:
        return np.repeat(s[first + sizes - 1], sizes)

    n = upto(w)
    total = whole(n)
    if classify:
        # a row of weight w adds 2kw + w*w to the sum of squares on the left, where k of its class are there before it
        group = (at * (int(y.max()) + 1) + y) * BINS + b
        by_class = np.argsort(group)
        g, v = group[by_class] // BINS, w[by_class]
        s = np.cumsum(v)
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        length = np.diff(np.r_[begin, len(g)])
        start = np.r_[0, s[begin[1:] - 1]]
        before, of_class = np.empty_like(s), np.empty_like(s)
        before[by_class] = s - v - np.repeat(start, length)
        of_class[by_class] = np.repeat(s[begin + length - 1] - start, length)
        left = upto(2 * before * w + w * w)
        right = whole(left) + upto(w * w - 2 * (of_class - before) * w)
        none = whole(left) / total
    else:
        s = upto(y)
        left, right, none = s * s, (whole(s) - s) ** 2, whole(s) ** 2 / total
    ends = np.r_[(c[1:] != c[:-1]) & (a[1:] == a[:-1]), False]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(ends, left / n + right / (total - n), -np.inf)
    best = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(ends & (score == np.repeat(best, sizes)))
    nodes, where = np.unique(a[hit], return_index=True)
    cut = np.full(len(first), -1)
    cut[nodes] = (c[hit[where]] % BINS)
    return best, cut, none[first]


def best_splits(seed: int, tree: int, nodes: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, m: int, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, bin) of each node."""
    drawn = drawn_features(seed, tree, nodes, x.shape[1], m)
    feature, cut, top = np.full(len(nodes), -1), np.zeros(len(nodes), int), np.full(len(nodes), -np.inf)
    for j in range(m):
        best, behind, none = best_bins(at, x[np.arange(len(at)), drawn[at, j]].astype(np.int64), y, w, classify)
        better = gains(best, none) & (best > top)
        feature[better], cut[better], top[better] = drawn[better, j], behind[better], best[better]
    return feature, cut


def gains(best: np.ndarray, none: np.ndarray) -> np.ndarray:
    return best > none + 1e-12 * np.abs(none)


def grown(seed: int, tree: int, node: int, depth: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, other: np.ndarray, m: int, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    """The leaves, below that node, of the training rows and of the other rows; children of node i are 2i and 2i+1."""
    at_node, at_other = np.full(len(x), node, np.int64), np.full(len(other), node, np.int64)
    rows, others = np.arange(len(x)), np.arange(len(other))
    for _ in range(depth - (node.bit_length() - 1)):
        if not len(rows):
            break
        nodes, at = np.unique(at_node[rows], return_inverse=True)
        feature, cut = best_splits(seed, tree, nodes, at, x[rows], y[rows], w[rows], m, classify)

        def down(rows, at, x, place):
            on = feature[at] >= 0
            rows, at = rows[on], at[on]
            place[rows] = 2 * place[rows] + (x[rows, feature[at]] > cut[at])
            return rows

        others = down(others, np.searchsorted(nodes, at_other[others]), other, at_other)
        rows = down(rows, at, x, at_node)
    return at_node, at_other


def placed(x: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node of each row below the splits of one tree."""
    node = np.ones(len(x), np.int64)
    ids = np.array(sorted(splits), np.int64)
    if not len(ids):
        return node
    feature, cut = (np.array([splits[i][k] for i in ids.tolist()]) for k in (0, 1))
    rows = np.arange(len(x))
    while len(rows):
        at = np.minimum(np.searchsorted(ids, node[rows]), len(ids) - 1)
        on = ids[at] == node[rows]
        rows, at = rows[on], at[on]
        node[rows] = 2 * node[rows] + (x[rows, feature[at]] > cut[at])
    return node


def _bounds(df: DataFrame, features: list[str], rows: int) -> list[np.ndarray]:
    """At most BINS - 1 bounds for each feature: between all values of few, else between shares of about equal size.

    Equal rows have one draw, which rounds their share of BOUND_ROWS up or down: copies are neither all left out nor all fetched.
    """
    draw = F.pmod(F.xxhash64(F.lit("bounds"), "_row"), F.lit(1 << 30)) / float(1 << 30)
    pool = df.groupBy("_row", *features).agg(F.count(F.lit(1)).alias("_rows"))
    pool = pool.withColumn("_drawn", F.ceil(F.col("_rows") * min(1.0, BOUND_ROWS / max(rows, 1)) - draw)).where("_drawn > 0")
    sample = pool.select(*features, "_drawn").toPandas()
    out = []
    for f in features:
        v = np.sort(sample[f].repeat(sample["_drawn"]).dropna().to_numpy(dtype=float))
        distinct, begin = np.unique(v, return_index=True)
        ends = np.arange(1, len(distinct))
        if len(distinct) > BINS:  # the value that begins nearest to each share's begin
            share = np.arange(1, BINS) * len(v) / BINS
            after = np.searchsorted(begin, share)
            near = np.where((after < len(begin)) & (begin[np.minimum(after, len(begin) - 1)] - share <= share - begin[after - 1]), after, after - 1)
            ends = np.unique(near[near > 0])
        out.append(distinct[ends - 1] / 2 + distinct[ends] / 2)
    return out


def _buffers(batches, columns: list[str]):
    """Columns of Arrow batches, DEALT_ROWS rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= DEALT_ROWS:
            yield [pa.Table.from_batches(held).column(c) for c in columns]
            held, n = [], 0
    if n:
        yield [pa.Table.from_batches(held).column(c) for c in columns]


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def forest_predictions(df: DataFrame, features: list[str], held_out, classify: bool, trees: int, depth: int, seed: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """(label, prediction) of the held-out rows of a table (_row, label, features) by a forest fitted on the others.

    Each tree has a bootstrap of the rows; a node looks at ceil(sqrt(features)) of them for classes, else at a third; bins, gains and
    votes are those of Spark's forests.  A tree's votes for classes are the shares in its leaf, ties go to the smaller class.
    """
    spark, width = df.sparkSession, len(features)
    m = math.ceil(math.sqrt(width)) if classify else math.ceil(width / 3)
    known = written(df.select("_row", "label", *features, held_out.alias("held_out")), "forest-rows")
    bounds = _bounds(known.where("NOT held_out"), features, known.where("NOT held_out").count())

    def bin_rows(batches):
        for b in batches:
            x = np.column_stack([np.searchsorted(t, b.column(f).to_numpy(zero_copy_only=False).astype(float)).astype(np.uint8) for f, t in zip(features, bounds, strict=True)])
            packed = pa.array([x[i].tobytes() for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, b.column("label"), b.column("held_out")], names=["x", "label", "held_out"])

    binned = written(known.mapInArrow(bin_rows, "x binary, label double, held_out boolean"), "forest-bins")
    # labels enter the sums as distances from their mean
    middle = 0.0 if classify else float(binned.where("NOT held_out").agg(F.avg("label")).first()[0] or 0.0)
    cells = binned.where("NOT held_out").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("x", "label"))
    asked = binned.where("held_out").select("x", F.lit(None).cast("double").alias("label"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("id")).distinct()
    cells = written(cells.select("x", "label", "n", "id").unionByName(asked), "forest-cells")

    def taken(table, tree, x):
        """The training rows that a tree's bootstrap has, with their weights."""
        _, _, n, key = table
        w = repeats(n, seed, tree, key)
        rows = np.flatnonzero(w)
        return rows, w[rows]

    def arrays(columns):
        x, label, n, key = columns
        return _matrix(x, width), label.to_numpy().astype(float) - middle, n.to_numpy(), key.to_numpy()

    splits: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
    ready: dict[int, dict[int, tuple[list[int], list[float]]]] = {t: {} for t in range(trees)}  # leaves known so far
    large = {(t, 1) for t in range(trees)} if cells.where("n > 0").count() > node_rows else set()
    columns = ["x", "label", "n", "id"]

    def summed(batches):
        top, wanted = shared.value
        for held in _buffers(batches, columns):
            table = arrays(held)
            x, label, _, _ = table
            for tree in sorted({t for t, _ in wanted}):
                rows, w = taken(table, tree, x)
                node = placed(x[rows], top[tree])
                nodes = np.array(sorted(i for t, i in wanted if t == tree), np.int64)
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                on = nodes[at] == node
                rows, w, at = rows[on], w[on], at[on]
                if not len(rows):
                    continue
                drawn = drawn_features(seed, tree, nodes, width, m)
                y = label[rows].astype(np.int64) if classify else np.zeros(len(rows), np.int64)
                most = int(y.max()) + 1
                for j in range(m):
                    key, of = np.unique((at * BINS + x[rows, drawn[at, j]]) * most + y, return_inverse=True)
                    place = key // most
                    yield pa.RecordBatch.from_pydict({
                        "tree": np.full(len(key), tree), "node": nodes[place // BINS], "j": np.full(len(key), j), "bin": place % BINS, "class": key % most,
                        "w": np.bincount(of, w).astype(np.int64), "s": np.bincount(of, w * label[rows]), "rows": np.bincount(of)})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        best = (-np.inf, -1, 0, 0, 0)
        for j, part in pdf.groupby("j"):
            b, w = part["bin"].to_numpy(np.int64), part["w"].to_numpy(np.int64)
            score, cut, none = best_bins(np.zeros(len(part), np.int64), b, part["class"].to_numpy(np.int64) if classify else part["s"].to_numpy(float), w, classify)
            if gains(score, none)[0] and score[0] > best[0]:
                left = int(part["rows"][part["bin"] <= cut[0]].sum())
                best = (score[0], int(drawn_features(seed, tree, np.array([node]), width, m)[0, j]), int(cut[0]), left, int(part["rows"].sum()) - left)
        leaf = pdf[pdf["j"] == 0].groupby("class")[["w", "s"]].sum()
        values = leaf["w"] / leaf["w"].sum() if classify else leaf["s"] / leaf["w"]
        final = best[1] < 0
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": [best[1]], "cut": [best[2]], "left": [best[3]], "right": [best[4]],
                             "classes": [leaf.index.tolist() if final else []], "values": [values.tolist() if final else []]})

    while large:
        shared = spark.sparkContext.broadcast((splits, large))
        sums = cells.where("n > 0").mapInArrow(summed, "tree long, node long, j long, bin long, class long, w long, s double, rows long")
        sums = sums.groupBy("tree", "node", "j", "bin", "class").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("rows").alias("rows"))
        found = sums.groupBy("tree", "node").applyInPandas(split, "tree long, node long, feature long, cut long, left long, right long, classes array<long>, values array<double>").collect()
        large = set()
        for r in found:
            if r["feature"] < 0:
                ready[r["tree"]][r["node"]] = (r["classes"], r["values"])
                continue
            splits[r["tree"]][r["node"]] = (r["feature"], r["cut"])
            if r["node"].bit_length() < depth:
                large |= {(r["tree"], 2 * r["node"] + k) for k, rows in enumerate((r["left"], r["right"])) if rows > node_rows}
    whole = spark.sparkContext.broadcast((splits, ready))

    def dealt(batches):
        """The rows of every tree by the nodes that tasks grow, packed."""
        top, known = whole.value
        for held in _buffers(batches, columns):
            table = arrays(held)
            x, label, n, _ = table
            for tree in range(trees):
                rows, w = taken(table, tree, x)
                rows, w = np.r_[rows, np.flatnonzero(n == 0)], np.r_[w, np.zeros(int((n == 0).sum()), np.int64)]
                node = placed(x[rows], top[tree])
                order = np.argsort(node, kind="stable")
                begins = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0]) if len(order) else []
                out = {"tree": [], "node": [], "x": [], "y": [], "w": []}
                for part in np.split(order, begins[1:]) if len(order) else []:
                    if int(node[part[0]]) in known[tree]:
                        part = part[w[part] == 0]  # the leaf is known, only rows that ask for it go there
                    if len(part):
                        at = rows[part]
                        for name, v in (("tree", tree), ("node", int(node[part[0]])), ("x", x[at].tobytes()), ("y", label[at].tobytes()), ("w", w[part].astype(np.int32).tobytes())):
                            out[name].append(v)
                if out["tree"]:
                    yield pa.RecordBatch.from_pydict(out)

    def votes(key, table):
        tree, node = key[0].as_py(), key[1].as_py()
        x = _matrix(table.column("x"), width)
        y, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("y", float), ("w", np.int32)))
        fit = w > 0
        given = whole.value[1][tree].get(node)
        other = x[~fit]
        if given:
            leaf = np.zeros(len(other), np.int64)
            of, classes, values = np.zeros(len(given[0]), np.int64), np.array(given[0], np.int64), np.array(given[1], float)
        else:
            x, y, w = x[fit], y[fit], w[fit].astype(np.int64)
            # rows in one order, whatever the order in which they came
            order = np.lexsort((y, *x.T))
            x, y, w = x[order], y[order], w[order]
            label = y.astype(np.int64) if classify else y * w
            at, leaf = grown(seed, tree, node, depth, x, label, w, other, m, classify)
            of, inverse = np.unique(at * (int(label.max()) + 1 if classify else 1) + label if classify else at, return_inverse=True) if len(at) else (np.zeros(0, np.int64), at)
            weight = np.bincount(inverse, w, len(of))
            if classify:
                most = int(label.max()) + 1 if len(label) else 1
                of, classes = of // most, of % most
                begin = np.flatnonzero(np.r_[True, np.diff(of) != 0]) if len(of) else np.zeros(0, np.int64)
                values = weight / np.repeat(np.add.reduceat(weight, begin), np.diff(np.r_[begin, len(of)])) if len(of) else weight
            else:
                classes, values = np.zeros(len(of), np.int64), np.bincount(inverse, label, len(of)) / weight
        low, high = np.searchsorted(of, leaf), np.searchsorted(of, leaf, "right")
        count = high - low
        pick = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return pa.table({"x": pa.array([other[i].tobytes() for i in np.repeat(np.arange(len(other)), count)], pa.binary()), "class": classes[pick], "vote": values[pick]})

    groups = sum(len(s) + 1 for s in splits.values())
    packed = cells.mapInArrow(dealt, "tree long, node long, x binary, y binary, w binary").repartition(min(2000, 3 * groups), "tree", "node")
    each = packed.groupBy("tree", "node").applyInArrow(votes, "x binary, class long, vote double")
    if classify:
        # rounded, so that the order of sums breaks no ties
        by_class = each.groupBy("x", "class").agg(F.round(F.sum("vote"), 9).alias("vote"))
        chosen = by_class.groupBy("x").agg(F.max_by("class", F.struct("vote", -F.col("class"))).cast("double").alias("prediction"))
    else:
        chosen = each.groupBy("x").agg((F.avg("vote") + F.lit(middle)).alias("prediction"))
    return written(binned.where("held_out").join(chosen, "x").select("label", "prediction"), "forest-votes")
