import numpy as np
import pytest

from plumbline.llm import vantage


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 3) for i in range(900)]
    rows += [(i, rows[i % 7][1], 1) for i in range(900, 960)]
    rows += [(1000, None, 1), (1100, [0.0] * 6, 1), (1200, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (1300, [float("nan")] * 6, 1), (1400, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1500, [1.0, 2.0], 1), (1501, [1.5, 2.0], 1), (1600, [], 1), (0, rows[0][1], 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q in {(i, tuple(v)) for i, v in usable if i in queries}:
        near = sorted((vantage.distances(np.array(q[1])[None], v[None])[0], i) for i, v in usable if i != q[0] and len(v) == len(q[1]))
        out |= {(q[0], n + 1, i, d) for n, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("shard_rows", "block"), [(100, 3), (10_000, 1000)])
def test_exact(table, shard_rows, block):
    queries = table.filter("vec_id % 100 = 0")
    found = vantage.nearest(table, queries, shard_rows=shard_rows, block=block).collect()
    want = brute([tuple(r) for r in table.collect()], {r["vec_id"] for r in queries.collect()}, 10)
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_relaxed_recall(table):
    queries = table.filter("vec_id % 20 = 0")
    exact, relaxed = ({(r["query_id"], r["vec_id"]) for r in vantage.nearest(table, queries, factor=f).collect()} for f in (1.0, 0.7))
    assert len(exact & relaxed) >= 0.9 * len(exact)


def test_index_holds_every_row(table):
    rows = table.filter("vec_id < 960").select("vec_id", table["embedding"].cast("array<double>").alias("vector"))
    trees = [vantage.Tree.unpack(bytes(r["tree"])) for r in vantage.index(rows, 100)[0].collect()]
    assert sum(len(t.ids) for t in trees) == rows.count() and len(trees) > 5


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vantage.nearest(none, none).count() == 0 and vantage.nearest(some, none).count() == 0
    assert vantage.nearest(none, some).count() == 0 and vantage.nearest(some, some).count() == 0


def clustered(n, dim=16, centres=40):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(centres, dim)) * 10
    return middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))


def test_far_leaves_are_not_searched():
    """On vectors in clusters most leaves are ruled out, and none that holds one of the nearest."""
    x = clustered(8000)
    top = vantage.Top(x[::4], 6)
    leaf, queries = top.leaf(x), x[:200]
    far = np.sqrt(((queries[:, None] - x[None]) ** 2).sum(-1))
    worst = np.sort(far, axis=1)[:, 10]
    found = top.reached(queries, worst)
    assert all(set(leaf[far[i] <= worst[i]].tolist()) <= set(found[i].tolist()) for i in range(200))
    assert sum(map(len, found)) < 0.25 * 200 * 64


def test_clusters_and_copies(spark):
    """A third of all rows are copies of one row: they are dealt into shards of their own size, and told as the search of all tells them."""
    x = clustered(600, 5, 6)
    rows = [(i, x[i].tolist()) for i in range(600)] + [(5000, x[3].tolist())] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    trees, tops = vantage.index(df.select("vec_id", df["embedding"].alias("vector")), 50)
    sizes = [len(vantage.Tree.unpack(bytes(r["tree"])).ids) for r in trees.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 100 and tops[5].levels >= 4
    found = vantage.nearest(df, df.filter("vec_id % 100 = 0"), shard_rows=50, block=2).collect()
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    assert {tuple(r) for r in found} == want


def test_recall_of_relaxed_search(spark):
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 30 = 0")
    exact, relaxed = ({(r["query_id"], r["vec_id"]) for r in vantage.nearest(df, queries, factor=f, shard_rows=100).collect()} for f in (1.0, 0.5))
    assert len(exact) == 1000 and len(exact & relaxed) >= 900
