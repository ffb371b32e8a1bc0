import math
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ranking


def terms(text):
    return re.findall(ranking.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for q, text in dict.fromkeys(items):
        scored = []
        for i, c in found:
            m = 75 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(q, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scored)[:k])]
    return out


def table(spark, rows, name):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], f"{name} long, text string, n int, path string, rank int")


def same(found, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    chance = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=chance / chance.sum()))) for i in range(n)]


EDGES = [(900, None), (901, ""), (902, "--- !"), (None, "w1 w2 w50"), (903, "W1, w1;ÉTÉ été"), (5, "w1 w59"), (5, "w1 w59"), (904, "w59 " * 3000), (905, "\x00w7\x7fw8")]
ITEMS = [(1, "w1 w2 w50 w59 w59"), (2, "W1!"), (2, "w7 w8"), (2, "w7 w8"), (None, "été"), (3, None), (4, ""), (5, "nowhere"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("rows", [40, 10_000])
def test_equals_brute_force(spark, rows):
    docs = corpus(300) + EDGES
    docs += [(2000 + i, docs[0][1]) for i in range(150)]  # a third are copies
    found = ranking.ranked(table(spark, docs, "doc_id"), table(spark, ITEMS, "item_id"), rows=rows)
    same(found.collect(), brute(docs, ITEMS))


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ITEM_CELLS", 10)
    docs = corpus(80, 3)
    same(ranking.ranked(table(spark, docs, "doc_id"), table(spark, ITEMS, "item_id"), k=5).collect(), brute(docs, ITEMS, 5))


@pytest.mark.parametrize("whole", [np.float64, np.int64])
def test_tree_leaves_documents_out(whole):
    """All of the best are found, and few scores are worked out where documents are of different kinds."""
    rng = np.random.default_rng(4)
    paths = [np.unique(rng.integers(100 * kind, 100 * kind + 100, 20)).astype(np.int32) for kind in range(20) for _ in range(200)]
    tfs = [rng.integers(1, 9, len(p)) for p in paths]
    offsets = np.cumsum([0, *map(len, paths)])
    m = rng.integers(75, 300, len(paths))
    weights = np.zeros((20, 2000), whole)
    for q in range(20):
        weights[q, rng.integers(100 * q, 100 * q + 100, 10)] = rng.integers(1, 9000, 10)
    tree = ranking.Tree(offsets, np.concatenate(paths), np.concatenate(tfs), m)
    place, score, worked = tree.search(weights, np.arange(len(paths)), 10)
    for q in range(20):
        full = [int(sum(int(weights[q, t]) * int(a) for t, a in zip(p, ranking.added(f, x), strict=True))) for p, f, x in zip(paths, tfs, m, strict=True)]
        want = sorted(range(len(full)), key=lambda d: (-full[d], d))[:10]
        assert score[q].tolist() == [full[d] for d in want] and place[q].tolist() == want
    assert worked < 20 * len(paths) / 4


def test_bounds_hold():
    """No document adds more than its nodes say."""
    rng = np.random.default_rng(5)
    paths = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(400)] + [np.array([1, 2, 3], np.int32)] * 300
    tfs = [rng.integers(1, 5, len(p)) for p in paths]
    m = rng.integers(75, 200, len(paths))
    tree = ranking.Tree(np.cumsum([0, *map(len, paths)]), np.concatenate(paths), np.concatenate(tfs), m, leaf=8)
    todo, seen = [tree.root], 0
    while todo:
        node = todo.pop()
        for d in range(node.begin, node.end):
            at = np.searchsorted(node.terms, tree.paths[d])
            assert (node.terms[at] == tree.paths[d]).all() and (node.most[at] >= ranking.added(tree.tfs[d], tree.m[d])).all()
        assert not node.children or [c.begin for c in node.children] == [node.begin, *[c.end for c in node.children[:-1]]]
        seen += 0 if node.children else node.end - node.begin
        todo += node.children
    assert seen == len(paths)


def test_paths_that_end_one_by_one():
    paths = [np.arange(i + 1, dtype=np.int32) for i in range(1500)]
    offsets = np.cumsum([0, *map(len, paths)])
    tree = ranking.Tree(offsets, np.concatenate(paths), np.ones(offsets[-1], np.int64), np.arange(1500) + 75, leaf=1)
    weights = np.zeros((1, 1500))
    weights[0, [0, 700]] = 5, 900
    place, score, _ = tree.search(weights, np.arange(1500), 3)
    assert place[0].tolist() == [700, 701, 702] and score[0, 0] > score[0, 1]


def test_empty(spark):
    docs, items = table(spark, corpus(3), "doc_id"), table(spark, ITEMS, "item_id")
    none, nothing = table(spark, [], "doc_id"), table(spark, [], "item_id")
    assert ranking.ranked(none, items).count() == 0 and ranking.ranked(docs, nothing).count() == 0 and ranking.ranked(none, nothing).count() == 0
    assert ranking.ranked(table(spark, [(1, None)], "doc_id"), items).count() == 0


def test_long_text(spark):
    docs = [(1, "w1 " * 900_000 + "w2"), (2, "w2"), (3, "x" * 200_000), *corpus(20)]
    same(ranking.ranked(table(spark, docs, "doc_id"), table(spark, ITEMS, "item_id")).collect(), brute(docs, ITEMS))
