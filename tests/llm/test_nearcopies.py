import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from plumbline.llm import nearcopies
from plumbline.llm.components import components
from tests.llm.conftest import sentence


def changed(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for k in range(n):
        words[rng.randrange(len(words))] = f"new{seed}y{k}"
    return " ".join(words)


def windows(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def common(a, b):
    """The longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def classes_of(df):
    return {r["doc_id"]: r["class_id"] for r in nearcopies.classes(df).collect()}


def test_against_all_pairs(docs):
    texts = {}
    for base in range(8):
        text = sentence(base, 40 + 15 * base)
        for k in range(5):
            texts[base * 10 + k] = changed(text, k * (1 + base % 3), base * 10 + k)
    got = classes_of(docs(list(texts.items())))
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            if a < b:
                x, y = windows(texts[a]), windows(texts[b])
                met = common(x, y)
                if met >= 0.8 * (len(x) + len(y) - met):
                    parent[root(b)] = root(a)
    groups = defaultdict(set)
    for d in texts:
        groups[root(d)].add(d)
    want = {d: min(g) for g in groups.values() for d in g}
    assert got == want


def test_short_texts_against_all_pairs(docs):
    """Short texts that differ by a word at the begin or end, or by one in the middle."""
    texts = {}
    for base, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 14, 20, 30, 45, 55, 66, 68, 70, 75]):
        t = sentence(base, n)
        cut = t.split()
        for k, one in enumerate([t, t + " after", "before " + t, f"before {t} after", " ".join(cut[: n // 2] + ["amid"] + cut[n // 2 + 1 :])]):
            texts[base * 10 + k] = one
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            if a < b:
                x, y = windows(texts[a]), windows(texts[b])
                met = common(x, y)
                if met >= 0.8 * (len(x) + len(y) - met):
                    one, two = sorted((root(a), root(b)))
                    parent[two] = one
    assert classes_of(docs(list(texts.items()))) == {d: root(d) for d in texts}


def test_cases(docs):
    t = sentence(1, 30)
    rows = [(5, t), (3, t), (3, t), (9, t.replace(" ", "\n ")), (1, None), (2, ""), (4, " \t"), (None, t), (7, "a b"), (8, "a b"), (10, "b a"), (11, sentence(2, 20_000))]
    found = nearcopies.classes(docs(rows)).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r["class_id"] for r in found}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 4, None: None, 7: 7, 8: 7, 10: 10, 11: 11}
    kept = nearcopies.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, d) for d in (1, 2, 3, 4, 7, 10, 11)] + [(True, 0)]
    assert nearcopies.classes(docs([])).count() == 0 and nearcopies.keep_one(docs([])).count() == 0


def test_large_group_with_a_common_passage(docs):
    base, line = sentence(1, 120), sentence(99, 40)
    rows = [(0, base)] + [(i, changed(base, 2, i)) for i in range(1, 60)] + [(100 + i, line + " " + sentence(1000 + i, 45)) for i in range(60)]
    got = classes_of(docs(rows))
    assert {got[i] for i in range(60)} == {0}
    assert all(got[100 + i] == 100 + i for i in range(60))


def test_group_of_which_a_part_is_near(docs):
    """Copies with many changes share buckets with the others, but are near to none."""
    base = sentence(1, 150)
    texts = {i: changed(base, i % 9, i) for i in range(90)}
    got = classes_of(docs(list(texts.items())))
    parent = list(range(90))

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in range(90):
        for b in range(a):
            x, y = windows(texts[a]), windows(texts[b])
            if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    assert got == {d: root(d) for d in texts}


def edited(base, slots, tag):
    """The base of 150 words with a word of its own in each of the slots, which are five words apart."""
    words = base.split()
    for k in slots:
        words[5 * k + 2] = f"own{tag}y{k}"
    return " ".join(words)


def pairs_of_one_base(base, n, first):
    """Pairs of similarity 0.814, changed in the same three slots, and less than 0.8 to all others; they share windows of the base only."""
    slots = random.Random(first).sample([(a, b, c) for a in range(1, 28) for b in range(a) for c in range(b)], n)
    return {first + 2 * i + j: edited(base, s, first + 2 * i + j) for i, s in enumerate(slots) for j in (0, 1)}


def linked(docs, near, rest, sketches):
    """The classes found, and those of all pairs (d, d + 1) of near that share a sketch."""
    texts = pa.record_batch([pa.array(list(near)), pa.array(list(near.values()))], ["id", "text"])
    keys = {i: set(k) for b in nearcopies._sketched(5, sketches, 8)([texts]) for i, k in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)}
    want = {d: d - 1 if d % 2 and keys[d] & keys[d - 1] else d for d in near} | {d: d for d in rest}
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(docs([*near.items(), *rest.items()]), sketches=sketches).collect()}
    return got, want


def test_large_group_of_which_few_pass_the_bound(docs):
    base = sentence(1, 150)
    got, want = linked(docs, pairs_of_one_base(base, 60, 10_000), {i: base + " " + sentence(10 + i, 45) for i in range(600)}, 6)
    assert got == want


def test_large_group_of_pairs_that_share_one_bucket(docs):
    got, want = linked(docs, pairs_of_one_base(sentence(1, 150), 250, 10_000), {}, 8)
    assert got == want


def test_alignment_is_the_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 5))) if rng.random() < 0.7 else rng.integers(0, 30, 40).astype(np.uint64)
        want, got = common(a.tolist(), b.tolist()), nearcopies.aligned(a, b, 0.8)
        enough = want >= 0.8 * (len(a) + len(b) - want) - 1e-9
        assert got <= want and (got == want or not enough)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
