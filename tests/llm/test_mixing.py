import random
from collections import Counter

import duckdb
import pytest

from plumbline.llm import mixing
from tests.llm.conftest import sentence


def level_by_rounds(sizes, weights, epochs):
    """Targets by giving out what is over again and again."""
    target, open_, left = {s: 0.0 for s in sizes}, set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            most = epochs * sizes[s] - target[s]
            target[s] += min(share[s], most)
            if share[s] >= most:
                left += share[s] - most
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 2, "c": 3, "d": 100_000, "e": 50}, {"a": 7}, {"a": 0, "b": 9}, {"a": 0}])
def test_targets(spark, sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(level_by_rounds(sizes, weights, 3))


def rows():
    rng = random.Random(3)
    out = [(i, sentence(i, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "c", None, "ä"])) for i in range(400)]
    return out + [(None, "x y z", "a")] * 3 + [(5, "q r", "c")] * 2 + [(900, None, "b"), (901, "", "z")]


def test_mix(docs):
    found = mixing.mix(docs(rows())).collect()
    assert len(found) == len(rows())
    taken, target = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(taken[s] == round(target[s]) for s in target)
    again = mixing.mix(docs(rows()[::-1]).repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    out = mixing.mixed(docs(rows()), length="n_chars")
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"] or "")
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n} and out.columns == docs(rows()).columns


def test_sql_twin_and_ranges(spark, docs, tmp_path, monkeypatch):
    docs(rows()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.execute(mixing.ORACLE_SQL).fetchall()))
    for bits in (0, 3, 30):
        monkeypatch.setattr(mixing, "_bits", lambda rows, bits=bits: bits)
        assert sorted(str(tuple(r)) for r in mixing.query(spark, str(tmp_path)).collect()) == want


def test_empty(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0


def test_rows_without_id_are_spread(docs):
    """Texts of one size and no id have keys of their own, so the cut's range holds few of them."""
    found = docs([(None, f"a{i} b", "s") for i in range(2000)])
    keys = mixing._sized(found, "doc_id", "text", "source", 8).groupBy("key").count()
    assert keys.count() == 2000
    mix = mixing.mix(docs([(None, f"a{i} b", "s") for i in range(200)] + [(1, "x " * 50, "t")])).collect()
    assert sum(r["taken"] for r in mix if r["source"] == "s") == round(next(r["target"] for r in mix if r["source"] == "s"))
