import duckdb
import pytest

from plumbline.llm import quality
from tests.llm.conftest import sentence

PROSE = "The quick brown fox jumps over the lazy dog near the river bank. "


def prose(i):
    return " ".join(f"Some{chr(97 + i % 26)}{chr(97 + j % 26)} word{chr(97 + (i * j) % 26)}s stand{chr(97 + (i + j) % 26)} here{chr(97 + j // 26)}." if j % 3 == 0 else f"and{chr(97 + (i * 3 + j) % 26)}{chr(97 + j % 26)} other{chr(97 + (j * j + i) % 26)}" for j in range(60))


def test_counts_and_base(docs):
    rows = [(1, "a b c\na b c\n\n \nx#y $$"), (2, None), (3, ""), (4, "é é"), (5, "a a a a"), (1, "a b c\na b c\n\n \nx#y $$")]
    found = {r["doc_id"]: r for r in quality.quality(docs(rows)).collect()}
    one = found[1]
    assert (one["n_words"], one["word_chars"], one["n_symbols"], one["n_dup_lines"], one["n_repeat_words"]) == (8, 11, 3, 1, 6)
    assert found[2]["n_words"] == found[3]["n_words"] == 0 and found[2]["base_failed"] and not found[2]["kept"]
    assert found[4]["word_chars"] == 2 and found[5]["n_repeat_words"] == 4
    assert quality.quality(docs(rows)).count() == 6


def test_defects_go_and_prose_stays(docs):
    good = [(i, prose(i)) for i in range(80)]
    bad = [(100 + i, " ".join(f"{w}%%%" if k % 2 else f"{w}$$$" for k, w in enumerate(prose(i).split()))) for i in range(12)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality(docs(good + bad)).collect()}
    assert all(found[i] for i, _ in good)
    assert not any(found[i] for i, _ in bad)
    kept = quality.keep_good(docs(good + bad))
    assert kept.columns == docs(good).columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(80))


def test_sql_twin(spark, docs, tmp_path):
    rows = [(i, prose(i) if i % 5 else sentence(i, 60).replace("x", "# ")) for i in range(60)] + [(None, "a b"), (70, None), (70, "\n\n\t")]
    table = docs(rows)
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.execute(quality.ORACLE_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in quality.query(spark, str(tmp_path)).collect()) == want


def test_empty(docs):
    assert quality.quality(docs([])).count() == 0 and quality.keep_good(docs([])).count() == 0


@pytest.mark.parametrize("rounds", [1, 5])
def test_trust_without_documents_is_the_prior(spark, rounds):
    t = quality.estimate(spark.createDataFrame([], "votes array<int>, n long"), rounds=rounds)
    assert t.good == pytest.approx(0.9) and all(a == pytest.approx(0.99) for a in t.right_on_good)
