"""Byte ranges of XML files, and searches with a stored index."""

import gzip
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import search
from plumbline.operators.papers import search_papers
from plumbline.operators.search import search_index, store_index
from plumbline.sources import ranges as G
from plumbline.sources import readers as R

ARTICLES = "".join(
    f'<PubmedArticle Status="x"><MedlineCitation><PMID Version="1">{i}</PMID><Article><ArticleTitle>Étude &lt;{i}&gt;</ArticleTitle>'
    f"<Abstract><AbstractText>Words {'more ' * (i % 5)}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>\n" for i in range(12)
)
FILE = f'<?xml version="1.0"?>\n<PubmedArticleSet>\n{ARTICLES}<PubmedArticle/>\n</PubmedArticleSet>\n'


def test_ranges_cut_anywhere():
    """Two ranges that meet at any byte of the file tell every record once, whatever is read at a time."""
    data = FILE.encode()
    whole = list(G.records(io.BytesIO(data), "PubmedArticle", 0, len(data)))
    assert len(whole) == 13 and whole[-1] == "<PubmedArticle/>" and whole[3].startswith("<PubmedArticle S") and whole[3].endswith("</PubmedArticle>")
    for cut in range(len(data) + 1):
        chunk = 1 + cut % 97
        assert list(G.records(io.BytesIO(data), "PubmedArticle", 0, cut, chunk)) + list(G.records(io.BytesIO(data), "PubmedArticle", cut, len(data), chunk)) == whole
    assert list(G.records(io.BytesIO(data[:-60]), "PubmedArticle", 0, len(data), 50)) == whole[:11] and list(G.records(io.BytesIO(b""), "a", 0, 9)) == []


def test_small_ranges_read_the_file_once():
    """Ranges smaller than a chunk read little more than their own bytes, and a record is no copy of all that follows it."""

    class Counted(io.BytesIO):
        got = 0

        def read(self, size=-1):
            part = super().read(size)
            Counted.got += len(part)
            return part

    data = (b"<PubmedArticle>" + b"x" * 1500 + b"</PubmedArticle>\n") * 4000
    found = sum(len(list(G.records(Counted(data), "PubmedArticle", a, min(a + (1 << 18), len(data))))) for a in range(0, len(data), 1 << 18))
    assert found == 4000 and Counted.got < 1.1 * len(data)


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
def test_article_ranges(spark, tmp_path, size):
    (tmp_path / "a.xml").write_text(FILE)
    (tmp_path / "b.xml").write_text(FILE.replace("Words", "Other"))
    want = rows(R.read_article_xml(spark, str(tmp_path)))
    found = G.read_article_ranges(spark, str(tmp_path), size)
    assert found.rdd.getNumPartitions() == 2 * -(-len(FILE.encode()) // size)
    key = lambda r: str(r)
    assert sorted(rows(found), key=key) == sorted(want, key=key) and len(want) == 26
    assert found.columns == R.read_article_xml(spark, str(tmp_path)).columns


def test_packed_and_broken_files(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(FILE.encode()))
    (tmp_path / "c.xml").write_text("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</MedlineCitation></PubmedArticle></PubmedArticleSet>")
    (tmp_path / "empty.xml").write_text("")
    assert G.read_article_ranges(spark, str(tmp_path), 100).count() == 13
    assert G.read_feed_ranges(spark, str(tmp_path), 100).count() == 0


def test_search_equals_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["on", "Graph", "graphs", "naïve", "ÉTUDE", "x", "quantum", "zz"]
    data = [(i, " ".join(rng.choices(words, k=3)), None if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(400)]
    data += [(400 + i, "needle in block" if i == 77 else "hay", "") for i in range(200)]
    papers = spark.createDataFrame(data, "id long, title string, abstract string")
    store_index(papers, str(tmp_path / "index"), block_rows=60)
    for text in ("graph", "GRAPHS ON", "étude", "x", "zz", "on x", "needle in b", "nowhere", "n", "lock", "s", "y n", ""):
        found = search_index(spark, str(tmp_path / "index"), text)
        assert sorted(r["id"] for r in found.papers.collect()) == sorted(r["id"] for r in search_papers(papers, text or None).collect()), text
        assert found.papers.columns == papers.columns
    rare = search_index(spark, str(tmp_path / "index"), "needle")
    assert rare.blocks_read == 1 < rare.blocks and rare.candidates == 1
    assert search_index(spark, str(tmp_path / "index"), "nowhere").blocks_read == 0
    grams = spark.read.parquet(str(tmp_path / "index/grams")).filter(F.col("gram").isin("nee", "eed"))
    assert "PushedFilters: [In(gram" in grams._jdf.queryExecution().executedPlan().toString()


def test_search_of_no_papers(spark, tmp_path):
    none = spark.createDataFrame([], "id long, title string, abstract string")
    store_index(none.union(spark.createDataFrame([(1, None, None)], none.schema)), str(tmp_path / "i"))
    assert search_index(spark, str(tmp_path / "i"), "a").papers.count() == 0


@pytest.mark.parametrize("chars, papers", [(search.PIECE_CHARS, search.PIECE_PAPERS), (12, 2)])
def test_postings_are_made_where_the_papers_are(spark, monkeypatch, chars, papers):
    """Every stretch of every text went through a shuffle as a row of its own before."""
    monkeypatch.setattr(search, "PIECE_CHARS", chars)
    monkeypatch.setattr(search, "PIECE_PAPERS", papers)
    wide = "".join(map(chr, range(0x4E00, 0x9FA5)))
    data = [(0, 3, "Ab", "aBcabc"), (0, 1, None, "\U0001F600\u00c9\U0001F600\u00e9x"), (1, 7, "", None), (1, 4, "a\0b", "\0"), (2, 9, "abc", "b"), (2, 2, "bc", "ABCab")]
    data += [(3, i, wide[i:] + wide[:i], "") for i in range(12)]
    rows = search.postings(spark.createDataFrame(data, "block int, key long, title string, abstract string").coalesce(1))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want, got = {}, {}
    for block, key, *texts in data:
        for t in texts:
            t = (t or "").lower()
            for i in range(len(t)):
                want.setdefault((t[i : i + 3].ljust(3, "\0"), block), set()).add(key)
    for r in rows.collect():
        assert r["keys"] == sorted(r["keys"]) and (r["low"], r["high"], r["n"]) == (r["keys"][0], r["keys"][-1], len(r["keys"]))
        known = got.setdefault((r["gram"], r["block"]), [])
        known += r["keys"]
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}


def test_search_of_blocks_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PIECE_PAPERS", 7)
    papers = spark.createDataFrame([(i, f"paper {i}", "needle" if i % 11 == 0 else "hay") for i in range(90)], "id long, title string, abstract string")
    store_index(papers, str(tmp_path / "index"), block_rows=45)
    for text in ("needle", "r 1", "ha", "paper 89"):
        found = search_index(spark, str(tmp_path / "index"), text)
        assert sorted(r["id"] for r in found.papers.collect()) == sorted(r["id"] for r in search_papers(papers, text).collect()), text


def test_postings_of_texts_of_very_many_characters():
    """A number holds the characters and papers of a few papers only: the others are taken by themselves."""
    wide = "".join(map(chr, range(0x10000, 0x110000)))
    texts = [wide, *[f"text {i}" for i in range(20)]]
    given = pa.RecordBatch.from_pydict({"block": pa.array([0] * 21, pa.int32()), "key": list(range(21)), "title": texts, "abstract": [None] * 21})
    made = list(search._posting_batches([given]))
    want = {(t[i : i + 3].ljust(3, "\0"), k) for k, t in enumerate(texts) for i in range(len(t))}
    got = [(g, k) for b in made for g, keys in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for k in keys]
    assert len(made) > 1 and len(got) == len(want) and set(got) == want
