import itertools
import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pieces
from plumbline.llm.wordhash import mixed

P = pieces.pieces(pieces.default_model())


def texts_of(texts, seeds=None, sharpness=1.0):
    ids, n = pieces.sampled(pa.array(texts, pa.string()), np.arange(len(texts), dtype=np.uint64) if seeds is None else seeds, P, sharpness)
    ends = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in itertools.pairwise(ends)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), max_size=6))
def test_lossless(texts):
    assert [pieces.joined(x, P) for x in texts_of(texts)] == texts


def test_special_texts():
    texts = ["", " ", "  a", "a  ", "▁", " ▁▁ x", "\n\n", "a\nb", "<s></s><unk><0x0A>", "\x00", "😀" * 50, "x" * 5000, " " * 3000]
    assert [pieces.joined(x, P) for x in texts_of(texts)] == texts
    assert not {0, 1, 2} & {i for x in texts_of(texts) for i in x}


def test_distribution():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    names = {model.id_to_piece(i): i for i in range(3, model.get_piece_size()) if not model.is_byte(i)}
    n, sharpness = 40_000, 0.3
    for word in ("▁there", "▁haus"):
        ways = {}
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in names for p in parts):
                ways[tuple(names[p] for p in parts)] = math.exp(sharpness * sum(P.log_p[names[p]] for p in parts))
        total = sum(ways.values())
        got = Counter(map(tuple, texts_of([word[1:]] * n, mixed(np.arange(n, dtype=np.uint64)), sharpness)))
        assert set(got) <= set(ways)
        for way, weight in ways.items():
            p = weight / total
            assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_table(spark, docs):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (None, "x"), (1, "Hello  world"), (4, "word " * 30_000), (5, "é" * 400)]
    df = docs(rows)
    out = pieces.encode(df, keep=["doc_id", "text"], sharpness=0.2)
    found = out.collect()
    assert len(found) == len(rows) and all(r["n_pieces"] == len(r["ids"] or []) for r in found)
    assert [r["ids"] for r in found if r["doc_id"] == 2] == [None] and [r["ids"] for r in found if r["doc_id"] == 3] == [[]]
    one = [r["ids"] for r in found if r["doc_id"] == 1]
    assert one[0] == one[1]
    again = pieces.encode(df.repartition(3), keep=["doc_id", "text"], sharpness=0.2)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    assert all(r["decoded"] == r["text"] for r in pieces.decode(out).collect())
    assert pieces.encode(docs([])).count() == 0 and pieces.decode(pieces.encode(docs([]))).count() == 0


def test_keys_differ(docs):
    found = pieces.encode(docs([(i, "internationalisation of understanding " * 5) for i in range(40)]), sharpness=0.1).collect()
    assert len({tuple(r["ids"]) for r in found}) > 20


def test_clashing_names(docs):
    with pytest.raises(ValueError, match="n_pieces"):
        pieces.encode(docs([(1, "a")]).withColumnRenamed("n_chars", "n_pieces"), keep=["doc_id", "n_pieces"])


@pytest.mark.parametrize("window", [1, 5, 64, 4096])
def test_long_units_draw_as_short_ones(monkeypatch, window):
    """Windows of any size give the ids of the whole lattice, characters without a piece and literal U+2581 included."""
    rng = np.random.default_rng(3)
    alphabet = list("abcdefghijstmnoe▁é語😀")
    texts = ["".join(rng.choice(alphabet, n)) for n in (0, 1, 40, 300, 1900)] + ["a b " + "there" * 200 + " c", "there" * 200, None, "there" * 200, " " * 900, "x\n" + "=" * 500]
    want = texts_of(texts, sharpness=0.3)
    monkeypatch.setattr(pieces, "LONG", 30)
    monkeypatch.setattr(pieces, "WINDOW", window)
    assert texts_of(texts, sharpness=0.3) == want
    assert texts_of([texts[4]], np.array([4], np.uint64), 0.3) == want[4:5]


def test_text_of_a_megabyte_without_spaces():
    text = "".join(np.random.default_rng(1).choice(list("ABCDEFabcdef0123456789+/"), 1_000_000))
    start = time.perf_counter()
    (ids,) = texts_of([text])
    assert pieces.joined(ids, P) == text and time.perf_counter() - start < 60
