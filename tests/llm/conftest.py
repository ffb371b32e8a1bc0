import pytest


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text, source) rows, with columns that clash with names used inside operators."""

    def make(rows):
        rows = [(*r, "src")[:3] if len(r) < 3 else r for r in rows]
        full = [(i, t, "en", s, len(t or ""), 1, "x", 2.5, [1]) for i, t, s in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long, id int, row string, words double, _kept array<int>"
        return spark.createDataFrame(full, kind)

    return make


def sentence(seed: int, n: int) -> str:
    """n words that no other seed gives."""
    return " ".join(f"w{seed}x{i * 7919 % 1000003}" for i in range(n))
