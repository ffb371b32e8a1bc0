import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import contexts

TEXTS = ["the cat sat on the mat", "The cat ate", "", None, "ça va, ça va bien", "the mat\nsat\t on the cat", "\x00\x7f zz", "the cat sat on the mat", "unseen words here"]


def lowered(text):
    return re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def positions(data):
    padded = b"\xff" * contexts.ORDER + data + b"\xff"
    return [(padded[i - contexts.ORDER : i][::-1], padded[i]) for i in range(contexts.ORDER, len(padded))]


class Plain:
    """The same tree, node by node, from dictionaries."""

    def __init__(self, texts):
        self.counts = Counter()
        for data in texts:
            for near, byte in positions(data):
                for i in range(8):
                    for d in range(contexts.ORDER + 1):
                        self.counts[near[:d], 1 << i | byte >> (8 - i), byte >> (7 - i) & 1] += 1
        self.children = {}
        for near, known, _ in self.counts:
            if near:
                self.children.setdefault((near[:-1], known), set()).add(near)
        self.found = {}

    def own(self, near, known):
        a, b = self.counts[near, known, 0], self.counts[near, known, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, near, known):
        key = near, known
        if key not in self.found:
            kt = self.own(near, known)
            if len(near) == contexts.ORDER:
                self.found[key] = 1.0, kt
            else:
                rest = sum(self.weighted(child, known)[1] for child in self.children.get(key, ()))
                self.found[key] = 1 / (1 + math.exp(min(rest - kt, 700))), float(np.logaddexp(kt, rest)) - math.log(2)
        return self.found[key]

    def chance(self, near, byte):
        total = 0.0
        for i in range(8):
            known, bit, q = 1 << i | byte >> (8 - i), byte >> (7 - i) & 1, 0.0
            for d in range(contexts.ORDER, -1, -1):
                n = self.counts[near[:d], known, 0] + self.counts[near[:d], known, 1]
                w = self.weighted(near[:d], known)[0]
                q = w * (self.counts[near[:d], known, bit] + 0.5) / (n + 1) + (1 - w) * q
            total += math.log10(q)
        return total


def brute(rows):
    data = [(i, held(i), lowered(t)) for i, t in rows]
    tokens = [[*re.findall(rb"[^\x20\x09-\x0d]+", t), None] for _, _, t in data]
    seen = Counter(w for (_, h, _), x in zip(data, tokens, strict=True) if not h for w in x)
    tree, total = Plain([t for _, h, t in data if not h]), seen.total()
    return [
        (i, h, len(x), sum(seen[w] > 0 for w in x), total, sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in x), sum(tree.chance(*p) for p in positions(t)))
        for (i, h, t), x in zip(data, tokens, strict=True)
    ]


def same(found, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    found, want = sorted((tuple(r)[:7] for r in found), key=key), sorted(want, key=key)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in want], rtol=1e-9)


def test_equals_plain_tree(docs):
    rows = [*enumerate(TEXTS), (None, "null id"), (5, TEXTS[5]), *((i, f"cat {i % 3} the mat") for i in range(20, 40))]
    assert any(held(i) for i, _ in rows)
    same(contexts.scored(docs(rows)).collect(), brute(rows))


def test_parts_and_blocks(docs, monkeypatch):
    """Texts over several blocks and chunks, read by the plain tree as well."""
    rows = [(i, " ".join(TEXTS[j % 9] or "x" for j in range(i, i + 6))) for i in range(30)]
    for name, size in (("BLOCK", 300), ("CHUNK", 64)):
        monkeypatch.setattr(contexts, name, size)
    same(contexts.scored(docs(rows)).collect(), brute(rows))


def test_chances_of_all_bytes_sum_to_one():
    tree = Plain([lowered(t) for t in TEXTS])
    assert abs(sum(10 ** tree.chance(b"eht o", b) for b in range(256)) - 1) < 1e-9


def test_groups_cut_anywhere(monkeypatch):
    """Sorted windows in batches of any size give the same rows as all at once."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 100, (4000, 6)) @ (1 << 8 * np.arange(6)[::-1]))
    n = rng.integers(0, 5, len(keys))
    whole, _ = contexts.subtrees(keys, n)
    cut = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7]), pa.array(n[a : a + 7])], ["key", "n"]) for a in range(0, len(keys), 7)]
    found = [r for b in contexts._mixed(iter(cut)) for r in b.to_pylist() if r["key"] is not None]
    assert [r["key"] for r in found] == keys.tolist() and np.allclose([r["bits"] for r in found], whole)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 1e3 + 0.5, 1e6, 1e12])
    assert np.allclose(contexts.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("rows", [[], [(2, None)], [(i, "a b") for i in range(60) if held(i)]])
def test_small(docs, rows):
    """No rows, one empty text, and held-out texts only: then a bit has chance one half and no token is known."""
    found = contexts.scored(docs(rows)).collect()
    same(found, brute(rows))
    if rows and all(held(i) for i, _ in rows):
        assert all(abs(r["bits_per_byte"] - 8) < 1e-9 and r["n_known"] == 0 for r in found)


def test_long_text_and_words(docs):
    """A word of 300,000 letters and a text of many parts."""
    rows = [(1, "ab" * 150_000), (3, "the cat " * 40_000), (4, "the cat")]
    found = {r["doc_id"]: r for r in contexts.scored(docs(rows)).collect()}
    assert found[1]["n_tokens"] == 2 and found[3]["n_tokens"] == 80_001 and found[3]["bits_per_byte"] < 0.1
