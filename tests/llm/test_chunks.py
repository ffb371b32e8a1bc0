import random

import numpy as np
import pyarrow as pa

from plumbline.llm import chunks
from plumbline.llm.wordhash import text_bytes
from tests.llm.conftest import sentence


def test_chunks_cover_texts_and_survive_insertions():
    text = sentence(1, 2000) + " ünï 漢字 " * 50
    for t in (text, "x" + text, text[:5000] + "inserted" + text[5000:], "a" * 5000, "é" * 999, ""):
        data, at = text_bytes(pa.array([t]))
        cuts = chunks._cuts(data, at)[0]
        raw = t.encode()
        parts = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        assert b"".join(parts) == raw
        assert all(len(p) <= chunks.MAX_BYTES for p in parts) and all(len(p) >= chunks.MIN_BYTES - 3 for p in parts[:-1])
        assert [p.decode() for p in parts] is not None
    one, two = (set(np.array([hash(t.encode()[a:b]) for a, b in zip([0, *c], c)])) for t in (text, "x" + text) for c in [chunks._cuts(*text_bytes(pa.array([t])))[0]])
    assert len(one - two) <= 3


def test_copies(docs):
    rng, passages = random.Random(2), [sentence(700 + k, 55) for k in range(4)]
    rows = [(i, f"{sentence(i, rng.randrange(20, 90))} {passages[i % 4]} {sentence(300 + i, 40)}") for i in range(40)]
    rows += [(100 + i, sentence(2000 + i, 120)) for i in range(30)] + [(200, None), (201, ""), (None, rows[0][1]), (7, rows[7][1])]
    df, texts = docs(rows), dict((i, t) for i, t in rows)
    found = chunks.copied_runs(df).collect()
    assert {r["id"] for r in found} == set(range(4, 40))
    for r in found:
        part = texts[r["id"]].encode()[r["begin"] : r["end"]].decode()
        assert r["first_id"] == r["id"] % 4 and part in texts[r["first_id"]]
    out = chunks.without_copies(df)
    assert out.columns == df.columns and out.count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[3] == texts[3] and len(left[39]) < len(texts[39]) - 96 and left[200] is None and left[201] == ""
    assert chunks.copied_runs(docs([])).count() == 0 and chunks.without_copies(docs([])).count() == 0


def plain_chunks(raw):
    """Chunks of a text, byte by byte, the hash of the last bytes taken anew at every place."""
    mask = ((1 << chunks.BITS) - 1) << (chunks.WINDOW - chunks.BITS)
    inside = [0x80 <= b < 0xC0 for b in raw] + [False]
    ends = []
    for c in range(chunks.MIN_BYTES, len(raw)):
        rolled = sum(int(chunks._GEAR[raw[c - 1 - j]]) << j for j in range(chunks.WINDOW))
        if not rolled & mask and not inside[c]:
            ends.append(c)
    start, out = 0, []
    for c in [*ends, len(raw)]:
        while c - start > chunks.MAX_BYTES:
            cut = start + chunks.MAX_BYTES
            while inside[cut]:
                cut -= 1
            out.append((start, cut))
            start = cut
        if c - start >= chunks.MIN_BYTES or (c == len(raw) and c > start):
            out.append((start, c))
            start = c
    return out


def brute(texts):
    """Runs of chunks, by their bytes, that a text of smaller id has too."""
    parts = {(i, t): [(a, b, t.encode()[a:b]) for a, b in plain_chunks(t.encode())] for i, t in texts}
    first = {}
    for (i, _), cut in parts.items():
        for _, _, piece in cut:
            first[piece] = min(first.get(piece, i), i)
    out = set()
    for (i, _), cut in parts.items():
        run = []
        for a, b, piece in [*cut, (0, 0, None)]:
            if piece is not None and first[piece] < i:
                run.append((a, b, first[piece]))
                continue
            if run and run[-1][1] - run[0][0] >= chunks.LEAST_BYTES:
                longest = max(run, key=lambda r: (r[1] - r[0], -r[2]))
                out.add((i, run[0][0], run[-1][1], len(run), longest[2]))
            run = []
    return out


def test_against_plain_chunks(docs):
    rng = random.Random(8)
    passages = [sentence(800 + k, 20 + 9 * k) for k in range(6)] + ["ünï 漢字 " * 30, "a" * 700, "ab" * 300]
    rows = []
    for i in range(70):
        parts = [sentence(i, rng.randrange(0, 30))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            cut = rng.randrange(0, 40)
            parts += [p[cut:], sentence(4000 + 10 * i + len(parts), rng.randrange(0, 12))]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (3, rows[3][1]), (3, rows[5][1]), (80, ""), (81, "é" * 500), (82, "é" * 500)]
    found = [(r["id"], r["begin"], r["end"], r["n_chunks"], r["first_id"]) for r in chunks.copied_runs(docs(rows)).collect()]
    assert set(found) == brute(rows) and len(found) == len(set(found)) > 60
