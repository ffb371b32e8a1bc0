import random

from plumbline.llm import suffixes
from tests.llm.conftest import sentence


def brute(texts):
    first, out = {}, {}
    split = {d: t.split() for d, t in texts.items()}
    for d in sorted(split):
        for j in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][j : j + 50]), d)
    for d, w in split.items():
        hit = {x for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < d for x in range(j, j + 50)}
        if hit:
            out[d] = hit
    return out


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).update(range(r["begin"], r["end"]))
    return out


def test_against_all_windows(docs):
    rng, texts = random.Random(1), {}
    passages = [sentence(900 + k, 49 + k) for k in range(8)]
    for d in range(60):
        parts = [sentence(d, rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            parts += [p, sentence(5000 + d * 10 + len(parts), rng.randrange(0, 40))]
        texts[d] = " ".join(parts)
    texts[60] = texts[61] = "again " * 400
    texts[62] = texts[3]
    assert covered(suffixes.repeats(docs(list(texts.items())))) == brute(texts)


def test_cut(docs):
    p = sentence(1, 70)
    rows = [(1, "head  one\n" + p + "\ttail"), (2, p), (3, "a b\n" + p + "\n c"), (4, None), (5, ""), (None, p), (3, "a b\n" + p + "\n c"), (6, sentence(2, 49))]
    out = suffixes.without_repeats(docs(rows), length="n_chars")
    assert out.columns == docs(rows).columns
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_chars"]) for r in out.filter("text IS NOT NULL").collect())
    assert got == sorted([(1, rows[0][1], len(rows[0][1])), (3, "a b\nc", 5), (3, "a b\nc", 5), (5, "", 0), (0, p, len(p)), (6, rows[7][1], len(rows[7][1]))])
    assert out.count() == 7
    assert suffixes.repeats(docs([])).count() == 0 and suffixes.without_repeats(docs([])).count() == 0


def test_first_copy_is_named(docs):
    p = sentence(1, 60)
    found = suffixes.repeats(docs([(i, f"{sentence(10 + i, 30)} {p} {sentence(50 + i, 30)}") for i in range(20)])).collect()
    assert sorted((r["id"], r["begin"], r["end"], r["first_id"]) for r in found) == [(i, 30, 90, 0) for i in range(1, 20)]


def test_first_text_has_less_than_the_passage(docs):
    texts = {}
    for k in range(40):
        words = sentence(100 + k, 50 + k % 6).split()
        begin = " ".join(words[: 44 + k % 6])
        again = f"{begin} {sentence(3000 + k, 9)} {' '.join(words)}" if k % 4 == 3 else begin
        for i, part in enumerate((again, " ".join(words), " ".join(words))):
            texts[k * 3 + i] = f"{sentence(1000 + k * 3 + i, 30)} {part} {sentence(2000 + k * 3 + i, 30)}"
    want = brute(texts)
    assert len(want) >= 40 and covered(suffixes.repeats(docs(list(texts.items())))) == want
