"""Each stage of the pipeline against a plain version of it on its own input."""

from collections import Counter

import corpus_pipeline
from plumbline.llm import mixing, pieces
from tests.llm.test_mixing import level_by_rounds

FOLDER = "/root/testdata/sf0.001"


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] * bool(words)


def split(text):
    return text.translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if text else []


def words_of(text):
    return [w for w in split(text) if w]


def judge_by_base(rows):
    """Ids that fail the base, by counting."""
    out = set()
    for r in rows:
        w = words_of(r["text"])
        threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            out.add(r["doc_id"])
    return out


def near_classes(rows):
    sets = {r["doc_id"]: set(windows(words_of(r["text"]), 5)) for r in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return {root(d) for d in ids}


def cut_repeats(rows):
    first, out = {}, {}
    texts = {r["doc_id"]: words_of(r["text"]) for r in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(tuple(texts[d][i : i + 50]), d)
    for d, w in texts.items():
        hit = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        left = [x for i, x in enumerate(w) if i not in hit]
        if left or not w:
            out[d] = left
    return out


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs.collect(), out := spark.read.parquet(f"{tmp_path}/{name}")))
        docs = out
    made = {name: (before, after.collect()) for name, before, after in seen}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "repeated_passages", "source_mix", "sampled_pieces"]

    before, after = made["quality_rules"]
    kept = {r["doc_id"] for r in after}
    assert kept.isdisjoint(judge_by_base(before)) and 0.5 * len(before) < len(kept) < len(before)
    assert all(r in before for r in after)

    before, after = made["near_copies"]
    assert {r["doc_id"] for r in after} == near_classes(before) and all(r in before for r in after)

    before, after = made["repeated_passages"]
    assert {r["doc_id"]: words_of(r["text"]) for r in after} == cut_repeats(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = made["source_mix"]
    sizes, given = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words_of(r["text"]))
    for r in after:
        given[r["source"]] += len(words_of(r["text"]))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target = level_by_rounds(sizes, weights, mixing.EPOCHS)
    assert all(abs(given[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    whole = {(r["doc_id"], r["text"]) for r in before}
    assert sum((r["doc_id"], r["text"]) not in whole for r in after) <= len(sizes)

    before, after = made["sampled_pieces"]
    decoded = [(r["doc_id"], r["decoded"]) for r in pieces.decode(seen[-1][2]).collect()]
    assert sorted(decoded) == sorted((r["doc_id"], r["text"]) for r in before)
    assert all(r["n_pieces"] == len(r["ids"]) for r in after)
