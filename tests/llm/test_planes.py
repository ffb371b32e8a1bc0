import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm import planes
from plumbline.llm.store import opened

E = planes.encoder(planes.default_tokenizer())


def direct(text):
    return E.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (planes.from_planes(planes.to_planes(ids, kind), n, kind) == ids).all()
    small = ids % 3
    assert planes.to_planes(small, kind)[-1] == b"" and (planes.from_planes(planes.to_planes(small, kind), n, kind) == small).all()


def test_parts_give_the_ids_of_whole_texts():
    rng, letters = random.Random(5), "aA1.,'!s ́éß×÷“ \n≠tΣ漢-_<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", "<|endoftext|>", "don't 'S it'll. x'", "ΑΣ. a\u0338= =\u0338"]
    ids, n = E(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [direct(t) for t in texts]


def test_added_tokens_as_a_fresh_tokenizer_reads_them():
    fresh = Tokenizer.from_file(planes.default_tokenizer())
    texts = ["one <|endoftext|> two.", "a<|endoftext|>", None, "", "plain text, x'", "<|startoftext|>b!<|endoftext|>.. c", "<|ENDOFTEXT|> <|endoftext |>"]
    ids, n = E(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 49407 in ids and 49406 in ids
    assert E(pa.array(["<|endoftext|>"]))[0].tolist() == [49407]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, docs, tmp_path, kind):
    rng = random.Random(6)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(200)))) for i in rng.sample(range(1000), 120)]
    rows += [(2000, None), (2001, ""), (2002, "long " * 9000), (None, "no id")]
    files = planes.write_planes(docs(rows), f"file://{tmp_path}/planes", kind=kind, block=256, per_file=3000)
    found = planes.read_planes(files).collect()
    assert files.count() > 3 and len(found) == len(rows)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*direct(t or ""), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    one = files.orderBy("first").first()
    with opened(one["file"]) as f:
        r = planes.Reader(f)
        whole = np.concatenate([r.block(i) for i in range(len(r.index))])
        assert len(r.index) > 1 and (r.ids(200, 700) == whole[200:700]).all() and r.ids(5, 5).size == 0


def test_repeated_rows_and_empty(spark, docs, tmp_path):
    files = planes.write_planes(docs([(1, "a b"), (1, "a b"), (0, "c")]), f"{tmp_path}/x")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in planes.read_planes(files, with_ids=False).collect()) == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
    assert planes.read_planes(planes.write_planes(docs([]), f"{tmp_path}/y")).count() == 0
