"""Language-model scores by context-tree weighting over bytes, each byte taken apart into eight binary decisions.

A node of the tree stands for the bytes before a position, nearest first, and the bits of the byte that are already
known.  It holds how often a 0 and a 1 followed in the training texts, and the Krichevsky-Trofimov estimate of these
counts.  A node's weighted probability is half its own estimate and half the product of those of its children, which
know one byte more; the odds of the two halves are the weight by which estimates of all depths are mixed when a text is
scored.  Counts are all that is needed, so the tree is built by groupings instead of position by position.

Texts are packed into blocks of bounded bytes.  A block gives its distinct windows of ORDER + 1 bytes with their counts;
these are summed over all blocks.  Contexts that share their SPLIT nearest bytes are worked out together, one group in
memory at a time (at most 256 ** (ORDER + 1 - SPLIT) windows, whatever the corpus); the few levels above are plain
aggregates.  Each window's log probability goes back to the blocks that have it, where the texts are summed up.  The words of
the base are counted and sent back in the same way, as hashes of 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.wordhash import IS_SPACE, span_hashes, text_bytes, word_spans

ORDER = 5
SPLIT = 3
END = 0xFF  # no byte of UTF-8: it ends a text, and stands before its first byte
BLOCK = 32 << 20
CHUNK = 1 << 18
ROWS = 1 << 16
LOOK = 4096
END_KEY = -(1 << 63)  # the token that ends a text
FOLDS, HELD_OUT = 7, 2
BETWEEN = IS_SPACE.copy()
BETWEEN[END] = True


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for numbers above 0: Stirling's series, eight steps up."""
    up = np.ones_like(x)
    for j in range(8):
        up *= np.where(x < 1e6, x + j, 1.0)
    z = np.where(x < 1e6, x + 8, x)
    series = 1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / z**2) / z**2) / z**2) / z**2
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series / z - np.log(up)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def subtrees(keys: np.ndarray, counts: np.ndarray, order: int = ORDER, split: int = SPLIT):
    """The levels from split to order of the trees over sorted windows, nearest context byte first, predicted byte last.

    Gives for each window the mixed probabilities of its eight bits as they are, and (node, zeros, ones, log of the weighted
    probability) of the nodes at the level split; a node is its context, then a 1, then the bits known: below 256.
    """
    levels = {}  # by level and bit: nodes, weights, counts of both bits and of ones
    below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    at, byte, n = keys >> 8, keys & 255, counts
    top = []
    for d in range(order, split - 1, -1):
        if d < order:
            flat = (at >> 8) << 8 | byte
            pick = np.argsort(flat, kind="stable")
            flat = flat[pick]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            at, byte, n = flat[first] >> 8, flat[first] & 255, np.add.reduceat(n[pick], first)
        for i in range(8):
            node = at << 8 | 1 << i | byte >> (8 - i)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            total = np.add.reduceat(n, first)
            ones = np.add.reduceat(np.where(byte >> (7 - i) & 1, n, 0), first)
            node = node[first]
            kt = estimate(total - ones, ones)
            if d == order:
                weight, weighted = np.ones(len(node)), kt
            else:
                child, value = below[i]
                parent = np.searchsorted(node, (child >> 16) << 8 | child & 255)
                rest = np.bincount(parent, value, len(node))
                weight = 1 / (1 + np.exp(np.minimum(rest - kt, 700)))
                weighted = np.logaddexp(kt, rest) - np.log(2)
            below[i] = node, weighted
            levels[d, i] = node, weight, total, ones
            if d == split:
                top.append((node, total - ones, ones, weighted))
    mixed = np.empty((len(keys), 8))
    for i in range(8):
        bit = keys >> (7 - i) & 1
        q = np.zeros(len(keys))
        for d in range(order, split - 1, -1):
            node, weight, total, ones = levels[d, i]
            found = np.searchsorted(node, (keys >> (8 * (order - d) + 8)) << 8 | 1 << i | (keys & 255) >> (8 - i))
            met = np.where(bit, ones[found], total[found] - ones[found])
            q = weight[found] * ((met + 0.5) / (total[found] + 1)) + (1 - weight[found]) * q
        mixed[:, i] = q
    return mixed, tuple(np.concatenate(x) for x in zip(*top, strict=True))


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Block:
    """Texts end to end, with the end byte ORDER times before each text and once behind it; begins are the places of the first of these."""

    def __init__(self, buffer: np.ndarray, begins: np.ndarray):
        self.buffer, self.begins, self.texts = buffer, begins, len(begins) - 1

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The window that ends at every byte and at every end of a text, and the text it is in; a part at a time."""
        for a in range(0, len(self.buffer), CHUNK):
            place = np.arange(a, min(len(self.buffer), a + CHUNK))
            text = np.searchsorted(self.begins, place, "right") - 1
            real = place - self.begins[text] >= ORDER
            place, text = place[real], text[real]
            key = np.zeros(len(place), np.int64)
            for j in range(1, ORDER + 1):
                key = key << 8 | self.buffer[place - j]
            yield key << 8 | self.buffer[place], text

    def words(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the tokens and the text each is in, a part at a time; keys of tokens are below 0, windows are not."""
        a = 0
        while a < len(self.buffer):
            b = min(len(self.buffer), a + CHUNK)
            while not BETWEEN[self.buffer[b - 1]]:  # no word is cut: a text's end is behind each
                ahead = np.flatnonzero(BETWEEN[self.buffer[b : b + LOOK]])
                b += int(ahead[0]) + 1 if len(ahead) else LOOK
            starts, ends, _ = word_spans(self.buffer[a:b], np.array([0, b - a]), BETWEEN)
            hashes = span_hashes(self.buffer[a:b], starts, ends).view(np.int64) | np.int64(-(1 << 63))
            yield hashes, np.searchsorted(self.begins, starts + a, "right") - 1
            a = b
        yield np.full(self.texts, END_KEY), np.arange(self.texts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) as blocks: ids, held_out and places of the texts as lists, the lowered texts compressed."""
    codec, before, behind = pa.Codec("zstd"), np.full(ORDER, END, np.uint8), np.full(1, END, np.uint8)
    ids, held, begins, parts = [], [], [0], []

    def block() -> pa.RecordBatch:
        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((ids, pa.int64()), (held, pa.bool_()), (begins, pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([codec.compress(np.concatenate(parts), asbytes=True)], pa.binary())], ["ids", "held", "begins", "texts"])

    for batch in batches:
        data, at = text_bytes(batch.column(2))
        for d, (i, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            size = int(at[d + 1] - at[d]) + ORDER + 1
            if ids and begins[-1] + size > BLOCK:
                yield block()
                ids, held, begins, parts = [], [], [0], []
            ids.append(i), held.append(h), begins.append(begins[-1] + size)
            parts += [before, _lowered(data[at[d] : at[d + 1]]), behind]
    if ids:
        yield block()


def _unpacked(begins: pa.Scalar, texts: pa.Scalar) -> Block:
    at = np.array(begins.as_py(), np.int64)
    return Block(np.frombuffer(pa.Codec("zstd").decompress(texts.as_buffer(), int(at[-1])), np.uint8), at)


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n): a block's distinct windows and words, with how often its training texts have them."""
    for batch in batches:
        for r in range(batch.num_rows):
            pa.default_memory_pool().release_unused()
            block = _unpacked(batch.column(3)[r], batch.column(4)[r])
            held = np.array(batch.column(2)[r].as_py(), bool)
            words = told = keys = counts = np.zeros(0, np.int64)
            pending: list[tuple[np.ndarray, np.ndarray]] = []
            for found, text in block.windows():
                marked, n = np.unique(found << 1 | held[text], return_counts=True)
                pending.append((marked >> 1, np.where(marked & 1, 0, n)))
                if sum(len(x) for x, _ in pending) > max(CHUNK, len(keys)):
                    (keys, counts), pending = _summed(*map(np.concatenate, zip((keys, counts), *pending, strict=True))), []
            keys, counts = _summed(*map(np.concatenate, zip((keys, counts), *pending, strict=True)))
            for found, text in block.words():
                kinds, at = np.unique(found, return_inverse=True)
                n = np.bincount(at, ~held[text], len(kinds)).astype(np.int64)
                words, told = _summed(np.concatenate([words, kinds]), np.concatenate([told, n]))
            keys, counts = np.concatenate([words, keys]), np.concatenate([told, counts])
            own = pa.scalar(batch.column(0)[r].as_py(), pa.int64())
            for a in range(0, len(keys), ROWS):
                part = pa.array(keys[a : a + ROWS])
                yield pa.RecordBatch.from_arrays([pa.repeat(own, len(part)), part, pa.array(counts[a : a + ROWS])], ["block", "key", "n"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows (key, n) to a row (key, bits) for each, and rows (node, zeros, ones, below) that are summed over the children of a node."""
    kind = pa.list_(pa.float64())

    def group(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        mixed, (node, zeros, ones, weighted) = subtrees(keys, n)
        none = pa.nulls(len(keys), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(keys) + 1, 8), pa.int32()), pa.array(mixed.ravel()))
        names = ["key", "bits", "node", "zeros", "ones", "below"]
        yield pa.RecordBatch.from_arrays([pa.array(keys), lists, none, none, none, pa.nulls(len(keys), pa.float64())], names)
        above = (node >> 16) << 8 | node & 255
        order = np.argsort(above, kind="stable")
        above = above[order]
        first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        sums = [np.add.reduceat(x[order], first) for x in (zeros, ones, weighted)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.nulls(len(first), kind), pa.array(above[first]), *map(pa.array, sums)], names)

    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys, counts = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([counts, batch.column(1).to_numpy()])
        if len(keys) < 1 << 16:
            continue
        near = keys >> 8 * (ORDER + 1 - SPLIT)
        whole = int(np.searchsorted(near, near[-1]))  # the last group may go on
        if whole:
            yield from group(keys[:whole], counts[:whole])
            keys, counts = keys[whole:], counts[whole:]
    if len(keys):
        yield from group(keys, counts)


def _log_gamma(x: Column) -> Column:
    """log_gamma() as a column; x is at least one half."""
    up = F.lit(1.0)
    for j in range(8):
        up = up * (x + j)
    small = x < 1e6
    z = F.when(small, x + 8).otherwise(x)
    series = 1 / F.lit(12.0) - (1 / F.lit(360.0) - (1 / F.lit(1260.0) - (1 / F.lit(1680.0) - 1 / F.lit(1188.0) / (z * z)) / (z * z)) / (z * z)) / (z * z)
    return (z - 0.5) * F.ln(z) - z + float(0.5 * np.log(2 * np.pi)) + series / z - F.when(small, F.ln(up)).otherwise(0.0)


def _level(sums: DataFrame, d: int) -> DataFrame:
    """(node, zeros, ones, below) of level d with the chances kt0, kt1, the weight, and the log of the weighted probability."""
    a, b = F.col("zeros").cast("double"), F.col("ones").cast("double")
    kt = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - float(np.log(np.pi))
    out = sums.select("*", kt.alias("kt"))
    gap = F.col("below") - F.col("kt")
    out = out.select(
        "node", "zeros", "ones",
        ((a + 0.5) / (a + b + 1)).alias(f"no{d}"), ((b + 0.5) / (a + b + 1)).alias(f"yes{d}"), (1 / (1 + F.exp(F.least(gap, F.lit(700.0))))).alias(f"weight{d}"),
        (F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(gap))) - float(np.log(2))).alias("weighted"),
    )
    return written(out, f"level-{d}")


def _above(node: str = "node") -> Column:
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(F.col(node).bitwiseAND(F.lit(255)))


def _upper(deep: DataFrame) -> DataFrame:
    """(near, bits): for each context of SPLIT - 1 bytes, by known bits, what the mixed probability p of a bit from below becomes at
    the root: add0 or add1 plus times * p.  At most 256 ** (SPLIT - 1) rows of 255 entries."""
    sums = deep.filter("node IS NOT NULL").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    levels = []
    for d in range(SPLIT - 1, -1, -1):
        levels.append(_level(sums, d))
        sums = levels[-1].groupBy(_above().alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    out = levels[0].select("node", F.col("node").alias("up"), F.col(f"no{SPLIT - 1}").alias("add0"), F.col(f"yes{SPLIT - 1}").alias("add1"), F.col(f"weight{SPLIT - 1}").alias("w"))
    out = out.select("node", "up", (F.col("w") * F.col("add0")).alias("add0"), (F.col("w") * F.col("add1")).alias("add1"), (1 - F.col("w")).alias("times"))
    for d, level in zip(range(SPLIT - 2, -1, -1), levels[1:], strict=True):
        w = F.col(f"weight{d}")
        met = out.withColumn("up", _above("up")).join(level.select(F.col("node").alias("up"), f"no{d}", f"yes{d}", f"weight{d}"), "up")
        out = met.select(
            "node", "up", (w * F.col(f"no{d}") + (1 - w) * F.col("add0")).alias("add0"), (w * F.col(f"yes{d}") + (1 - w) * F.col("add1")).alias("add1"), ((1 - w) * F.col("times")).alias("times")
        )
    entry = F.struct(F.col("node").bitwiseAND(F.lit(255)).cast("int").alias("known"), F.struct("add0", "add1", "times").alias("to"))
    return written(out.groupBy(F.shiftright("node", 8).alias("near")).agg(F.map_from_entries(F.collect_list(entry)).alias("upper")), "upper-levels")


def _window_scores(deep: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of the last byte of each window after the bytes before it."""
    near = F.shiftright("key", 8 * (ORDER + 2 - SPLIT))
    met = deep.filter("key IS NOT NULL").select("key", "bits", near.alias("near")).join(_upper(deep), "near")
    total = F.lit(0.0)
    for i in range(8):
        known = F.lit(1 << i).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit(255)), 8 - i)).cast("int")
        bit = F.shiftright("key", 7 - i).bitwiseAND(F.lit(1)) == 1
        to = F.element_at("upper", known)
        total = total + F.log10(F.when(bit, to["add1"]).otherwise(to["add0"]) + to["times"] * F.get("bits", F.lit(i)))
    return met.select("key", total.alias("value"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, value) as rows (block, packed) with all that a batch has for the block."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        block, key, value = (batch.column(c).to_numpy() for c in range(3))
        order = np.lexsort((key, block))
        block, key, value = block[order], key[order], value[order]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        packed = [codec.compress(np.diff(key[a:b], prepend=0).tobytes() + value[a:b].tobytes(), asbytes=True) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(np.diff(edges), pa.int32()), pa.array(packed, pa.binary())], ["block", "n", "packed"])


class Values:
    """The values of keys, all of which are known: most are found where their hash points to, the others in the sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(63 - len(keys).bit_length())
        self.place = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.place[self._hash(self.keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, found: np.ndarray) -> np.ndarray:
        at = self.place[self._hash(found)]
        missed = np.flatnonzero(self.keys[at] != found)
        at[missed] = np.searchsorted(self.keys, found[missed])
        return self.values[at]


def _scored(train: int, kinds: int):
    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what earlier blocks of this worker have left
        block, codec = _unpacked(blocks["begins"][0], blocks["texts"][0]), pa.Codec("zstd")
        sizes = values["n"].to_numpy()
        keys, told, at = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum(), np.float64), 0
        for n, packed in zip(sizes.tolist(), values["packed"], strict=True):
            raw = codec.decompress(packed.as_buffer(), 16 * n)
            np.cumsum(np.frombuffer(raw, np.int64, n), out=keys[at : at + n])
            told[at : at + n] = np.frombuffer(raw, np.float64, n, 8 * n)
            at += n
        value = Values(keys, told)
        del keys, told  # the values have their own, in order
        texts = block.texts
        score = np.zeros(texts)
        for found, text in block.windows():
            score += np.bincount(text, value(found), texts)
        base, tokens, known = np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for found, text in block.words():
            met = value(found)
            base += np.bincount(text, np.log10((met + 1) / (train + kinds + 1)), texts)
            tokens += np.bincount(text, minlength=texts)
            known += np.bincount(text, met > 0, texts).astype(np.int64)
        size = np.diff(block.begins) - ORDER - 1
        return pa.table({
            "doc_id": pa.array(blocks["ids"][0].as_py(), pa.int64()), "held_out": pa.array(blocks["held"][0].as_py(), pa.bool_()),
            "n_tokens": pa.array(tokens), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(texts, train, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            "n_bytes": pa.array(size), "bits_per_byte": pa.array(-score * np.log2(10) / (size + 1)),
        })

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """A row for each row of docs: its score, the log10 probability that the model gives its whole text and its end.

    The model learns from all texts that are not held out (by default one id in FOLDS is); it does not change while texts
    are scored.  A-Z are read as a-z.  bits_per_byte is the code length over the text's n_bytes and its end.  base_score is that of
    single words with one added to every count: tokens are the words and one end for each text; n_known of the n_tokens were seen
    in training, which had train_tokens.  A null text is empty: its end is scored.  A null id is in training.  Repeated rows count
    and are scored each.  Without training texts every bit has chance one half.  Other columns are not read.  Empty in, empty out.
    """
    if held_out is None:
        held_out = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = rows.mapInArrow(_packed, "ids array<long>, held array<boolean>, begins array<long>, texts binary")
    blocks = written(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "text-blocks")
    counts = written(blocks.mapInArrow(_counted, "block long, key long, n long"), "block-counts", codec="zstd")

    sums = written(counts.groupBy("key").agg(F.sum("n").alias("n")), "key-sums", codec="zstd")
    words, windows = sums.filter("key < 0"), sums.filter("key >= 0")
    train, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    near = windows.repartition(F.shiftright("key", 8 * (ORDER + 1 - SPLIT)))
    deep = near.sortWithinPartitions("key").mapInArrow(_mixed, "key long, bits array<double>, node long, zeros long, ones long, below double")
    values = _window_scores(written(deep, "deep-levels")).unionByName(words.select("key", F.col("n").cast("double").alias("value")))

    back = counts.select("block", "key").join(written(values, "values"), "key").select("block", "key", "value")
    back = back.mapInArrow(_returned, "block long, n int, packed binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored(train, kinds), RESULT)


def query(spark, folder: str) -> DataFrame:
    return scored(spark.read.parquet(f"{folder}/documents.parquet"))
