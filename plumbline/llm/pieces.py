"""Sampled piece segmentations of a SentencePiece model, and their lossless decoding.

Forward filtering runs over the lattice of all pieces that fit into a text: each node gets the total weight of the ways
to reach it.  Backward sampling then walks from the end, choosing each piece with the share of weight that it brings,
so a segmentation is drawn with exactly its probability under a unigram model of the pieces.  Random numbers are hashes
of the row's key, the place in the text and the step: reruns, retries and other partitions draw the same.

No piece has a space after another character, so every path through the lattice meets at the spaces: the lattice is
built once for each distinct word of a block of texts, all of them at a time in numpy, and only the walk back is done
for every occurrence.  A stretch of more than LONG characters without a space goes window by window, with weights kept
at the windows' begins only.  The model's pieces are merges with ranks; a piece of rank r has the probability
1 / (r + RANK_SHIFT), scaled to sum up to one.  Characters without a piece are spelled as their UTF-8 bytes, as is a
literal U+2581, which the pieces use for the space; so decoding gives back every text as it was.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept
from plumbline.llm.wordhash import blocks, mixed, text_bytes

SPACE = "▁"
RANK_SHIFT = 100.0
SHARPNESS = 1.0
BYTE_COST = 20.0
TEXT_BLOCK = 2 << 20
LONG = 2048  # characters; longer units go window by window
WINDOW = 4096
_LITERAL = 0x110001  # stands for a literal U+2581; no piece has it
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model by hash, their log probabilities, and what each decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        if any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] for i in plain):
            raise ValueError("a piece has a space after another character or a line feed")
        if any(SPACE in names[i][1:] and names[i].strip(SPACE) for i in plain):
            raise ValueError("a piece has several spaces before other characters")
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no piece for some byte")
        self.decoded = [b""] * n
        for i in plain:
            self.decoded[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.decoded[i] = bytes([b])
        weight = 1 / (np.array([-model.get_score(i) for i in plain]) + RANK_SHIFT)
        self.log_p = np.zeros(n)
        self.log_p[plain] = np.log(weight / weight.sum())
        self.longest = max(len(names[i]) for i in plain)
        known: dict[str, int] = {}
        for i in plain:
            for size in range(1, len(names[i])):
                known.setdefault(names[i][:size], -1)
        known.update((names[i], i) for i in plain)
        hashes = np.array([_hash(x) for x in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()), np.int32)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        bucket = (self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        self.first = np.searchsorted(bucket, np.arange((1 << _TABLE_BITS) + 1)).astype(np.int32)
        self.probes = int(np.diff(self.first).max())
        self.hashes = np.concatenate([self.hashes, np.zeros(self.probes, np.uint64)])
        self.ids = np.concatenate([self.ids, np.full(self.probes, -2, np.int32)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for what only begins pieces, -2 for what no piece begins with."""
        at = self.first[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)]
        out = np.where(self.hashes[at] == hashes, self.ids[at], np.int32(-2))
        for j in range(1, self.probes):
            rest = np.flatnonzero(out == -2)
            spot = at[rest] + np.int32(j)
            hit = self.hashes[spot] == hashes[rest]
            out[rest[hit]] = self.ids[spot[hit]]
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in mixed(np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)).tolist():
        h = (h * int(_STEP) + c) & (1 << 64) - 1
    return h


def pieces(path: str) -> Pieces:
    return kept(f"pieces {path}", lambda: Pieces(path))


def _in_pieces(raw: np.ndarray) -> np.ndarray:
    """Characters as the pieces have them."""
    return np.where(raw == 32, np.uint32(ord(SPACE)), np.where(raw == ord(SPACE), np.uint32(_LITERAL), raw))


def _spelled(raw: np.ndarray) -> np.ndarray:
    """How many bytes spell each character."""
    return (1 + (raw >= 0x80).astype(np.int8) + (raw >= 0x800) + (raw >= 0x10000)).astype(np.int8)


def _edges(p: Pieces, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size and id of all pieces that fit, shorter ones first; -1 is a character without a piece; left tells the characters up to a unit's end."""
    mixed_chars = mixed(chars.astype(np.uint64))
    at, h = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.uint64)
    begins, lengths, ids = [], [], []
    for size in range(1, p.longest + 1):
        fits = left[at] >= size
        at, h = at[fits], h[fits]
        if not len(at):
            break
        h = h * _STEP + mixed_chars[at + (size - 1)]
        found = p.find(h)
        hit = found >= 0 if size > 1 else found >= -2
        begins.append(at[hit]), ids.append(np.maximum(found[hit], -1)), lengths.append(np.full(len(begins[-1]), size, np.int32))
        on = found > -2
        at, h = at[on], h[on]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (begins, lengths, ids))


class Lattice:
    """All pieces that fit into some distinct units, with the chance of each to be the last one on the way to its end.

    Nodes are the places between characters; unit u has nodes start[u] to end[u].  Edges lie sorted by the node that
    they end in: first[node] is a node's first edge, and share the part of its weight that edges up to this one bring.
    """

    def __init__(self, p: Pieces, units: pa.Array, sharpness: float):
        data, at = text_bytes(units)
        chars = self.raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        sizes = np.diff(before).astype(np.int32)
        chars = _in_pieces(chars)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        place = np.arange(len(chars), dtype=np.int32)
        char_end = before[1:].astype(np.int32)
        begin, size, piece = _edges(p, chars, char_end[unit] - place)
        n_bytes = _spelled(self.raw)
        self.start = (before[:-1] + np.arange(len(units))).astype(np.int32)
        self.end = self.start + sizes
        source = begin + unit[begin]
        target = source + size
        # Sorted by level (characters from the unit's start), within it by node; the pieces came size by size in order.
        order = np.argsort(target, kind="stable")
        level = (target - self.start[unit[begin]])[order]
        by_level = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        order, level = order[by_level], level[by_level]
        source, target = source[order], target[order]
        self.source, self.piece, self.char = source, piece[order], begin[order]
        self.count = np.where(self.piece >= 0, np.int8(1), n_bytes[self.char])
        cost = np.where(self.piece >= 0, p.log_p[self.piece], -BYTE_COST * self.count) * sharpness
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        group = np.flatnonzero(new)
        self.first = np.zeros(len(chars) + len(units) + 1, np.int32)
        self.first[target[group]] = group
        reach = np.zeros(len(chars) + len(units) + 1)
        self.share = np.empty(len(target))
        cuts = np.searchsorted(level, np.arange(1, level[-1] + 2)) if len(level) else np.zeros(1, np.int64)
        group_cuts = np.searchsorted(group, cuts)
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1]
            heads = group[group_cuts[k] : group_cuts[k + 1]] - a
            way = reach[source[a:b]] + cost[a:b]
            runs = np.diff(np.append(heads, b - a))
            top = np.repeat(np.maximum.reduceat(way, heads), runs)
            weight = np.exp(way - top)
            total = np.add.reduceat(weight, heads)
            reach[target[a:b][heads]] = top[heads] + np.log(total)
            sums = np.cumsum(weight)
            self.share[a:b] = (sums - np.repeat(sums[heads] - weight[heads], runs)) / np.repeat(total, runs)
        last = np.append(group[1:], len(target))[: len(group)] - 1
        self.share[last] = 2.0

    def sample(self, units: np.ndarray, seeds: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units one after another, and how many each unit has."""
        who, node, start = np.arange(len(units), dtype=np.int32), self.end[units], self.start[units]
        taken, step = [], 0
        counts = np.zeros(len(units), np.int64)
        while len(who):
            u = (mixed(seeds[who] + np.uint64(step * int(_STEP) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            more = np.flatnonzero(u >= self.share[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.share[edge[more]]]
            taken.append((who, edge))
            counts[who] += self.count[edge]
            node = self.source[edge]
            on = node > start
            who, node, start = who[on], node[on], start[on]
            step += 1
        out = np.empty(int(counts.sum()), np.int32)
        cursor = np.cumsum(counts)
        for who, edge in taken:
            cursor[who] -= self.count[edge]
            place, piece = cursor[who], self.piece[edge]
            out[place] = piece
            for k in np.flatnonzero(piece < 0).tolist():
                spelled = chr(self.raw[self.char[edge[k]]]).encode()
                out[place[k] : place[k] + len(spelled)] = p.bytes[list(spelled)]
        return out, counts


class LongUnit:
    """The same lattice for one long unit, window by window: memory does not grow with its length but for characters and ids.

    Forward, only the weights of the ways to the last nodes before each window are kept; backward, a window's edges are
    found again.  Draws are those of Lattice.sample.
    """

    def __init__(self, p: Pieces, raw: np.ndarray, sharpness: float):
        self.p, self.raw, self.sharpness = p, raw, sharpness
        self.reach = [[0.0]]
        for a in range(0, len(raw) - WINDOW, WINDOW):
            self.reach.append(self._window(a, self.reach[-1])[0][-p.longest :])

    def _window(self, a: int, reach: list[float]) -> tuple[list[float], list[int], list[int], list[int], list[float]]:
        """Weights of the ways to the nodes up to this window's end, from those given to the last ones up to a; then each
        node's first edge, and the source, piece and share of all edges that end in the window."""
        p, b = self.p, min(len(self.raw), a + WINDOW)
        low = a + 1 - len(reach)
        raw = self.raw[low:b]
        begin, size, piece = _edges(p, _in_pieces(raw), len(raw) - np.arange(len(raw)))
        inside = np.flatnonzero(begin + size > a - low)
        inside = inside[np.argsort((begin + size)[inside], kind="stable")]
        begin, end, piece = begin[inside], (begin + size)[inside], piece[inside]
        cost = np.where(piece >= 0, p.log_p[piece], -BYTE_COST * _spelled(raw)[begin]) * self.sharpness
        first = np.searchsorted(end, np.arange(a - low + 1, b - low + 2)).tolist()
        source, cost, way, share = begin.tolist(), cost.tolist(), list(reach), []
        for i, j in zip(first, first[1:]):  # noqa: B905
            ways = [way[source[k]] + cost[k] for k in range(i, j)]
            top = max(ways)
            sums = list(accumulate([exp(w - top) for w in ways]))
            way.append(top + log(sums[-1]))
            share += [x / sums[-1] for x in sums]
            share[-1] = 2.0
        return way, first, (begin + low).tolist(), piece.tolist(), share

    def sample(self, seed: int) -> np.ndarray:
        out, node, step, draws = array("i"), len(self.raw), 0, []
        for w in range(len(self.reach) - 1, -1, -1):
            a = w * WINDOW
            _, first, source, piece, share = self._window(a, self.reach[w])
            while node > a:
                if step % WINDOW == 0:
                    steps = np.arange(step, step + WINDOW, dtype=np.uint64)
                    draws = ((mixed(np.uint64(seed) + steps * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
                u, edge = draws[step % WINDOW], first[node - a - 1]
                while u >= share[edge]:
                    edge += 1
                if piece[edge] >= 0:
                    out.append(piece[edge])
                else:
                    out.extend(self.p.bytes[list(chr(self.raw[node - 1]).encode())][::-1].tolist())
                node, step = source[edge], step + 1
        return np.frombuffer(out, np.int32)[::-1]


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts, each after a space of its own, in stretches that end before a space or around a line feed; how many each has."""
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), pa.scalar(""))
    data, at = text_bytes(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", spaced))
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    line, begins = data == 10, data == 32
    begins[1:] &= data[:-1] != 32
    begins |= line
    begins[1:] |= line[:-1]
    begins[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data)).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return units, np.diff(np.searchsorted(starts, at))


def sampled(texts: pa.Array, seeds: np.ndarray, p: Pieces, sharpness: float = SHARPNESS) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and how many each has; a null text has none."""
    units, per_text = _units(pc.fill_null(texts, ""))
    if not len(units):
        return np.zeros(0, np.int32), per_text
    coded = units.dictionary_encode()
    distinct, which = coded.dictionary, coded.indices.to_numpy()
    far = pc.utf8_length(distinct.cast(pa.string())).to_numpy() > LONG
    lattice = Lattice(p, pc.if_else(pa.array(far), b"", distinct) if far.any() else distinct, sharpness)
    first = np.cumsum(per_text) - per_text
    number = np.arange(len(units)) - np.repeat(first, per_text)
    unit_seeds = mixed(np.repeat(seeds, per_text) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = far[which]
    ids, counts = lattice.sample(which[~long], unit_seeds[~long], p)
    if far.any():
        raw = lambda u: np.frombuffer(distinct[int(u)].as_py().decode().encode("utf-32-le"), np.uint32)
        spread = {u: LongUnit(p, raw(u), sharpness) for u in np.flatnonzero(far).tolist()}
        drawn = [spread[u].sample(seed) for u, seed in zip(which[long].tolist(), unit_seeds[long].tolist(), strict=True)]
        every = np.empty(len(units), np.int64)
        every[~long], every[long] = counts, [len(x) for x in drawn]
        of_long, out = np.repeat(long, every), np.empty(every.sum(), np.int32)
        out[~of_long], out[of_long] = ids, np.concatenate(drawn)
        ids, counts = out, every
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[first + per_text] - ends[first]


def joined(ids: list[int], p: Pieces) -> str:
    """The text of which ids are pieces."""
    return b"".join([p.decoded[i] for i in ids])[1:].decode()


def _encoded(path: str, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for whole in batches:
            for a, b in blocks(whole.column("text"), TEXT_BLOCK):
                batch = whole.slice(a, b - a)
                seeds = mixed(batch.column("seed").to_numpy().view(np.uint64))
                texts = batch.column("text")
                ids, counts = sampled(texts, seeds, p, sharpness)
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                missing = pc.is_null(texts).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists, pa.array(counts), pa.array(crc, pa.int64())], ["row", "ids", "n_pieces", "ids_crc32"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, model: str | None = None, sharpness: float = SHARPNESS) -> DataFrame:
    """The columns in keep (the key alone by default), then ids (array of int), n_pieces and ids_crc32 for each row.

    Equal keys and texts get equal segmentations; a null key is a key.  A null text has null ids, an empty one none;
    both have 0 pieces.  Greater sharpness draws likely segmentations more often.  A kept column that is called like one
    of the new ones raises.  The model is a file that every executor has at this path.
    """
    clash = {c.lower() for c in keep or [key]} & {"ids", "n_pieces", "ids_crc32"}
    if clash:
        raise ValueError(f"kept columns are called like new ones: {sorted(clash)}")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep or [key]]).alias("row")
    rows = docs.select(kept, F.xxhash64(F.col(key)).alias("seed"), F.col(text).alias("text"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, n_pieces long, ids_crc32 long"
    return rows.mapInArrow(_encoded(model or default_model(), sharpness), out).select("row.*", "ids", "n_pieces", "ids_crc32")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids = part.column("ids")
                texts = [None if x is None else joined(x, p) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    return run


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """All columns but ids, and decoded: exactly the text that was encoded; null for null ids, empty for none."""
    kept = F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != ids]).alias("row")
    rows = encoded.select(kept, F.col(ids).alias("ids"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, decoded string"
    return rows.mapInArrow(_decoded(model or default_model()), out).select("row.*", "decoded")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = decode(encode(docs, keep=["doc_id", "text"]))
    return back.select("doc_id", "n_pieces", "ids_crc32", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
