"""Token ids in files of planes.

Ids are cut into blocks of a fixed size.  A block of n 32-bit ids is transposed, so that the first bytes (or bits) of all
its ids stand together, then the second, and so on; each of these planes is compressed by itself with zstandard, and a
plane of zeros takes no room.  At the end of a file stand the index of its blocks and the ids and lengths of its
documents, so any block, and any document, can be read without the rest.

Documents are dealt out in ranges of ascending id, each task tokenizes its range and writes it as it goes; a task holds
one batch of texts and one block.  The files' numbers of ids are summed up afterwards, which gives each document its
place in the whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept, written
from plumbline.llm.store import opened, put
from plumbline.llm.wordhash import blocks, span_hashes, text_bytes, word_spans
from plumbline.session import fresh_path

MAGIC = b"PLANES01"
BLOCK = 1 << 16
IDS_PER_FILE = 1 << 25
LEVEL = 3
END_ID = 1
TEXT_BLOCK = 8 << 20
NULL_ID = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of 32-bit ids, lowest first: 4 of bytes or 32 of bits; a plane of zeros is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        rows = np.ascontiguousarray(raw.T)
    return [row.tobytes() if row.any() else b"" for row in rows]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    width = -(-n // 8) if kind == "bit" else n
    rows = np.stack([np.frombuffer(p or bytes(width), np.uint8) for p in planes])
    if kind == "bit":
        raw = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    return raw.reshape(-1).view("<u4")


class Writer:
    """One file: blocks as they fill, then the index."""

    def __init__(self, out, kind: str, block: int, level: int):
        self.out, self.kind, self.block, self.level = out, kind, block, level
        self.rest, self.rest_n, self.index, self.docs, self.n_ids = [], 0, [], [], 0
        out.write(MAGIC)
        self.place = len(MAGIC)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, lengths))
        self.n_ids += len(ids)
        self.rest.append(ids), setattr(self, "rest_n", self.rest_n + len(ids))
        if self.rest_n >= self.block:
            every = np.concatenate(self.rest)
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(every[i : i + self.block])
            self.rest, self.rest_n = [every[whole:]], len(every) - whole

    def _flush(self, ids: np.ndarray) -> None:
        packer = zstandard.ZstdCompressor(level=self.level)
        packed = [packer.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.index.append((self.place, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)
            self.place += len(p)

    def close(self) -> None:
        if self.rest_n:
            self._flush(np.concatenate(self.rest))
        doc_ids = np.concatenate([d for d, _ in self.docs] or [np.zeros(0, np.int64)]).astype("<i8")
        lengths = np.concatenate([n for _, n in self.docs] or [np.zeros(0, np.int64)]).astype("<i8")
        planes = 32 if self.kind == "bit" else 4
        index = np.array([[place, n, *sizes] for place, n, sizes in self.index], "<i8").reshape(-1, 2 + planes)
        tail = zstandard.ZstdCompressor(level=self.level).compress(b"".join([index.tobytes(), doc_ids.tobytes(), lengths.tobytes()]))
        self.out.write(tail)
        self.out.write(struct.pack("<QQQQ8s", len(tail), len(index), len(doc_ids), planes, MAGIC))


class Reader:
    """One file: its documents, and its ids block by block or from any place."""

    _END = struct.calcsize("<QQQQ8s")

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail, n_blocks, n_docs, planes, magic = struct.unpack("<QQQQ8s", file.read_at(self._END, size - self._END))
        if magic != MAGIC:
            raise ValueError("not a file of planes, or cut short")
        raw = zstandard.ZstdDecompressor().decompress(file.read_at(tail, size - self._END - tail))
        values = np.frombuffer(raw, "<i8")
        cut = n_blocks * (2 + planes)
        self.index = values[:cut].reshape(n_blocks, 2 + planes)
        self.doc_ids, self.lengths = values[cut : cut + n_docs], values[cut + n_docs :]
        self.kind = "bit" if planes == 32 else "byte"
        self.first = np.concatenate([[0], np.cumsum(self.index[:, 1])])

    def block(self, i: int) -> np.ndarray:
        place, n, sizes = int(self.index[i, 0]), int(self.index[i, 1]), self.index[i, 2:].tolist()
        raw, unpack, planes, at = self.file.read_at(sum(sizes), place), zstandard.ZstdDecompressor(), [], 0
        for s in sizes:
            planes.append(unpack.decompress(raw[at : at + s]) if s else b"")
            at += s
        return from_planes(planes, n, self.kind)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from place begin to place end; reads only the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.first, begin, "right") - 1, np.searchsorted(self.first, end, "left")
        return np.concatenate([self.block(i) for i in range(a, b)])[begin - self.first[a] : end - self.first[a]]


_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER & ~_DIGIT


class Encoder:
    """A tokenizer of the tokenizers library for whole texts.

    This vocabulary's pre-tokenizer drops white space, never joins what it parts, and parts letters and digits from the
    punctuation after them; its normalizer does not reach over either.  So a text's ids are those of its words in turn, and
    of a word with ASCII punctuation at its end those of both parts.  Each distinct part is encoded once by the library and
    then known by its 64-bit hash, up to KNOWN parts in a task's process.  Texts that hold the string of an added token are
    encoded whole by the library.
    """

    KNOWN = 2_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _parts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of all words, those with punctuation after a letter or digit in two, and how many come before each text."""
        starts, ends, _ = word_spans(data, at)
        if not len(starts):
            return starts, ends, np.zeros(len(at), np.int64)
        mark = _MARK[data]
        last = np.where(mark, -1, np.arange(len(data)))
        last = np.maximum.accumulate(last)[ends - 1]  # the last byte of each word that is no mark
        inner = (last >= starts) & (last < ends - 1)
        spot = np.maximum(last, 0)
        two = np.maximum(spot - 1, 0)
        latin = (data[two] == 0xC3) & (data[spot] >= 0x80) & (data[spot] != 0x97) & (data[spot] != 0xB7)
        inner &= _LETTER[data[spot]] | _DIGIT[data[spot]] | latin
        cuts = last[inner] + 1
        all_starts = np.sort(np.concatenate([starts, cuts]))
        all_ends = np.sort(np.concatenate([ends, cuts]))
        return all_starts, all_ends, np.searchsorted(all_starts, at)

    def _learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size + len(self.flat)
        order = np.argsort(hashes)
        spots = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, spots, hashes[order])
        self.first = np.insert(self.first, spots, first[order])
        self.size = np.insert(self.size, spots, size[order])
        self.flat = np.concatenate([self.flat, flat])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        holds = np.zeros(len(texts), bool)
        for content in self.added:
            holds |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._by_parts(texts)
        ids, n = self._by_parts(pc.if_else(pa.array(holds), pa.scalar("", texts.type), texts))
        lists = np.split(ids, np.cumsum(n)[:-1])
        for i in np.flatnonzero(holds).tolist():
            lists[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))

    def _by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = text_bytes(texts)
        starts, ends, before = self._parts(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes, distinct = pd.factorize(span_hashes(data, starts, ends))
        if len(self.keys) + len(distinct) > self.KNOWN:
            self._forget()
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            self._learn(distinct[new], [raw[s:e].decode() for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, distinct)
        n = self.size[spot][codes]
        ends_of = np.cumsum(n)
        ids = self.flat[np.arange(int(ends_of[-1])) + np.repeat(self.first[spot][codes] - (ends_of - n), n)]
        per_text = np.concatenate([[0], ends_of])
        return ids, np.diff(per_text[before])


def encoder(path: str) -> Encoder:
    return kept(f"encoder {path}", lambda: Encoder(path))


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id))


def _write(folder: str, tokenizer: str, kind: str, block: int, per_file: int, level: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()

        def pieces():
            for whole in batches:
                for a, b in blocks(whole.column(1), TEXT_BLOCK):
                    batch = whole.slice(a, b - a)
                    ids, counts = encode(batch.column(1))
                    ids, counts, keys = _with_ends(ids, counts, end_id), counts + 1, batch.column(0).fill_null(NULL_ID).to_numpy()
                    ends, i = np.concatenate([[0], np.cumsum(counts)]), 0
                    while i < len(keys):  # some documents at a time, so that files end near their size
                        j = max(i + 1, int(np.searchsorted(ends, ends[i] + per_file // 8, "right")) - 1)
                        yield keys[i:j], counts[i:j], ids[ends[i] : ends[j]]
                        i = j

        source, number = pieces(), 0
        piece = next(source, None)
        while piece is not None:
            path, told = f"{folder}/part-{part:06d}-{number:04d}.planes", {}

            def fill(out, told=told):
                nonlocal piece
                w, docs = Writer(out, kind, block, level), 0
                while piece is not None and w.n_ids < per_file:
                    w.add(*piece)
                    docs += len(piece[0])
                    piece = next(source, None)
                w.close()
                told.update(ids=w.n_ids, docs=docs)

            size = put(path, fill)
            yield pa.RecordBatch.from_pylist([{"file": path, "part": part, "number": number, "docs": told["docs"], "ids": told["ids"], "bytes": size}], _FILES)
            number += 1

    return run


_FILES = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_planes(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, kind: str = "byte", block: int = BLOCK, per_file: int = IDS_PER_FILE, level: int = LEVEL, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts in ascending order of doc_id below folder; a row for each file, with its place in the whole.

    A null text counts as empty; each document ends with end_id.  Rows with a null id come first, rows of one id in order
    of their texts' hashes.  Other columns are not read.  An empty table gives no file.  folder must be shared by all
    executors.  kind is "byte" or "bit".
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"planes of {kind!r}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("order"))
    dealt = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order").select("doc_id", "text")
    files = dealt.mapInArrow(_write(folder.rstrip("/"), tokenizer or default_tokenizer(), kind, block, per_file, level, end_id), "file string, part int, number int, docs long, ids long, bytes long")
    files = written(files, "plane-files")
    # One row for each file of many megabytes, so this window stays small.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return written(files.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first")), "plane-files")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with opened(path) as file:
                    yield from _documents(Reader(file), first, with_ids)

    return run


def _documents(r: Reader, first: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a file, some at a time; a long one is read block by block where only its checksum is wanted."""
    ends = np.cumsum(r.lengths)
    begins, a = ends - r.lengths, 0
    block, held = -1, np.zeros(0, np.uint32)
    while a < len(ends):
        b = max(a + 1, min(a + 4096, int(np.searchsorted(ends, begins[a] + 4 * BLOCK, "right"))))
        crcs, lists = [], []
        for d in range(a, b):
            crc, at, parts = 0, int(begins[d]), []
            while at < ends[d]:
                if not (block >= 0 and r.first[block] <= at < r.first[block + 1]):
                    block = int(np.searchsorted(r.first, at, "right")) - 1
                    held = r.block(block)
                part = held[at - r.first[block] : min(int(ends[d]), int(r.first[block + 1])) - r.first[block]]
                if with_ids:
                    parts.append(part)
                crc = zlib.crc32(part.tobytes(), crc)
                at += len(part)
            crcs.append(crc)
            lists.append(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
        ids = pa.array(r.doc_ids[a:b])
        columns = [pa.array(r.doc_ids[a:b], mask=r.doc_ids[a:b] == NULL_ID) if (r.doc_ids[a:b] == NULL_ID).any() else ids, pa.array(begins[a:b] + first), pa.array(r.lengths[a:b]), pa.array(crcs, pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)
        a = b


def read_planes(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files that write_planes() told of."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    n = max(1, files.count())
    return files.select("file", "first").repartition(n).mapInArrow(_read(with_ids), kind)


def query(spark, folder: str) -> DataFrame:
    files = write_planes(spark.read.parquet(f"{folder}/documents.parquet"), fresh_path(spark, "planes"))
    return read_planes(files, with_ids=False)
