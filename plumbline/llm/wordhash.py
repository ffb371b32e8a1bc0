"""Word and shingle hashes of whole Arrow batches of texts, in numpy; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_of(step: int, n: int) -> np.ndarray:
    known = _powers.get(step)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES // 4), step, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[step] = known
    return known[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and each text's start among them (one more for the end); null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes of text each, one text at least."""
    _, at = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words, and the number of words before each text; between tells which bytes part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = between[data]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] = ~space[edges]
    edges = at[1:][at[:-1] < at[1:]] - 1
    ends[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def parts(data: np.ndarray, at: np.ndarray, between: np.ndarray = IS_SPACE, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Byte ranges (a, b) of about size that cut no word, the first text in each, and the starts of its texts counted from a."""
    a = 0
    while a < len(data):
        b = min(len(data), a + size)
        while True:
            ahead = np.flatnonzero(between[data[b : b + 4096]])
            stop = min(int(at[np.searchsorted(at, b)]), b + (int(ahead[0]) if len(ahead) else 4096))
            if len(ahead) or stop < b + 4096:
                break
            b = stop
        b = stop
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b))
        yield a, b, first, np.clip(at[first : last + 1], a, b) - a
        a = b


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range; ranges ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        part = data[base : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _powers_of(_STEP, len(part)), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _powers_of(_BACK, len(part) + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def shingles(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, the first word of each, and the number of windows before each text.

    A text of fewer than k words has one window of all of them, a text without words none.
    """
    n = np.diff(before)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(before[:-1] - first[:-1], count)
    end = np.repeat(before[1:], count)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(at + j < end, padded[at + j], np.uint64(0))
    return mixed(out), at, first
