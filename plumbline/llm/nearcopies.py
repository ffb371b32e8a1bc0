"""Near copies by order MinHash.

A sketch of a text is made of the few windows of five words that have the smallest hash under the sketch's own hash
function, in the order in which they stand in the text; a window that occurs several times counts once for each
occurrence, told apart by its number.  Sketches of short texts are made of fewer windows.  Two texts agree in a sketch with a chance that falls with their edit distance.
Texts that agree in a sketch share a bucket.  Candidates out of the buckets are verified by a banded alignment of their
windows, and verified links are joined into classes.

Work inside a bucket grows with its size, not its square, while its texts are near copies of each other: in the
first round each is compared with the text that shares most buckets, and what is then in one class needs no further
comparison.  Windows that only one text has can't be matched by any other; texts, and pairs of texts, that have too many
of them to be similar are left out by that bound.  What stays apart meets MET of its bucket's texts, chosen by hash, all in a
bucket of no more, and then, where a larger one still has several classes, all others there too.  So a pair is missed only
if it shares no sketch; no number of partners or candidates is limited.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, written
from plumbline.llm.components import components
from plumbline.llm.wordhash import blocks, mixed, shingles, span_hashes, text_bytes, word_spans

WINDOW = 5
SIMILARITY = 0.8
SKETCHES = 40
PICKED = 8
SHORT = 64
SHORT_PICKED = 4
CELLS = 1 << 20
MET = 64
PART = 256
MARKS = 8
MANY_PLACES = 64


def _numbered(windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Windows told apart by how often the same one came before in its text."""
    keys = mixed(windows + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if new.all():
        return windows
    at = np.arange(len(keys))
    number = np.zeros(len(keys), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(number > 0, mixed(windows + number * np.uint64(0xA0761D6478BD642F)), windows)


def _sketches(windows: np.ndarray, factors: np.ndarray, picked: int) -> np.ndarray:
    """One key for each factor: the picked windows of smallest hash, in text order."""
    n = len(windows)
    out = np.empty(len(factors), np.uint64)
    step = max(1, CELLS // n)
    for i in range(0, len(factors), step):
        part = factors[i : i + step, None]
        if n > picked:
            hashes = ((windows ^ (windows >> np.uint64(32)))[None, :] * part) >> np.uint64(20)
            chosen = np.sort(np.argpartition(hashes, picked - 1, axis=1)[:, :picked], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(n), (len(part), n))
        key = part[:, 0].copy()
        for c in range(chosen.shape[1]):
            key = key * np.uint64(0xD6E8FEB86659FD93) + windows[chosen[:, c]]
        out[i : i + step] = mixed(key)
    return out


def _keys(windows: np.ndarray, factors: np.ndarray, picked: int, least: float) -> np.ndarray:
    """A text's sketches: of up to SHORT windows by fewer of them, and both kinds where a near copy may have either."""
    n, kinds = len(windows), []
    if n <= SHORT:
        kinds.append(min(SHORT_PICKED, picked))
    if n >= least * SHORT - 1e-9:
        kinds.append(picked)
    return np.concatenate([_sketches(windows, factors, p) for p in kinds])


def _sketched(k: int, sketches: int, picked: int, least: float = SIMILARITY):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(6).integers(1, 2**62, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for a, b in blocks(whole.column(1)):
                batch = whole.slice(a, b - a)
                data, at = text_bytes(batch.column(1))
                starts, ends, before = word_spans(data, at)
                words = span_hashes(data, starts, ends)
                windows, _, first = shingles(words, before, k)
                numbered = _numbered(windows, np.repeat(np.arange(len(at) - 1), np.diff(first)))
                short = words.astype(np.uint32)
                digests, kept, keys = [], [], []
                for d in range(len(at) - 1):
                    if first[d] == first[d + 1]:
                        digests.append(None), kept.append(None), keys.append(None)
                        continue
                    digests.append(hashlib.blake2b(words[before[d] : before[d + 1]].tobytes(), digest_size=16).digest())
                    kept.append(short[before[d] : before[d + 1]].tobytes())
                    keys.append(_keys(numbered[first[d] : first[d + 1]], factors, picked, least).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "digest", "words", "sketches"],
                )

    return run


def _bits(places: list[int]) -> int:
    if len(places) <= MANY_PLACES:
        return functools.reduce(lambda m, i: m | 1 << i, places, 0)
    flags = np.zeros(places[-1] + 1, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """How many windows of a and b an alignment in text order can match; less than needed for the similarity may be told as 0.

    A common subsequence, found a row of bits at a time.  The band holds every cell that an alignment of sufficient
    similarity can use: such an alignment leaves at most len - need windows of either text unmatched.
    """
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if need > min(len(a), len(b)):
        return 0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    sure, need = head + tail, need - head - tail
    if not len(a) or not len(b):
        return sure
    common = np.intersect1d(a, b)
    if not len(common):
        return sure
    ca, cb = np.isin(a, common), np.isin(b, common)
    if min(ca.sum(), cb.sum()) < need:
        return 0
    band = max(len(a), len(b)) - max(need, 0)
    # A row's length of bits for each window would grow with the square of the text: only windows of very many places keep one.
    places: dict[int, list[int]] = {}
    for i, x in zip(np.flatnonzero(ca).tolist(), a[ca].tolist(), strict=True):
        places.setdefault(x, []).append(i)
    masks = {x: _bits(at) for x, at in places.items() if len(at) > MANY_PLACES}
    full = (1 << len(a)) - 1
    row = full
    for j, x in zip(np.flatnonzero(cb).tolist(), b[cb].tolist(), strict=True):
        hit = (masks[x] if x in masks else _bits(places[x])) & row
        if band < len(a):
            hit &= ((1 << 2 * band + 1) - 1) << (j - band) if j > band else (1 << j + band + 1) - 1
        if hit:
            row = (row + hit | row - hit) & full
    return sure + len(a) - row.bit_count()


def similar(x: bytes, y: bytes, k: int, least: float) -> bool:
    """Whether the windows that an alignment matches are that share of all windows of both texts."""
    one, two = _windows(x, k), _windows(y, k)
    met = aligned(one, two, least)
    return met >= least * (len(one) + len(two) - met) - 1e-9


def _windows(words: bytes, k: int) -> np.ndarray:
    w = np.frombuffer(words, np.uint32).astype(np.uint64)
    return shingles(w, np.array([0, len(w)]), k)[0]


def _verified(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), k, least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["u", "v"])

    return run


def _labelled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                nodes, words = (batch.column(c).slice(i, 500) for c in (0, 1))
                found = [_windows(w.as_py(), k) for w in words]
                n = np.fromiter(map(len, found), np.int64, len(found))
                text = np.repeat(np.arange(len(found)), n)
                numbered = _numbered(np.concatenate(found), text).view(np.int64)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(text)), pa.array(numbered)], ["node", "window"])

    return run


def _bounds(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, n, most): a text's windows, and how many of them another of the nodes has as often."""
    windows = texts.join(nodes, "node", "left_semi").select("node", "words").mapInArrow(_labelled(k), "node long, window long")
    alone = windows.groupBy("window").agg(F.count("*").alias("texts"), F.min("node").alias("node")).filter("texts = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    size = F.greatest(F.octet_length("words") / 4 - (k - 1), F.lit(1)).cast("long")
    sizes = texts.join(nodes, "node", "left_semi").select("node", size.alias("n")).join(alone, "node", "left")
    return sizes.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))


def _open(placed: DataFrame) -> DataFrame:
    """(key, size) of the buckets whose texts are not all in one class."""
    return placed.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key", "size")


def _marked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros((batch.num_rows, MARKS), np.uint64)
            for i, w in enumerate(batch.column(1)):
                bit = _windows(w.as_py(), k) % np.uint64(64 * MARKS)
                np.bitwise_or.at(marks[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(marks[:, m].view(np.int64)) for m in range(MARKS))], ["node", *(f"m{m}" for m in range(MARKS))])

    return run


def _met_by_all(rest: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (u, v) of different labels that share a bucket and may be similar by the windows they lack of each other.

    Buckets are cut in parts of about PART texts, and each part meets each.  A window whose bit is not among the other
    text's is not matched: a pair is left out if those that remain are too few in either text.
    """
    marks = written(texts.join(rest.select("node").distinct(), "node", "left_semi").select("node", "words").mapInArrow(_marked(k), "node long, " + ", ".join(f"m{m} long" for m in range(MARKS))), "marks")
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(PART)), parts).cast("int")
    rest = rest.join(marks, "node").select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("each"))
    names = ["node", "label", "n", "most", *(f"m{m}" for m in range(MARKS))]
    one = written(rest.select("key", F.col("own").alias("a"), F.col("each").alias("b"), *names), "open-parts")
    two = one.select(F.col("key").alias("met"), F.col("b").alias("c"), F.col("a").alias("d"), *(F.col(c).alias(f"u{c}") for c in names))

    def left(n: str, x: str, y: str) -> Column:
        return F.col(n) - functools.reduce(Column.__add__, [F.bit_count(F.col(f"{x}m{m}").bitwiseAND(F.bitwise_not(f"{y}m{m}"))) for m in range(MARKS)])

    matched = F.least("most", "umost", left("n", "", "u"), left("un", "u", ""))
    enough = matched >= least / (1 + least) * (F.col("n") + F.col("un")) - 1e-6
    same = (F.col("key") == F.col("met")) & (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))
    return one.join(two, same & (F.col("ulabel") < F.col("label")) & enough).select(F.least("unode", "node").alias("u"), F.greatest("unode", "node").alias("v"))


def _links(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""
    with_v = pairs.join(texts.select(F.col("node").alias("v"), F.col("words").alias("y")), "v")
    with_both = with_v.join(texts.select(F.col("node").alias("u"), F.col("words").alias("x")), "u")
    return with_both.select("u", "v", "x", "y").mapInArrow(_verified(k, least), "u long, v long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, least: float = SIMILARITY, sketches: int = SKETCHES, picked: int = PICKED) -> DataFrame:
    """A row (doc_id, digest, class_id) for each row of docs; class_id is the smallest id among its near copies.

    Two texts are near copies if an alignment in text order matches windows of k words that make up the share least of
    the windows of both.  Texts with the same words are near copies in any case.  A null text, or one without words,
    is in a class of its own and has no digest; a row with a null id takes no part and has a null class.  Repeated rows
    are in one class; texts under one id count as one document.  Other columns are not read.  Empty in, empty out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    table = written(rows.mapInArrow(_sketched(k, sketches, picked, least), "id long, digest binary, words binary, sketches array<long>"), "sketches")
    named = table.filter("id IS NOT NULL AND digest IS NOT NULL")
    # Aggregates are written before they are joined: with plain exchanges on both sides Spark can split a hot key.
    nodes = written(named.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    # Sketches are the same for all copies of a text: those of the row that names the class are enough.
    one = named.join(nodes, "digest").filter("id = node")
    spread = one.select("node", F.explode("sketches").alias("key")).distinct()
    shared = written(spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared-keys")
    members = written(spread.join(shared, "key"), "buckets")
    wanted = members.select("node").distinct()
    texts = written(one.join(wanted, "node", "left_semi").select("node", "words").dropDuplicates(["node"]), "candidate-texts")

    weight = written(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    ranked = members.join(weight, "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("u"))
    pairs = members.join(written(centres, "centres"), "key").filter("node <> u").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
    tried = written(pairs, "tried")
    links = written(_links(tried, texts, k, least), "verified")
    labels = written(components(links), "labels")
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = written(placed.join(written(_open(placed).select("key"), "open-buckets"), "key", "left_semi").select("node").distinct(), "open-nodes")
    bounds = written(_bounds(apart, texts, k).filter(F.col("most") >= least * F.col("n")), "bounds")
    for chosen in (MET, None):
        # Both rounds count a bucket's texts after the bound: what the first one leaves to the last is what that one takes up.
        placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")).join(bounds, "node")
        sizes = _open(placed)
        if chosen is None:
            sizes = sizes.filter(F.col("size") > MET)  # of smaller buckets the last round has tried all
        rest = placed.join(written(sizes, "open-buckets"), "key")
        rest = written(rest, "open-members")
        if chosen:
            # A text that is chosen in one bucket is chosen in all others that are no larger.
            draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(MET)), 11) * F.lit(2.0**-53)
            some = rest.filter(draw * F.col("size") < chosen)
            some = some.select(F.col("key").alias("met"), F.col("node").alias("u"), F.col("label").alias("of"), F.col("n").alias("un"), F.col("most").alias("umost"))
            enough = F.least("most", "umost") >= least / (1 + least) * (F.col("n") + F.col("un")) - 1e-6
            more = rest.join(some, (F.col("key") == F.col("met")) & (F.col("label") != F.col("of")) & enough)
            more = more.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
        else:
            more = _met_by_all(rest, texts, k, least)
        more = more.distinct()
        more = written(more.join(tried, ["u", "v"], "left_anti"), "tried")
        found = written(_links(more, texts, k, least), "verified")
        tried = tried.unionByName(more)
        # Only classes that a new link joins get new labels.
        named = found.join(labels.select(F.col("node").alias("u"), F.col("label").alias("a")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("label").alias("b")), "v", "left")
        joined = components(named.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
        old = labels.unionByName(found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = written(old.join(joined.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")
    placed = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    return table.select("id", "digest").join(placed, "digest", "left").select(
        F.col("id").alias("doc_id"), "digest", F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("class_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their near copies, all columns unchanged: of each class the row with the smallest id stays.

    Rows with a null id, null texts and texts without words all stay.  Of repeated rows one stays.
    """
    # Only ids that lose rows are told, so most texts need no partner, and where these are few none is shuffled.
    with scratch(docs.sparkSession):
        found = classes(docs, doc_id, text, **options).filter("digest IS NOT NULL AND doc_id IS NOT NULL")
        told = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).filter("doc_id <> class_id OR n > 1")
        stays = (F.col("doc_id") == F.col("class_id")).alias("stays")
        told = written(told.select(F.col("doc_id").alias("of"), stays, (F.col("n") > 1).alias("repeated")), "near-copies", outlives=True)
    # Documents go through one join, with one copy of their text, and it is planned alike at every size.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"))
    empty = ~F.coalesce(F.col(f"row.`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met = packed.join(told.hint("merge"), F.col("id") == F.col("of"), "left")
    once = met.filter(F.col("of").isNull() | empty | (F.col("stays") & ~F.col("repeated")))
    # Ids that have several rows: few, as a rule, and joined for themselves.
    several = told.filter("stays AND repeated").select(F.col("of").alias("id"))
    first = packed.filter(~empty).join(several, "id", "left_semi").dropDuplicates(["id"])
    return once.select("row").unionByName(first.select("row")).select("row.*")


def query(spark, folder: str) -> DataFrame:
    return classes(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "class_id")
