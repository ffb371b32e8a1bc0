"""Whitening of embeddings, with each distinct vector worked on once.

Entries become whole numbers on a grid.  Equal vectors are grouped and counted, and the covariance is the centred product
of the distinct vectors, weighted by their counts (or by one each).  Its unit eigenvectors, scaled by the roots of the
eigenvalues, whiten every distinct vector once; a digest of the vector joins the results back to its rows.

Sums, and the distance of a vector to the mean, are exact: whole numbers of 64 bits where a bound shows that they fit,
else Python's.  Tasks give a partial product each, d rows of d numbers for vectors of d entries, and these are summed up by
entry; only the sums, d * d numbers, reach the driver, which takes the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

COMPONENTS = 32
GRID = 64
SHIFT = 1_000_000
LIMIT = 2.0**62  # entries on the grid stay below it
FIT_CELLS = 1 << 26
LEAST_SHARE = 1e-15  # of the trace and for each dimension: eigenvalues up to it are none
INT = pa.decimal128(38, 0)


def _usable(c: Column) -> Column:
    """Not null, not empty, and every entry a finite number that fits on the grid."""
    fits = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / GRID))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(fits, F.lit(False))


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the length, the places of its rows, and a matrix of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[offsets[at][:, None] + np.arange(d)]


def exact_sums(x: np.ndarray, counts: np.ndarray) -> list[int]:
    """Sums of rows times counts, by column."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    if most * int(counts.sum()) < 1 << 62:
        return (counts @ x).tolist()
    return [sum(int(c) * int(v) for c, v in zip(counts, column, strict=True)) for column in x.T]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - sums / n in double precision, taken from exact n * x - sums, and these."""
    small = max(abs(int(x.min())), abs(int(x.max()))) * n < 1 << 61 and max(map(abs, sums)) < 1 << 61
    whole = x * np.int64(n) - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
    return (whole / n).astype(np.float64), whole


def exact_deviation(whole: np.ndarray) -> list[int]:
    """The sum of the squares of each row."""
    most = max(abs(int(whole.min())), abs(int(whole.max())))
    if whole.dtype != object and most * most * whole.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", whole, whole).tolist()
    return [sum(int(v) ** 2 for v in row) for row in whole]


def _totals(weigh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            counts = batch.column(1).to_numpy() if weigh else np.ones(batch.num_rows, np.int64)
            for d, at, x in _rows(batch.column(0)):
                n, sums = found.get(d, (0, [0] * d))
                found[d] = n + int(counts[at].sum()), [a + b for a, b in zip(sums, exact_sums(x, counts[at]), strict=True)]
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums, INT)], ["d", "i", "n", "sum"])

    return run


def _products(centres: dict[int, tuple[int, list[int]]], weigh: bool, onto: dict[int, np.ndarray] | None = None):
    """Rows (d, i, row) of the weighted product of the centred vectors, or of what they become under a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            counts = batch.column(1).to_numpy() if weigh else np.ones(batch.num_rows, np.int64)
            for d, at, x in _rows(batch.column(0)):
                y, _ = centred(x, *centres[d])
                y = y @ onto[d] if onto else y
                found[d] = found.get(d, 0) + (y * counts[at].astype(np.float64)[:, None]).T @ y
        for d, product in found.items():
            for i, row in enumerate(product):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["d", "i", "row"])

    return run


def _summed(products: DataFrame, centres: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The products of all tasks added up by entry and divided by n."""
    sums = products.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("d", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("row"))
    found: dict[int, list] = {}
    for d, i, row in rows.toLocalIterator():
        found.setdefault(d, []).append((i, row))
    out = {}
    for d, parts in found.items():
        whole = np.array([row for _, row in sorted(parts)]) / centres[d][0]
        out[d] = (whole + whole.T) / 2
    return out


@dataclass(frozen=True)
class Fit:
    """What all vectors of one length share: their number and sums, and the eigenvalues, unit eigenvectors (columns) and trace of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self, components: int) -> np.ndarray:
        """The first eigenvectors over the roots of their eigenvalues; zeros where there is no variance."""
        some = self.values[:components] > LEAST_SHARE * len(self.sums) * self.trace
        return np.where(some, self.vectors[:, :components] / np.sqrt(np.where(some, self.values[:components], 1)), 0)


def fitted(distinct: DataFrame, weigh: bool = True) -> dict[int, Fit]:
    """The fit of each length d among (x, n) rows of distinct vectors and their counts.

    Only sums reach the driver, d * d numbers for each length; more than FIT_CELLS of them raise.
    """
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().limit(FIT_CELLS).collect()]
    if sum(d * d for d in lengths) > FIT_CELLS:
        raise ValueError(f"covariances of vectors of {len(lengths)} lengths up to {max(lengths)} have more than {FIT_CELLS} entries")
    totals = distinct.select("x", "n").mapInArrow(_totals(weigh), "d int, i int, n long, sum decimal(38,0)").groupBy("d", "i").agg(F.sum("n"), F.sum("sum"))
    parts: dict[int, list] = {}
    for d, i, n, s in totals.collect():
        parts.setdefault(d, []).append((i, n, int(s)))
    centres = {d: (p[0][1], [s for _, _, s in sorted(p)]) for d, p in parts.items()}
    products = distinct.select("x", "n").mapInArrow(_products(centres, weigh), "d int, i int, row array<double>")
    fits = {}
    for d, covariance in _summed(products, centres).items():
        values, vectors = np.linalg.eigh(covariance)
        fits[d] = Fit(*centres[d], values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)))
    return fits


def _whitened(fits: dict[int, Fit], components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = {d: fit.scaled(components) for d, fit in fits.items()}
        for batch in batches:
            for d, at, x in _rows(batch.column(1)):
                fit = fits[d]
                y, whole = centred(x, fit.n, fit.sums)
                deviation = exact_deviation(whole)
                wide = pa.array([v if v < 10**38 else None for v in deviation], INT)
                short = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([d] * len(at), pa.int32()), short, wide, pa.array(list(y @ onto[d]), pa.list_(pa.float64()))],
                    ["digest", "d", "deviation", "wide", "whitened"],
                )

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weigh: bool = True) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each usable row and component.

    An entry c becomes x = floor(64 c) + 1000000.  The covariance is over all usable rows, or with weigh=False over the distinct
    x-vectors; n counts these.  Components are numbered from 1 by falling eigenvalue, up to the length of the vectors.
    deviation is the sum of (n x - S)**2 over the entries, S the sums of x; it is null where it does not fit in a long, deviation_exact
    holds it up to 38 digits.  whitened is (x - S / n) on the component over the root of its eigenvalue, explained that eigenvalue's
    share of the trace, and identity_error how far the covariance of the whitened vectors is from the identity at most.  A
    component without variance (all of them where all vectors are equal) has whitened and explained 0, and no say in identity_error.

    Vectors that are null or empty, hold null or non-finite entries, or entries of 2**56 and more, take no part.  Vectors of
    different lengths have fits of their own.  Null ids and repeated rows are rows like others.  Other columns are not read.
    Empty in, empty out.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(_usable(F.col("v")))
    grid = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * GRID).cast("long") + SHIFT).alias("x"))
    digest = F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256))
    named = written(grid.select("vec_id", digest.alias("digest"), "x"), "grid-vectors")
    distinct = written(named.groupBy("digest").agg(F.any_value("x").alias("x"), F.count("*").alias("n")), "distinct-vectors")
    fits = fitted(distinct, weigh)
    scaled = {d: fit.scaled(components) for d, fit in fits.items()}
    centres = {d: (fit.n, fit.sums) for d, fit in fits.items()}
    left = _summed(distinct.select("x", "n").mapInArrow(_products(centres, weigh, scaled), "d int, i int, row array<double>"), centres)
    shared = []
    for d, fit in fits.items():
        some = np.flatnonzero(scaled[d].any(axis=0))
        error = np.abs(left[d][np.ix_(some, some)] - np.eye(len(some))).max(initial=0.0)
        share = np.where(np.arange(len(fit.values)) < len(some), fit.values / fit.trace if len(some) else 0.0, 0.0)
        shared.append((d, fit.n, float(error), [float(v) for v in share[:components]]))
    spark = vectors.sparkSession
    facts = spark.createDataFrame(shared, "d int, n long, identity_error double, explained array<double>")
    done = distinct.select("digest", "x").mapInArrow(_whitened(fits, components), "digest binary, d int, deviation long, wide decimal(38,0), whitened array<double>")
    # Written, so that the join's sides are plain exchanges: Spark can split a digest that very many rows have.
    done = written(done, "whitened")
    met = named.select("vec_id", "digest").join(done, "digest").join(F.broadcast(facts), "d")  # a row for each length
    each = met.select("vec_id", "n", "deviation", "wide", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error",
        F.col("wide").alias("deviation_exact"),
    )


def query(spark, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
