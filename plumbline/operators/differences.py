"""Differences of two tables as multisets, then cell by cell where keys are known.

Tables are compared by counts of row digests: only digests, not rows, are shuffled, and rows are looked up for the
digests whose counts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import quoted, written


def _digest(columns: list[str]) -> Column:
    """128 bits of a row; which cells are missing is told beside the values, as a hash passes over them."""
    cells = [F.col(quoted(c)) for c in columns]
    missing = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cells])
    return F.struct(F.xxhash64(F.lit(1), missing, *cells).alias("a"), F.xxhash64(F.lit(2), *reversed(cells), missing).alias("b"))


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that one table has more often than the other: its columns, ``side`` (left or right) and ``times``, how much more often.

    Both tables have the same columns, of the same types; missing cells equal each other, and so do NaNs.  Expanded by times, the rows of the left
    side are left EXCEPT ALL right, those of the right side right EXCEPT ALL left.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    marked = [df.select(*[F.col(quoted(c)) for c in columns], _digest(columns).alias("_row")) for df in (left, right)]
    counts = marked[0].select("_row", F.lit(1).alias("n")).unionByName(marked[1].select("_row", F.lit(-1).alias("n")))
    differ = written(counts.groupBy("_row").agg(F.sum("n").alias("n")).filter("n <> 0"), "differing-rows")
    sides = []
    for side, rows, wanted in (("left", marked[0], "n > 0"), ("right", marked[1], "n < 0")):
        some = differ.filter(wanted).select("_row", F.abs("n").alias("times"))
        # Copies of a row share a digest, one of them is told.
        one = rows.join(some, "_row").groupBy("_row").agg(F.any_value(F.struct(*[F.col(quoted(c)) for c in columns])).alias("cells"), F.any_value("times").alias("times"))
        sides.append(one.select("cells.*", F.lit(side).alias("side"), "times"))
    return sides[0].unionByName(sides[1])


def cell_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, column, left, right) for keys, unique in each table, whose rows differ: the cells that differ as text, or a row that only one side has.

    change is cell, removed (only left has the key) or added; of the latter two column, left and right are null.
    """
    differ = written(row_difference(left, right), "differing-cells")
    rest = [c for c in left.columns if c not in keys]
    sides = [differ.filter(F.col("side") == s).select(*[F.col(quoted(k)) for k in keys], F.struct(*[F.col(quoted(c)).cast("string").alias(c) for c in rest], F.lit(1).alias("_has")).alias(s)) for s in ("left", "right")]
    same = sides[0].alias("l").join(sides[1].alias("r"), [F.col(f"l.{quoted(k)}").eqNullSafe(F.col(f"r.{quoted(k)}")) for k in keys], "full")
    both = same.select(*[F.coalesce(F.col(f"l.{quoted(k)}"), F.col(f"r.{quoted(k)}")).alias(k) for k in keys], "left", "right")
    none = F.lit(None).cast("string")
    cells = [
        F.when(~F.col(f"left.{quoted(c)}").eqNullSafe(F.col(f"right.{quoted(c)}")), F.struct(F.lit("cell").alias("change"), F.lit(c).alias("column"), F.col(f"left.{quoted(c)}").alias("left"), F.col(f"right.{quoted(c)}").alias("right")))
        for c in rest
    ]
    whole = F.array(F.struct(F.when(F.col("left").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("change"), none.alias("column"), none.alias("left"), none.alias("right")))
    changes = F.when(F.col("left").isNull() | F.col("right").isNull(), whole).otherwise(F.array_compact(F.array(*cells)))
    return both.select(*map(quoted, keys), F.explode(changes).alias("c")).select(*map(quoted, keys), "c.*")
