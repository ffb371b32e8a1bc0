"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source it stands in the order of keys, and the source gives as many
whole epochs as fit into its budget of words, then the documents from the front of the order until the budget is used
up exactly; the document over the cut gives the words that are left.

The order is never held in one place: keys are cut into about as many ranges as the root of the number of documents,
words are summed by source and range (with map-side sums), prefix sums run over these ranges, and only the one range of a
source that its cut falls into is sorted row by row; neither holds more than about that root.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, WORD, word_count, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 8
KEY_BITS = 60


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 random-looking bits; rows differ in nothing that counts where they share them."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, *more: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _key(F.col(doc_id), F.col(text), seed).alias("key"), *more)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, budget, epochs, rest) from (source, source_size), a row for each source.

    Sources in code point order, null last, weigh weights in turn, and share all words; a target stops at epochs times
    its source's size, and what is over is shared by weight among the others until none is above.  With sources in order
    of limit over weight, the level is that of the first source that stays within its limit.  The windows run over
    one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    rows = rows.select("*", (F.sum("source_size").over(every) - before).alias("left"), after.alias("share"), F.row_number().over(by_limit).alias("place"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    within = exact("left") * exact("weight") <= exact("most") * exact("share")
    level = F.min(F.when(within, F.struct("place", (F.col("left").cast("double") / F.col("share")).alias("level")))).over(every)["level"]
    target = F.least(F.coalesce(level, F.lit(0.0)) * F.col("weight"), F.col("most").cast("double"))
    rows = rows.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("budget"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rows = rows.select("*", whole.cast("long").alias("epochs"))
    return rows.select("*", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _ranged(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))


def plan(slim: DataFrame, bits: int, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """targets() with the range that the cut of each source falls into, and the words in front of that range."""
    sums = written(_ranged(slim, bits).groupBy("source", "range").agg(F.sum("size").alias("words")), "range-sums")
    found = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select("*", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("in_front"))
    placed = placed.withColumnRenamed("source", "of")
    cuts = found.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("in_front") < F.col("rest")) & (F.col("rest") <= F.col("in_front") + F.col("words")))
    cuts = cuts.select(F.col("source").alias("of"), F.col("range").alias("cut"), "in_front")
    out = found.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(*found.columns, "cut", "in_front")
    return written(out.withColumnRenamed("source", "of"), "mix-plan")


def _cut(rows: DataFrame, planned: DataFrame, bits: int) -> DataFrame:
    """Adds epochs (whole copies) and part (words of the last, broken epoch; null where it does not reach)."""
    met = _ranged(rows, bits).join(planned, F.col("source").eqNullSafe(F.col("of")))
    here = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    whole = F.when(F.coalesce(F.col("range") < F.col("cut"), F.lit(False)), F.col("size"))
    apart = met.filter(~here).withColumn("part", whole)
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("in_front") - F.coalesce(F.sum("size").over(order), F.lit(0))
    broken = met.filter(here).withColumn("left", left)
    broken = broken.withColumn("part", F.when(F.col("left") > 0, F.least("left", "size"))).drop("left")
    return apart.unionByName(broken)


def _bits(rows: int) -> int:
    return (rows.bit_length() + 1) // 2


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken) for each row of docs.

    size is the text's words, 0 for null; taken is what the mix takes of the row, all copies together, and sums up to
    the target of the source, rounded.  No row gives more than epochs times its size.  A null source is a source, the
    last.  Null ids are ids; of rows that agree in id and size any may be the one that the cut falls on.  A source
    without words has target 0.  Other columns are not read.  The result depends on rows and seed only.
    """
    slim = written(_sized(docs, doc_id, text, source, seed), "mix-sizes")
    bits = _bits(slim.count())
    out = _cut(slim, plan(slim, bits, weights, epochs), bits)
    taken = F.col("epochs") * F.col("size") + F.coalesce("part", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", taken.alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None, **options) -> DataFrame:
    """The documents that the mix takes, once for each epoch, all columns; see mix().

    The document over a source's cut ends after the words that are left; the column named length gets its characters.
    """
    weights, epochs, seed = options.get("weights", WEIGHTS), options.get("epochs", EPOCHS), options.get("seed", SEED)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = written(_sized(docs, doc_id, text, source, seed, row), "sized-documents")
    bits = _bits(sized.count())
    out = _cut(sized, plan(sized, bits, weights, epochs), bits)
    copies = F.when(F.col("epochs") > 0, F.sequence(F.lit(1), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<int>"))
    copies = F.transform(copies, lambda _: F.lit(None).cast("long"))
    copies = F.when(F.col("part").isNotNull(), F.concat(copies, F.array(F.when(F.col("part") < F.col("size"), F.col("part"))))).otherwise(copies)
    out = out.select("row", F.explode(copies).alias("words"))
    pieces = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(f"[{SPACES}]*{WORD}"), F.lit(0))
    short = F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")
    cut = out.filter("words IS NOT NULL").withColumn("row", F.col("row").withField(f"`{text}`", short))
    if length:
        cut = cut.withColumn("row", F.col("row").withField(f"`{length}`", F.length(F.col(f"row.`{text}`")).cast(docs.schema[length].dataType)))
    return out.filter("words IS NULL").unionByName(cut).select("row.*")


def query(spark, folder: str) -> DataFrame:
    return mix(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || t), 1, {KEY_BITS // 4}))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, source_size * {EPOCHS} AS most FROM s),
o AS (SELECT *, row_number() OVER by_limit AS place,
  (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_words,
  (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share
  FROM w WINDOW by_limit AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT arg_min(rest_words::DOUBLE / share, place) AS level FROM o WHERE rest_words::HUGEINT * weight <= most::HUGEINT * share),
t AS (SELECT source, source_size, least(coalesce(l.level, 0) * weight, most::DOUBLE) AS target FROM o, l),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_front
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - in_front)))::BIGINT AS taken FROM r"""
