"""Table generation: a spec compiles to column expressions over a row id.

The few whole-column facts a spec needs (moments for outliers, noise and
correlation, the exact outlier cutoffs) are measured first, each step in one
aggregate over all columns, and enter the plan as literals.  What is left is a
map over the id, so generation neither shuffles nor depends on partitioning.
"""

from __future__ import annotations

import math
import string
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import Draws
from plumbline.operators.ranks import dense_ranks, smallest_k_cutoffs
from plumbline.plans.rules import apply_rules
from plumbline.plans.spec import ColumnSpec, DatasetSpec, SpecError
from plumbline.session import prefer_compiled_methods, quoted, settle

# Defaults of the formats and of the correlation rule.
DEFAULT_TEXT_PATTERN = "text_{}"
DEFAULT_ID_PREFIX = "ID"
DEFAULT_ID_FORMAT = "{prefix}_{:06d}"
ID_POOL_SHARE = 0.8
CATEGORY_CORRELATION_FLOOR = 0.3
VARIANT_SUFFIX = "_var"

# Filler vocabulary for prose columns.
FILLER_WORDS = (
    "about above again along among answer area back base become before begin between both build "
    "call carry change city clear close color common course cover cross early earth enough every "
    "field figure final follow form general green ground group half heat hold hour idea inside "
    "island just keep land large learn letter level light line list main measure money morning "
    "nature north notice number object ocean often order paper part pattern place plain plane "
    "power problem public question reach record river road round science second serve short"
).split()


def format_with_id(pattern: str, value: Column, **names: str) -> Column:
    """``str.format`` with one running number: supports ``{}``, ``{:0Nd}`` and named literals."""
    printf, args = "", 0
    for literal, name, spec, _ in string.Formatter().parse(pattern):
        printf += literal.replace("%", "%%")
        if name is None:
            continue
        if name in names:
            printf += names[name].replace("%", "%%")
        elif name in ("", "0"):
            printf += "%" + (spec if spec else "d")
            args += 1
        else:
            raise SpecError(f"unknown field {{{name}}} in pattern {pattern!r}")
    return F.format_string(printf, *[value] * args) if args else F.lit(printf.replace("%%", "%"))


def numeric_base(column: ColumnSpec, draws: Draws) -> Column:
    d, p = column.distribution, column.distribution.parameters
    mean = 0.0 if d.mean is None else d.mean
    std = 1.0 if d.std is None else d.std
    if d.kind == "normal":
        value = draws.normal("x", mean, std)
    elif d.kind == "uniform":
        low = 0.0 if d.min_value is None else d.min_value
        high = 1.0 if d.max_value is None else d.max_value
        value = draws.uniform("x", low, high)
    elif d.kind == "exponential":
        value = draws.exponential("x", p.get("scale", 1.0))
    elif d.kind == "gamma":
        value = draws.gamma("x", p.get("shape", 2.0), p.get("scale", 1.0))
    elif d.kind == "beta":
        value = draws.beta("x", p.get("alpha", 2.0), p.get("beta", 2.0))
    else:
        value = draws.lognormal("x", mean, std)
    return clip(value, d.min_value, d.max_value)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def category(column: ColumnSpec, draws: Draws) -> Column:
    cats, cuts = column.distribution.category_list(), column.distribution.cumulative_weights()
    u = draws.unit("x")
    value = F.lit(cats[-1])
    for cat, cut in reversed(list(zip(cats[:-1], cuts[:-1]))):
        value = F.when(u < F.lit(cut), F.lit(cat)).otherwise(value)
    return value


def instant(column: ColumnSpec, draws: Draws, as_of: datetime) -> Column:
    """A local timestamp between start and end, to the microsecond."""
    start = column.datetime_start or as_of - timedelta(days=365)
    end = column.datetime_end or as_of
    span = (end - start) // timedelta(microseconds=1)
    offset = F.floor(draws.unit("x") * F.lit(float(span))).cast("long")
    origin = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    return origin + offset * F.expr("INTERVAL '0.000001' SECOND")


def filler_text(column: ColumnSpec, draws: Draws) -> Column:
    """Words up to a length drawn from ``text_length_range``; the last word may be cut."""
    low, high = column.text_length_range
    words = max(1, high // 4 + 1)
    length = F.lit(low) + F.floor(draws.unit("len") * F.lit(float(high - low + 1))).cast("int")
    vocabulary = F.lit(list(FILLER_WORDS))
    base = draws.row_id.cast("long") * F.lit(words)

    def pick(k: Column) -> Column:
        u = Draws(draws.seed, draws.column, base + k.cast("long")).unit("word")
        return F.get(vocabulary, F.floor(u * F.lit(float(len(FILLER_WORDS)))).cast("int"))

    prose = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), pick), " ")
    return F.substring(prose, F.lit(1), length)


def identifier(column: ColumnSpec, draws: Draws, num_rows: int) -> Column:
    prefix = column.id_prefix or DEFAULT_ID_PREFIX
    pattern = column.id_format or DEFAULT_ID_FORMAT
    if column.unique:
        number = draws.row_id.cast("long")
    else:
        pool = max(1, int(num_rows * ID_POOL_SHARE))
        number = F.floor(draws.unit("x") * F.lit(float(pool))).cast("long")
    return format_with_id(pattern, number, prefix=prefix)


def seasonal_factor(when: Column, season: str) -> Column:
    # Cycle lengths of the four seasons.
    cycle = {
        "daily": (F.hour(when), 24.0),
        "weekly": (F.weekday(when), 7.0),
        "monthly": (F.dayofmonth(when), 30.0),
        "yearly": (F.dayofyear(when), 365.0),
    }
    step, length = cycle[season]
    return F.sin(F.lit(2.0 * math.pi) * step.cast("double") / F.lit(length))


def trend_factor(row_id: Column, num_rows: int, trend: str) -> Column:
    i = row_id.cast("double")
    last = float(max(1, num_rows - 1))
    if trend == "increasing":
        return i / F.lit(last)
    if trend == "decreasing":
        return F.lit(1.0) - i / F.lit(last)
    return F.sin(F.lit(2.0 * math.pi) * i / F.lit(num_rows / 3.0))


ROW = "_row_id"  # the row id inside a plan, so that a table may have a column of any name


class CompiledSpec:
    """A spec with its measured literals; ``apply`` maps any table of row ids, batch or stream."""

    def __init__(self, spec: DatasetSpec, rows: DataFrame, row_id: str = "id"):
        self.spec, self.row_id = spec, row_id
        self.rows = self._ids(rows)
        self.as_of = spec.as_of or datetime.now().replace(microsecond=0)
        self.outliers: dict[str, tuple[int, float, float]] = {}
        self.noise: dict[str, float] = {}
        self.moments: dict[str, tuple[float, float]] = {}
        self.mixed: dict[str, tuple[float, float]] = {}
        self._base: DataFrame | None = None
        self._measure()

    def _ids(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(quoted(self.row_id)).cast("long").alias(ROW))

    def draws(self, name: str, purpose: str = "value") -> Draws:
        return Draws(self.spec.seed, f"{name}/{purpose}", F.col(ROW))

    def numeric(self, column: ColumnSpec) -> Column:
        value = numeric_base(column, self.draws(column.name))
        if column.name in self.outliers:
            cutoff, mean, std = self.outliers[column.name]
            d = self.draws(column.name, "outlier")
            size = d.uniform("size", 3.0, 5.0) * F.lit(std)
            extreme = F.when(d.unit("side") > 0.5, F.lit(mean) + size).otherwise(F.lit(mean) - size)
            value = F.when(d.bits("pick") <= F.lit(cutoff).cast("long"), extreme).otherwise(value)
        if column.name in self.noise:
            value = value + self.draws(column.name, "noise").normal("x", 0.0, self.spec.noise_level * self.noise[column.name])
        return value

    def _moments(self, df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float]]:
        row = df.agg(
            *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
            *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values.values())],
        ).first()
        return {n: (row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(values)}

    def _measure(self) -> None:
        spec = self.spec
        numeric = [c for c in spec.columns if c.data_type == "numeric"]
        k = int(spec.num_rows * spec.outlier_probability) if spec.add_outliers else 0
        if numeric and k > 0:
            base = self._moments(self.rows, {c.name: self.numeric(c) for c in numeric})
            picks = {c.name: self.draws(c.name, "outlier").bits("pick") for c in numeric}
            cutoffs = smallest_k_cutoffs(self.rows, picks, k, spec.num_rows)
            self.outliers = {n: (cutoffs[n], *base[n]) for n in base}
        linked: set[str] = set()
        for c in numeric:
            if c.correlation_with and spec.column(c.correlation_with).data_type == "numeric":
                linked |= {c.name, c.correlation_with}
        if numeric and spec.add_noise:
            self._measure_noise(numeric)
        elif linked:
            self.moments = self._moments(self.rows, {c.name: self.numeric(c) for c in numeric if c.name in linked})
        self._base = self._columns(self.rows)

    def _measure_noise(self, numeric: list[ColumnSpec]) -> None:
        """Spread before noise and moments after it in one pass: the noise z enters as v + level * std(v) * z."""
        aggs = []
        for i, c in enumerate(numeric):
            v, z = self.numeric(c), self.draws(c.name, "noise").normal("x")
            aggs += [F.avg(v).alias(f"v{i}"), F.stddev_pop(v).alias(f"s{i}"), F.avg(z).alias(f"z{i}"), F.var_pop(z).alias(f"w{i}"), F.covar_pop(v, z).alias(f"c{i}")]
        row = self.rows.agg(*aggs).first()
        for i, c in enumerate(numeric):
            std = row[f"s{i}"]
            scale = self.spec.noise_level * std
            self.noise[c.name] = std
            spread = std * std + 2.0 * scale * row[f"c{i}"] + scale * scale * row[f"w{i}"]
            self.moments[c.name] = (row[f"v{i}"] + scale * row[f"z{i}"], math.sqrt(max(0.0, spread)))

    def _column(self, c: ColumnSpec) -> Column:
        d = self.draws(c.name)
        if c.data_type == "numeric":
            return self.numeric(c)
        if c.data_type == "categorical":
            return category(c, d)
        if c.data_type == "datetime":
            return instant(c, d, self.as_of)
        if c.data_type == "boolean":
            return d.unit("x") < F.lit(float(c.distribution.parameters.get("prob_true", 0.5)))
        if c.data_type == "id":
            return identifier(c, d, self.spec.num_rows)
        if c.text_words and not c.text_pattern:
            return filler_text(c, d)
        return format_with_id(c.text_pattern or DEFAULT_TEXT_PATTERN, F.col(ROW))

    def _columns(self, rows: DataFrame) -> DataFrame:
        """Independent columns in one projection, then the correlated ones in order."""
        spec = self.spec
        df = rows.select(
            ROW,
            *[self._column(c).alias(c.name) for c in spec.columns if c.correlation_with is None],
        )
        for c in spec.columns:
            if c.correlation_with is None:
                continue
            ref = spec.column(c.correlation_with)
            own = self._column(c)
            if c.data_type == "numeric" and ref.data_type == "numeric":
                # a reference that is itself correlated no longer has the moments of its own draws
                own_moments = ref.correlation_with is None
                ref_mean, ref_std = self.moments[ref.name] if own_moments else self._reference_moments(df, ref.name)
                mean, std = self.moments[c.name]
                r = c.correlation_strength
                if not ref_std or not std:
                    raise SpecError(f"{c.name}: a constant column cannot be correlated")
                z_ref = (F.col(quoted(ref.name)) - F.lit(ref_mean)) / F.lit(ref_std)
                z_own = (own - F.lit(mean)) / F.lit(std)
                mixed = F.lit(r) * z_ref + F.lit(math.sqrt(1.0 - r * r)) * z_own
                df = df.withColumn(c.name, mixed * F.lit(std) + F.lit(mean))
            elif c.data_type == "categorical" and abs(c.correlation_strength) > CATEGORY_CORRELATION_FLOOR:
                df = self._category_by_rank(df, c, ref)
            else:
                df = df.withColumn(c.name, own)
        return df

    def _reference_moments(self, df: DataFrame, name: str) -> tuple[float, float]:
        if name not in self.mixed:
            self.mixed[name] = self._moments(df, {name: F.col(quoted(name))})[name]
        return self.mixed[name]

    def _category_by_rank(self, df: DataFrame, c: ColumnSpec, ref: ColumnSpec) -> DataFrame:
        """The i-th sorted distinct reference value takes category ``i % k``."""
        cats = c.distribution.category_list()
        source = df if self._base is None else self._base
        bounded = ref.data_type in ("categorical", "boolean")
        values = len(ref.distribution.category_list()) if bounded else self.spec.num_rows
        ranks = dense_ranks(source.select(quoted(ref.name)), ref.name, values)
        named = ranks.select(
            F.col("value").alias("_ref"),
            F.get(F.lit(cats), (F.col("rank") % len(cats)).cast("int")).alias(c.name),
        )
        # No more rows than declared categories; else settled, so that a popular value can be split over tasks.
        named = F.broadcast(named) if bounded else settle(named)
        return df.join(named, df[quoted(ref.name)] == named["_ref"], "left").drop("_ref")

    def apply(self, rows: DataFrame | None = None, keep_id: bool = False) -> DataFrame:
        spec = self.spec
        if keep_id and self.row_id in {c.name for c in spec.columns}:
            raise SpecError(f"a column is already named {self.row_id}")
        df = self._base if rows is None else self._columns(self._ids(rows))
        finish = {}
        for c in spec.columns:
            value = F.col(quoted(c.name))
            if c.data_type == "numeric" and spec.clip_last:
                value = clip(value, c.distribution.min_value, c.distribution.max_value)
            if c.nullable and c.null_probability > 0:
                value = F.when(self.draws(c.name, "null").unit("x") >= F.lit(c.null_probability), value)
            if spec.consistency_level < 1.0 and c.data_type in ("categorical", "text", "id"):
                changed = self.draws(c.name, "variant").unit("x") < F.lit(1.0 - spec.consistency_level)
                value = F.when(changed, F.concat(value, F.lit(VARIANT_SUFFIX))).otherwise(value)
            finish[c.name] = value
        names = [c.name for c in spec.ordered_columns()]
        df = df.select(ROW, *[finish[n].alias(n) for n in names])
        df = apply_rules(df, spec.business_rules, spec.lenient_rules)
        main = spec.main_datetime()
        if spec.add_temporal_patterns and main:
            if spec.seasonality:
                df = df.withColumn(f"{main}_seasonal_factor", seasonal_factor(F.col(quoted(main)), spec.seasonality))
            if spec.trend:
                df = df.withColumn(f"{main}_trend_factor", trend_factor(F.col(ROW), spec.num_rows, spec.trend))
        return df.withColumnRenamed(ROW, self.row_id) if keep_id else df.drop(ROW)


def compile_spec(spark: SparkSession, spec: DatasetSpec, rows: DataFrame | None = None, row_id: str = "id") -> CompiledSpec:
    """Measure what the spec needs over ``rows`` (default: ids 0 .. num_rows-1)."""
    prefer_compiled_methods(spark)
    if rows is None:
        rows = spark.range(spec.num_rows)
        row_id = "id"
    return CompiledSpec(spec, rows, row_id)


def generate(
    spark: SparkSession, spec: DatasetSpec, rows: DataFrame | None = None, row_id: str = "id", keep_id: bool = False
) -> DataFrame:
    """The generated table.  With ``rows``, one row per given id (``num_rows`` must equal their number)."""
    return compile_spec(spark, spec, rows, row_id).apply(keep_id=keep_id)


def check_generated(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Findings (kind, column, value): repeats in unique columns, type mismatches, low completeness."""
    expected = {"numeric": "double", "categorical": "string", "text": "string", "id": "string",
                "boolean": "boolean", "datetime": "timestamp_ntz"}
    types = dict(df.dtypes)
    present = [c for c in spec.columns if c.name in types]
    unique = [c.name for c in present if c.unique]
    cells = len(df.columns)
    stats = df.agg(
        F.count("*").alias("n"),
        *[F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    filled = sum((F.col(f"c{i}") for i in range(cells)), F.lit(0))
    completeness = filled / F.nullif(F.col("n") * cells, F.lit(0))
    found = stats.select(
        F.lit("low_completeness").alias("kind"), F.lit("*").alias("column"), completeness.alias("value")
    ).where(F.col("value") < spec.completeness_level - 0.05)
    for c in unique:
        col = F.col(quoted(c))
        repeats = df.groupBy(col.alias("v")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).cast("double").alias("value"))
        found = found.unionByName(
            repeats.select(F.lit("duplicates").alias("kind"), F.lit(c).alias("column"), "value").where("value > 0")
        )
    wrong = [c.name for c in present if types[c.name] != expected[c.data_type]]
    for c in wrong:
        found = found.unionByName(
            stats.select(F.lit("type_mismatch").alias("kind"), F.lit(c).alias("column"), F.lit(1.0).alias("value"))
        )
    return found


def tabular_random(rows: DataFrame, row_id: str = "id", num_columns: int = 3, seed: int = 42) -> DataFrame:
    """id 1..n, then by column index mod 3 a whole number 1..100, one of four words, a 3-decimal uniform."""
    # The four words.
    words = ["alpha", "beta", "gamma", "delta"]
    rid = F.col(quoted(row_id))
    columns = [(rid.cast("long") + 1).alias("id")]
    for j in range(num_columns - 1):
        u = Draws(seed, f"col_{j + 1}", rid).unit("x")
        if j % 3 == 0:
            value = (F.lit(1) + F.floor(u * 100.0)).cast("int")
        elif j % 3 == 1:
            value = F.get(F.lit(words), F.floor(u * 4.0).cast("int"))
        else:
            value = F.round(u, 3)
        columns.append(value.alias(f"col_{j + 1}"))
    return rows.select(*columns)


def generate_many(spark: SparkSession, specs: dict[str, DatasetSpec], rows: dict[str, DataFrame] | None = None):
    """Named specs to lazy tables; failures are collected by name instead of stopping the rest."""
    tables, errors = {}, {}
    for name, spec in specs.items():
        try:
            tables[name] = generate(spark, spec, (rows or {}).get(name))
        except Exception as problem:  # noqa: BLE001 - reported by name
            errors[name] = str(problem)
    return tables, errors
