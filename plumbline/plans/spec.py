"""Declared table shape: distributions, columns, dataset.  Plain data, JSON-loadable."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from datetime import datetime

DISTRIBUTIONS = ("normal", "uniform", "exponential", "gamma", "beta", "lognormal")
DATA_TYPES = ("numeric", "categorical", "datetime", "text", "boolean", "id")
SEASONS = ("daily", "weekly", "monthly", "yearly")
TRENDS = ("increasing", "decreasing", "cyclical")
# Fixed value: categories of a categorical column that declares none.
DEFAULT_CATEGORIES = ("A", "B", "C", "D", "E")


class SpecError(ValueError):
    """A spec that cannot be generated."""


@dataclass
class Distribution:
    kind: str = "normal"
    parameters: dict[str, float] = field(default_factory=dict)
    min_value: float | None = None
    max_value: float | None = None
    mean: float | None = None
    std: float | None = None
    categories: list[str] | None = None
    weights: list[float] | None = None

    def __post_init__(self):
        if self.kind not in DISTRIBUTIONS:
            raise SpecError(f"unsupported distribution: {self.kind}")

    def category_list(self) -> list[str]:
        return list(self.categories or DEFAULT_CATEGORIES)

    def cumulative_weights(self) -> list[float]:
        cats = self.category_list()
        weights = list(self.weights or [1.0] * len(cats))
        if len(weights) != len(cats):
            raise SpecError("one weight per category is needed")
        total = float(sum(weights))
        running, out = 0.0, []
        for w in weights:
            running += w / total
            out.append(running)
        return out


@dataclass
class ColumnSpec:
    name: str
    data_type: str = "numeric"
    distribution: Distribution = field(default_factory=Distribution)
    nullable: bool = False
    null_probability: float = 0.0
    unique: bool = False
    correlation_with: str | None = None
    correlation_strength: float = 0.0
    text_pattern: str | None = None
    text_length_range: tuple[int, int] = (5, 50)
    text_words: bool = False
    datetime_start: datetime | None = None
    datetime_end: datetime | None = None
    id_prefix: str | None = None
    id_format: str | None = None

    def __post_init__(self):
        if self.data_type not in DATA_TYPES:
            raise SpecError(f"unsupported data type: {self.data_type}")
        if not 0.0 <= self.null_probability <= 1.0:
            raise SpecError("null_probability must lie in [0, 1]")
        if not -1.0 <= self.correlation_strength <= 1.0:
            raise SpecError("correlation_strength must lie in [-1, 1]")


@dataclass
class DatasetSpec:
    columns: list[ColumnSpec]
    num_rows: int = 1000
    consistency_level: float = 0.9
    completeness_level: float = 0.95
    add_outliers: bool = False
    outlier_probability: float = 0.05
    add_noise: bool = False
    noise_level: float = 0.1
    add_temporal_patterns: bool = False
    seasonality: str | None = None
    trend: str | None = None
    business_rules: list[str] = field(default_factory=list)
    lenient_rules: bool = False
    clip_last: bool = False
    seed: int = 42
    as_of: datetime | None = None

    def __post_init__(self):
        if self.num_rows < 1:
            raise SpecError("num_rows must be at least 1")
        names = [c.name for c in self.columns]
        if len(names) != len(set(names)):
            raise SpecError("column names must differ")
        if self.seasonality is not None and self.seasonality not in SEASONS:
            raise SpecError(f"unknown seasonality: {self.seasonality}")
        if self.trend is not None and self.trend not in TRENDS:
            raise SpecError(f"unknown trend: {self.trend}")
        for label in ("consistency_level", "completeness_level", "outlier_probability", "noise_level"):
            if not 0.0 <= getattr(self, label) <= 1.0:
                raise SpecError(f"{label} must lie in [0, 1]")
        seen = {c.name for c in self.columns if c.correlation_with is None}
        for c in self.columns:
            if c.correlation_with is not None:
                if c.correlation_with not in seen:
                    raise SpecError(f"{c.name} correlates with {c.correlation_with}, which is not generated before it")
                seen.add(c.name)

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    def ordered_columns(self) -> list[ColumnSpec]:
        """Independent columns first, correlated ones after, each in declared order."""
        return [c for c in self.columns if c.correlation_with is None] + [
            c for c in self.columns if c.correlation_with is not None
        ]

    def main_datetime(self) -> str | None:
        return next((c.name for c in self.ordered_columns() if c.data_type == "datetime"), None)

    @classmethod
    def from_dict(cls, data: dict) -> "DatasetSpec":
        data = dict(data)
        columns = []
        for raw in data.pop("columns"):
            raw = dict(raw)
            dist = dict(raw.pop("distribution", None) or {})
            for old in ("distribution_type",):
                if old in dist:
                    dist["kind"] = dist.pop(old)
            for key in ("datetime_start", "datetime_end"):
                if isinstance(raw.get(key), str):
                    raw[key] = datetime.fromisoformat(raw[key])
            if "text_length_range" in raw:
                raw["text_length_range"] = tuple(raw["text_length_range"])
            columns.append(ColumnSpec(distribution=Distribution(**dist), **raw))
        if isinstance(data.get("as_of"), str):
            data["as_of"] = datetime.fromisoformat(data["as_of"])
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = set(data) - known
        if unknown:
            raise SpecError(f"unknown settings: {sorted(unknown)}")
        return cls(columns=columns, **data)

    @classmethod
    def from_json(cls, text: str) -> "DatasetSpec":
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), default=str)
