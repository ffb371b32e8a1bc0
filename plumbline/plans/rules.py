"""Business rules of the form ``if COLUMN > NUMBER then TARGET = VALUE``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.spec import SpecError
from plumbline.session import quoted

# Texts that mean true for a boolean target.
TRUE_WORDS = ("true", "1", "yes", "on")

_RULE = re.compile(r"^\s*if\s+([^<>=]+?)\s*>\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+then\s+([^<>=]+?)\s*=\s*(.+?)\s*$")


@dataclass
class Rule:
    source: str
    threshold: float
    target: str
    value: str


def parse_rule(text: str) -> Rule | None:
    match = _RULE.match(text)
    if not match:
        return None
    source, threshold, target, value = match.groups()
    return Rule(source, float(threshold), target, value.strip("'\""))


def apply_rules(df: DataFrame, rules: list[str], lenient: bool = False) -> DataFrame:
    """Apply rules in order; a later rule sees what earlier ones wrote.  Values are cast to the target's type."""
    types = dict(df.dtypes)
    for text in rules:
        rule = parse_rule(text)
        if rule is None or rule.source not in types or rule.target not in types:
            if lenient:
                continue
            raise SpecError(f"unsupported rule: {text}")
        if types[rule.target] == "boolean":
            new: Column = F.lit(rule.value.lower() in TRUE_WORDS)
        else:
            new = F.lit(rule.value).cast(types[rule.target])
        hit = F.col(quoted(rule.source)) > F.lit(rule.threshold)
        df = df.withColumn(rule.target, F.when(hit, new).otherwise(F.col(quoted(rule.target))))
    return df
