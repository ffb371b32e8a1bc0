"""The draws of ``plumbline.functions.draws`` written as SQL over unsigned integers, for the SQL twins.

``xxhash64`` of (constant key, id) with Spark's seed 42, from its published definition.
"""

from __future__ import annotations

import math

import xxhash

from plumbline.functions.draws import GAMMA_TRIES, stream_key

# The multipliers of the published 64-bit xxHash.
P1, P2, P3, P4, P5 = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
M = 1 << 64


def _mul(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {M}::UHUGEINT)::UBIGINT"


def _let(value: str, body: str) -> str:
    return f"list_transform([{value}], lambda v: {body})[1]"


def _rotl(v: str, r: int) -> str:
    return f"({_mul(v, 1 << r)} | ({v} >> {64 - r}))"


def hash_sql(seed: int, column: str, draw: str | int, row_id: str) -> str:
    """Unsigned 64-bit hash of the id within one stream."""
    key = stream_key(seed, column, draw)
    start = xxhash.xxh64_intdigest((key % M).to_bytes(8, "little"), seed=42)
    begin = (start + P5 + 8) % M
    h = _let(_mul(f"({row_id})::UBIGINT", P2), f"xor({begin}::UBIGINT, {_mul(_rotl('v', 31), P1)})")
    h = _let(h, f"(({_mul(_rotl('v', 27), P1)}::UHUGEINT + {P4}::UHUGEINT) % {M}::UHUGEINT)::UBIGINT")
    h = _let(h, _mul("xor(v, v >> 33)", P2))
    h = _let(h, _mul("xor(v, v >> 29)", P3))
    return _let(h, "xor(v, v >> 32)")


def signed_order_sql(seed, column, draw, row_id) -> str:
    """A key that sorts like the signed value of the hash."""
    return f"xor({hash_sql(seed, column, draw, row_id)}, {1 << 63}::UBIGINT)"


class SqlDraws:
    """SQL text of each draw of a column."""

    def __init__(self, seed: int, column: str, row_id: str):
        self.seed, self.column, self.row_id = seed, column, row_id

    def unit(self, draw) -> str:
        return f"(({hash_sql(self.seed, self.column, draw, self.row_id)} >> 12)::DOUBLE / 4503599627370496.0::DOUBLE)"

    def uniform(self, draw, low, high) -> str:
        return f"({float(low)!r}::DOUBLE + {self.unit(draw)} * {float(high) - float(low)!r}::DOUBLE)"

    def exponential(self, draw, scale=1.0) -> str:
        return f"({-float(scale)!r}::DOUBLE * ln(1.0::DOUBLE - {self.unit(draw)}))"

    def normal(self, draw, mean=0.0, std=1.0) -> str:
        radius = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {self.unit(f'{draw}.a')}))"
        return f"({float(mean)!r}::DOUBLE + {float(std)!r}::DOUBLE * {radius} * cos({2 * math.pi!r}::DOUBLE * {self.unit(f'{draw}.b')}))"

    def lognormal(self, draw, mean=0.0, sigma=1.0) -> str:
        return f"exp({self.normal(draw, mean, sigma)})"

    def gamma(self, draw, shape, scale=1.0) -> str:
        halves = shape * 2
        if halves == int(halves) and halves <= 32:
            whole, odd = divmod(int(halves), 2)
            parts = [self.exponential(f"{draw}.e{i}") for i in range(whole)]
            if odd:
                parts.append(f"pow({self.normal(f'{draw}.z')}, 2) / 2.0")
            return f"({float(scale)!r}::DOUBLE * ({' + '.join(parts)}))"
        boosted = shape + 1.0 if shape < 1.0 else shape
        d = boosted - 1.0 / 3.0
        c = 1.0 / math.sqrt(9.0 * d)
        tries = []
        for i in range(GAMMA_TRIES):
            z, u = self.normal(f"{draw}.t{i}"), self.unit(f"{draw}.u{i}")
            tries.append(
                f"list_transform([[{z}, {u}]], lambda w: list_transform([pow(1.0 + {c!r}::DOUBLE * w[1], 3)], lambda v: "
                f"CASE WHEN v > 0 THEN CASE WHEN ln(1.0 - w[2]) < w[1] * w[1] / 2.0 + {d!r} - {d!r} * v + {d!r} * ln(v) THEN {d!r}::DOUBLE * v END END)[1])[1]"
            )
        value = f"coalesce({', '.join(tries)}, {d!r}::DOUBLE)"
        if shape < 1.0:
            value = f"{value} * pow(1.0 - {self.unit(f'{draw}.p')}, {1.0 / shape!r}::DOUBLE)"
        return f"({float(scale)!r}::DOUBLE * {value})"

    def beta(self, draw, alpha, beta) -> str:
        return _let(f"[{self.gamma(f'{draw}.ga', alpha)}, {self.gamma(f'{draw}.gb', beta)}]", "v[1] / (v[1] + v[2])")
