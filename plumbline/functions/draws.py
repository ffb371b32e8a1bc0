"""Random draws as pure functions of a row id.

A draw is the 64-bit ``xxhash64`` of (stream key, row id).  The stream key is a
constant made from (seed, column, draw number), so a value depends only on the
row's id: not on partitioning, task retries or evaluation order.  Everything
stays inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)
GAMMA_TRIES = 8


def stream_key(seed: int, column: str, draw: int | str) -> int:
    digest = hashlib.md5(f"{seed}:{column}:{draw}".encode()).digest()
    return int.from_bytes(digest[:8], "little", signed=True)


class Draws:
    """The stream of draws of one column."""

    def __init__(self, seed: int, column: str, row_id: Column | str):
        self.seed = seed
        self.column = column
        self.row_id = F.col(row_id) if isinstance(row_id, str) else row_id

    def bits(self, draw: int | str) -> Column:
        """Signed 64-bit hash; distinct ids give distinct values within one stream."""
        key = F.lit(stream_key(self.seed, self.column, draw)).cast("long")
        return F.xxhash64(key, self.row_id.cast("long"))

    def unit(self, draw: int | str) -> Column:
        """Uniform double in [0, 1) with 52 random bits."""
        return F.shiftrightunsigned(self.bits(draw), 12).cast("double") / F.lit(TWO_POW_52)

    def uniform(self, draw, low: float, high: float) -> Column:
        return F.lit(float(low)) + self.unit(draw) * F.lit(float(high) - float(low))

    def exponential(self, draw, scale: float = 1.0) -> Column:
        return F.lit(-float(scale)) * F.log(F.lit(1.0) - self.unit(draw))

    def normal(self, draw, mean: float = 0.0, std: float = 1.0) -> Column:
        """Box-Muller from the two draws ``draw``.a and ``draw``.b."""
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.unit(f"{draw}.a")))
        angle = F.cos(F.lit(2.0 * math.pi) * self.unit(f"{draw}.b"))
        return F.lit(float(mean)) + F.lit(float(std)) * radius * angle

    def lognormal(self, draw, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return F.exp(self.normal(draw, mean, sigma))

    def gamma(self, draw, shape: float, scale: float = 1.0) -> Column:
        """Exact sum of exponentials (and half a squared normal) when 2*shape is a small
        whole number, otherwise Marsaglia-Tsang rejection with a fixed number of tries."""
        if shape <= 0:
            raise ValueError("gamma shape must be positive")
        halves = shape * 2
        if halves == int(halves) and halves <= 32:
            whole, odd = divmod(int(halves), 2)
            parts = [self.exponential(f"{draw}.e{i}") for i in range(whole)]
            if odd:
                z = self.normal(f"{draw}.z")
                parts.append(z * z / F.lit(2.0))
            total = parts[0]
            for part in parts[1:]:
                total = total + part
            return F.lit(float(scale)) * total
        boosted = shape + 1.0 if shape < 1.0 else shape
        d = boosted - 1.0 / 3.0
        c = 1.0 / math.sqrt(9.0 * d)

        def accepted(z: Column, u: Column) -> Column:
            base = F.lit(1.0) + F.lit(c) * z
            v = F.when(base > 0, base * base * base)
            bound = z * z / 2.0 + F.lit(d) - F.lit(d) * v + F.lit(d) * F.log(v)
            return F.when(F.log(F.lit(1.0) - u) < bound, F.lit(d) * v)

        # a one-element zip binds z and u once; later tries are only evaluated after a rejection
        tries = [
            F.get(F.zip_with(F.array(self.normal(f"{draw}.t{i}")), F.array(self.unit(f"{draw}.u{i}")), accepted), F.lit(0))
            for i in range(GAMMA_TRIES)
        ]
        value = F.coalesce(*tries, F.lit(d))
        if shape < 1.0:
            value = value * F.pow(F.lit(1.0) - self.unit(f"{draw}.p"), F.lit(1.0 / shape))
        return F.lit(float(scale)) * value

    def beta(self, draw, alpha: float, beta: float) -> Column:
        a = self.gamma(f"{draw}.ga", alpha)
        b = self.gamma(f"{draw}.gb", beta)
        return a / (a + b)
