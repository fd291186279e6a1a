"""Code lengths: the universal code of integers, entropies, and their sums over block matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the constant of the universal integer code.
UNIVERSAL = 2.8665064
#: Fixed value: keeps logarithms finite.
TINY = math.exp(-700)


def log_star_column(n: Column) -> Column:
    """Bits of the universal code of n: its positive iterated logarithms, plus the constant's; 0 for n <= 0. Five logarithms reach below 1 for any long."""
    out, x = F.lit(math.log2(UNIVERSAL)), n.cast("double")
    for _ in range(5):
        x = F.when(x > 0, F.log2(x)).otherwise(F.lit(0.0))
        out = out + F.greatest(x, F.lit(0.0))
    return F.when(n > 0, out).otherwise(0.0)


def entropy_bits(p: Column) -> Column:
    return F.when(p > 0, -F.log2(p + F.lit(TINY))).otherwise(0.0)
