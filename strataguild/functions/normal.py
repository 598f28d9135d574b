"""Tail of the standard normal distribution as a plain expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximation of the normal tail (Hart 1968,
# West 2005), highest power first.
NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
FAR = 7.07106781186547
SQRT_2PI = 2.506628274631


def _poly(z: Column, coef: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * z + F.lit(c), coef[1:], F.lit(coef[0]))


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    e = F.exp(-z * z / 2.0)
    near = e * _poly(z, NUMERATOR) / _poly(z, DENOMINATOR)
    far = e / (z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))) / SQRT_2PI
    return F.when(z < FAR, near).otherwise(far)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * upper_tail(F.abs(z)))
