"""Two-sided p-values as Spark expressions.

Neither Student's nor the normal distribution function is a Spark built-in, so both are
Simpson sums over the density. The sum starts at the statistic itself, which keeps tiny
p-values accurate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

STEPS = 2000  # Simpson steps, even
SPAN = 14.0  # standard deviations beyond which a tail adds nothing to a double


def _simpson(low: Column, high: Column, density) -> Column:
    step = (high - low) / F.lit(float(STEPS))

    def term(i):
        weight = (
            F.when((i == 0) | (i == STEPS), F.lit(1.0))
            .when(i % 2 == 1, F.lit(4.0))
            .otherwise(F.lit(2.0))
        )
        return weight * density(low + i * step)

    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + term(i)
    )
    return total * step / F.lit(3.0)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) for `freedom` degrees of freedom."""
    right = F.lit(math.pi / 2)
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    width = F.lit(SPAN) / F.sqrt(freedom)
    # At the right angle the cosine is zero up to rounding, and must not turn negative.
    density = lambda x: F.pow(F.greatest(F.cos(x), F.lit(0.0)), freedom - 1)
    tail = _simpson(angle, F.least(right, angle + width), density)
    whole = _simpson(F.lit(0.0), F.least(right, width), density)
    return F.least(tail / whole, F.lit(1.0))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    start = F.abs(z)
    density = lambda x: F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
    return F.least(F.lit(2.0) * _simpson(start, start + F.lit(SPAN), density), F.lit(1.0))
