"""Arrays in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements folded at a stretch; the stretches' results are folded after.
STRETCH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step folded over longs: for each its result with all values up to there. step gets null for what is before the first.

    Work is linear but for what lies within a stretch and between stretches: an array grows by copying.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.expr("cast(array() as array<bigint>)"), lambda done, x: F.concat(done, F.array(step(F.try_element_at(done, F.lit(-1)), x))))

    def joined(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: step(F.get(e, i - 1), x))))))

    stretches = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int"))), lambda b: fold(F.slice(v, b * STRETCH + 1, STRETCH)))
    return let(values, lambda v: let(stretches(v), joined))


def sums(values: Column) -> Column:
    return running(values, lambda before, x: F.coalesce(before, F.lit(0).cast("long")) + x)


def maxima(values: Column) -> Column:
    return running(values, lambda before, x: F.greatest(before, x))
