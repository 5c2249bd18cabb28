"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-12


def finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def number(c: Column) -> Column:
    """The value as a double; null where it is none, or NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def or_zero(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def clip(c: Column, lo, hi) -> Column:
    """Lower bound first, upper bound last."""
    return F.least(F.greatest(c, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def average_rank(keys: Sequence[str], value: str, ascending: bool = True) -> Column:
    """Rank in which ties share their mean position."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    return rank + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def interval_label(value: Column, bounds: Sequence[float]) -> tuple[Column, Column]:
    """Label and order of the bin: up to the first bound, then open below and closed above, then beyond the last."""
    show = lambda b: str(int(b)) if float(b).is_integer() else f"{b:g}"
    names = [f"0-{show(bounds[0])}", *(f">{show(a)}-{show(b)}" for a, b in zip(bounds, bounds[1:])), f">{show(bounds[-1])}"]
    label, order = F.lit(names[-1]), F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        label, order = F.when(value <= bounds[k], F.lit(names[k])).otherwise(label), F.when(value <= bounds[k], F.lit(k)).otherwise(order)
    return label, order


def tail_size(fraction: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n))


def uniform_index(draw: Column, slot: Column, n: Column) -> Column:
    """An index below ``n`` that follows from draw and slot alone, the same in any engine with MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", draw.cast("string"), slot.cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), n.cast("bigint"))
