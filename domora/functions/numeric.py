"""Numbers: safe casts, relative differences and bins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


_TYPED = re.compile(r"(tinyint|smallint|int|bigint|float|double|decimal\(.*\))")


def plain(c: Column, kind: str = "string") -> Column:
    """A double, finite or not, or null; words and suffixes such as 5d are null. kind: the column's type."""
    if _TYPED.fullmatch(kind):
        return c.cast("double")
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def number(c: Column, kind: str = "string") -> Column:
    """A finite double or null; what is no number, NaN and infinities are null. kind: the column's type."""
    value = plain(c, kind)
    # NaN is above all numbers here
    return F.when(F.abs(value) < float("inf"), value)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed, left-open bins; a value outside of them is null."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        hit = (c > lo) & (c <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def round_to(c: Column, digits: int) -> Column:
    """Rounded half up; values a rounding error below a half count as halves, so that engines agree."""
    return F.floor(c * 10**digits + 0.500000001) / 10**digits
