"""Functions over list and struct Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_len(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def get(c: Column, i: int) -> Column:
    """Element at a place, from the end if negative; missing beyond the ends."""
    return F.get(c, F.lit(i)) if i >= 0 else F.when(F.size(c) >= -i, F.try_element_at(c, F.lit(i)))


def slice_(c: Column, start: int = 0, stop: int | None = None) -> Column:
    n = F.size(c)
    low = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = n if stop is None else (F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0)))
    return F.when(c.isNotNull(), F.slice(c, low + 1, F.greatest(high - low, F.lit(0))))


def flatten(c: Column) -> Column:
    """One row for each element; see Frame.explode for rows without one."""
    return F.explode(c)


def field(c: Column, name: str) -> Column:
    return c.getField(name)


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two lists of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def parsed(c: Column, schema: str) -> Column:
    """A struct out of JSON text."""
    return F.from_json(c, schema)
