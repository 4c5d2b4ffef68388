"""Aggregates by name, with missing values passed over, corrected skewness and kurtosis, and sums of nothing being 0.

`aggregate(name, column)` gives an expression that serves whole tables, groups, sliding frames and time bins alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.coalesce(F.when(F.var_pop(c) > 0, F.skewness(c)), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurt(c: Column) -> Column:
    """Excess kurtosis without bias; 0 where all values are equal."""
    n = F.count(c).cast("double")
    body = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.when(F.var_pop(c) > 0, F.kurtosis(c)) + 6)
    return F.when(n > 3, F.coalesce(body, F.lit(0.0)))


def var(c: Column, ddof: int = 1) -> Column:
    if ddof == 1:
        return F.var_samp(c)
    if ddof == 0:
        return F.var_pop(c)
    n = F.count(c).cast("double")
    return F.var_pop(c) * n / F.when(n > ddof, n - ddof)


def std(c: Column, ddof: int = 1) -> Column:
    return F.sqrt(var(c, ddof))


def sem(c: Column, ddof: int = 1) -> Column:
    n = F.count(c)
    return std(c, ddof) / F.sqrt(F.when(n > 0, n))


def total(c: Column, min_count: int = 0) -> Column:
    s = F.coalesce(F.sum(c), F.lit(0))
    return s if min_count <= 0 else F.when(F.count(c) >= min_count, s)


def prod(c: Column, min_count: int = 0) -> Column:
    s = F.coalesce(F.product(c), F.lit(1.0))
    return s if min_count <= 0 else F.when(F.count(c) >= min_count, s)


def quantile(c: Column, q: float = 0.5, interpolation: str = "linear") -> Column:
    """Exact quantile. Other interpolations than the linear one gather a group's values, so they are for groups that fit a task."""
    if interpolation == "linear":
        return F.percentile(c, F.lit(float(q)))
    v = F.sort_array(F.collect_list(c))
    at = (F.size(v) - 1) * F.lit(float(q))
    low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
    if interpolation == "nearest":
        return F.get(v, F.rint(at).cast("int"))
    return {"lower": low, "higher": high, "midpoint": (low + high) / 2}[interpolation]


def nunique(c: Column, dropna: bool = True) -> Column:
    n = F.count_distinct(c)
    return n if dropna else n + F.max(F.when(c.isNull(), 1).otherwise(0))


def any_(c: Column) -> Column:
    return F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False))


def all_(c: Column) -> Column:
    return F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": total, "prod": prod, "product": prod, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "any": any_, "all": all_, "median": lambda c: F.percentile(c, F.lit(0.5)),
    "var": var, "std": std, "sem": sem, "skew": skew, "kurt": kurt, "kurtosis": kurt, "nunique": nunique, "quantile": quantile, "null_count": lambda c: F.count_if(c.isNull()), "size": lambda c: F.count(F.lit(1)),
    "mode": lambda c: F.mode(c, True), "approx_nunique": F.approx_count_distinct, "list": F.collect_list, "unique": F.collect_set, "norm": lambda c: F.sqrt(F.sum(c * c)),
}


def aggregate(name: str, c: Column, **options: object) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"no aggregate is called {name!r}; there are {', '.join(sorted(AGGREGATES))}")
    return AGGREGATES[name](c, **options)


def first(c: Column, order: Column) -> Column:
    """First value that is not missing in the order."""
    return F.min_by(c, F.when(c.isNotNull(), order))


def last(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


def arg_extreme(label: Column, c: Column, order: Column, largest: bool = True) -> Column:
    """Label of the largest or smallest value; of equal ones, the first in the order."""
    if largest:
        return F.max_by(label, F.when(c.isNotNull(), F.struct(c, -order)))
    return F.min_by(label, F.when(c.isNotNull(), F.struct(c, order)))


def covar(a: Column, b: Column, ddof: int = 1) -> Column:
    if ddof == 1:
        return F.covar_samp(a, b)
    both = a.isNotNull() & b.isNotNull()
    n = F.count_if(both).cast("double")
    return F.covar_pop(a, b) if ddof == 0 else F.covar_pop(a, b) * n / F.when(n > ddof, n - ddof)


def corr(a: Column, b: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Pearson's correlation of the rows where both are there; missing where one of them does not vary, for which Spark's own
    aggregate divides by zero. `over` puts each of its parts into a frame.

    Whether a column varies is read from its extremes: where parts of equal values are merged, their variance may be a little
    above zero. Sums are taken in the steps and the order of SQL's corr(a, b), so that a frame gives the same bits.
    """
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    p, q = over(F.covar_pop(x, x)), over(F.covar_pop(y, y))
    varies = (over(F.min(x)) < over(F.max(x))) & (over(F.min(y)) < over(F.max(y)))
    return F.when(varies & (p > 0) & (q > 0), over(F.covar_pop(y, x)) / (F.sqrt(p) * F.sqrt(q)))


def entropy(p: Column, base: float = 2.718281828459045) -> Column:
    import math

    return -F.sum(F.when(p > 0, p * F.log(p))) / math.log(base)


#: Aggregates whose whole result follows from those of the parts, so that adaptive plans may combine them map-side.
DECOMPOSABLE = frozenset(("count", "sum", "prod", "min", "max", "any", "all", "mean", "var", "std", "sem", "skew", "kurt", "size"))
