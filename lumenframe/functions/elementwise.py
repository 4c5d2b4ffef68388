"""Element-wise arithmetic, comparison, logic, mathematics and missing values, as expressions that stay in generated code.

Every function takes and gives a Column. A missing value is NULL: frames turn NaN into NULL when they are built, and what would
be NaN comes out as NULL. Arithmetic with a missing operand is missing, unless a fill value stands in for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int | float | str | bool | None


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _filled(a: Value, b: Value, fill: Value) -> tuple[Column, Column]:
    """Both operands; a fill value stands in for one that is missing, not for both."""
    a, b = col(a), col(b)
    if fill is None:
        return a, b
    return F.when(a.isNull() & b.isNotNull(), col(fill)).otherwise(a), F.when(b.isNull() & a.isNotNull(), col(fill)).otherwise(b)


def add(a: Value, b: Value, fill: Value = None) -> Column:
    a, b = _filled(a, b, fill)
    return a + b


def sub(a: Value, b: Value, fill: Value = None) -> Column:
    a, b = _filled(a, b, fill)
    return a - b


def mul(a: Value, b: Value, fill: Value = None) -> Column:
    a, b = _filled(a, b, fill)
    return a * b


def truediv(a: Value, b: Value, fill: Value = None) -> Column:
    """IEEE division: x / 0 is infinite with the sign of x, 0 / 0 is missing."""
    a, b = _filled(a, b, fill)
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when((b == 0) & (a != 0), F.signum(a) * F.lit(math.inf))


def floordiv(a: Value, b: Value, fill: Value = None) -> Column:
    """Floor of the quotient, a double; a zero divisor gives what true division gives."""
    a, b = _filled(a, b, fill)
    a, b = a.cast("double"), b.cast("double")
    q = a / b
    # a quotient that is zero keeps its sign, one past 2^52 has no fraction and need not fit a bigint
    down = F.when((q == 0) | ~(F.abs(q) < 1 << 52), q).otherwise(F.floor(q).cast("double"))
    return F.when(b != 0, down).when((b == 0) & (a != 0), F.signum(a) * F.lit(math.inf))


def mod(a: Value, b: Value, fill: Value = None) -> Column:
    """Remainder with the sign of the divisor; missing for a zero divisor."""
    a, b = _filled(a, b, fill)
    rest = F.when(b != 0, a % b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def power(a: Value, b: Value, fill: Value = None) -> Column:
    a, b = _filled(a, b, fill)
    return F.pow(a.cast("double"), b.cast("double"))


def swapped(f: Callable[..., Column]) -> Callable[..., Column]:
    """The form with the operands the other way round."""

    def reverse(a: Value, b: Value, fill: Value = None) -> Column:
        return f(b, a, fill)

    return reverse


radd, rsub, rmul, rtruediv, rfloordiv, rmod, rpow = map(swapped, (add, sub, mul, truediv, floordiv, mod, power))


def divmod_(a: Value, b: Value) -> tuple[Column, Column]:
    return floordiv(a, b), mod(a, b)


def rdivmod(a: Value, b: Value) -> tuple[Column, Column]:
    return divmod_(b, a)


def _compared(f: Callable[[Column, Column], Column], missing: bool = False) -> Callable[[Value, Value], Column]:
    def compare(a: Value, b: Value) -> Column:
        return F.coalesce(f(col(a), col(b)), F.lit(missing))

    return compare


eq = _compared(lambda a, b: a == b)
ne = _compared(lambda a, b: a != b, True)
lt = _compared(lambda a, b: a < b)
le = _compared(lambda a, b: a <= b)
gt = _compared(lambda a, b: a > b)
ge = _compared(lambda a, b: a >= b)


def eq_missing(a: Value, b: Value) -> Column:
    return col(a).eqNullSafe(col(b))


def ne_missing(a: Value, b: Value) -> Column:
    return ~eq_missing(a, b)


def logical_and(a: Value, b: Value) -> Column:
    return F.coalesce(col(a), F.lit(False)) & F.coalesce(col(b), F.lit(False))


def logical_or(a: Value, b: Value) -> Column:
    return F.coalesce(col(a), F.lit(False)) | F.coalesce(col(b), F.lit(False))


def logical_xor(a: Value, b: Value) -> Column:
    return F.coalesce(col(a), F.lit(False)) != F.coalesce(col(b), F.lit(False))


def logical_not(a: Value) -> Column:
    return ~F.coalesce(col(a), F.lit(False))


def bit_and(a: Value, b: Value) -> Column:
    return col(a).bitwiseAND(col(b))


def bit_or(a: Value, b: Value) -> Column:
    return col(a).bitwiseOR(col(b))


def bit_xor(a: Value, b: Value) -> Column:
    return col(a).bitwiseXOR(col(b))


def invert_bits(a: Value) -> Column:
    return F.bitwise_not(col(a))


absolute, negative, conj = F.abs, F.negative, lambda c: c
sqrt, exp, tanh, sinh, cosh, tan, sin, cos, cot = F.sqrt, F.exp, F.tanh, F.sinh, F.cosh, F.tan, F.sin, F.cos, F.cot
arcsin, arccos, arctan, arcsinh, arccosh, arctanh = F.asin, F.acos, F.atan, F.asinh, F.acosh, F.atanh
cbrt, sign, log10, log1p = F.cbrt, F.signum, F.log10, F.log1p
ceil = lambda c: F.ceil(c).cast("double")
floor = lambda c: F.floor(c).cast("double")


def log(c: Column, base: float | None = None) -> Column:
    return F.log(c) if base is None else F.log(c) / F.lit(math.log(base))


def round_(c: Column, decimals: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, decimals)


def round_sig_figs(c: Column, digits: int) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def clip(c: Column, lower: Value = None, upper: Value = None) -> Column:
    """Missing bounds bound nothing; a missing value stays missing."""
    out = c
    if lower is not None:
        out = F.greatest(out, col(lower))
    if upper is not None:
        out = F.least(out, col(upper))
    return F.when(c.isNotNull(), out)


def isna(c: Column) -> Column:
    return c.isNull()


def notna(c: Column) -> Column:
    return c.isNotNull()


def isfinite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False))


def isinf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == math.inf, F.lit(False))


def isposinf(c: Column) -> Column:
    return F.coalesce(c == math.inf, F.lit(False))


def isneginf(c: Column) -> Column:
    return F.coalesce(c == -math.inf, F.lit(False))


def isnan(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def iscomplex(c: Column) -> Column:
    return F.lit(False)


def isreal(c: Column) -> Column:
    return F.lit(True)


def fillna(c: Column, value: Value) -> Column:
    return F.coalesce(c, col(value))


def where(c: Column, condition: Column, other: Value = None) -> Column:
    """`c` where the condition holds (a missing condition does not), else `other`."""
    return F.when(F.coalesce(condition, F.lit(False)), c).otherwise(col(other))


def mask(c: Column, condition: Column, other: Value = None) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), col(other)).otherwise(c)


def case_when(c: Column, cases: Sequence[tuple[Column, Value]]) -> Column:
    """The value of the first condition that holds, else `c`."""
    out = None
    for condition, value in cases:
        out = F.when(condition, col(value)) if out is None else out.when(condition, col(value))
    return c if out is None else out.otherwise(c)


def isin(c: Column, values: Sequence) -> Column:
    """Membership; a missing value is a member where the values hold a missing one."""
    given = [v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v))]
    inside = F.coalesce(c.isin(given), F.lit(False)) if given else F.lit(False)
    return inside | c.isNull() if len(given) < len(values) else inside


def between(c: Column, left: Value, right: Value, inclusive: str = "both") -> Column:
    low = c >= col(left) if inclusive in ("both", "left") else c > col(left)
    high = c <= col(right) if inclusive in ("both", "right") else c < col(right)
    return F.coalesce(low & high, F.lit(False))


def replace(c: Column, values: Mapping) -> Column:
    """Each key by its value; a key None stands for missing values."""
    out = None
    for old, new in values.items():
        test = c.isNull() if old is None else c == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    return c if out is None else out.otherwise(c)


def replace_strict(c: Column, values: Mapping) -> Column:
    """As replace, but a value that is no key becomes missing."""
    return map_values(c, values)


def map_values(c: Column, values: Mapping) -> Column:
    """Look-up; what is no key becomes missing."""
    out = None
    for old, new in values.items():
        test = c.isNull() if old is None else c == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    return F.lit(None) if out is None else out


def replace_regex(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def to_numeric(c: Column, errors: str = "raise", downcast: str | None = None) -> Column:
    kind = {"integer": "bigint", "signed": "bigint", "unsigned": "bigint", "float": "float"}.get(downcast or "", "double")
    return c.try_cast(kind) if errors == "coerce" else c.cast(kind)


_UNITS = {"D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def to_datetime(c: Column, fmt: str | None = None, unit: str | None = None, origin: str = "1970-01-01", errors: str = "raise") -> Column:
    """Parsed text, or numbers of a unit since `origin`. `fmt` is a strftime pattern."""
    if unit:
        return F.timestamp_micros((c * _UNITS[unit]).cast("bigint") + F.unix_micros(F.lit(origin).cast("timestamp"))).cast("timestamp_ntz")
    if fmt:
        from lumenframe.functions.dates import java_pattern

        return F.try_to_timestamp(c, F.lit(java_pattern(fmt))).cast("timestamp_ntz") if errors == "coerce" else F.to_timestamp_ntz(c, F.lit(java_pattern(fmt)))
    return c.try_cast("timestamp_ntz") if errors == "coerce" else c.cast("timestamp_ntz")


def to_timedelta(c: Column, unit: str = "s") -> Column:
    return F.make_dt_interval(secs=(c * (_UNITS[unit] / 1e6)).cast("decimal(18,6)"))


def cut(c: Column, edges: Sequence[float], labels: Sequence | None = None, right: bool = True, include_lowest: bool = False) -> Column:
    """The bin of each value; without labels `(a, b]`. A value outside the edges has none."""
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        low = c > a if right and not (include_lowest and k == 0) else c >= a
        high = c <= b if right else c < b
        shown = labels[k] if labels is not None else (f"({a}, {b}]" if right else f"[{a}, {b})")
        out = F.when(low & high, F.lit(shown)) if out is None else out.when(low & high, F.lit(shown))
    return F.lit(None) if out is None else out


def horizontal(cols: Sequence[Column], how: str) -> Column:
    """max, min, sum, mean, count, any, all, first over the columns of a row; missing values are passed over."""
    cols = list(cols)
    counted = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    if how in ("max", "min"):
        return cols[0] if len(cols) == 1 else (F.greatest if how == "max" else F.least)(*cols)
    if how == "any":
        return sum((F.coalesce(c.cast("boolean"), F.lit(False)).cast("int") for c in cols), F.lit(0)) > 0
    if how == "all":
        return sum((F.coalesce(c.cast("boolean"), F.lit(True)).cast("int") for c in cols), F.lit(0)) == len(cols)
    if how == "count":
        return counted.cast("bigint")
    if how == "first":
        return F.coalesce(*cols)
    total = sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0))
    return total if how == "sum" else F.when(counted > 0, total / counted)
