"""Time bins: aggregates per bin with empty bins kept, upsampling with fills, frequency conversion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import statistics as S
from lumenframe.functions.dates import UNITS, from_micros, micros
from lumenframe.operators.windowing import fill, interpolate

_MONTHS = {"M": 1, "MS": 1, "ME": 1, "Q": 3, "QS": 3, "QE": 3, "Y": 12, "YS": 12, "YE": 12}


def _rule(rule: str) -> tuple[int, str]:
    n, unit = re.fullmatch(r"(\d*)(\w+)", rule).groups()
    return int(n or 1), unit


def bin_start(c: Column, rule: str, closed: str = "left", offset: int = 0) -> Column:
    """Start of the bin that holds the time. Fixed lengths count from 1970 plus `offset` microseconds; weeks begin on Monday."""
    n, unit = _rule(rule)
    if unit in _MONTHS:
        k = n * _MONTHS[unit]
        months = F.floor(((F.year(c) - 1970) * 12 + F.month(c) - 1) / k) * k
        return F.make_date(F.lit(1970) + F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    step = n * (7 * UNITS["D"] if unit == "W" else UNITS[{"H": "h", "T": "min", "S": "s"}.get(unit, unit)])
    shift = offset + (4 * UNITS["D"] if unit == "W" else 0)
    us = micros(c) - shift
    if closed == "right":
        us = us - 1
    return from_micros(us - F.pmod(us, F.lit(step)) + shift)


def bin_end(start: Column, rule: str) -> Column:
    n, unit = _rule(rule)
    if unit in _MONTHS:
        return start + F.make_ym_interval(F.lit(0), F.lit(n * _MONTHS[unit]))
    return from_micros(micros(start) + n * (7 * UNITS["D"] if unit == "W" else UNITS[{"H": "h", "T": "min", "S": "s"}.get(unit, unit)]))


def calendar(df: DataFrame, column: str, rule: str, by: Sequence[str] = ()) -> DataFrame:
    """All bins between the first and the last one (of each group), made on the executors."""
    n, unit = _rule(rule)
    span = df.groupBy(*by).agg(F.min(column).alias("__a"), F.max(column).alias("__b")) if by else df.agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    span = span.filter("__a is not null")
    if unit in _MONTHS:
        k = n * _MONTHS[unit]
        steps = F.sequence(F.lit(0), F.floor(F.months_between("__b", "__a") / k).cast("int"))
        return span.select(*by, F.explode(steps).alias("__i"), "__a").select(*by, (F.col("__a") + F.make_ym_interval(F.lit(0), (F.col("__i") * k).cast("int"))).alias(column))
    step = n * (7 * UNITS["D"] if unit == "W" else UNITS[{"H": "h", "T": "min", "S": "s"}.get(unit, unit)])
    return span.select(*by, F.explode(F.sequence(micros(F.col("__a")), micros(F.col("__b")), F.lit(step))).alias("__i")).select(*by, from_micros(F.col("__i")).alias(column))


#: What an empty bin has: sums and counts of nothing are 0, products 1, all else is missing.
_EMPTY = {"sum": 0, "count": 0, "size": 0, "nunique": 0, "prod": 1.0, "null_count": 0}


def resample(df: DataFrame, rule: str, on: str, aggs: dict[str, tuple], by: Sequence[str] = (), closed: str = "left", label: str = "left", offset: int = 0, order: str | None = None, empty: bool = True, name: str | None = None) -> DataFrame:
    """Aggregates of each time bin: {name: (column, aggregate[, options])}; one partial-and-final pass, then empty bins join in.

    first, last and ohlc parts go by `on` (and `order` for ties). `label` names a bin by its start or its end.
    """
    name = name or on
    bin_ = bin_start(F.col(f"`{on}`"), rule, closed, offset)
    place = F.struct(on, order) if order else F.col(f"`{on}`")
    made = []
    for n, (column, how, *more) in aggs.items():
        c = F.col(f"`{column}`") if column else F.lit(1)
        value = getattr(S, how)(c, place) if how in ("first", "last") else S.aggregate(how, c, **(more[0] if more else {}))
        made.append(value.alias(n))
    out = df.filter(F.col(f"`{on}`").isNotNull()).withColumn("__bin", bin_).groupBy(*by, "__bin").agg(*made)
    if empty:
        out = calendar(out, "__bin", rule, by).join(out, [*by, "__bin"], "left")
        out = out.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(_EMPTY[x[1]])) for n, x in aggs.items() if x[1] in _EMPTY})
    shown = F.col("__bin") if label == "left" else bin_end(F.col("__bin"), rule)
    return out.select(*by, shown.alias(name), *[f"`{n}`" for n in aggs])


def ohlc(df: DataFrame, rule: str, on: str, column: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    return resample(df, rule, on, {"open": (column, "first"), "high": (column, "max"), "low": (column, "min"), "close": (column, "last")}, by, order=order)


def upsample(df: DataFrame, rule: str, on: str, columns: Sequence[str], method: str | None = None, by: Sequence[str] = (), limit: int | None = None, fill_value: object = None) -> DataFrame:
    """Rows at every step of the rule from the first to the last time (asfreq), gaps filled by ffill, bfill, nearest or linear."""
    rows = df.select(*by, on, *columns)
    steps = calendar(rows.withColumn(on, bin_start(F.col(on), rule)), on, rule, by)
    if method in (None, "linear"):
        wide = steps.join(rows, [*by, on], "left")
        if method == "linear":
            for c in columns:
                wide = interpolate(wide, [on], c, by)
            return wide
        return wide.fillna(fill_value, list(columns)) if fill_value is not None else wide
    if method == "nearest":
        from lumenframe.operators.joining import merge_asof

        return merge_asof(steps, rows, on=on, by=list(by) or None, direction="nearest")
    wide = steps.join(rows.withColumn("__own", F.lit(True)), [*by, on], "left")
    return fill(wide, [on], columns, method, limit, by).drop("__own")


def transform(df: DataFrame, rule: str, on: str, how: str, columns: dict[str, str]) -> DataFrame:
    """The bin's aggregate beside each of its rows."""
    from lumenframe.operators.grouping import Groups

    return Groups(df.withColumn("__bin", bin_start(F.col(on), rule)), ["__bin"]).transform(how, columns).drop("__bin")


def get_group(df: DataFrame, rule: str, on: str, start: str) -> DataFrame:
    return df.filter(bin_start(F.col(on), rule) == F.lit(start).cast("timestamp_ntz"))


def groups(df: DataFrame, rule: str, on: str, label: str) -> DataFrame:
    return df.groupBy(bin_start(F.col(on), rule).alias(on)).agg(F.sort_array(F.collect_list(label)).alias("labels"))
