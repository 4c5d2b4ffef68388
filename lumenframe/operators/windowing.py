"""Row-wise windows: sliding and expanding frames, exponential weights, running results, shifts, ranks, fills, interpolation.

Groups (`by`) make plain partitioned windows. Over a whole table the work is dealt into ranges of the order (see
plans.ordering), so no operator here needs all rows in one task, but for the ones that say so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from lumenframe.functions import statistics as S
from lumenframe.functions.dates import micros
from lumenframe.functions.elementwise import truediv
from lumenframe.plans.ordering import SCANS, hot, keys, placed, sampled_bounds, scan, sliding

Order = Sequence[str | Column]


def _over(name: str, c: Column, w: WindowSpec, min_periods: int, q: float = 0.5, other: Column | None = None, ddof: int = 1) -> Column:
    """An aggregate over a frame; missing where fewer than min_periods values are there. Parts of composites get the frame each."""
    n = F.count(c).over(w)
    d = n.cast("double")
    if name == "count":
        return F.when(F.count(F.lit(1)).over(w) >= min_periods, n).cast("double")
    if name in ("var", "std", "sem"):
        v = F.var_samp(c).over(w) if ddof == 1 else F.var_pop(c).over(w) * d / F.when(d > ddof, d - ddof)
        value = v if name == "var" else F.sqrt(v) if name == "std" else F.sqrt(v) / F.sqrt(d)
    elif name == "skew":
        flat = F.var_pop(c).over(w) > 0
        value = F.when(n > 2, F.coalesce(F.when(flat, F.skewness(c).over(w)), F.lit(0.0)) * F.sqrt(d * (d - 1)) / F.when(n > 2, d - 2))
    elif name in ("kurt", "kurtosis"):
        flat = F.var_pop(c).over(w) > 0
        value = F.when(n > 3, (d - 1) / F.when(n > 3, (d - 2) * (d - 3)) * ((d + 1) * F.when(flat, F.kurtosis(c).over(w)) + 6))
    elif name in ("median", "quantile"):
        value = F.percentile(c, F.lit(q)).over(w)
    elif name == "corr":
        value = S.corr(c, other, lambda a: a.over(w))
    elif name == "cov":
        value = F.covar_samp(c, other).over(w)
    elif name == "nunique":
        value = F.size(F.collect_set(c).over(w)).cast("double")
    elif name == "rank":
        seen = F.collect_list(c).over(w)
        value = F.when(c.isNotNull(), F.size(F.filter(seen, lambda x: x < c)) + (F.size(F.filter(seen, lambda x: x == c)) + 1) / 2)
    elif name == "first":
        value = F.first(c, ignorenulls=True).over(w)
    elif name == "last":
        value = F.last(c, ignorenulls=True).over(w)
    else:
        value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "prod": F.product}[name](c).over(w)
    if name in ("corr", "cov"):
        n = F.count(F.when(c.isNotNull() & other.isNotNull(), 1)).over(w)
    return F.when(n >= min_periods, value)


def rolling(
    df: DataFrame, order: Order, window: int | str, aggs: dict[str, tuple], by: Sequence[str] = (), min_periods: int | None = None, center: bool = False, closed: str | None = None, on: str | None = None, step: int = 1,
) -> DataFrame:
    """`df` with {name: (aggregate, column[, q or other column])} over a sliding frame of rows or, for a text such as "1h", of time.

    Row frames: `window` rows that end at the row (or are centred on it), min_periods = window by default. Time frames need
    `on`, a timestamp that the order starts with; min_periods = 1; `closed` is right, left, both or neither. `step` keeps
    every step-th row. Sums, counts, means, variances and extremes over time frames take time in proportion to the rows, however
    many are in a frame (see _by_cells). The other aggregates look at each frame's rows: over the whole table, or with hot
    groups, they are dealt by sampled ranges of time that are no shorter than the frame, with its reach as overlap.
    """
    if isinstance(window, str):
        return _rolling_time(df, window, aggs, by, 1 if min_periods is None else min_periods, closed or "right", on or next(c for c in order if isinstance(c, str)))
    least = window if min_periods is None else min_periods
    shift = (window - 1) // 2 if center else 0
    low, high = -(window - 1) + shift, shift
    if closed == "left":
        low, high = low - 1, high - 1
    elif closed == "both":
        low -= 1
    elif closed == "neither":
        high -= 1

    def made(spec: tuple) -> Callable[[WindowSpec], Column]:
        name, c, *more = spec
        extra = {"q": more[0]} if more and isinstance(more[0], float) else {"other": F.col(f"`{more[0]}`")} if more else {}
        return lambda w: _over(name, F.col(f"`{c}`"), w.rowsBetween(low, high), least, **extra)

    out = sliding(df, order, {n: made(x) for n, x in aggs.items()}, max(0, -low), max(0, high), by)
    if step > 1:
        from lumenframe.plans.ordering import POSITION, positions

        out = positions(out, order).filter(F.col(POSITION) % step == 0).drop(POSITION)
    return out


def span_micros(text: str) -> int:
    """Microseconds of "90s", "15min", "1h", "2D"."""
    from lumenframe.functions.dates import UNITS

    digits = "".join(x for x in text if x.isdigit())
    unit = text[len(digits) :]
    return int(digits or 1) * {**UNITS, "d": UNITS["D"], "H": UNITS["h"], "T": UNITS["min"], "S": UNITS["s"], "W": 7 * UNITS["D"]}[unit]


#: Aggregates that two parts of a frame give together, with what must be known of each part.
_PARTS = {"count": (), "sum": ("sum",), "mean": ("sum",), "min": ("min",), "max": ("max",), "prod": ("prod",), "var": ("mean", "square"), "std": ("mean", "square"), "sem": ("mean", "square")}


def _by_cells(df: DataFrame, aggs: dict[str, tuple], groups: Sequence[str], low: int, high: int, least: int) -> DataFrame:
    """`df` with aggregates over the rows from `low` to `high` microseconds off each row's __us.

    Time is cut into cells as long as the frame, so a frame is the end of one cell and the start of the next: two running
    results, one back from the end of a cell and one on from its start, neither of which looks at a row twice. A row asks for
    both at the times where its frame begins and ends, as a guest among the rows of that cell. Nothing is subtracted, so large
    values that have left the frame leave no error behind. The rows of a cell, in a group, are a task's unit.
    """
    span, us = F.lit(high - low + 1).cast("bigint"), F.col("__us")
    cell = lambda t: t - F.pmod(t, span)
    columns = {c: F.col(f"`{c}`") for c in dict.fromkeys(x[1] for x in aggs.values())}
    kinds = {c: {"rows", "count"}.union(*[_PARTS[x[0]] for x in aggs.values() if x[1] == c]) for c in columns}

    def running(w: WindowSpec, tag: str, own: Column | None) -> dict[str, Column]:
        made = {}
        for k, (c, v) in enumerate(columns.items()):
            v = v if own is None else F.when(own, v)
            rows = F.count(F.lit(1) if own is None else F.when(own, 1)).over(w)
            all_of = {"rows": rows, "count": F.count(v).over(w), "sum": F.sum(v).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w)}
            all_of |= {"prod": F.product(v).over(w), "mean": F.avg(v.cast("double")).over(w), "square": F.var_pop(v).over(w) * F.count(v).over(w)}
            made |= {f"__{tag}{k}_{x}": all_of[x] for x in sorted(kinds[c])}
        return made

    def asked(df: DataFrame, at: Column, home: Column, tag: str, back: bool) -> DataFrame:
        """Each row with the running results of the cell `home` up to the time `at`."""
        seat = lambda c, t, asks: F.struct(c.alias("cell"), t.alias("time"), F.lit(asks).alias("asks"))
        seated = df.withColumn("__seat", F.explode(F.array(seat(cell(us), us, False), seat(home, at, True))))
        time = F.col("__seat.time")
        w = Window.partitionBy(*groups, F.col("__seat.cell")).orderBy(time.desc() if back else time).rangeBetween(Window.unboundedPreceding, 0)
        return seated.withColumns(running(w, tag, ~F.col("__seat.asks"))).filter("__seat.asks").drop("__seat")

    end = us + high
    out = asked(df, us + low, cell(end) - span, "a", True)
    if high == 0:
        w = Window.partitionBy(*groups, cell(us)).orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
        out = out.withColumns(running(w, "b", None))
    else:
        out = asked(out, end, cell(end), "b", False)
    made = {}
    for n, (name, c, *_) in aggs.items():
        k = list(columns).index(c)
        # rows without a time are peers of one another, and their frame is all of them
        a, b = (lambda x, k=k: F.when(us.isNotNull(), F.col(f"__a{k}_{x}"))), (lambda x, k=k: F.col(f"__b{k}_{x}"))
        n1, n2 = F.coalesce(a("count"), F.lit(0)), b("count")
        count = n1 + n2
        if name in ("sum", "prod", "min", "max"):
            value = SCANS[name][2](a(name), b(name))
        elif name == "mean":
            value = SCANS["sum"][2](a("sum"), b("sum")) / F.when(count > 0, count)
        else:
            d = count.cast("double")
            off = b("mean") - a("mean")
            square = F.coalesce(a("square") + b("square") + off * off * n1 * n2 / F.when(count > 0, d), a("square"), b("square"))
            v = square / F.when(count > 1, d - 1)
            value = v if name == "var" else F.sqrt(v) if name == "std" else F.sqrt(v) / F.sqrt(d)
        if name == "count":
            made[n] = F.when(F.coalesce(a("rows"), F.lit(0)) + b("rows") >= least, count.cast("double"))
        else:
            made[n] = F.when(count >= least, value)
    return out.withColumns(made).drop(*[f"__{t}{k}_{x}" for t in "ab" for k, c in enumerate(columns) for x in kinds[c]])


def _rolling_time(df: DataFrame, window: str, aggs: dict[str, tuple], by: Sequence[str], least: int, closed: str, on: str) -> DataFrame:
    reach = span_micros(window)
    low = -reach + (0 if closed in ("left", "both") else 1)
    high = -1 if closed in ("left", "neither") else 0
    groups = list(by)
    dealt = df.withColumn("__us", micros(F.col(f"`{on}`")))
    quick = {n: x for n, x in aggs.items() if x[0] in _PARTS} if high - low >= 0 else {}
    if quick:
        dealt = _by_cells(dealt, quick, groups, low, high, least)
    aggs = {n: x for n, x in aggs.items() if n not in quick}
    if not aggs:
        return dealt.drop("__us")
    apart = not groups or hot(df, groups)
    if apart:
        bounds = []
        for x in sampled_bounds(dealt, F.col("__us").cast("double")).tolist():
            if not bounds or x >= bounds[-1] + reach:
                bounds.append(x)
        edges = np.array(bounds)
        home, last = (placed((F.col("__us") + k).cast("double"), edges) for k in (0, reach))
        dealt = dealt.withColumn("__home", home).withColumn("__block", F.explode(F.sequence("__home", last)))
        groups = [*groups, "__block"]
    w = Window.partitionBy(*groups).orderBy("__us").rangeBetween(low, high)
    made = {}
    for n, (name, c, *more) in aggs.items():
        extra = {"q": more[0]} if more and isinstance(more[0], float) else {"other": F.col(f"`{more[0]}`")} if more else {}
        made[n] = _over(name, F.col(f"`{c}`"), w, least, **extra)
    out = dealt.withColumns(made)
    return out.filter("__block = __home").drop("__us", "__home", "__block") if apart else out.drop("__us")


def expanding(df: DataFrame, order: Order, aggs: dict[str, tuple], by: Sequence[str] = (), min_periods: int = 1) -> DataFrame:
    """Aggregates over all rows so far. Over a whole table they are scans over ranges; quantiles and ranks need `by`, as they
    must hold what they have seen."""
    moments = {"var": 2, "std": 2, "sem": 2, "skew": 3, "kurt": 4}
    plain = {"sum", "mean", "min", "max", "count", "prod", "cov", "corr", *moments}
    if by:
        w = Window.partitionBy(*by).orderBy(*keys(order)).rowsBetween(Window.unboundedPreceding, 0)
        made = {}
        for n, (name, c, *more) in aggs.items():
            extra = {"q": more[0]} if more and isinstance(more[0], float) else {"other": F.col(f"`{more[0]}`")} if more else {}
            made[n] = _over(name, F.col(f"`{c}`"), w, min_periods, **extra)
        return df.withColumns(made)
    if bad := {x[0] for x in aggs.values()} - plain:
        raise NotImplementedError(f"{sorted(bad)} over a whole table would hold it in one task; give groups, or use quantiles of the table")
    centred = sorted({c for name, *cs in aggs.values() if name in moments or name in ("cov", "corr") for c in cs})
    means = df.agg(*[F.avg(f"`{c}`").alias(c) for c in centred]).first().asDict() if centred else {}

    def less_mean(c: str) -> Column:
        """Sums of powers are taken about the mean of the column, which keeps their differences exact enough."""
        return F.col(f"`{c}`").cast("double") - F.lit(float(means[c] or 0.0))

    runs: dict[str, tuple[str, Column]] = {}
    for n, (name, c, *more) in aggs.items():
        x = F.col(f"`{c}`")
        if name in ("cov", "corr"):
            both = x.isNotNull() & F.col(f"`{more[0]}`").isNotNull()
            p, q = F.when(both, less_mean(c)), F.when(both, less_mean(more[0]))
            runs |= {f"__n_{n}": ("count", p), f"__p_{n}": ("sum", p), f"__q_{n}": ("sum", q), f"__pq_{n}": ("sum", p * q), f"__pp_{n}": ("sum", p * p), f"__qq_{n}": ("sum", q * q)}
            if name == "corr":
                runs |= {f"__{k}{m}_{n}": (k, v) for m, v in (("p", p), ("q", q)) for k in ("min", "max")}
            continue
        runs[f"__n_{n}"] = ("count", x)
        if name in ("sum", "mean"):
            runs[f"__s_{n}"] = ("sum", x)
        elif name in ("min", "max", "prod"):
            runs[f"__s_{n}"] = (name, x)
        for k in range(1, moments.get(name, 0) + 1):
            runs[f"__s{k}_{n}"] = ("sum", F.pow(less_mean(c), F.lit(float(k))))
    run = scan(df, order, runs)
    out = {}
    for n, (name, *_) in aggs.items():
        count = F.col(f"__n_{n}")
        d = count.cast("double")
        if name == "count":
            value = d
        elif name == "mean":
            value = F.col(f"__s_{n}") / F.when(count > 0, count)
        elif name in moments:
            value = _from_sums(name, d, [F.col(f"__s{k}_{n}") for k in range(1, moments[name] + 1)])
        elif name in ("cov", "corr"):
            p, q, pq, pp, qq = (F.col(f"__{k}_{n}") for k in ("p", "q", "pq", "pp", "qq"))
            shared, one, two = pq - p * q / d, pp - p * p / d, qq - q * q / d
            if name == "cov":
                value = shared / F.when(d > 1, d - 1)
            else:
                # differences of sums of equal values are not quite zero
                varies = (F.col(f"__minp_{n}") < F.col(f"__maxp_{n}")) & (F.col(f"__minq_{n}") < F.col(f"__maxq_{n}"))
                value = F.when(varies & (one > 0) & (two > 0), shared / (F.sqrt(one) * F.sqrt(two)))
        else:
            value = F.col(f"__s_{n}")
        out[n] = F.when(count >= min_periods, value)
    return run.withColumns(out).drop(*runs)


def _from_sums(name: str, d: Column, s: list[Column]) -> Column:
    """A statistic from the number of values and the sums of their powers; 0 for the shape of equal values."""
    mean = s[0] / d
    square = F.greatest(F.lit(0.0), s[1] - s[0] * mean)
    if name in ("var", "std", "sem"):
        v = square / F.when(d > 1, d - 1)
        return v if name == "var" else F.sqrt(v) if name == "std" else F.sqrt(v) / F.sqrt(d)
    m2 = square / d
    some = m2 > 1e-24
    if name == "skew":
        m3 = s[2] / d - 3 * mean * s[1] / d + 2 * mean * mean * mean
        return F.when(d > 2, F.when(some, F.sqrt(d * (d - 1)) / F.when(d > 2, d - 2) * m3 / F.when(some, F.pow(m2, F.lit(1.5)))).otherwise(0.0))
    m4 = s[3] / d - 4 * mean * s[2] / d + 6 * mean * mean * s[1] / d - 3 * mean * mean * mean * mean
    body = (d - 1) / F.when(d > 3, (d - 2) * (d - 3)) * ((d + 1) * m4 / F.when(some, m2 * m2) - 3 * (d - 1))
    return F.when(d > 3, F.when(some, body).otherwise(0.0))


def weighted(df: DataFrame, order: Order, column: str, weights: Sequence[float], name: str, how: str = "mean", by: Sequence[str] = (), center: bool = False) -> DataFrame:
    """Sliding frame with a weight for each place (the shapes of signal windows): mean, sum, var or std; full frames only."""
    n = len(weights)
    shift = (n - 1) // 2 if center else 0
    w_lit = F.array(*[F.lit(float(x)) for x in weights])

    def made(w: WindowSpec) -> Column:
        seen = F.collect_list(F.col(f"`{column}`").cast("double")).over(w.rowsBetween(-(n - 1) + shift, shift))
        total = F.aggregate(F.zip_with(seen, w_lit, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        share = total / float(sum(weights))
        if how == "sum":
            value = total
        elif how == "mean":
            value = share
        else:
            square = F.aggregate(F.zip_with(seen, w_lit, lambda x, y: (x - share) * (x - share) * y), F.lit(0.0), lambda s, x: s + x)
            value = square / (float(sum(weights)) * (n - 1) / n)
            value = value if how == "var" else F.sqrt(value)
        return F.when(F.size(seen) == n, value)

    return sliding(df, order, {name: made}, n - 1 - shift, shift, by)


def rolling_apply(df: DataFrame, order: Order, window: int, column: str, func: Callable[[pd.Series], float] | Callable[[np.ndarray], float], name: str, by: Sequence[str] = (), raw: bool = False) -> DataFrame:
    """A Python function of each full frame; frames go to Python in Arrow batches. The function gets a Series or, if `raw`, an
    array, which costs much less for each row."""

    @F.arrow_udf("double")  # type: ignore[call-overload]
    def run(frames: pa.Array) -> pa.Array:
        values = frames.values.to_numpy(zero_copy_only=False)
        ends = frames.offsets.to_numpy()
        made = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            x = values[a:b]
            made.append(float(func(x if raw else pd.Series(x))) if b - a == window else None)
        return pa.array(made, pa.float64(), from_pandas=True)

    return sliding(df, order, {"__frame": lambda w: F.collect_list(F.col(f"`{column}`")).over(w.rowsBetween(-(window - 1), 0))}, window - 1, 0, by).withColumn(name, run("__frame")).drop("__frame")


def _ewm_local(x: np.ndarray, alpha: float, adjust: bool) -> dict[str, np.ndarray]:
    """What the rows of a range add to weighted sums: each is kept * (sum before) + own. Adjusted sums start with the range,
    others are normalised at each value and start with the first value, whose own results are left to the carry."""
    n, keep = len(x), 1 - alpha
    names = ("kept", "s1", "s2", "w1", "w2")
    out = {c: np.zeros(n) for c in names}
    seen = np.zeros(n, bool)
    if adjust:
        has = ~np.isnan(x)
        v = pd.DataFrame({"s1": np.where(has, x, 0.0), "s2": np.where(has, x * x, 0.0), "w1": has.astype(float)})
        for c in v:
            out[c] = v[c].ewm(alpha=alpha).sum().to_numpy()
        out["w2"] = v["w1"].ewm(alpha=1 - keep * keep).sum().to_numpy()
        out["kept"] = keep ** np.arange(1, n + 1)
        return out | {"seen": np.ones(n, bool)}
    p, a, b, d, f, on = 1.0, 0.0, 0.0, 0.0, 1.0, False
    for i, y in enumerate(x.tolist()):
        f *= keep
        if y == y:
            if on:
                t = f + alpha
                p, a, b, d = p * f / t, (f * a + alpha * y) / t, (f * b + alpha * y * y) / t, (f * f * d + alpha * alpha) / (t * t)
            on, f = True, 1.0
        seen[i] = on
        out["kept"][i], out["s1"][i], out["s2"][i], out["w2"][i] = p, a, b, d
    return out | {"seen": seen}


def _ewm_whole(df: DataFrame, order: Sequence[str], column: str, name: str, alpha: float, adjust: bool, how: str, bias: bool) -> DataFrame:
    """Weighted sums of values, squares and weights are linear recurrences: each range runs on from what the ranges before it
    add up to, of which the driver sees a few numbers for each range."""
    from lumenframe.plans.ordering import checkpoint, ranged

    keep = 1 - alpha
    middle = float(df.agg(F.avg(F.col(f"`{column}`"))).first()[0] or 0.0) if how != "mean" else 0.0
    dealt = ranged(df, order)
    kinds = "__kept double, __s1 double, __s2 double, __w1 double, __w2 double, __seen boolean, __k bigint, __first double, __at bigint, __gap bigint"
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL(kinds).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable", na_position="last")
        x = pdf[column].astype(float).to_numpy() - middle
        for c, v in _ewm_local(x, alpha, adjust).items():
            pdf[f"__{c}"] = v
        has = np.flatnonzero(~np.isnan(x))
        pdf["__k"] = np.arange(1, len(pdf) + 1)
        pdf["__first"], pdf["__at"], pdf["__gap"] = (x[has[0]], has[0] + 1, len(x) - 1 - has[-1]) if len(has) else (None, 0, len(x))
        return pdf

    local = checkpoint(dealt.groupBy("__range").applyInPandas(run, schema))
    fields = ("__kept", "__s1", "__s2", "__w1", "__w2", "__first", "__at", "__gap")
    ends = local.groupBy("__range").agg(*[F.max_by(c, "__k").alias(c) for c in fields], F.max("__k").alias("n")).orderBy("__range").collect()
    none = (0.0, 0.0, 0.0, 0.0)
    now, gap, carried = none, 0, []
    for e in ends:
        into, start = now, none
        if adjust:
            start, fade = into, e["__kept"]
            now = tuple(f * s + x for f, s, x in zip((fade, fade, fade, fade * fade), into, (e["__s1"], e["__s2"], e["__w1"], e["__w2"])))
        elif e["__first"] is None:
            gap += e.n
        else:
            x, f = e["__first"], keep ** (gap + e["__at"])
            t = f + alpha
            start = (x, x * x, 1.0, 1.0) if not into[2] else ((f * into[0] + alpha * x) / t, (f * into[1] + alpha * x * x) / t, 1.0, (f * f * into[3] + alpha * alpha) / (t * t))
            p = e["__kept"]
            now, gap = (p * start[0] + e["__s1"], p * start[1] + e["__s2"], 1.0, p * p * start[3] + e["__w2"]), e["__gap"]
        carried.append((e["__range"], *into, *start))
    table = df.sparkSession.createDataFrame(carried, "__of int, " + ", ".join(f"__{x}{k} double" for x in "is" for k in range(4)))
    p = F.col("__kept")
    grown = lambda k, own, fade: F.when(F.col("__seen"), fade * F.col(f"__s_{k}") + own).otherwise(F.col(f"__i_{k}"))
    table = table.withColumnsRenamed({f"__{x}{k}": f"__{x}_{k}" for x in "is" for k in range(4)})
    joined = local.join(F.broadcast(table), F.col("__range") == F.col("__of"))
    made = {"__t1": grown(0, F.col("__s1"), p), "__t2": grown(1, F.col("__s2"), p), "__tw": grown(2, F.col("__w1") if adjust else 1 - p, p), "__td": grown(3, F.col("__w2"), p * p)}
    out = joined.withColumns(made)
    w, d = F.col("__tw"), F.col("__td")
    mean = F.col("__t1") / F.when(w > 0, w)
    if how == "mean":
        value = mean
    else:
        value = F.when(w > 0, F.greatest(F.lit(0.0), F.col("__t2") / F.when(w > 0, w) - mean * mean))
        if not bias:
            value = value * w * w / F.when(w * w - d > 1e-12 * w * w, w * w - d)
        value = F.sqrt(value) if how == "std" else value
    extra = [f.name for f in StructType.fromDDL(kinds).fields]
    return out.withColumn(name, value).drop("__range", "__of", *extra, *made, *[f"__{x}_{k}" for x in "is" for k in range(4)])


def ewm(df: DataFrame, order: Sequence[str], column: str, name: str, by: Sequence[str] = (), alpha: float | None = None, span: float | None = None, com: float | None = None, halflife: float | None = None, adjust: bool = True, how: str = "mean", bias: bool = False) -> DataFrame:
    """Exponentially weighted mean, var or std: inside groups, each of which is a task's unit, or over a whole table by ranges.

    Weights of a missing value's place count, as they do by default: a value k rows back weighs (1 - alpha)^k.
    """
    if alpha is None:
        alpha = 2 / (span + 1) if span is not None else 1 / (1 + com) if com is not None else 1 - float(np.exp(-np.log(2) / halflife))
    if not by:
        return _ewm_whole(df, order, column, name, alpha, adjust, how, bias)
    return ewms(df, order, column, {name: how}, by, alpha, adjust, bias)


def ewms(df: DataFrame, order: Sequence[str], column: str, names: dict[str, str], by: Sequence[str], alpha: float, adjust: bool = True, bias: bool = False) -> DataFrame:
    """Several exponentially weighted results, {name: mean, var or std}, in one pass over the groups."""

    def run(given: dict[str, np.ndarray], group: np.ndarray) -> dict[str, np.ndarray]:
        e = pd.Series(given[column]).groupby(group, sort=False).ewm(alpha=alpha, adjust=adjust)
        return {n: (e.mean() if how == "mean" else getattr(e, how)(bias=bias)).to_numpy() for n, how in names.items()}

    return of_groups(df.withColumn("__x", F.col(f"`{column}`").cast("double")), by, order, {column: "__x"}, run, list(names)).drop("__x")


def of_groups(df: DataFrame, by: Sequence[str], order: Order, columns: dict[str, str], func: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], names: Sequence[str]) -> DataFrame:
    """`df` with double columns from a Python function of whole groups in their order, many groups in a call.

    `func` gets {name: values} of the numeric `columns` (missing ones are NaN) and the number of the group of each row, rising
    from 0, and gives an array for each of `names`. Rows stay in Arrow; a group that goes on in the next batch is held until
    it ends.
    """
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    given, wanted = dict(columns), list(names)

    def done(parts: list) -> object:
        t = pa.Table.from_batches(parts).combine_chunks()
        group = np.cumsum(t.column("__k").to_numpy() == 1) - 1
        made = func({n: t.column(c).to_numpy() for n, c in given.items()}, group)
        t = t.drop_columns(["__k"])
        for n in wanted:
            t = t.append_column(n, pa.array(np.asarray(made[n], np.float64), pa.float64(), from_pandas=True))
        return t.to_batches()

    def run(batches: object) -> object:
        held: list = []
        for b in batches:
            starts = np.flatnonzero(b.column(b.schema.get_field_index("__k")).to_numpy(zero_copy_only=False) == 1)
            if not len(starts):
                held.append(b)
                continue
            cut = int(starts[-1])
            held += [b.slice(0, cut)] if cut else []
            if held:
                yield from done(held)
            held = [b.slice(cut)]
        if held:
            yield from done(held)

    placed = df.withColumn("__k", F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*keys(order))))
    return placed.mapInArrow(run, schema)


def cumulative(df: DataFrame, order: Order, columns: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Running sum, prod, max, min or count; a missing value gives a missing result and is passed over."""
    runs = {f"__c_{n}": (k.removeprefix("cum"), F.col(f"`{c}`")) for n, (k, c) in columns.items()}
    run = scan(df, order, runs, by)
    return run.withColumns({n: F.col(f"__c_{n}") if k.removeprefix("cum") == "count" else F.when(F.col(f"`{c}`").isNotNull(), F.col(f"__c_{n}")) for n, (k, c) in columns.items()}).drop(*runs)


def cumcount(df: DataFrame, order: Order, by: Sequence[str], name: str = "cumcount", ascending: bool = True) -> DataFrame:
    by_order = list(order) if ascending else [F.col(c).desc() if isinstance(c, str) else c for c in order]
    if hot(df, by):
        return scan(df, by_order, {name: ("count", F.lit(1))}, by).withColumn(name, (F.col(name) - 1).cast("bigint"))
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*keys(by_order))) - 1).cast("bigint"))


def shift(df: DataFrame, order: Order, columns: dict[str, str], periods: int = 1, by: Sequence[str] = (), fill: object = None) -> DataFrame:
    """{name: column} moved `periods` rows on (back if negative); what comes in is `fill`."""
    f = F.lag if periods >= 0 else F.lead
    made = {n: (lambda w, c=c: f(F.col(f"`{c}`"), abs(periods), fill).over(w)) for n, c in columns.items()}
    return sliding(df, order, made, max(0, periods), max(0, -periods), by)


def diff(df: DataFrame, order: Order, columns: dict[str, str], periods: int = 1, by: Sequence[str] = ()) -> DataFrame:
    f = F.lag if periods >= 0 else F.lead
    made = {n: (lambda w, c=c: F.col(f"`{c}`") - f(F.col(f"`{c}`"), abs(periods)).over(w)) for n, c in columns.items()}
    return sliding(df, order, made, max(0, periods), max(0, -periods), by)


def pct_change(df: DataFrame, order: Order, columns: dict[str, str], periods: int = 1, by: Sequence[str] = (), infinite: bool = False) -> DataFrame:
    """Relative change against the value `periods` rows before; gaps are filled from before first. Against a zero it is missing,
    or, if `infinite`, what IEEE division gives: infinite with the sign of the value, missing for a zero."""
    filled = scan(df, order, {f"__f_{n}": ("last", F.col(f"`{c}`")) for n, c in columns.items()}, by)

    def made(n: str) -> Callable[[WindowSpec], Column]:
        before = lambda w: F.lag(f"__f_{n}", periods).over(w)
        return (lambda w: truediv(F.col(f"__f_{n}"), before(w)) - 1) if infinite else lambda w: F.col(f"__f_{n}") / F.nullif(before(w), F.lit(0)) - 1

    return sliding(filled, order, {n: made(n) for n in columns}, periods, 0, by).drop(*[f"__f_{n}" for n in columns])


def rank(df: DataFrame, column: str, name: str = "rank", method: str = "average", ascending: bool = True, pct: bool = False, by: Sequence[str] = (), order: Order = (), na_option: str = "keep") -> DataFrame:
    """Ranks from 1: average, min, max, dense or first (ties in `order`). Missing values have none (keep) or come last or first.

    Over a whole table the ranks come from grouped counts of the distinct values and a scan over them, joined back.
    """
    c = F.col(f"`{column}`")
    by_value = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    if na_option == "top":
        by_value = c.asc_nulls_first() if ascending else c.desc_nulls_first()
    counted = c if na_option == "keep" else F.lit(1)
    if by and not pct and hot(df, by):
        return _rank_hot(df, column, name, method, by, by_value, order, na_option)
    if by:
        w = Window.partitionBy(*by).orderBy(by_value)
        ties = Window.partitionBy(*by, column)
        low = F.rank().over(w).cast("double")
        value = {"min": low, "dense": F.dense_rank().over(w).cast("double"), "first": F.row_number().over(Window.partitionBy(*by).orderBy(by_value, *keys(order))).cast("double"), "max": low + F.count(F.lit(1)).over(ties) - 1, "average": low + (F.count(F.lit(1)).over(ties) - 1) / 2}[method]
        whole = F.max(F.dense_rank().over(w)).over(Window.partitionBy(*by)) if method == "dense" and pct else F.count(counted).over(Window.partitionBy(*by))
        if pct and method == "dense":
            df = df.withColumn("__dense", F.when(c.isNotNull() if na_option == "keep" else F.lit(True), F.dense_rank().over(w)))
            whole = F.max("__dense").over(Window.partitionBy(*by))
        value = value / whole if pct else value
        out = df.withColumn(name, F.when(c.isNotNull(), value) if na_option == "keep" else value)
        return out.drop("__dense")
    if method == "first":
        from lumenframe.plans.ordering import POSITION, positions

        out = positions(df, [by_value, *keys(order)])
        value = (F.col(POSITION) + 1).cast("double")
        if pct:
            value = value / df.select(F.count(counted)).first()[0]
        return out.withColumn(name, F.when(c.isNotNull(), value) if na_option == "keep" else value).drop(POSITION)
    values = df.groupBy(F.col(f"`{column}`").alias("__rv")).agg(F.count(F.lit(1)).alias("__n"))
    if na_option == "keep":
        values = values.filter("__rv is not null")
    v = F.col("__rv")
    value_order = {(True, False): v.asc_nulls_last(), (False, False): v.desc_nulls_last(), (True, True): v.asc_nulls_first(), (False, True): v.desc_nulls_first()}[(ascending, na_option == "top")]
    run = scan(values, [value_order], {"__upto": ("sum", F.col("__n")), "__dense": ("count", F.lit(1))})
    high = F.col("__upto").cast("double")
    value = {"max": high, "min": high - F.col("__n") + 1, "average": high - (F.col("__n") - 1) / 2, "dense": F.col("__dense").cast("double")}[method]
    if pct:
        totals = values.agg(F.sum("__n").alias("n"), F.count("*").alias("d")).first()
        value = value / float((totals.d if method == "dense" else totals.n) or 1)
    table = run.select("__rv", value.alias(name))
    return df.join(table, c.eqNullSafe(F.col("__rv")), "left").drop("__rv")


def _rank_hot(df: DataFrame, column: str, name: str, method: str, by: Sequence[str], by_value: Column, order: Order, na_option: str) -> DataFrame:
    """Ranks inside groups of which one is hot: a running count of the rows, or of the distinct values and their rows, by ranges."""
    c = F.col(f"`{column}`")
    fine = c.isNotNull() if na_option == "keep" else F.lit(True)
    if method == "first":
        out = scan(df, [by_value, *order], {name: ("count", F.lit(1))}, by)
        return out.withColumn(name, F.when(fine, F.col(name).cast("double")))
    values = df.filter(fine).groupBy(*by, c.alias("__rv")).agg(F.count(F.lit(1)).alias("__n"))
    v = F.col("__rv")
    down = "DESC" in by_value._jc.toString()
    last = "NULLS LAST" in by_value._jc.toString()
    way = (v.desc_nulls_last() if last else v.desc_nulls_first()) if down else (v.asc_nulls_last() if last else v.asc_nulls_first())
    run = scan(values, [way], {"__upto": ("sum", F.col("__n")), "__dense": ("count", F.lit(1))}, by)
    high = F.col("__upto").cast("double")
    value = {"max": high, "min": high - F.col("__n") + 1, "average": high - (F.col("__n") - 1) / 2, "dense": F.col("__dense").cast("double")}[method]
    table = run.select(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(by)], "__rv", value.alias(name))
    same = c.eqNullSafe(v)
    for i, g in enumerate(by):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    return df.join(table, same, "left").drop("__rv", *[f"__g{i}" for i in range(len(by))])


def fill(df: DataFrame, order: Order, columns: Sequence[str], method: str = "ffill", limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Gaps filled from the last (ffill) or next (bfill) value, over at most `limit` rows."""
    if limit is None:
        ordered = list(order) if method == "ffill" else [F.col(c).desc_nulls_first() if isinstance(c, str) else c for c in order]
        if by or method == "ffill":
            run = scan(df, ordered, {f"__f_{c}": ("last", F.col(f"`{c}`")) for c in columns}, by)
        else:
            run = _scan_back(df, order, columns)
        return run.withColumns({c: F.col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])
    if method == "ffill":
        made = {f"__f_{c}": (lambda w, c=c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(w.rowsBetween(-limit, 0))) for c in columns}
    else:
        made = {f"__f_{c}": (lambda w, c=c: F.first(F.col(f"`{c}`"), ignorenulls=True).over(w.rowsBetween(0, limit))) for c in columns}
    run = sliding(df, order, made, limit if method == "ffill" else 0, 0 if method == "ffill" else limit, by)
    return run.withColumns({c: F.col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])


def _scan_back(df: DataFrame, order: Order, columns: Sequence[str], prefix: str = "__f_") -> DataFrame:
    """Next value that is not missing: the forward scan over the reversed positions."""
    from lumenframe.plans.ordering import POSITION, positions

    placed = positions(df, order).withColumn("__back", -F.col(POSITION))
    return scan(placed, ["__back"], {f"{prefix}{c}": ("last", F.col(f"`{c}`")) for c in columns}).drop(POSITION, "__back")


def interpolate(df: DataFrame, order: Sequence[str], column: str, by: Sequence[str] = (), x: str | None = None, limit_area: str | None = None) -> DataFrame:
    """Linear over the rows, or over `x` (a number or a time); after the last value it is carried on, before the first it is missing."""
    from lumenframe.plans.ordering import POSITION, positions

    if by:
        placed = df.withColumn(POSITION, F.row_number().over(Window.partitionBy(*by).orderBy(*keys(order))))
    else:
        placed = positions(df, order)
    at = F.col(POSITION).cast("double") if x is None else (micros(F.col(f"`{x}`")) if dict(df.dtypes)[x].startswith("timestamp") else F.col(f"`{x}`")).cast("double")
    c = F.col(f"`{column}`")
    placed = placed.withColumn("__x", at).withColumn("__k", F.when(c.isNotNull(), F.struct(F.col("__x").alias("x"), c.cast("double").alias("y")))).withColumn("__back", -F.col(POSITION))
    run = scan(placed, [POSITION], {"__a": ("last", F.col("__k"))}, by)
    run = scan(run, ["__back"], {"__b": ("last", F.col("__k"))}, by)
    between = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col("__x") - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    value = F.when(c.isNotNull(), c.cast("double")).when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), between)
    if limit_area != "inside":
        value = F.coalesce(value, F.col("__a.y"))
    return run.withColumn(column, value).drop(POSITION, "__x", "__k", "__back", "__a", "__b")


def peaks(df: DataFrame, order: Order, column: str, name: str, largest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(f"`{column}`")

    def made(w: WindowSpec) -> Column:
        a, b = F.lag(c).over(w), F.lead(c).over(w)
        over = (lambda x: c > x) if largest else (lambda x: c < x)
        return F.coalesce(over(a), F.lit(True)) & F.coalesce(over(b), F.lit(True)) & c.isNotNull()

    return sliding(df, order, {name: made}, 1, 1, by)


def runs(df: DataFrame, order: Sequence[str], column: str, name: str = "rle_id", by: Sequence[str] = ()) -> DataFrame:
    """Number of the run of equal values that each row is in, from 0."""
    c = F.col(f"`{column}`")
    changed = sliding(df, order, {"__new": lambda w: (~c.eqNullSafe(F.lag(c).over(w)) & (F.lag(F.lit(1)).over(w).isNotNull())).cast("int")}, 1, 0, by)
    return scan(changed, order, {name: ("sum", F.col("__new"))}, by).drop("__new")


def run_lengths(df: DataFrame, order: Sequence[str], column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rle_id, value, len)."""
    return runs(df, order, column, by=by).groupBy(*by, "rle_id").agg(F.first(f"`{column}`").alias("value"), F.count(F.lit(1)).alias("len"))


def is_monotonic(df: DataFrame, order: Order, column: str, increasing: bool = True, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each group): whether the values never fall (rise)."""
    c = F.col(f"`{column}`")

    def made(w: WindowSpec) -> Column:
        before = F.lag(c).over(w)
        fine = (c > before if strict else c >= before) if increasing else (c < before if strict else c <= before)
        return F.when(F.lag(F.lit(1)).over(w).isNull(), F.lit(True)).otherwise(F.coalesce(fine, F.lit(False)))

    checked = sliding(df, order, {"__fine": made}, 1, 0, by)
    return (checked.groupBy(*by) if by else checked.groupBy()).agg(F.bool_and("__fine").alias("is_monotonic"))


__all__ = ["S", "cumcount", "cumulative", "diff", "ewm", "ewms", "expanding", "fill", "interpolate", "is_monotonic", "of_groups", "pct_change", "peaks", "rank", "rolling", "rolling_apply", "run_lengths", "runs", "shift", "weighted"]
