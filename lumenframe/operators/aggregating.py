"""Whole-table aggregates: one row, or one row for each column, out of a single partial-and-final pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import statistics as S

#: Rows up to which the exact quantiles of a whole column are taken by one aggregate, which holds its distinct values.
QUANTILE_ROWS = 20_000_000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k.startswith(NUMERIC)]


def ranked_quantiles(df: DataFrame, column: str, shares: Sequence[float], interpolation: str = "linear") -> list[float | None]:
    """Exact quantiles of a column of any size: distinct values counted, a running count over ranges, and the values at the
    wanted ranks picked by one aggregate. No task holds more than its range."""
    from lumenframe.plans.ordering import scan

    counts = df.select(F.col(f"`{column}`").cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    run = scan(counts, ["v"], {"upto": ("sum", F.col("n"))})
    total = run.agg(F.max("upto")).first()[0]
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * float(q) for q in shares]
    if interpolation == "nearest":
        at = [float(round(x)) for x in at]
    ranks = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    row = run.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(f"r{k}") for k in ranks]).first()
    out = []
    for x in at:
        low, high = row[f"r{math.floor(x)}"], row[f"r{math.ceil(x)}"]
        out.append({"lower": low, "higher": high, "midpoint": (low + high) / 2}.get(interpolation, low + (high - low) * (x - math.floor(x))))
    return out


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], interpolation: str = "linear") -> dict[str, list[float | None]]:
    """Exact quantiles of each column: by one aggregate up to QUANTILE_ROWS rows, by ranks beyond; the results are the same."""
    if df.count() > QUANTILE_ROWS or interpolation != "linear":
        return {c: ranked_quantiles(df, c, shares, interpolation) for c in columns}
    row = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), F.array(*[F.lit(float(q)) for q in shares])).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(shares) for i, c in enumerate(columns)}


def reduce_columns(df: DataFrame, how: str, columns: Sequence[str] | None = None, skipna: bool = True, **options: object) -> DataFrame:
    """One row with the aggregate of each column, under its name. Without `skipna` a missing value makes the result missing."""
    columns = columns or (df.columns if how in ("count", "nunique", "min", "max", "null_count", "any", "all") else numeric(df))
    if how in ("median", "quantile") and skipna:
        found = quantiles(df, columns, [options.get("q", 0.5)], options.get("interpolation", "linear"))
        return df.sparkSession.createDataFrame([tuple(found[c][0] for c in columns)], ", ".join(f"`{c}` double" for c in columns))
    made = []
    for c in columns:
        value = S.aggregate(how, F.col(f"`{c}`"), **options)
        if not skipna:
            value = F.when(F.count_if(F.col(f"`{c}`").isNull()) == 0, value)
        made.append(value.alias(c))
    return df.agg(*made)


def extreme_label(df: DataFrame, columns: Sequence[str], label: str, order: str, largest: bool = True) -> DataFrame:
    """One row: for each column the label of its largest (smallest) value, the first of ties."""
    return df.agg(*[S.arg_extreme(F.col(label), F.col(c), F.col(order), largest).alias(c) for c in columns])


def arg_extreme(df: DataFrame, column: str, order: Sequence[str], largest: bool = True) -> int | None:
    """Position in the order of the largest (smallest) value."""
    from lumenframe.plans.ordering import POSITION, positions

    return positions(df.select(*dict.fromkeys([*order, column])), order).agg(S.arg_extreme(F.col(POSITION), F.col(column), F.col(POSITION), largest)).first()[0]


def long(df: DataFrame, name: str = "value", key: str = "column") -> DataFrame:
    """A one-row result as (column, value) rows."""
    return df.unpivot([], df.columns, key, name)


def agg(df: DataFrame, spec: dict[str, str | Sequence[str]] | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """{column: aggregate(s)} or a list of aggregates: one row for each aggregate, missing where a column hasn't it."""
    if not isinstance(spec, dict):
        spec = {c: list(spec) for c in columns or numeric(df)}
    given = {c: [h] if isinstance(h, str) else list(h) for c, h in spec.items()}
    hows = list(dict.fromkeys(h for hs in given.values() for h in hs))
    row = df.agg(*[S.aggregate(h, F.col(f"`{c}`")).cast("double").alias(f"{i}__{h}") for i, (c, hs) in enumerate(given.items()) for h in hs])
    cells = F.array(*[F.struct(F.lit(h).alias("aggregate"), *[(F.col(f"`{i}__{h}`") if h in hs else F.lit(None).cast("double")).alias(c) for i, (c, hs) in enumerate(given.items())]) for h in hows])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, count, mean, std, min, percentiles..., max), exact, for numeric columns."""
    columns = list(columns or numeric(df))
    names = ["count", "mean", "std", "min", *[f"{p * 100:g}%" for p in percentiles], "max"]

    found = quantiles(df, columns, percentiles) if columns and percentiles else {c: [] for c in columns}

    def stats(c: Column, name: str) -> list[Column]:
        return [F.count(c), F.avg(c), S.std(c), F.min(c), *[F.lit(x) for x in found[name]], F.max(c)]

    row = df.agg(*[s.cast("double").alias(f"{i}_{n}") for i, c in enumerate(columns) for n, s in zip(names, stats(F.col(f"`{c}`"), c), strict=True)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{i}_{n}`").alias(n) for n in names]) for i, c in enumerate(columns)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def describe_objects(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, unique, top, freq) for text columns; of equally frequent values, the least. One grouped count over all columns."""
    long_form = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long_form.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n")))
    top = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best["n"].alias("freq"))
    first = counts.join(top.select("column", "freq"), "column").filter("n = freq").groupBy("column").agg(F.min("v").alias("top"))
    return top.join(first, "column").select("column", "count", "unique", "top", "freq")


def mode(df: DataFrame, column: str) -> DataFrame:
    """All commonest values."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return n.join(n.agg(F.max("__n").alias("__n")), "__n", "left_semi").select(column)


def _spearman_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from lumenframe.operators.windowing import rank

    for c in columns:
        df = rank(df, c, f"__rank_{c}")
    return df.select(*[F.col(f"__rank_{c}").alias(c) for c in columns])


def corr(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", min_periods: int = 1) -> DataFrame:
    """(x, y, corr) for each pair of columns, over the rows where both are there. spearman ranks each column first; kendall
    counts discordant pairs by sorted inversions over ranges of the distinct points."""
    columns = list(columns or numeric(df))
    if method == "kendall":
        return _kendall(df, columns)
    if method == "spearman":
        df = _spearman_ranks(df, columns)
    return _pairs(df, columns, S.corr, "corr", min_periods)


def cov(df: DataFrame, columns: Sequence[str] | None = None, ddof: int = 1, min_periods: int = 1) -> DataFrame:
    return _pairs(df, list(columns or numeric(df)), lambda a, b: S.covar(a, b, ddof), "cov", min_periods)


def _pairs(df: DataFrame, columns: list[str], f: Callable[[Column, Column], Column], name: str, least: int) -> DataFrame:
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.count_if(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()) >= least
    row = df.agg(*[F.when(both(a, b), f(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{k}").alias(name)) for k, (a, b) in enumerate(pairs)])).alias("v")).select("v.*")


#: Distinct points that a range of Kendall's tau has at least, and ranges at most, whose square is the number of sums the driver sees.
KENDALL_POINTS, KENDALL_RANGES = 5_000, 1_000


def _lexical(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Complex numbers, which numpy orders by the first part and then by the second."""
    out = np.empty(len(first), complex)
    out.real, out.imag = first, second
    return out


def _inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight[i] * weight[j] over i < j with rank[i] > rank[j]; ranks are different. Bit by bit from the highest."""
    total = 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        above = rank >> (bit + 1)
        one = (rank >> bit & 1).astype(bool)
        seen = np.cumsum(np.where(one, weight, 0)) - np.where(one, weight, 0)
        total += int(np.sum(np.where(one, 0, weight * (seen - seen[np.searchsorted(above, above)]))))
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def _discordant(points: DataFrame, number: int) -> int:
    """Pairs of rows of the checkpointed distinct points (x, y, n) whose orders by x and by y differ, ties left out.

    Points are dealt into ranges of (x, y) and of (y, x), so that a hot value is split too. A discordant pair is one that these
    two orders sort differently: within a range of the first it is counted there; else within a range of the second, there;
    else from the sums of the cells that two ranges make.
    """
    ranges = max(1, min(KENDALL_RANGES, number // KENDALL_POINTS))
    some = np.array([tuple(r) for r in points.select("x", "y").sample(min(1.0, 100 * ranges / number), 5).collect()] if ranges > 1 else [], float).reshape(-1, 2)
    by_x, by_y = (np.sort(_lexical(some[:, k], some[:, 1 - k])) for k in (0, 1))
    by_x, by_y = (z[np.arange(1, ranges) * len(z) // ranges] if len(z) else z for z in (by_x, by_y))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            own = [np.searchsorted(by_x, _lexical(x, y), "right"), np.searchsorted(by_y, _lexical(y, x), "right")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k.astype(np.int32)) for k in own)], ["x", "y", "n", "r", "q"])

    def count(table: pa.Table, cells: bool) -> pa.Table:
        x, y, n, r = (table.column(c).to_numpy() for c in ("x", "y", "n", "r"))
        order = np.lexsort((y, x))
        x, y, n, r = x[order], y[order], n[order], r[order]
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort((x, y))] = np.arange(len(x))
        found = _inversions(rank, n)
        if cells:
            own = np.empty(len(x), np.int64)
            own[np.lexsort((rank, r))] = np.arange(len(x))
            found -= _inversions(own, n)
        return pa.table({"d": pa.array([found], pa.int64())})

    placed = points.select("x", "y", "n").mapInArrow(place, "x double, y double, n bigint, r int, q int")
    counted = placed.groupBy("r").applyInArrow(lambda t: count(t, False), "d bigint").unionByName(placed.groupBy("q").applyInArrow(lambda t: count(t, True), "d bigint"))
    total = int(counted.agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0])
    cell = np.zeros((ranges, ranges), np.int64)
    for r, q, n in placed.groupBy("r", "q").agg(F.sum("n")).collect():
        cell[r, q] = n
    below = np.cumsum(cell, 1) - cell
    later = np.cumsum(below[::-1], 0)[::-1] - below
    return total + int((cell * later).sum())


def _tau(points: DataFrame) -> float | None:
    pairs = lambda n: F.coalesce(F.sum((n.cast("decimal(38,0)") * (n - 1)) / 2).cast("decimal(38,0)"), F.lit(0))
    number, rows, same = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), pairs(F.col("n"))).first()
    tied = {c: int(points.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).first()[0]) for c in ("x", "y")}
    all_ = rows * (rows - 1) // 2
    scale = (all_ - tied["x"]) * (all_ - tied["y"])
    if not scale:
        return None
    return (all_ - tied["x"] - tied["y"] + int(same) - 2 * _discordant(points, number)) / math.sqrt(scale)


def _kendall(df: DataFrame, columns: list[str]) -> DataFrame:
    """tau-b, exact for any number of rows; null where a column has one value only."""
    from lumenframe.plans.ordering import checkpoint

    tau: dict[frozenset, float | None] = {}
    for a in columns:
        for b in columns:
            if frozenset((a, b)) not in tau:
                points = df.select(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
                tau[frozenset((a, b))] = _tau(checkpoint(points))
    return df.sparkSession.createDataFrame([(a, b, tau[frozenset((a, b))]) for a in columns for b in columns], "x string, y string, corr double")


def autocorr(df: DataFrame, column: str, order: Sequence[str], lag: int = 1) -> DataFrame:
    from lumenframe.operators.windowing import shift

    return shift(df, order, {"__lag": column}, lag).agg(S.corr(F.col(f"`{column}`"), F.col("__lag")).alias("autocorr"))


def is_unique(df: DataFrame, column: str) -> DataFrame:
    """One row: whether no value comes twice."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).select((F.col("most") <= 1).alias("is_unique"))


def dot(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.sum(F.col(a) * F.col(b)).alias("dot"))


def entropy(df: DataFrame, column: str, base: float = 2.718281828459045, normalize: bool = True) -> DataFrame:
    p = F.col(column)
    if normalize:
        df = df.crossJoin(F.broadcast(df.agg(F.sum(column).alias("__all"))))
        p = p / F.col("__all")
    return df.agg(S.entropy(p, base).alias("entropy"))
