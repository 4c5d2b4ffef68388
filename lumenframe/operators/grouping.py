"""Grouped operators: `Groups(df, keys)` with aggregates in one pass, ranked rows, group-wide values and Python functions."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lumenframe.functions import statistics as S
from lumenframe.operators import windowing
from lumenframe.plans.ordering import keys


class Groups:
    """Rows by the values of key columns. Rows with a missing key are left out unless `dropna` is off.

    `order` names the columns that rows of a group are ordered by, for the operators that need an order. `categories` maps a
    key to its categories; with `observed` off, combinations without rows are reported too.
    """

    def __init__(self, df: DataFrame, by: str | Sequence[str], order: Sequence[str] = (), dropna: bool = True, sort: bool = False, categories: dict[str, Sequence] | None = None, observed: bool = True):
        self.by = [by] if isinstance(by, str) else list(by)
        self.df = df.dropna(subset=self.by) if dropna else df
        self.order, self.sort, self.categories, self.observed = list(order), sort, categories or {}, observed

    def _values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.by]

    def _numeric(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if f.name not in self.by and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]

    def _done(self, out: DataFrame) -> DataFrame:
        if self.categories and not self.observed:
            frame = None
            for k in self.by:
                one = out.sparkSession.createDataFrame([(v,) for v in self.categories[k]], f"`{k}` string") if k in self.categories else self.df.select(k).distinct()
                frame = one if frame is None else frame.join(one, how="cross")
            out = frame.join(out, self.by, "left")
        return out.orderBy(*keys(self.by)) if self.sort else out

    def agg(self, spec: dict[str, tuple] | None = None, **named: tuple | Column) -> DataFrame:
        """Named aggregates: name=(column, aggregate[, options]) or name=Column; all in one partial-and-final pass."""
        out = []
        for name, x in {**(spec or {}), **named}.items():
            if isinstance(x, Column):
                out.append(x.alias(name))
                continue
            column, how, *more = x
            options = more[0] if more else {}
            if how in ("first", "last"):
                value = getattr(S, how)(F.col(f"`{column}`"), self._place())
            elif how in ("idxmax", "idxmin"):
                value = S.arg_extreme(F.col(options["label"]), F.col(f"`{column}`"), self._place(), how == "idxmax")
            else:
                value = how(F.col(f"`{column}`")) if callable(how) else S.aggregate(how, F.col(f"`{column}`") if column else F.lit(1), **options)
            out.append(value.alias(name))
        return self._done(self.df.groupBy(*self.by).agg(*out))

    def _place(self) -> Column:
        if not self.order:
            raise ValueError("this aggregate needs an order: Groups(..., order=[...])")
        return F.col(f"`{self.order[0]}`") if len(self.order) == 1 else F.struct(*self.order)

    def each(self, how: str, columns: Sequence[str] | None = None, **options: object) -> DataFrame:
        """One aggregate of every (numeric) column, under the column's name."""
        numeric = how not in ("count", "nunique", "first", "last", "min", "max", "any", "all", "null_count")
        columns = columns or (self._numeric() if numeric else self._values())
        return self.agg({c: (c, how, options) for c in columns})

    def size(self, name: str = "size") -> DataFrame:
        return self._done(self.df.groupBy(*self.by).agg(F.count(F.lit(1)).alias(name)))

    def ohlc(self, column: str) -> DataFrame:
        c, at = F.col(f"`{column}`"), self._place()
        return self._done(self.df.groupBy(*self.by).agg(S.first(c, at).alias("open"), F.max(c).alias("high"), F.min(c).alias("low"), S.last(c, at).alias("close")))

    def describe(self, column: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        c = F.col(f"`{column}`")
        stats = [F.count(c).alias("count"), F.avg(c).alias("mean"), S.std(c).alias("std"), F.min(c).alias("min")]
        return self._done(self.df.groupBy(*self.by).agg(*stats, *[F.percentile(c, F.lit(p)).alias(f"{p * 100:g}%") for p in percentiles], F.max(c).alias("max")))

    def value_counts(self, column: str, normalize: bool = False) -> DataFrame:
        n = self.df.filter(F.col(f"`{column}`").isNotNull()).groupBy(*self.by, column).agg(F.count(F.lit(1)).alias("count"))
        if normalize:
            n = n.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(*self.by))).drop("count")
        return n

    def corr(self, a: str, b: str) -> DataFrame:
        return self._done(self.df.groupBy(*self.by).agg(S.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("corr")))

    def cov(self, a: str, b: str, ddof: int = 1) -> DataFrame:
        return self._done(self.df.groupBy(*self.by).agg(S.covar(F.col(a), F.col(b), ddof).alias("cov")))

    def ngroups(self) -> int:
        return self.df.select(*self.by).distinct().count()

    def groups(self, label: str) -> DataFrame:
        """Labels of each group as a list in order."""
        return self._done(self.df.groupBy(*self.by).agg(F.sort_array(F.collect_list(label)).alias("labels")))

    def get_group(self, *values: object) -> DataFrame:
        out = self.df
        for k, v in zip(self.by, values, strict=True):
            out = out.filter(F.col(k) == F.lit(v))
        return out

    def _numbered(self, ascending: bool = True) -> Column:
        by_order = keys(self.order) if ascending else [F.col(c).desc() for c in self.order]
        return F.row_number().over(Window.partitionBy(*self.by).orderBy(*by_order))

    def head(self, n: int = 5) -> DataFrame:
        return self.df.withColumn("__n", self._numbered()).filter(F.col("__n") <= n).drop("__n")

    def tail(self, n: int = 5) -> DataFrame:
        return self.df.withColumn("__n", self._numbered(False)).filter(F.col("__n") <= n).drop("__n")

    def nth(self, n: int) -> DataFrame:
        return self.df.withColumn("__n", self._numbered(n >= 0)).filter(F.col("__n") == (n + 1 if n >= 0 else -n)).drop("__n")

    take = nth

    def nlargest(self, column: str, n: int = 5, largest: bool = True) -> DataFrame:
        by_value = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
        w = Window.partitionBy(*self.by).orderBy(by_value, *keys(self.order))
        return self.df.filter(F.col(column).isNotNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")

    def nsmallest(self, column: str, n: int = 5) -> DataFrame:
        return self.nlargest(column, n, False)

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 0, key: str | None = None) -> DataFrame:
        """n rows or a share of each group, chosen by a hash of `key` (all columns by default), so reruns agree."""
        draw = F.xxhash64(*([key] if key else self.df.columns), F.lit(seed))
        w = Window.partitionBy(*self.by).orderBy(draw)
        most = F.lit(n) if n is not None else F.bround(F.count(F.lit(1)).over(Window.partitionBy(*self.by)) * frac)
        return self.df.withColumn("__n", F.row_number().over(w)).withColumn("__most", most).filter("__n <= __most").drop("__n", "__most")

    def cumcount(self, name: str = "cumcount", ascending: bool = True) -> DataFrame:
        return windowing.cumcount(self.df, self.order, self.by, name, ascending)

    def ngroup(self, name: str = "ngroup", ascending: bool = True) -> DataFrame:
        """Number of the group in the order of the keys: numbered over the distinct keys and joined back."""
        from lumenframe.plans.ordering import POSITION, positions

        order = [F.col(k).asc() if ascending else F.col(k).desc() for k in self.by]
        numbers = positions(self.df.select(*self.by).distinct(), order).withColumnRenamed(POSITION, name)
        return self.df.join(numbers, self.by)

    def cumulative(self, columns: dict[str, tuple[str, str]]) -> DataFrame:
        return windowing.cumulative(self.df, self.order, columns, self.by)

    def shift(self, columns: dict[str, str], periods: int = 1, fill: object = None) -> DataFrame:
        return windowing.shift(self.df, self.order, columns, periods, self.by, fill)

    def diff(self, columns: dict[str, str], periods: int = 1) -> DataFrame:
        return windowing.diff(self.df, self.order, columns, periods, self.by)

    def pct_change(self, columns: dict[str, str], periods: int = 1) -> DataFrame:
        return windowing.pct_change(self.df, self.order, columns, periods, self.by)

    def rank(self, column: str, name: str = "rank", **options: object) -> DataFrame:
        return windowing.rank(self.df, column, name, by=self.by, order=self.order, **options)

    def fill(self, columns: Sequence[str], method: str = "ffill", limit: int | None = None) -> DataFrame:
        return windowing.fill(self.df, self.order, columns, method, limit, self.by)

    def fillna(self, columns: Sequence[str], value: object) -> DataFrame:
        return self.df.fillna(value, list(columns))

    def rolling(self, window: int | str, aggs: dict[str, tuple], **options: object) -> DataFrame:
        return windowing.rolling(self.df, self.order, window, aggs, self.by, **options)

    def expanding(self, aggs: dict[str, tuple], min_periods: int = 1) -> DataFrame:
        return windowing.expanding(self.df, self.order, aggs, self.by, min_periods)

    def ewm(self, column: str, name: str, **options: object) -> DataFrame:
        return windowing.ewm(self.df, self.order, column, name, self.by, **options)

    def resample(self, rule: str, on: str, aggs: dict[str, tuple], **options: object) -> DataFrame:
        from lumenframe.operators.resampling import resample

        return resample(self.df, rule, on, aggs, by=self.by, **options)

    def transform(self, how: str | Callable, columns: dict[str, str], schema: StructType | str | None = None) -> DataFrame:
        """The group's aggregate beside each of its rows, or a Python function of the group's series.

        Aggregates are made with a partial step and joined back, so that a hot group is no task of its own.
        """
        if callable(how):
            return self.apply(lambda pdf: pdf.assign(**{n: how(pdf[c]) for n, c in columns.items()}), schema or self.df.schema)
        value = {"nunique": F.count_distinct, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "size": lambda c: F.count(F.lit(1)), "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_samp, "var": F.var_samp}
        made = [(value[how](F.col(f"`{c}`")) if how in value else S.aggregate(how, F.col(f"`{c}`"))).alias(f"__t{k}") for k, c in enumerate(columns.values())]
        found = self.df.groupBy(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(self.by)]).agg(*made)
        same = reduce(operator.and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(self.by)])
        joined = self.df.join(found, same, "left").withColumns({n: F.col(f"__t{k}") for k, n in enumerate(columns)})
        return joined.drop(*[f"__g{i}" for i in range(len(self.by))], *[f"__t{k}" for k in range(len(columns))])

    def filter(self, test: Column | Callable[[pd.DataFrame], bool]) -> DataFrame:
        """Groups for which an aggregate condition holds; kept by a semi-join, so no group is gathered. A Python test gathers each."""
        if isinstance(test, Column):
            fine = self.df.groupBy(*self.by).agg(test.alias("__fine")).filter("__fine").select(*self.by)
            return self.df.join(fine, self.by, "left_semi")
        return self.apply(lambda pdf: pdf if test(pdf) else pdf.head(0), self.df.schema)

    def apply(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
        """A Python function of each group as a pandas frame; a group must fit a task."""
        return self.df.groupBy(*self.by).applyInPandas(func, schema)

    def pipe(self, func: Callable, *args: object, **options: object) -> object:
        return func(self, *args, **options)

    def is_monotonic(self, column: str, increasing: bool = True, strict: bool = False) -> DataFrame:
        return windowing.is_monotonic(self.df, self.order, column, increasing, strict, self.by)

    def corrwith(self, columns: Sequence[str], other: str) -> DataFrame:
        return self._done(self.df.groupBy(*self.by).agg(*[S.corr(F.col(f"`{c}`"), F.col(f"`{other}`")).alias(c) for c in columns]))

    def mode(self, column: str) -> DataFrame:
        """All commonest values of each group."""
        n = self.df.filter(F.col(column).isNotNull()).groupBy(*self.by, column).agg(F.count(F.lit(1)).alias("__n"))
        return n.withColumn("__most", F.max("__n").over(Window.partitionBy(*self.by))).filter("__n = __most").drop("__n", "__most")

    def dtypes(self) -> list[tuple[str, str]]:
        return [x for x in self.df.dtypes if x[0] not in self.by]
