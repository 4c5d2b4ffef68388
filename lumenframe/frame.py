"""The labelled, ordered frame: `Frame` and `Series` over Spark DataFrames.

A frame is a lazy Spark DataFrame with the names of its index columns and of the columns that its rows are ordered by. Both are
plain columns; an order that nobody named is a hidden column of increasing numbers that costs nothing until it is used.
A series is an expression over a frame; series over the same rows combine in one projection, others meet on the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import categories, dates, nested, strings
from lumenframe.functions import elementwise as E
from lumenframe.functions import statistics as S
from lumenframe.operators import aggregating, joining, resampling, reshaping, selecting, sorting, udfs, windowing
from lumenframe.operators.grouping import Groups
from lumenframe.plans import expressions
from lumenframe.sources import readers, writers

ORDER = "__ord__"
RESULT = "__value"


def _list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class Frame:
    def __init__(self, sdf: DataFrame, index: str | Sequence[str] | None = None, order: str | Sequence[str] | None = None, rows: object = None, base: Frame | None = None):
        self.base = base
        self.order = _list(order)
        if not self.order:
            self.order = [ORDER]
            if ORDER not in sdf.columns:
                sdf = sdf.withColumn(ORDER, F.monotonically_increasing_id())
        self.sdf, self.index = sdf, _list(index)
        self.rows = rows or object()

    @staticmethod
    def of(data: DataFrame | pd.DataFrame | dict, spark: SparkSession | None = None, index: str | Sequence[str] | None = None, order: str | Sequence[str] | None = None) -> Frame:
        """From a Spark frame (NaN becomes missing), a pandas frame or a dict of lists."""
        if isinstance(data, DataFrame):
            return Frame(readers.without_nan(data), index, order)
        spark = spark or SparkSession.getActiveSession()
        pdf = pd.DataFrame(data) if isinstance(data, dict) else data
        return Frame(readers.from_pandas(spark, pdf.assign(**{ORDER: range(len(pdf))})), index, order)

    def _new(self, sdf: DataFrame, same_rows: bool = False, index: Sequence[str] | None = None, order: Sequence[str] | None = None, adds: bool = False) -> Frame:
        """`adds`: the columns of this frame are all there unchanged, and the rows too."""
        index = self.index if index is None else index
        order = self.order if order is None else order
        return Frame(sdf, [c for c in index if c in sdf.columns], [c for c in order if c in sdf.columns], self.rows if same_rows else None, self if adds else None)

    def _extends(self, other: Frame) -> bool:
        f: Frame | None = self
        while f is not None:
            if f.sdf is other.sdf:
                return True
            f = f.base
        return False

    # Metadata

    @property
    def columns(self) -> list[str]:
        return [c for c in self.sdf.columns if c not in self.index and not c.startswith("__")]

    def keys(self) -> list[str]:
        return self.columns

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k for c, k in self.sdf.dtypes if c in self.columns}

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def size(self) -> int:
        return len(self) * len(self.columns)

    ndim = 2

    @property
    def empty(self) -> bool:
        return not self.columns or self.sdf.isEmpty()

    def __len__(self) -> int:
        return self.sdf.count()

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def _visible(self) -> DataFrame:
        return self.sdf.select(*[f"`{c}`" for c in (*self.index, *self.columns)])

    def spark(self) -> DataFrame:
        """Index columns and columns, without what is hidden."""
        return self._visible()

    def to_pandas(self) -> pd.DataFrame:
        """All rows to the driver, in order."""
        pdf = self.sdf.orderBy(*sorting.keys(self.order)).select(*[f"`{c}`" for c in (*self.index, *self.columns)]).toPandas()
        return pdf.set_index(self.index) if self.index else pdf

    def to_numpy(self) -> object:
        return self.to_pandas().to_numpy()

    def items(self) -> Iterator[tuple[str, Series]]:
        return ((c, self[c]) for c in self.columns)

    def iterrows(self) -> Iterator[tuple]:
        for k, r in enumerate(self.sdf.orderBy(*sorting.keys(self.order)).toLocalIterator()):
            yield (tuple(r[c] for c in self.index) if self.index else k), {c: r[c] for c in self.columns}

    def itertuples(self) -> Iterator[tuple]:
        for label, r in self.iterrows():
            yield (label, *r.values())

    def info(self) -> Frame:
        return Frame(selecting.info(self._visible()))

    def memory_usage(self) -> Frame:
        return Frame(selecting.memory_usage(self._visible()))

    def copy(self) -> Frame:
        return self._new(self.sdf, True)

    def pipe(self, func: Callable, *args: object, **options: object) -> object:
        return func(self, *args, **options)

    # Selection

    def __getitem__(self, key: object) -> Series | Frame:
        if isinstance(key, str):
            if key not in self.sdf.columns:
                raise KeyError(key)
            return Series(self, F.col(f"`{key}`"), key)
        if isinstance(key, Series):
            return self._new(self._onto(key)[0].filter(F.coalesce(self._onto(key)[1], F.lit(False))).select(*[f"`{c}`" for c in self.sdf.columns]))
        if isinstance(key, Column):
            return self._new(self.sdf.filter(key))
        if isinstance(key, slice):
            return self.iloc(key)
        return self._new(self.sdf.select(*dict.fromkeys([*self.index, *self.order, *key])), True)

    def __getattr__(self, name: str) -> Series:
        if not name.startswith("_") and "sdf" in self.__dict__ and name in self.sdf.columns:
            return self[name]
        raise AttributeError(name)

    def _onto(self, s: Series) -> tuple[DataFrame, Column]:
        """A DataFrame that has this frame's columns, and an expression for the series over it."""
        if s.frame.sdf is self.sdf:
            return self.sdf, s.col
        if s.frame._extends(self):
            return s.frame.sdf, s.col
        if self._extends(s.frame):
            return self.sdf, s.col
        on = self.order if s.frame.rows is self.rows and self.order == s.frame.order else self.index
        if not on or (on is self.index and s.frame.index != self.index):
            raise ValueError("series of other rows need a shared index")
        other = s.frame.sdf.select(*on, s.col.alias(RESULT))
        return self.sdf.join(other, list(on), "left"), F.col(RESULT)

    def assign(self, **columns: object) -> Frame:
        out = self
        for name, value in columns.items():
            if isinstance(value, Frame):
                raise TypeError("a column needs a series")
            value = value(out) if callable(value) and not isinstance(value, Column | Series) else value
            if isinstance(value, Series):
                sdf, c = out._onto(value)
                keep = out.sdf.columns
                out = out._new(sdf.withColumn(name, c).select(*[f"`{x}`" for x in dict.fromkeys([*keep, name])]), True, adds=name not in keep)
            else:
                out = out._new(out.sdf.withColumn(name, value if isinstance(value, Column) else F.lit(value)), True, adds=name not in out.sdf.columns)
        return out

    def insert(self, at: int, name: str, value: object) -> Frame:
        if name in self.columns:
            raise ValueError(f"{name} is there already")
        out = self.assign(**{name: value})
        cols = [c for c in out.columns if c != name]
        cols.insert(at, name)
        return out._new(out.sdf.select(*[c for c in out.sdf.columns if c not in cols], *cols), True)

    def loc(self, label: object, columns: str | Sequence[str] | None = None) -> Frame:
        if isinstance(label, Series):
            out = self[label]
        elif not self.index:
            return self.iloc(slice(label.start, None if label.stop is None else label.stop + 1, label.step) if isinstance(label, slice) else label)
        else:
            out = self._new(selecting.loc(self.sdf, self.index[0], label))
        return out[_list(columns)] if columns else out

    def iloc(self, at: object) -> Frame:
        return self._new(selecting.iloc(self.sdf, at, self.order))

    take = iloc

    def at(self, label: object, column: str) -> object:
        return selecting.at(self.sdf, self.index[0], label, column)

    def iat(self, row: int, column: int) -> object:
        return selecting.iat(self.sdf, row, self.columns[column], self.order)

    def xs(self, key: object, level: str | None = None, drop_level: bool = True) -> Frame:
        return self._new(selecting.xs(self.sdf, key, level or self.index[0], drop_level))

    def get(self, name: str, default: object = None) -> object:
        return self[name] if name in self.columns else default

    def head(self, n: int = 5) -> Frame:
        return self._new(sorting.head(self.sdf, n, self.order))

    def tail(self, n: int = 5) -> Frame:
        return self._new(sorting.tail(self.sdf, n, self.order))

    def query(self, text: str, **names: object) -> Frame:
        return self._new(expressions.query(self.sdf, text, **names))

    def eval(self, text: str, **names: object) -> Frame | Series:
        out = expressions.evaluate(self.sdf, text, **names)
        return self._new(out, True) if isinstance(out, DataFrame) else Series(self, out, None)

    def filter(self, items: Sequence[str] | None = None, like: str | None = None, regex: str | None = None) -> Frame:
        return self[selecting.filter_labels(self.sdf.select(*[f"`{c}`" for c in self.columns]), items, like, regex).columns]

    def select_dtypes(self, include: object = (), exclude: object = ()) -> Frame:
        return self[selecting.select_dtypes(self.sdf.select(*[f"`{c}`" for c in self.columns]), include, exclude).columns]

    def drop(self, labels: object = None, columns: str | Sequence[str] | None = None) -> Frame:
        if columns is not None:
            return self._new(self.sdf.drop(*_list(columns)), True)
        return self._new(selecting.drop_rows(self.sdf, self.index[0], labels if isinstance(labels, list | tuple) else [labels]))

    def pop(self, name: str) -> tuple[Series, Frame]:
        return self[name], self.drop(columns=name)

    def rename(self, columns: dict | Callable) -> Frame:
        names = columns if isinstance(columns, dict) else {c: columns(c) for c in self.columns}
        order = [names.get(c, c) for c in self.order]
        return self._new(self.sdf.withColumnsRenamed(names), True, [names.get(c, c) for c in self.index], order)

    def set_axis(self, names: Sequence[str]) -> Frame:
        return self.rename(dict(zip(self.columns, names, strict=True)))

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename(lambda c: prefix + c)

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename(lambda c: c + suffix)

    def rename_axis(self, names: str | Sequence[str]) -> Frame:
        return self._new(self.sdf.withColumnsRenamed(dict(zip(self.index, _list(names), strict=True))), True, _list(names))

    def set_index(self, columns: str | Sequence[str], append: bool = False, verify_integrity: bool = False) -> Frame:
        index = [*self.index, *_list(columns)] if append else _list(columns)
        if verify_integrity and self.sdf.groupBy(*index).count().filter("count > 1").limit(1).count():
            raise ValueError("index has duplicate keys")
        return self._new(self.sdf, True, index)

    def reset_index(self, drop: bool = False) -> Frame:
        return self._new(self.sdf.drop(*[c for c in self.index if c not in self.order]) if drop else self.sdf, True, [])

    def droplevel(self, level: str) -> Frame:
        return self._new(self.sdf.drop(level), True, [c for c in self.index if c != level])

    def reorder_levels(self, order: Sequence[str]) -> Frame:
        return self._new(self.sdf, True, list(order))

    def swaplevel(self, a: int = -2, b: int = -1) -> Frame:
        index = list(self.index)
        index[a], index[b] = index[b], index[a]
        return self._new(self.sdf, True, index)

    def reindex(self, labels: Sequence, fill_value: object = None, method: str | None = None) -> Frame:
        return Frame(selecting.reindex(self._visible(), self.index[0], labels, fill_value, method), self.index)

    def align(self, other: Frame, join: str = "outer") -> tuple[Frame, Frame]:
        a, b = joining.align(self._visible(), other._visible(), self.index, join)
        return Frame(a, self.index, self.index), Frame(b, self.index, self.index)

    def truncate(self, before: object = None, after: object = None) -> Frame:
        return self._new(selecting.truncate(self.sdf, self.index[0], before, after))

    def between_time(self, start: str, end: str, on: str | None = None, inclusive: str = "both") -> Frame:
        return self._new(selecting.between_time(self.sdf, on or self.index[0], start, end, inclusive))

    def at_time(self, time: str, on: str | None = None) -> Frame:
        return self._new(selecting.at_time(self.sdf, on or self.index[0], time))

    def first(self, span: str, on: str | None = None) -> Frame:
        return self._new(selecting.first_span(self.sdf, on or self.index[0], windowing.span_micros(span)))

    def last(self, span: str, on: str | None = None) -> Frame:
        return self._new(selecting.first_span(self.sdf, on or self.index[0], windowing.span_micros(span), True))

    def sample(self, n: int | None = None, frac: float | None = None, replace: bool = False, weights: str | None = None, random_state: int = 0) -> Frame:
        return self._new(selecting.sample(self.sdf, n, frac, replace, weights, random_state))

    def astype(self, kinds: str | dict[str, str], errors: str = "raise") -> Frame:
        kinds = kinds if isinstance(kinds, dict) else dict.fromkeys(self.columns, kinds)
        return self._new(self.sdf.withColumns({c: F.col(f"`{c}`").cast(k) if errors == "raise" else F.col(f"`{c}`").try_cast(k) for c, k in kinds.items()}), True)

    def convert_dtypes(self) -> Frame:
        return self._new(selecting.infer_types(self.sdf, [c for c, k in self.dtypes.items() if k == "string"]), True)

    infer_objects = convert_dtypes

    # Missing values and element-wise work

    def _each(self, f: Callable[[Column], Column], columns: Sequence[str] | None = None) -> Frame:
        return self._new(self.sdf.withColumns({c: f(F.col(f"`{c}`")) for c in columns or self.columns}), True)

    def isna(self) -> Frame:
        return self._each(E.isna)

    isnull = isna

    def notna(self) -> Frame:
        return self._each(E.notna)

    notnull = notna

    def dropna(self, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None, axis: int = 0) -> Frame:
        if axis == 1:
            return self[selecting.dropna_columns(self.sdf.select(*[f"`{c}`" for c in self.columns]), how, thresh).columns]
        return self._new(selecting.dropna(self.sdf, how, thresh, subset or self.columns))

    def fillna(self, value: object = None, method: str | None = None, limit: int | None = None) -> Frame:
        if method:
            return self._new(windowing.fill(self.sdf, self.order, self.columns, {"pad": "ffill", "backfill": "bfill"}.get(method, method), limit), True)
        return self._new(self.sdf.fillna(value) if isinstance(value, dict) else self.sdf.fillna(value, self.columns), True)

    def ffill(self, limit: int | None = None) -> Frame:
        return self.fillna(method="ffill", limit=limit)

    def bfill(self, limit: int | None = None) -> Frame:
        return self.fillna(method="bfill", limit=limit)

    pad, backfill = ffill, bfill

    def interpolate(self, columns: Sequence[str] | None = None) -> Frame:
        sdf = self.sdf
        for c in columns or aggregating.numeric(self.sdf.select(*self.columns)):
            sdf = windowing.interpolate(sdf, self.order, c)
        return self._new(sdf, True)

    def replace(self, values: dict) -> Frame:
        return self._each(lambda c: E.replace(c, values))

    def clip(self, lower: object = None, upper: object = None) -> Frame:
        return self._each(lambda c: E.clip(c, lower, upper))

    def abs(self) -> Frame:
        return self._each(F.abs)

    def round(self, decimals: int | dict[str, int] = 0) -> Frame:
        if isinstance(decimals, dict):
            return self._new(self.sdf.withColumns({c: E.round_(F.col(f"`{c}`"), d) for c, d in decimals.items()}), True)
        return self._each(lambda c: E.round_(c, decimals), aggregating.numeric(self.sdf.select(*self.columns)))

    def isin(self, values: Sequence | dict) -> Frame:
        if isinstance(values, dict):
            return self._new(self.sdf.withColumns({c: E.isin(F.col(f"`{c}`"), values[c]) if c in values else F.lit(False) for c in self.columns}), True)
        return self._each(lambda c: E.isin(c, values))

    def where(self, condition: Series | Column, other: object = None) -> Frame:
        c = condition.col if isinstance(condition, Series) else condition
        return self._each(lambda x: E.where(x, c, other))

    def mask(self, condition: Series | Column, other: object = None) -> Frame:
        c = condition.col if isinstance(condition, Series) else condition
        return self._each(lambda x: E.mask(x, c, other))

    def _arith(self, f: Callable, other: object, fill: object = None) -> Frame:
        if isinstance(other, Frame):
            shared = [c for c in self.columns if c in other.columns]
            if other.sdf is self.sdf:
                return self._each_pair(f, shared, fill)
            out = joining.combine(self._visible(), other._visible(), self.index, lambda a, b: f(a, b, fill) if fill is not None else f(a, b))
            return Frame(out, self.index, self.index)
        c = other.col if isinstance(other, Series) else other
        return self._each(lambda x: f(x, c, fill) if fill is not None else f(x, c))

    def _each_pair(self, f: Callable, shared: Sequence[str], fill: object) -> Frame:
        return self._new(self.sdf.withColumns({c: f(F.col(f"`{c}`"), F.col(f"`{c}`"), *([fill] if fill is not None else [])) for c in shared}), True)

    def map(self, func: Callable, kind: str = "double") -> Frame:
        return self._new(udfs.applymap(self.sdf, func, self.columns, kind), True)

    applymap = map

    def apply(self, func: str | Callable | dict | list, axis: int = 0, schema: object = None) -> Frame:
        """axis 0: aggregates by name, list or dict; axis 1: a Python function of each row with the schema of its result."""
        if axis in (1, "columns"):
            return Frame(udfs.apply_rows(self._visible(), func, schema))
        return self.agg(func)

    def transform(self, func: Callable[[Series], Series]) -> Frame:
        return self.assign(**{c: func(self[c]) for c in self.columns})

    # Aggregates

    def agg(self, spec: object) -> Frame:
        if isinstance(spec, str):
            return self._reduced(spec)
        return Frame(aggregating.agg(self.sdf, spec, None if isinstance(spec, dict) else aggregating.numeric(self.sdf.select(*self.columns))), "aggregate")

    aggregate = agg

    def _reduced(self, how: str, axis: int = 0, skipna: bool = True, numeric_only: bool = False, **options: object) -> Frame | Series:
        own = self.sdf.select(*[f"`{c}`" for c in self.columns])
        if axis in (1, "columns"):
            return Series(self, E.horizontal([F.col(f"`{c}`") for c in aggregating.numeric(own)], how), how)
        columns = aggregating.numeric(own) if numeric_only or how not in ("count", "nunique", "min", "max", "null_count", "any", "all") else self.columns
        return Frame(aggregating.reduce_columns(own, how, columns, skipna, **options))

    def describe(self, percentiles: Sequence[float] = (0.25, 0.5, 0.75), include: str = "number") -> Frame:
        own = self.sdf.select(*[f"`{c}`" for c in self.columns])
        if include == "object":
            return Frame(aggregating.describe_objects(own, [c for c, k in own.dtypes if k == "string"]), "column")
        return Frame(aggregating.describe(own, percentiles=percentiles), "column")

    def quantile(self, q: float = 0.5, interpolation: str = "linear") -> Frame:
        return self._reduced("quantile", q=q, interpolation=interpolation)

    def nunique(self, dropna: bool = True) -> Frame:
        return self._reduced("nunique", dropna=dropna)

    def mode(self, column: str) -> Frame:
        return Frame(aggregating.mode(self.sdf, column))

    def idxmax(self) -> Frame:
        return Frame(aggregating.extreme_label(self.sdf, aggregating.numeric(self.sdf.select(*self.columns)), self.index[0], self.order[0]))

    def idxmin(self) -> Frame:
        return Frame(aggregating.extreme_label(self.sdf, aggregating.numeric(self.sdf.select(*self.columns)), self.index[0], self.order[0], False))

    def corr(self, method: str = "pearson", min_periods: int = 1) -> Frame:
        return Frame(aggregating.corr(self.sdf.select(*self.columns), None, method, min_periods))

    def cov(self, ddof: int = 1) -> Frame:
        return Frame(aggregating.cov(self.sdf.select(*self.columns), None, ddof))

    def corrwith(self, other: Frame) -> Frame:
        shared = [c for c in aggregating.numeric(self.sdf.select(*self.columns)) if c in other.columns]
        return Frame(joining.corrwith(self.sdf, other.sdf, self.index, shared))

    def value_counts(self, subset: str | Sequence[str] | None = None, normalize: bool = False, dropna: bool = True, ascending: bool = False) -> Frame:
        return Frame(reshaping.value_counts(self.sdf, subset or self.columns, normalize, dropna, True, ascending))

    def duplicated(self, subset: str | Sequence[str] | None = None, keep: str | bool = "first") -> Series:
        sdf = reshaping.duplicated(self.sdf, subset or self.columns, self.order, "__duplicated", keep)
        return Series(self._new(sdf, True, adds=True), F.col("__duplicated"), "duplicated")

    def drop_duplicates(self, subset: str | Sequence[str] | None = None, keep: str | bool = "first") -> Frame:
        return self._new(reshaping.drop_duplicates(self.sdf, subset or self.columns, self.order, keep))

    def equals(self, other: Frame) -> bool:
        return selecting.equals(self._visible(), other._visible())

    def compare(self, other: Frame) -> Frame:
        return Frame(selecting.compare(self._visible(), other._visible(), self.index[0]))

    # Order

    def sort_values(self, by: str | Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", key: Callable | None = None) -> Frame:
        """The order is part of the frame: what follows sees it as positions."""
        from lumenframe.plans.ordering import positions

        placed = positions(self.sdf, [*sorting.order_keys(by, ascending, na_position, key), *sorting.keys(self.order)], "__sorted")
        return self._new(placed.drop(ORDER) if self.order == [ORDER] else placed, False, None, ["__sorted"])

    def sort_index(self, ascending: bool = True) -> Frame:
        return self.sort_values(self.index, ascending)

    def nlargest(self, n: int, columns: str | Sequence[str], keep: str = "first") -> Frame:
        return self._new(sorting.nlargest(self.sdf, n, columns, keep, self.order))

    def nsmallest(self, n: int, columns: str | Sequence[str], keep: str = "first") -> Frame:
        return self._new(sorting.nsmallest(self.sdf, n, columns, keep, self.order))

    # Joins

    def merge(self, right: Frame, how: str = "inner", on: object = None, left_on: object = None, right_on: object = None, left_index: bool = False, right_index: bool = False, suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool | str = False, validate: str | None = None) -> Frame:
        lo = self.index if left_index else left_on
        ro = right.index if right_index else right_on
        return Frame(joining.merge(self._visible(), right._visible(), how, on, lo, ro, suffixes, indicator, validate))

    def join(self, other: Frame | Sequence[Frame], how: str = "left", lsuffix: str = "", rsuffix: str = "") -> Frame:
        out = self
        for o in [other] if isinstance(other, Frame) else other:
            out = Frame(joining.join_index(out._visible(), o._visible(), self.index, how, lsuffix, rsuffix), self.index, self.index)
        return out

    def update(self, other: Frame) -> Frame:
        return Frame(joining.overlay(self._visible(), other._visible(), self.index), self.index, self.index)

    def combine_first(self, other: Frame) -> Frame:
        return Frame(joining.overlay(self._visible(), other._visible(), self.index, "combine_first"), self.index, self.index)

    def combine(self, other: Frame, func: Callable, fill_value: float | None = None) -> Frame:
        return Frame(joining.combine(self._visible(), other._visible(), self.index, func, fill_value), self.index, self.index)

    def asof(self, where: Frame, on: str) -> Frame:
        return Frame(joining.merge_asof(where._visible(), self._visible(), on=on))

    # Reshapes

    def melt(self, id_vars: object = None, value_vars: object = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return Frame(reshaping.melt(self.sdf.select(*self.columns), id_vars, value_vars, var_name, value_name))

    def pivot(self, index: object, columns: str, values: object) -> Frame:
        return Frame(reshaping.pivot(self.sdf, index, columns, values), index, index)

    def pivot_table(self, values: str, index: object, columns: str, aggfunc: str = "mean", fill_value: object = None, margins: bool = False) -> Frame:
        return Frame(reshaping.pivot_table(self.sdf, values, index, columns, aggfunc, fill_value, margins), index, index)

    def stack(self) -> Frame:
        return Frame(reshaping.stack(self._visible(), self.index), [*self.index, "level"])

    def unstack(self, level: str, value: str) -> Frame:
        rest = [c for c in self.index if c != level]
        return Frame(reshaping.unstack(self._visible(), rest, level, value), rest, rest)

    def explode(self, columns: str | Sequence[str]) -> Frame:
        return self._new(reshaping.explode(self.sdf, columns))

    def transpose(self) -> Frame:
        return Frame(reshaping.transpose(self._visible(), self.index[0]), "key")

    T = property(transpose)

    # Windows and groups

    def groupby(self, by: str | Sequence[str] | None = None, level: str | None = None, as_index: bool = True, sort: bool = True, dropna: bool = True) -> GroupBy:
        return GroupBy(self, _list(by) or _list(level) or self.index, as_index, sort, dropna)

    def rolling(self, window: int | str, min_periods: int | None = None, center: bool = False, on: str | None = None, closed: str | None = None, step: int = 1) -> Rolling:
        return Rolling(self, (), "rolling", window=window, min_periods=min_periods, center=center, on=on, closed=closed, step=step)

    def expanding(self, min_periods: int = 1) -> Rolling:
        return Rolling(self, (), "expanding", min_periods=min_periods)

    def ewm(self, column: str, name: str | None = None, alpha: float | None = None, span: float | None = None, com: float | None = None, halflife: float | None = None) -> Frame:
        """The adjusted exponentially weighted mean of a column, under its name or another."""
        out = windowing.ewm(self.sdf, self.order, column, name or "__ewm", (), alpha, span, com, halflife)
        return self._new(out if name else out.withColumn(column, F.col("__ewm")).drop("__ewm"), True)

    def squeeze(self) -> Frame | Series | object:
        """A series if there is one column, its value if there is one row too."""
        if len(self.columns) != 1:
            return self
        one = self[self.columns[0]]
        rows = self.sdf.select(one.col).limit(2).collect()
        return rows[0][0] if len(rows) == 1 else one

    def swapaxes(self) -> Frame:
        return self.transpose()

    def resample(self, rule: str, on: str | None = None, closed: str = "left", label: str = "left") -> Resampler:
        return Resampler(self, rule, on or self.index[0], closed, label)

    def _cumulative(self, how: str) -> Frame:
        columns = aggregating.numeric(self.sdf.select(*self.columns))
        out = windowing.cumulative(self.sdf, self.order, {f"__o_{c}": (how, c) for c in columns})
        return self._new(out.withColumns({c: F.col(f"__o_{c}") for c in columns}).drop(*[f"__o_{c}" for c in columns]), True)

    def cumsum(self) -> Frame:
        return self._cumulative("cumsum")

    def cumprod(self) -> Frame:
        return self._cumulative("cumprod")

    def cummax(self) -> Frame:
        return self._cumulative("cummax")

    def cummin(self) -> Frame:
        return self._cumulative("cummin")

    def _windowed(self, f: Callable, **options: object) -> Frame:
        columns = aggregating.numeric(self.sdf.select(*self.columns))
        out = f(self.sdf, self.order, {f"__o_{c}": c for c in columns}, **options)
        return self._new(out.withColumns({c: F.col(f"__o_{c}") for c in columns}).drop(*[f"__o_{c}" for c in columns]), True)

    def shift(self, periods: int = 1, fill_value: object = None) -> Frame:
        out = windowing.shift(self.sdf, self.order, {f"__o_{c}": c for c in self.columns}, periods, fill=fill_value)
        return self._new(out.withColumns({c: F.col(f"__o_{c}") for c in self.columns}).drop(*[f"__o_{c}" for c in self.columns]), True)

    def diff(self, periods: int = 1) -> Frame:
        return self._windowed(windowing.diff, periods=periods)

    def pct_change(self, periods: int = 1) -> Frame:
        return self._windowed(windowing.pct_change, periods=periods)

    def rank(self, method: str = "average", ascending: bool = True, pct: bool = False) -> Frame:
        sdf = self.sdf
        columns = aggregating.numeric(self.sdf.select(*self.columns))
        for c in columns:
            sdf = windowing.rank(sdf, c, f"__o_{c}", method, ascending, pct, order=self.order)
        return self._new(sdf.withColumns({c: F.col(f"__o_{c}") for c in columns}).drop(*[f"__o_{c}" for c in columns]), True)

    def to_csv(self, path: str, **options: object) -> None:
        writers.to_csv(self.sdf.orderBy(*sorting.keys(self.order)).select(*self.index, *self.columns), path, **options)

    def to_parquet(self, path: str, **options: object) -> None:
        writers.to_parquet(self._visible(), path, **options)

    def to_dict(self, orient: str = "dict") -> object:
        return self.to_pandas().to_dict(orient)


def _binary(f: Callable) -> Callable:
    def method(self: Frame | Series, other: object, fill_value: object = None) -> Frame | Series:
        return self._arith(f, other, fill_value)

    return method


_OPERATORS = {
    "add": E.add, "radd": E.radd, "sub": E.sub, "rsub": E.rsub, "mul": E.mul, "rmul": E.rmul, "truediv": E.truediv, "rtruediv": E.rtruediv, "floordiv": E.floordiv, "rfloordiv": E.rfloordiv, "mod": E.mod, "rmod": E.rmod, "pow": E.power, "rpow": E.rpow,
    "eq": E.eq, "ne": E.ne, "lt": E.lt, "le": E.le, "gt": E.gt, "ge": E.ge,
}
_REDUCTIONS = ("count", "sum", "prod", "mean", "median", "min", "max", "any", "all", "var", "std", "sem", "skew", "kurt")


class Series:
    def __init__(self, frame: Frame, col: Column, name: str | None):
        self.frame, self.col, self.name = frame, col, name

    def _like(self, col: Column, name: str | None = None) -> Series:
        return Series(self.frame, col, name or self.name)

    def _ordered(self, f: Callable[[DataFrame, list[str]], DataFrame], result: str = RESULT) -> Series:
        """A window over the value, which becomes a hidden column of the frame."""
        n = sum(c.startswith("__in") for c in self.frame.sdf.columns)
        sdf = f(self.frame.sdf.withColumn(f"__in{n}", self.col), f"__in{n}", f"__out{n}")
        return Series(self.frame._new(sdf, True, adds=True), F.col(f"__out{n}"), self.name)

    def _arith(self, f: Callable, other: object, fill: object = None) -> Series:
        if isinstance(other, Series):
            sdf, c = self.frame._onto(other)
            base = self.frame if sdf is self.frame.sdf else self.frame._new(sdf, True, adds=True)
            return Series(base, f(self.col, c, fill) if fill is not None else f(self.col, c), self.name if self.name == other.name else None)
        return self._like(f(self.col, other, fill) if fill is not None else f(self.col, other))

    def to_frame(self, name: str | None = None) -> Frame:
        name = name or self.name or "value"
        keep = [*self.frame.index, *(c for c in self.frame.order if c != name)]
        return self.frame._new(self.frame.sdf.select(*dict.fromkeys(keep), self.col.alias(name)), True)

    def to_pandas(self) -> pd.Series:
        return self.to_frame(self.name or "value").to_pandas()[self.name or "value"]

    def to_list(self) -> list:
        return self.to_pandas().tolist()

    tolist = to_list

    def rename(self, name: str) -> Series:
        return Series(self.frame, self.col, name)

    def _value(self, c: Column) -> object:
        return self.frame.sdf.agg(c).first()[0]

    def agg(self, how: str | list[str], **options: object) -> object:
        if how == "median":
            return self.quantile()
        if isinstance(how, str):
            return self._value(S.aggregate(how, self.col, **options))
        row = self.frame.sdf.agg(*[S.aggregate(h, self.col).alias(h) for h in how]).first()
        return row.asDict()

    aggregate = agg

    def quantile(self, q: float = 0.5, interpolation: str = "linear") -> float:
        return aggregating.quantiles(self.frame.sdf.select(self.col.alias(RESULT)), [RESULT], [q], interpolation)[RESULT][0]

    def nunique(self, dropna: bool = True) -> int:
        return self.agg("nunique", dropna=dropna)

    def idxmax(self) -> object:
        return self._value(S.arg_extreme(F.col(self.frame.index[0]), self.col, F.col(self.frame.order[0])))

    def idxmin(self) -> object:
        return self._value(S.arg_extreme(F.col(self.frame.index[0]), self.col, F.col(self.frame.order[0]), False))

    def argmax(self) -> int:
        return aggregating.arg_extreme(self.to_frame(RESULT).sdf, RESULT, self.frame.order)

    def argmin(self) -> int:
        return aggregating.arg_extreme(self.to_frame(RESULT).sdf, RESULT, self.frame.order, False)

    def corr(self, other: Series) -> float:
        sdf, c = self.frame._onto(other)
        return sdf.agg(S.corr(self.col, c)).first()[0]

    def cov(self, other: Series, ddof: int = 1) -> float:
        sdf, c = self.frame._onto(other)
        return sdf.agg(S.covar(self.col, c, ddof)).first()[0]

    def autocorr(self, lag: int = 1) -> float:
        return aggregating.autocorr(self.to_frame(RESULT).sdf, RESULT, self.frame.order, lag).first()[0]

    def dot(self, other: Series) -> float:
        sdf, c = self.frame._onto(other)
        return sdf.agg(F.sum(self.col * c)).first()[0]

    def value_counts(self, normalize: bool = False, dropna: bool = True, ascending: bool = False, bins: int | None = None) -> Frame:
        name = self.name or "value"
        return Frame(reshaping.value_counts(self.frame.sdf.select(self.col.alias(name)), name, normalize, dropna, True, ascending, bins), name if not bins else "bin")

    def unique(self) -> list:
        f = self.to_frame(RESULT)
        return [r[0] for r in reshaping.unique(f.sdf, RESULT, f.order).orderBy("first_seen").collect()]

    def mode(self) -> list:
        return sorted(r[0] for r in aggregating.mode(self.frame.sdf.select(self.col.alias(RESULT)), RESULT).collect())

    def describe(self) -> dict:
        return aggregating.describe(self.frame.sdf.select(self.col.alias("value")), ["value"]).drop("column").first().asDict()

    @property
    def is_unique(self) -> bool:
        return aggregating.is_unique(self.frame.sdf.select(self.col.alias(RESULT)), RESULT).first()[0]

    @property
    def hasnans(self) -> bool:
        return bool(self._value(F.coalesce(F.bool_or(self.col.isNull()), F.lit(False))))

    def _monotonic(self, up: bool) -> bool:
        f = self.to_frame(RESULT)
        return windowing.is_monotonic(f.sdf, f.order, RESULT, up).first()[0]

    @property
    def is_monotonic_increasing(self) -> bool:
        return self._monotonic(True)

    @property
    def is_monotonic_decreasing(self) -> bool:
        return self._monotonic(False)

    # Element-wise

    def isna(self) -> Series:
        return self._like(E.isna(self.col))

    isnull = isna

    def notna(self) -> Series:
        return self._like(E.notna(self.col))

    notnull = notna

    def fillna(self, value: object) -> Series:
        return self._like(E.fillna(self.col, value))

    def dropna(self) -> Series:
        return Series(self.frame._new(self.frame.sdf.filter(self.col.isNotNull())), self.col, self.name)

    def isin(self, values: Sequence) -> Series:
        return self._like(E.isin(self.col, values))

    def between(self, left: object, right: object, inclusive: str = "both") -> Series:
        return self._like(E.between(self.col, left, right, inclusive))

    def where(self, condition: Series, other: object = None) -> Series:
        return self._like(E.where(self.col, condition.col, other.col if isinstance(other, Series) else other))

    def mask(self, condition: Series, other: object = None) -> Series:
        return self._like(E.mask(self.col, condition.col, other.col if isinstance(other, Series) else other))

    def case_when(self, cases: Sequence[tuple[Series, object]]) -> Series:
        return self._like(E.case_when(self.col, [(c.col, v.col if isinstance(v, Series) else v) for c, v in cases]))

    def clip(self, lower: object = None, upper: object = None) -> Series:
        return self._like(E.clip(self.col, lower, upper))

    def replace(self, values: dict) -> Series:
        return self._like(E.replace(self.col, values))

    def map(self, func: dict | Callable, kind: str = "double") -> Series:
        return self._like(E.map_values(self.col, func) if isinstance(func, dict) else udfs.map_elements(self.col, func, kind))

    apply = map

    def abs(self) -> Series:
        return self._like(F.abs(self.col))

    def round(self, decimals: int = 0) -> Series:
        return self._like(E.round_(self.col, decimals))

    def astype(self, kind: str, errors: str = "raise") -> Series:
        return self._like(self.col.cast(kind) if errors == "raise" else self.col.try_cast(kind))

    def repeat(self, n: int) -> Series:
        return Series(self.frame._new(reshaping.repeat(self.frame.sdf, n)), self.col, self.name)

    def explode(self) -> Series:
        f = self.to_frame(self.name or "value")
        return f.explode(self.name or "value")[self.name or "value"]

    # Windows

    def _cumulative(self, how: str) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.cumulative(sdf, self.frame.order, {o: (how, i)}))

    def cumsum(self) -> Series:
        return self._cumulative("cumsum")

    def cumprod(self) -> Series:
        return self._cumulative("cumprod")

    def cummax(self) -> Series:
        return self._cumulative("cummax")

    def cummin(self) -> Series:
        return self._cumulative("cummin")

    def shift(self, periods: int = 1, fill_value: object = None) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.shift(sdf, self.frame.order, {o: i}, periods, fill=fill_value))

    def diff(self, periods: int = 1) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.diff(sdf, self.frame.order, {o: i}, periods))

    def pct_change(self, periods: int = 1) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.pct_change(sdf, self.frame.order, {o: i}, periods))

    def rank(self, method: str = "average", ascending: bool = True, pct: bool = False) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.rank(sdf, i, o, method, ascending, pct, order=self.frame.order))

    def ffill(self, limit: int | None = None) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.fill(sdf.withColumn(o, F.col(i)), self.frame.order, [o], "ffill", limit))

    def bfill(self, limit: int | None = None) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.fill(sdf.withColumn(o, F.col(i)), self.frame.order, [o], "bfill", limit))

    def interpolate(self) -> Series:
        return self._ordered(lambda sdf, i, o: windowing.interpolate(sdf.withColumn(o, F.col(i)), self.frame.order, o))

    def rolling(self, window: int | str, min_periods: int | None = None, center: bool = False, on: str | None = None) -> Rolling:
        f = self.to_frame(self.name or "value")
        return Rolling(f, (), "rolling", window=window, min_periods=min_periods, center=center, on=on)

    def expanding(self, min_periods: int = 1) -> Rolling:
        return Rolling(self.to_frame(self.name or "value"), (), "expanding", min_periods=min_periods)

    def duplicated(self, keep: str | bool = "first") -> Series:
        return self._ordered(lambda sdf, i, o: reshaping.duplicated(sdf, i, self.frame.order, o, keep))

    def drop_duplicates(self, keep: str | bool = "first") -> Series:
        f = self.to_frame(self.name or "value")
        return f.drop_duplicates([self.name or "value"], keep)[self.name or "value"]

    def factorize(self) -> Series:
        return self._ordered(lambda sdf, i, o: reshaping.factorize(sdf, i, o, self.frame.order))

    def sort_values(self, ascending: bool = True) -> Series:
        f = self.to_frame(self.name or "value")
        return f.sort_values(self.name or "value", ascending)[self.name or "value"]

    def nlargest(self, n: int = 5) -> Series:
        f = self.to_frame(self.name or "value")
        return f.nlargest(n, self.name or "value")[self.name or "value"]

    def nsmallest(self, n: int = 5) -> Series:
        f = self.to_frame(self.name or "value")
        return f.nsmallest(n, self.name or "value")[self.name or "value"]

    def head(self, n: int = 5) -> Series:
        return self.to_frame(self.name or "value").head(n)[self.name or "value"]

    def __getitem__(self, mask: Series) -> Series:
        return Series(self.frame[mask], self.col, self.name)

    def __len__(self) -> int:
        return len(self.frame)

    def __neg__(self) -> Series:
        return self._like(-self.col)

    def __abs__(self) -> Series:
        return self.abs()

    def __invert__(self) -> Series:
        return self._like(E.logical_not(self.col))

    def __and__(self, other: object) -> Series:
        return self._arith(E.logical_and, other)

    def __or__(self, other: object) -> Series:
        return self._arith(E.logical_or, other)

    def __xor__(self, other: object) -> Series:
        return self._arith(E.logical_xor, other)

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __divmod__(self, other: object) -> tuple[Series, Series]:
        return self._arith(E.floordiv, other), self._arith(E.mod, other)

    @property
    def str(self) -> Accessor:
        return Accessor(self, strings)

    @property
    def dt(self) -> Accessor:
        return Accessor(self, dates)

    @property
    def list(self) -> Accessor:
        return Accessor(self, nested)

    @property
    def struct(self) -> Accessor:
        return Accessor(self, nested)

    @property
    def cat(self) -> categories.Categorical:
        c = categories.Categorical.of(self.frame.sdf.select(self.col.alias("v")), "v")
        return categories.Categorical(self.col, c.categories, c.ordered)


for _name, _f in _OPERATORS.items():
    for _kind in (Frame, Series):
        setattr(_kind, _name, _binary(_f))
        if not _name.startswith("r") or _name in ("radd", "rsub", "rmul", "rtruediv", "rfloordiv", "rmod", "rpow"):
            setattr(_kind, f"__{_name}__", _binary(_f))
for _kind in (Frame, Series):
    _kind.div = _kind.divide = _kind.truediv
    _kind.multiply, _kind.subtract = _kind.mul, _kind.sub
    _kind.__hash__ = object.__hash__


def _reduction(how: str) -> tuple[Callable, Callable]:
    def of_frame(self: Frame, axis: int = 0, skipna: bool = True, numeric_only: bool = False, **options: object) -> Frame | Series:
        return self._reduced(how, axis, skipna, numeric_only, **options)

    def of_series(self: Series, **options: object) -> object:
        return self.agg(how, **options)

    return of_frame, of_series


for _name in _REDUCTIONS:
    _a, _b = _reduction(_name)
    setattr(Frame, _name, _a)
    setattr(Series, _name, _b)
Frame.product, Series.product, Frame.kurtosis, Series.kurtosis = Frame.prod, Series.prod, Frame.kurt, Series.kurt


class Accessor:
    """The functions of a module as methods of a series: s.str.upper(), s.dt.year(), s.list.get(0)."""

    def __init__(self, series: Series, module: object):
        self._series, self._module = series, module

    def __getattr__(self, name: str) -> Callable:
        f = getattr(self._module, name + "_", None) or getattr(self._module, name)

        def call(*args: object, **options: object) -> Series | tuple[Series, ...]:
            out = f(self._series.col, *[a.col if isinstance(a, Series) else a for a in args], **options)
            return tuple(self._series._like(x) for x in out) if isinstance(out, tuple) else self._series._like(out)

        return call


class GroupBy:
    def __init__(self, frame: Frame, by: Sequence[str], as_index: bool = True, sort: bool = True, dropna: bool = True, columns: Sequence[str] | None = None):
        self.frame, self.by, self.as_index, self.sort, self.dropna = frame, list(by), as_index, sort, dropna
        self.columns = list(columns) if columns else [c for c in frame.columns if c not in by]
        self.groups = Groups(frame.sdf, by, frame.order, dropna)

    def __getitem__(self, columns: str | Sequence[str]) -> GroupBy:
        return GroupBy(self.frame, self.by, self.as_index, self.sort, self.dropna, _list(columns))

    def _out(self, sdf: DataFrame) -> Frame:
        return Frame(sdf, self.by if self.as_index else None, self.by if self.sort else None)

    def agg(self, spec: object = None, **named: tuple) -> Frame:
        """A name, a list (columns `column_aggregate`), a dict, or named (column, aggregate) pairs."""
        numeric = [c for c in aggregating.numeric(self.frame.sdf.select(*self.columns))] if self.columns else []
        if isinstance(spec, str):
            return self._out(self.groups.each(spec, numeric if spec not in ("count", "nunique", "first", "last", "min", "max", "any", "all") else self.columns))
        if isinstance(spec, list):
            named = {f"{c}_{h}": (c, h) for c in numeric for h in spec}
        elif isinstance(spec, dict):
            named = {c if isinstance(h, str) else f"{c}_{x}": (c, x) for c, h in spec.items() for x in ([h] if isinstance(h, str) else h)}
        return self._out(self.groups.agg(**named))

    aggregate = agg

    def size(self) -> Frame:
        return self._out(self.groups.size())

    def ngroup(self) -> Series:
        return Series(self.frame._new(self.groups.ngroup("__ngroup"), True, adds=True), F.col("__ngroup"), "ngroup")

    def cumcount(self) -> Series:
        return Series(self.frame._new(self.groups.cumcount("__cumcount"), True, adds=True), F.col("__cumcount"), "cumcount")

    def head(self, n: int = 5) -> Frame:
        return self.frame._new(self.groups.head(n))

    def tail(self, n: int = 5) -> Frame:
        return self.frame._new(self.groups.tail(n))

    def nth(self, n: int) -> Frame:
        return self.frame._new(self.groups.nth(n))

    def _one(self, f: Callable[[dict], DataFrame]) -> Frame:
        made = f({f"__o_{c}": c for c in self.columns})
        return self.frame._new(made.withColumns({c: F.col(f"__o_{c}") for c in self.columns}).drop(*[f"__o_{c}" for c in self.columns]), True)[self.columns]

    def cumsum(self) -> Frame:
        return self._one(lambda m: self.groups.cumulative({o: ("cumsum", c) for o, c in m.items()}))

    def cumprod(self) -> Frame:
        return self._one(lambda m: self.groups.cumulative({o: ("cumprod", c) for o, c in m.items()}))

    def cummax(self) -> Frame:
        return self._one(lambda m: self.groups.cumulative({o: ("cummax", c) for o, c in m.items()}))

    def cummin(self) -> Frame:
        return self._one(lambda m: self.groups.cumulative({o: ("cummin", c) for o, c in m.items()}))

    def shift(self, periods: int = 1) -> Frame:
        return self._one(lambda m: self.groups.shift(m, periods))

    def diff(self, periods: int = 1) -> Frame:
        return self._one(lambda m: self.groups.diff(m, periods))

    def transform(self, how: str) -> Frame:
        return self._one(lambda m: self.groups.transform(how, m))

    def filter(self, test: Column | Callable) -> Frame:
        return self.frame._new(self.groups.filter(test))

    def apply(self, func: Callable, schema: object) -> Frame:
        return Frame(self.groups.apply(func, schema))

    def get_group(self, *values: object) -> Frame:
        return self.frame._new(self.groups.get_group(*values))

    def rolling(self, window: int | str, min_periods: int | None = None, on: str | None = None) -> Rolling:
        return Rolling(self.frame, self.by, "rolling", self.columns, window=window, min_periods=min_periods, on=on)

    def expanding(self, min_periods: int = 1) -> Rolling:
        return Rolling(self.frame, self.by, "expanding", self.columns, min_periods=min_periods)

    def value_counts(self, column: str) -> Frame:
        return Frame(self.groups.value_counts(column), [*self.by, column])

    def describe(self, column: str) -> Frame:
        return self._out(self.groups.describe(column))

    def ngroups(self) -> int:
        return self.groups.ngroups()


def _grouped(how: str) -> Callable:
    def method(self: GroupBy) -> Frame:
        return self.agg(how)

    return method


for _name in (*_REDUCTIONS, "nunique", "first", "last"):
    setattr(GroupBy, _name, _grouped(_name))


class Rolling:
    """Sliding or expanding frames over the numeric columns of a frame, in groups where there are any."""

    def __init__(self, frame: Frame, by: Sequence[str], kind: str, columns: Sequence[str] | None = None, **options: object):
        self.frame, self.by, self.kind, self.options = frame, list(by), kind, options
        self.columns = [c for c in columns or aggregating.numeric(frame.sdf.select(*frame.columns)) if c not in by]

    def __getitem__(self, columns: str | Sequence[str]) -> Rolling:
        return Rolling(self.frame, self.by, self.kind, _list(columns), **self.options)

    def agg(self, how: str, *more: object) -> Frame:
        aggs = {f"__o_{c}": (how, c, *more) for c in self.columns}
        if self.kind == "rolling":
            options = dict(self.options)
            out = windowing.rolling(self.frame.sdf, self.frame.order, options.pop("window"), aggs, self.by, **options)
        else:
            out = windowing.expanding(self.frame.sdf, self.frame.order, aggs, self.by, self.options["min_periods"])
        return self.frame._new(out.withColumns({c: F.col(f"__o_{c}") for c in self.columns}).drop(*aggs), True)

    def quantile(self, q: float) -> Frame:
        return self.agg("quantile", float(q))

    def corr(self, other: str) -> Frame:
        return self.agg("corr", other)

    def cov(self, other: str) -> Frame:
        return self.agg("cov", other)


def _rolled(how: str) -> Callable:
    def method(self: Rolling) -> Frame:
        return self.agg(how)

    return method


for _name in ("count", "sum", "mean", "median", "min", "max", "var", "std", "sem", "skew", "kurt", "rank", "first", "last", "nunique"):
    setattr(Rolling, _name, _rolled(_name))


class Resampler:
    def __init__(self, frame: Frame, rule: str, on: str, closed: str, label: str):
        self.frame, self.rule, self.on, self.options = frame, rule, on, {"closed": closed, "label": label}

    def agg(self, spec: str | dict) -> Frame:
        columns = [c for c in aggregating.numeric(self.frame.sdf.select(*self.frame.columns)) if c != self.on]
        aggs = {c: (c, spec) for c in columns} if isinstance(spec, str) else {c: (c, h) for c, h in spec.items()}
        out = resampling.resample(self.frame.sdf, self.rule, self.on, aggs, order=self.frame.order[0], **self.options)
        return Frame(out, self.on, self.on)

    def ohlc(self, column: str) -> Frame:
        return Frame(resampling.ohlc(self.frame.sdf, self.rule, self.on, column, order=self.frame.order[0]), self.on, self.on)

    def asfreq(self, method: str | None = None) -> Frame:
        columns = [c for c in self.frame.columns if c != self.on]
        return Frame(resampling.upsample(self.frame.sdf, self.rule, self.on, columns, method), self.on, self.on)


def _resampled(how: str) -> Callable:
    def method(self: Resampler) -> Frame:
        return self.agg(how)

    return method


for _name in ("count", "sum", "prod", "mean", "median", "min", "max", "var", "std", "sem", "nunique", "first", "last", "size"):
    setattr(Resampler, _name, _resampled(_name))


def concat(frames: Sequence[Frame | None], join: str = "outer", keys: Sequence[str] | None = None, axis: int = 0) -> Frame:
    given = [f for f in frames if f is not None]
    if axis == 1:
        out = given[0]
        for f in given[1:]:
            out = out.join(f, "outer" if join == "outer" else "inner")
        return out
    sdfs = [f.sdf.withColumn("__part", F.lit(i)).withColumn(ORDER, F.struct(*f.order) if len(f.order) > 1 else F.col(f.order[0])) for i, f in enumerate(given)]
    keep = [s.select("__part", ORDER, *[f"`{c}`" for c in (*f.index, *f.columns)]) for s, f in zip(sdfs, given, strict=True)]
    return Frame(reshaping.concat(keep, join, keys), [*(["key"] if keys else []), *given[0].index], ["__part", ORDER])


def merge(left: Frame, right: Frame, **options: object) -> Frame:
    return left.merge(right, **options)


def merge_asof(left: Frame, right: Frame, **options: object) -> Frame:
    return Frame(joining.merge_asof(left.spark(), right.spark(), **options))


def merge_ordered(left: Frame, right: Frame, **options: object) -> Frame:
    return Frame(joining.merge_ordered(left.spark(), right.spark(), **options))


def get_dummies(frame: Frame, columns: str | Sequence[str], **options: object) -> Frame:
    return frame._new(reshaping.get_dummies(frame.sdf, columns, **options), True)


def cut(s: Series, bins: int | Sequence[float], labels: Sequence | None = None, right: bool = True) -> Series:
    return s._ordered(lambda sdf, i, o: reshaping.cut(sdf, i, bins, o, labels, right))


def qcut(s: Series, q: int | Sequence[float], labels: Sequence | None = None) -> Series:
    return s._ordered(lambda sdf, i, o: reshaping.qcut(sdf, i, q, o, labels))


def to_numeric(s: Series, errors: str = "raise", downcast: str | None = None) -> Series:
    return s._like(E.to_numeric(s.col, errors, downcast))


def to_datetime(s: Series, format: str | None = None, unit: str | None = None, errors: str = "raise") -> Series:
    return s._like(E.to_datetime(s.col, format, unit, errors=errors))


def to_timedelta(s: Series, unit: str = "s") -> Series:
    return s._like(E.to_timedelta(s.col, unit))


def crosstab(a: Series, b: Series, normalize: bool = False) -> Frame:
    sdf, c = a.frame._onto(b)
    return Frame(reshaping.crosstab(sdf.select(a.col.alias(a.name or "row"), c.alias(b.name or "col")), a.name or "row", b.name or "col", normalize), a.name or "row", a.name or "row")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, index: str | None = None, order: str | None = None) -> Frame:
    return Frame(readers.without_nan(readers.read_parquet(spark, path, columns)), index, order)


def read_csv(spark: SparkSession, path: str, **options: object) -> Frame:
    return Frame(readers.read_csv(spark, path, **options))
