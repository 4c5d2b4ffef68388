"""Frames without labels, worked on by expressions: `Table` chains verbs over Columns, `Vector` is one column with its methods.

Everything is lazy but what returns a number. Order-sensitive verbs use the table's `order` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import elementwise as E
from lumenframe.functions import statistics as S
from lumenframe.functions.dates import micros
from lumenframe.operators import aggregating, joining, resampling, reshaping, selecting, sorting, udfs, windowing
from lumenframe.operators.grouping import Groups
from lumenframe.plans.ordering import POSITION, positions, scan
from lumenframe.sources import writers

Expr = str | Column


def _c(x: Expr) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x


def _field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


class Table:
    def __init__(self, sdf: DataFrame, order: Sequence[str] = ()):
        self.sdf, self.order = sdf, list(order)

    def _new(self, sdf: DataFrame) -> Table:
        return Table(sdf, [c for c in self.order if c in sdf.columns])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.sdf.columns if not c.startswith("__")]

    @property
    def schema(self) -> dict[str, str]:
        return {c: k for c, k in self.sdf.dtypes if c in self.columns}

    @property
    def height(self) -> int:
        return self.sdf.count()

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def __getitem__(self, name: str) -> Vector:
        return Vector(self, F.col(f"`{name}`"), name)

    get_column = __getitem__

    def lazy(self) -> Table:
        return self

    clone = collect = lazy

    def is_empty(self) -> bool:
        return self.sdf.isEmpty()

    # Verbs

    def select(self, *exprs: Expr, **named: Expr) -> Table:
        return self._new(self.sdf.select(*[_c(x) for x in exprs], *[_c(x).alias(n) for n, x in named.items()]))

    def with_columns(self, **named: Expr) -> Table:
        return self._new(self.sdf.withColumns({n: _c(x) for n, x in named.items()}))

    def filter(self, *tests: Column, **equal: object) -> Table:
        out = self.sdf
        for t in tests:
            out = out.filter(t)
        for n, v in equal.items():
            out = out.filter(F.col(n) == F.lit(v))
        return self._new(out)

    def sort(self, *by: Expr, descending: bool | Sequence[bool] = False, nulls_last: bool = False) -> Table:
        """Missing values come first unless they are asked to be last."""
        ways = [descending] * len(by) if isinstance(descending, bool) else list(descending)
        keys = [(_c(b).desc_nulls_last() if nulls_last else _c(b).desc_nulls_first()) if d else (_c(b).asc_nulls_last() if nulls_last else _c(b).asc_nulls_first()) for b, d in zip(by, ways, strict=True)]
        return self._resorted(self.sdf.orderBy(*keys))

    def _resorted(self, sdf: DataFrame) -> Table:
        """A table whose order is that of its rows as they now are; hidden increasing numbers stand for it."""
        return Table(sdf.drop("__ord__").withColumn("__ord__", F.monotonically_increasing_id()), ["__ord__"])

    def drop(self, *names: str) -> Table:
        return self._new(self.sdf.drop(*names))

    def rename(self, names: dict[str, str]) -> Table:
        return Table(self.sdf.withColumnsRenamed(names), [names.get(c, c) for c in self.order])

    def cast(self, kinds: dict[str, str]) -> Table:
        return self._new(self.sdf.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()}))

    def unique(self, subset: str | Sequence[str] | None = None, keep: str = "any") -> Table:
        """keep: any, first, last, or none (only what occurs once)."""
        if keep == "any" and subset is None:
            return self._new(self.sdf.distinct())
        return self._new(reshaping.drop_duplicates(self.sdf, subset or self.columns, self.order, {"any": "first", "none": False}.get(keep, keep)))

    def is_duplicated(self) -> Table:
        return self._new(reshaping.is_duplicated(self.sdf))

    def is_unique(self) -> Table:
        return self._new(reshaping.is_duplicated(self.sdf, "is_unique").withColumn("is_unique", ~F.col("is_unique")))

    def n_unique(self) -> int:
        return self.sdf.distinct().count()

    def approx_n_unique(self) -> Table:
        return Table(self.sdf.agg(*[F.approx_count_distinct(c).alias(c) for c in self.columns]))

    def head(self, n: int = 5) -> Table:
        return self._new(sorting.head(self.sdf, n, self.order) if self.order else self.sdf.limit(n))

    def limit(self, n: int = 5) -> Table:
        return self.head(n)

    def tail(self, n: int = 5) -> Table:
        return self._new(sorting.tail(self.sdf, n, self.order))

    def slice(self, offset: int, length: int | None = None) -> Table:
        return self._new(selecting.iloc(self.sdf, slice(offset, None if length is None else offset + length), self.order))

    def gather_every(self, n: int, offset: int = 0) -> Table:
        return self._new(reshaping.gather_every(self.sdf, n, self.order, offset))

    def reverse(self) -> Table:
        return self._resorted(sorting.reverse(self.sdf, self.order))

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 0, with_replacement: bool = False) -> Table:
        return self._new(selecting.sample(self.sdf, n, fraction, with_replacement, None, seed))

    def top_k(self, k: int, by: str) -> Table:
        return self._new(sorting.nlargest(self.sdf, k, by, order=self.order))

    def bottom_k(self, k: int, by: str) -> Table:
        return self._new(sorting.nsmallest(self.sdf, k, by, order=self.order))

    def with_row_index(self, name: str = "index", offset: int = 0) -> Table:
        return self._new(reshaping.with_row_index(self.sdf, self.order, name, offset))

    def row(self, at: int) -> tuple:
        return tuple(selecting.iloc(self.sdf, at, self.order).select(*[f"`{c}`" for c in self.columns]).first())

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in (self.sdf.orderBy(*self.order) if self.order else self.sdf).select(*[f"`{c}`" for c in self.columns]).collect()]

    def drop_nulls(self, subset: Sequence[str] | None = None) -> Table:
        return self._new(self.sdf.dropna(subset=list(subset) if subset else None))

    def fill_null(self, value: object = None, strategy: str | None = None, limit: int | None = None) -> Table:
        """A value, or forward, backward, zero, one, min, max, mean."""
        if strategy in ("forward", "backward"):
            rest = [c for c in self.columns if c not in self.order]
            return self._new(windowing.fill(self.sdf, self.order, rest, "ffill" if strategy == "forward" else "bfill", limit))
        if strategy in ("min", "max", "mean"):
            numeric = aggregating.numeric(self.sdf)
            row = aggregating.reduce_columns(self.sdf, strategy, numeric).first().asDict()
            return self._new(self.sdf.fillna({c: v for c, v in row.items() if v is not None}))
        return self._new(self.sdf.fillna({"zero": 0, "one": 1}.get(strategy or "", value)))

    def fill_nan(self, value: float | None) -> Table:
        floats = [c for c, k in self.sdf.dtypes if k in ("float", "double")]
        return self._new(self.sdf.withColumns({c: F.when(F.isnan(c), F.lit(value)).otherwise(F.col(c)) for c in floats}))

    def null_count(self) -> Table:
        return Table(aggregating.reduce_columns(self.sdf, "null_count", self.columns))

    def explode(self, *columns: str) -> Table:
        return self._new(reshaping.explode(self.sdf, list(columns)))

    def unnest(self, column: str) -> Table:
        return self._new(self.sdf.select(*[c for c in self.columns if c != column], f"{column}.*"))

    def to_struct(self, name: str = "struct") -> Table:
        return Table(self.sdf.select(F.struct(*self.columns).alias(name)))

    def extend(self, other: Table) -> Table:
        return self._new(self.sdf.unionByName(other.sdf))

    vstack = extend

    def hstack(self, other: Table) -> Table:
        return Table(joining.positional(self.sdf, other.sdf, self.order, other.order), self.order)

    def merge_sorted(self, other: Table, key: str) -> Table:
        return self._new(self.sdf.unionByName(other.sdf).orderBy(key))

    def shift(self, n: int = 1, fill_value: object = None) -> Table:
        rest = [c for c in self.columns if c not in self.order]
        out = windowing.shift(self.sdf, self.order, {f"__o_{c}": c for c in rest}, n, fill=fill_value)
        return self._new(out.withColumns({c: F.col(f"__o_{c}") for c in rest}).drop(*[f"__o_{c}" for c in rest]))

    def interpolate(self, *columns: str) -> Table:
        out = self.sdf
        for c in columns:
            out = windowing.interpolate(out, self.order, c)
        return self._new(out)

    def melt(self, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> Table:
        return Table(reshaping.melt(self.sdf, list(id_vars), value_vars, variable_name, value_name))

    unpivot = melt

    def pivot(self, on: str, index: str | Sequence[str], values: str, aggregate_function: str = "first") -> Table:
        if aggregate_function == "first":
            return Table(reshaping.unstack(self.sdf, index, on, values))
        return Table(reshaping.pivot_table(self.sdf, values, index, on, aggregate_function))

    def unstack(self, index: str, on: str, values: str) -> Table:
        return Table(reshaping.unstack(self.sdf, index, on, values))

    def to_dummies(self, *columns: str) -> Table:
        return self._new(reshaping.get_dummies(self.sdf, list(columns)))

    def transpose(self, key: str) -> Table:
        return Table(reshaping.transpose(self.sdf, key))

    def partition_by(self, column: str) -> dict[object, Table]:
        return {v: self._new(self.sdf.filter(F.col(column) == F.lit(v))) for v in reshaping.distinct_values(self.sdf, column)}

    def join(self, other: Table, on: object = None, how: str = "inner", left_on: object = None, right_on: object = None, suffix: str = "_right", join_nulls: bool = False, validate: str | None = None) -> Table:
        """inner, left, right, full, semi, anti or cross; missing keys do not match unless asked to."""
        return self._new(joining.merge(self.sdf, other.sdf, how, on, left_on, right_on, ("", suffix), validate=validate, null_keys=join_nulls))

    def join_asof(self, other: Table, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by: object = None, strategy: str = "backward", tolerance: object = None) -> Table:
        return self._new(joining.merge_asof(self.sdf, other.sdf, on, left_on, right_on, by, strategy, tolerance, suffixes=("", "_right")))

    def update(self, other: Table, on: str | Sequence[str]) -> Table:
        return self._new(joining.overlay(self.sdf, other.sdf, on))

    def group_by(self, *by: str) -> GroupedTable:
        return GroupedTable(self, by)

    def group_by_dynamic(self, on: str, every: str, aggs: dict[str, tuple], by: Sequence[str] = ()) -> Table:
        return Table(resampling.resample(self.sdf, every, on, aggs, by=by, empty=False), [on])

    def rolling(self, on: str, period: str, aggs: dict[str, tuple], by: Sequence[str] = ()) -> Table:
        return self._new(windowing.rolling(self.sdf, [on], period, aggs, by, on=on))

    def upsample(self, on: str, every: str, by: Sequence[str] = ()) -> Table:
        return Table(resampling.upsample(self.sdf, every, on, [c for c in self.columns if c not in (on, *by)], None, by), [on])

    def sql(self, text: str, name: str = "self") -> Table:
        """SQL over this table, as `self`."""
        return Table(self.sdf.sparkSession.sql(text.replace(name, "{__t}"), __t=self.sdf))

    def fold(self, f: Callable[[Column, Column], Column], columns: Sequence[str] | None = None, name: str = "fold") -> Table:
        out = None
        for c in columns or self.columns:
            out = F.col(c) if out is None else f(out, F.col(c))
        return self._new(self.sdf.select(out.alias(name)))

    def horizontal(self, how: str, columns: Sequence[str] | None = None) -> Table:
        """max, min, mean or sum over the columns of each row."""
        return self._new(self.sdf.withColumn(how, E.horizontal([F.col(c) for c in columns or aggregating.numeric(self.sdf)], how)))

    def hash_rows(self, seed: int = 0) -> Table:
        return self._new(self.sdf.select(F.xxhash64(*self.columns, F.lit(seed)).alias("hash")))

    def map_rows(self, func: Callable, schema: str) -> Table:
        return Table(udfs.apply_rows(self.sdf, func, schema))

    def equals(self, other: Table) -> bool:
        return selecting.equals(self.sdf, other.sdf)

    def describe(self) -> Table:
        return Table(aggregating.describe(self.sdf))

    def corr(self) -> Table:
        return Table(aggregating.corr(self.sdf))

    def _reduced(self, how: str, **options: object) -> Table:
        return Table(aggregating.reduce_columns(self.sdf, how, None, **options))

    def quantile(self, q: float, interpolation: str = "nearest") -> Table:
        return self._reduced("quantile", q=q, interpolation=interpolation)

    def to_pandas(self) -> pd.DataFrame:
        return self.sdf.toPandas()

    def to_arrow(self) -> object:
        return self.sdf.toArrow()

    def to_dict(self) -> dict:
        return self.sdf.toPandas().to_dict("list")

    def write_csv(self, path: str, **options: object) -> None:
        writers.to_csv(self.sdf, path, **options)

    def write_parquet(self, path: str) -> None:
        writers.to_parquet(self.sdf, path)

    def write_json(self, path: str) -> None:
        writers.to_json(self.sdf, path)


def _of_table(how: str) -> Callable:
    def method(self: Table) -> Table:
        return self._reduced(how)

    return method


for _name in ("mean", "median", "std", "sum", "var", "max", "min", "product", "count"):
    setattr(Table, _name, _of_table(_name))


class GroupedTable:
    def __init__(self, table: Table, by: Sequence[str]):
        self.table, self.by = table, list(by)
        self.groups = Groups(table.sdf, self.by, table.order, dropna=False)

    def agg(self, **named: tuple | Column) -> Table:
        return Table(self.groups.agg(**named))

    def len(self, name: str = "len") -> Table:
        return Table(self.groups.size(name))

    def head(self, n: int = 5) -> Table:
        return self.table._new(self.groups.head(n))

    def tail(self, n: int = 5) -> Table:
        return self.table._new(self.groups.tail(n))

    def all(self) -> Table:
        """Each group's values as lists, in the table's order."""
        rest = [c for c in self.table.columns if c not in self.by]
        place = F.struct(*self.table.order, *[c for c in rest if c not in self.table.order])
        sorted_rows = F.sort_array(F.collect_list(place))
        return Table(self.table.sdf.groupBy(*self.by).agg(sorted_rows.alias("__rows")).select(*self.by, *[F.transform("__rows", _field(c)).alias(c) for c in rest]))

    def quantile(self, q: float) -> Table:
        return Table(self.groups.each("quantile", None, q=q, interpolation="nearest"))

    def map_groups(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Table:
        return Table(self.groups.apply(func, schema))


def _of_groups(how: str) -> Callable:
    def method(self: GroupedTable) -> Table:
        return Table(self.groups.each({"n_unique": "nunique"}.get(how, how)))

    return method


for _name in ("count", "first", "last", "max", "mean", "median", "min", "n_unique", "sum"):
    setattr(GroupedTable, _name, _of_groups(_name))


class Vector:
    """A column of a table. Element-wise methods give vectors over the same table, the others tables or numbers."""

    def __init__(self, table: Table, col: Column, name: str):
        self.table, self.col, self.name = table, col, name

    def _like(self, col: Column) -> Vector:
        return Vector(self.table, col, self.name)

    def table_of(self) -> Table:
        """The order columns and the vector under its name."""
        keep = [c for c in self.table.order if c != self.name]
        return Table(self.table.sdf.select(*keep, self.col.alias(self.name)), self.table.order)

    to_frame = table_of

    def _ordered(self, f: Callable[[DataFrame, str], DataFrame], result: str) -> Vector:
        sdf = f(self.table.sdf.withColumn("__vec", self.col), "__vec").drop("__vec")
        return Vector(self.table._new(sdf), F.col(result), self.name)

    def agg(self, how: str, **options: object) -> object:
        return self.table.sdf.agg(S.aggregate(how, self.col, **options)).first()[0]

    def to_list(self) -> list:
        t = self.table_of()
        return [r[0] for r in (t.sdf.orderBy(*t.order) if t.order else t.sdf).select(self.name).collect()]

    # Aggregates with definitions of their own

    def arg_max(self) -> int:
        return aggregating.arg_extreme(self.table_of().sdf, self.name, self.table.order)

    def arg_min(self) -> int:
        return aggregating.arg_extreme(self.table_of().sdf, self.name, self.table.order, False)

    def arg_true(self) -> list[int]:
        return [r[0] for r in positions(self.table_of().sdf, self.table.order).filter(F.col(self.name)).orderBy(POSITION).select(POSITION).collect()]

    def mode(self) -> Table:
        return Table(aggregating.mode(self.table_of().sdf, self.name))

    def nan_max(self) -> float:
        return self.table.sdf.agg(F.max(self.col)).first()[0]

    def nan_min(self) -> float:
        return self.table.sdf.agg(F.when(F.bool_or(F.isnan(self.col)), F.lit(float("nan"))).otherwise(F.min(self.col))).first()[0]

    def skew(self, bias: bool = True) -> float:
        return self.table.sdf.agg(F.skewness(self.col) if bias else S.skew(self.col)).first()[0]

    def kurtosis(self, fisher: bool = True, bias: bool = True) -> float:
        value = F.kurtosis(self.col) if bias else S.kurt(self.col)
        return self.table.sdf.agg(value if fisher else value + 3).first()[0]

    def dot(self, other: Vector) -> float:
        return self.table.sdf.agg(F.sum(self.col * other.col)).first()[0]

    def entropy(self, base: float = 2.718281828459045, normalize: bool = True) -> float:
        return aggregating.entropy(self.table_of().sdf, self.name, base, normalize).first()[0]

    def null_count(self) -> int:
        return self.agg("null_count")

    def n_unique(self) -> int:
        return self.table.sdf.select(self.col).distinct().count()

    def unique_counts(self) -> Table:
        t = self.table_of()
        return Table(t.sdf.groupBy(self.name).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*t.order) if t.order else F.lit(0)).alias("__f")).orderBy("__f").drop("__f"))

    def value_counts(self) -> Table:
        return Table(self.table_of().sdf.groupBy(self.name).agg(F.count(F.lit(1)).alias("count")))

    def arg_sort(self) -> Table:
        return Table(sorting.argsort(self.table_of().sdf, self.name, self.table.order))

    def arg_unique(self) -> Table:
        placed = positions(self.table_of().sdf, self.table.order)
        return Table(placed.groupBy(self.name).agg(F.min(POSITION).alias("index")).select("index"))

    def search_sorted(self, values: Sequence[float], side: str = "left") -> Table:
        return Table(sorting.searchsorted(self.table_of().sdf, self.name, values, side))

    def is_sorted(self) -> bool:
        return windowing.is_monotonic(self.table_of().sdf, self.table.order, self.name).first()[0]

    def describe(self) -> Table:
        return Table(aggregating.describe(self.table_of().sdf, [self.name]))

    def implode(self) -> Table:
        t = self.table_of()
        row = F.struct(*[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(t.order)], F.col(f"`{self.name}`").alias("v"))
        return Table(t.sdf.agg(F.transform(F.sort_array(F.collect_list(row)), _field("v")).alias(self.name)))

    # Element-wise

    def cut(self, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Vector:
        edges = [float("-inf"), *breaks, float("inf")]
        return self._like(E.cut(self.col, edges, labels))

    def qcut(self, q: int | Sequence[float], labels: Sequence | None = None) -> Vector:
        return self._ordered(lambda sdf, v: reshaping.qcut(sdf, v, q, "__q", labels), "__q")

    def hist(self, bins: int = 10) -> Table:
        return Table(reshaping.hist(self.table_of().sdf, self.name, bins))

    def zip_with(self, mask: Vector, other: Vector) -> Vector:
        return self._like(F.when(mask.col, self.col).otherwise(other.col))

    def map_elements(self, func: Callable, kind: str) -> Vector:
        return self._like(udfs.map_elements(self.col, func, kind))

    def set(self, mask: Vector, value: object) -> Vector:
        return self._like(E.mask(self.col, mask.col, value))

    def scatter(self, at: Sequence[int], value: object) -> Vector:
        placed = positions(self.table.sdf, self.table.order)
        return Vector(self.table._new(placed), F.when(F.col(POSITION).isin(list(at)), F.lit(value)).otherwise(self.col), self.name)

    def gather(self, at: Sequence[int]) -> Table:
        return Table(selecting.iloc(self.table_of().sdf, list(at), self.table.order), self.table.order)

    def append(self, other: Vector) -> Table:
        return Table(self.table_of().sdf.select(self.name).union(other.table_of().sdf.select(other.name)))

    def extend_constant(self, value: object, n: int) -> Table:
        more = self.table.sdf.sparkSession.range(n).select(F.lit(value).alias(self.name))
        return Table(self.table_of().sdf.select(self.name).union(more))

    def shuffle(self, seed: int = 0) -> Table:
        return Table(sorting.shuffle(self.table_of().sdf, seed))

    def reverse(self) -> Table:
        return Table(sorting.reverse(self.table_of().sdf, self.table.order))

    def rle(self) -> Table:
        return Table(windowing.run_lengths(self.table_of().sdf, self.table.order, self.name), ["rle_id"])

    def shrink_dtype(self) -> Vector:
        low, high = self.table.sdf.agg(F.min(self.col), F.max(self.col)).first()
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if low is not None and -(1 << bits) <= low and high < (1 << bits):
                return self._like(self.col.cast(kind))
        return self

    # Ordered

    def _window(self, f: Callable, **options: object) -> Vector:
        return self._ordered(lambda sdf, v: f(sdf, self.table.order, {"__w": v}, **options), "__w")

    def diff(self, n: int = 1) -> Vector:
        return self._window(windowing.diff, periods=n)

    def shift(self, n: int = 1) -> Vector:
        return self._window(windowing.shift, periods=n)

    def pct_change(self, n: int = 1) -> Vector:
        return self._window(windowing.pct_change, periods=n, infinite=True)

    def _running(self, how: str) -> Vector:
        return self._ordered(lambda sdf, v: windowing.cumulative(sdf, self.table.order, {"__w": (how, v)}), "__w")

    def cum_sum(self) -> Vector:
        return self._running("cumsum")

    def cum_prod(self) -> Vector:
        return self._running("cumprod")

    def cum_max(self) -> Vector:
        return self._running("cummax")

    def cum_min(self) -> Vector:
        return self._running("cummin")

    def cum_count(self) -> Vector:
        return self._running("cumcount")

    def cumulative_eval(self, how: str) -> Vector:
        return self._ordered(lambda sdf, v: windowing.expanding(sdf, self.table.order, {"__w": (how, v)}), "__w")

    def rank(self, method: str = "average", descending: bool = False) -> Vector:
        return self._ordered(lambda sdf, v: windowing.rank(sdf, v, "__w", {"ordinal": "first"}.get(method, method), not descending, order=self.table.order), "__w")

    def peak_max(self) -> Vector:
        return self._ordered(lambda sdf, v: windowing.peaks(sdf, self.table.order, v, "__w"), "__w")

    def peak_min(self) -> Vector:
        return self._ordered(lambda sdf, v: windowing.peaks(sdf, self.table.order, v, "__w", False), "__w")

    def rle_id(self) -> Vector:
        return self._ordered(lambda sdf, v: windowing.runs(sdf, self.table.order, v, "__w"), "__w")

    def is_first_distinct(self) -> Vector:
        return self._ordered(lambda sdf, v: reshaping.duplicated(sdf, v, self.table.order, "__w").withColumn("__w", ~F.col("__w")), "__w")

    def is_last_distinct(self) -> Vector:
        return self._ordered(lambda sdf, v: reshaping.duplicated(sdf, v, self.table.order, "__w", "last").withColumn("__w", ~F.col("__w")), "__w")

    def interpolate_by(self, x: str) -> Vector:
        return self._ordered(lambda sdf, v: windowing.interpolate(sdf.withColumn("__w", F.col(v)), self.table.order, "__w", x=x), "__w")

    def _rolling(self, how: str, window: int, min_periods: int | None = None, center: bool = False, *more: object) -> Vector:
        return self._ordered(lambda sdf, v: windowing.rolling(sdf, self.table.order, window, {"__w": (how, v, *more)}, (), min_periods, center), "__w")

    def rolling_quantile(self, q: float, window: int) -> Vector:
        return self._rolling("quantile", window, None, False, float(q))

    def rolling_map(self, func: Callable, window: int, raw: bool = False) -> Vector:
        return self._ordered(lambda sdf, v: windowing.rolling_apply(sdf, self.table.order, window, v, func, "__w", raw=raw), "__w")

    def ewm(self, how: str, by: Sequence[str], **options: object) -> Vector:
        return self._ordered(lambda sdf, v: windowing.ewm(sdf, self.table.order, v, "__w", by, how=how, **options), "__w")

    def ewms(self, hows: Sequence[str], by: Sequence[str], **options: object) -> Table:
        """The rows with a column for each of mean, var, std, which share one pass over the groups."""
        return self.table._new(windowing.ewms(self.table.sdf.withColumn("__vec", self.col), self.table.order, "__vec", {h: h for h in hows}, by, **options).drop("__vec"))

    def ewm_mean_by(self, times: str, half_life: str, by: Sequence[str]) -> Vector:
        """Weights halve over each half life of the time that passed; inside groups."""
        import numpy as np

        life = windowing.span_micros(half_life)

        def run(given: dict[str, np.ndarray], group: np.ndarray) -> dict[str, np.ndarray]:
            out = np.full(len(group), np.nan)
            has = np.flatnonzero(~np.isnan(given["x"]))
            at, of = given["at"][has], group[has]
            fade = np.exp2(-np.diff(at, prepend=at[:1]) / life)
            fade[np.flatnonzero(np.diff(of, prepend=-1))] = 0.0
            now, made = 0.0, []
            for x, f in zip(given["x"][has].tolist(), fade.tolist(), strict=True):
                now = (1 - f) * x + (f * now if f else 0.0)
                made.append(now)
            out[has] = made
            return {"__w": out}

        def f(sdf: DataFrame, v: str) -> DataFrame:
            timed = sdf.withColumns({"__at": micros(F.col(f"`{times}`")), "__x": F.col(v).cast("double")})
            # ties of time keep the order of the table
            order = [times, *[c for c in self.table.order if c != times]]
            return windowing.of_groups(timed, by, order, {"at": "__at", "x": "__x"}, run, ["__w"]).drop("__at", "__x")

        return self._ordered(f, "__w")

    def __add__(self, o: object) -> Vector:
        return self._like(E.add(self.col, o.col if isinstance(o, Vector) else o))

    def __sub__(self, o: object) -> Vector:
        return self._like(E.sub(self.col, o.col if isinstance(o, Vector) else o))

    def __mul__(self, o: object) -> Vector:
        return self._like(E.mul(self.col, o.col if isinstance(o, Vector) else o))

    def __truediv__(self, o: object) -> Vector:
        return self._like(E.truediv(self.col, o.col if isinstance(o, Vector) else o))


_MATH = {n: getattr(E, n) for n in ("log10", "log1p", "exp", "sign", "cbrt", "sqrt", "sin", "cos", "tan", "cot", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan", "arcsinh", "arccosh", "arctanh", "ceil", "floor", "log", "round_sig_figs", "clip", "replace", "replace_strict")}
_MATH |= {
    "abs": F.abs, "round": E.round_, "is_between": E.between, "is_finite": E.isfinite, "is_infinite": E.isinf, "is_nan": F.isnan, "is_not_nan": lambda c: ~F.isnan(c), "is_null": E.isna, "is_not_null": E.notna, "is_in": E.isin, "eq_missing": E.eq_missing, "ne_missing": E.ne_missing,
    "pow": E.power, "hash": lambda c, seed=0: F.xxhash64(c, F.lit(seed)), "cast": lambda c, kind: c.cast(kind), "fill_null": E.fillna,
}


def _elementwise(f: Callable) -> Callable:
    def method(self: Vector, *args: object, **options: object) -> Vector:
        return self._like(f(self.col, *[a.col if isinstance(a, Vector) else a for a in args], **options))

    return method


for _name, _f in _MATH.items():
    setattr(Vector, _name, _elementwise(_f))


def _rolled(how: str) -> Callable:
    def method(self: Vector, window: int, min_periods: int | None = None, center: bool = False) -> Vector:
        return self._rolling(how, window, min_periods, center)

    return method


for _name in ("max", "mean", "median", "min", "skew", "std", "sum", "var"):
    setattr(Vector, f"rolling_{_name}", _rolled(_name))


def _of_vector(how: str) -> Callable:
    def method(self: Vector) -> object:
        return self.agg(how)

    return method


for _name in ("max", "min", "mean", "median", "product", "std", "sum", "var", "count", "all", "any"):
    setattr(Vector, _name, _of_vector(_name))

__all__ = ["GroupedTable", "POSITION", "Table", "Vector", "Window", "scan"]
