"""One- and two-dimensional arrays over a Spark DataFrame: numeric columns, rows in an order, no labels; variances have ddof 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import elementwise as E
from lumenframe.functions import statistics as S
from lumenframe.operators import aggregating, joining, reshaping
from lumenframe.plans.ordering import POSITION, positions

Value = "Array | int | float | bool"


class Array:
    """`columns` of `sdf` in the order of `order`; one column is a vector unless `matrix` is set."""

    def __init__(self, sdf: DataFrame, columns: Sequence[str], order: Sequence[str], matrix: bool | None = None):
        self.sdf, self.columns, self.order = sdf, list(columns), list(order)
        self.matrix = len(self.columns) > 1 if matrix is None else matrix

    @property
    def shape(self) -> tuple[int, ...]:
        n = self.sdf.count()
        return (n, len(self.columns)) if self.matrix else (n,)

    @property
    def ndim(self) -> int:
        return 2 if self.matrix else 1

    @property
    def size(self) -> int:
        return self.sdf.count() * len(self.columns)

    def __len__(self) -> int:
        return self.sdf.count()

    @property
    def dtype(self) -> str:
        return dict(self.sdf.dtypes)[self.columns[0]]

    def _each(self, f: Callable[[Column], Column]) -> Array:
        return Array(self.sdf.withColumns({c: f(F.col(f"`{c}`")) for c in self.columns}), self.columns, self.order, self.matrix)

    def _with(self, other: Value, f: Callable[[Column, Column], Column]) -> Array:
        """By a scalar, or by an array over the same rows: its columns go with ours by place, one column with all."""
        if not isinstance(other, Array):
            return self._each(lambda c: f(c, F.lit(other)))
        if other.sdf is self.sdf:
            sdf, theirs = self.sdf, [F.col(f"`{c}`") for c in other.columns]
        else:
            a, b = positions(self.sdf, self.order), positions(other.sdf, other.order).select(POSITION, *[F.col(f"`{c}`").alias(f"__b{k}") for k, c in enumerate(other.columns)])
            sdf, theirs = a.join(b, POSITION).drop(POSITION), [F.col(f"__b{k}") for k in range(len(other.columns))]
        if len(theirs) == 1:
            theirs = theirs * len(self.columns)
        out = sdf.withColumns({f"__o{k}": f(F.col(f"`{c}`"), t) for k, (c, t) in enumerate(zip(self.columns, theirs, strict=True))})
        out = out.withColumns({c: F.col(f"__o{k}") for k, c in enumerate(self.columns)}).drop(*[c for c in out.columns if c.startswith(("__o", "__b"))])
        return Array(out, self.columns, self.order, self.matrix)

    def reduce(self, how: str, axis: int | None = None, where: Column | None = None, **options: object) -> Array | float:
        """Over everything (a number), down the columns (axis 0, one row), or along the rows (axis 1)."""
        if axis == 1:
            value = E.horizontal([F.col(f"`{c}`") for c in self.columns], how)
            return Array(self.sdf.withColumn("__row", value), ["__row"], self.order)
        rows = self.sdf if where is None else self.sdf.filter(where)
        if axis == 0 and self.matrix:
            out = aggregating.reduce_columns(rows, how, self.columns, **options).withColumn("__i", F.lit(0))
            return Array(out, self.columns, ["__i"])
        flat = rows.select(F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])).alias("v"))
        return flat.agg(S.aggregate(how, F.col("v"), **options)).first()[0]

    def sum(self, axis: int | None = None) -> Array | float:
        return self.reduce("sum", axis)

    def prod(self, axis: int | None = None) -> Array | float:
        return self.reduce("prod", axis)

    def mean(self, axis: int | None = None) -> Array | float:
        return self.reduce("mean", axis)

    def var(self, axis: int | None = None, ddof: int = 0) -> Array | float:
        return self.reduce("var", axis, ddof=ddof)

    def std(self, axis: int | None = None, ddof: int = 0) -> Array | float:
        return self.reduce("std", axis, ddof=ddof)

    def max(self, axis: int | None = None) -> Array | float:
        return self.reduce("max", axis)

    def min(self, axis: int | None = None) -> Array | float:
        return self.reduce("min", axis)

    def all(self, axis: int | None = None) -> Array | bool:
        return self.reduce("all", axis)

    def any(self, axis: int | None = None) -> Array | bool:
        return self.reduce("any", axis)

    def argmax(self) -> int:
        return aggregating.arg_extreme(self.sdf, self.columns[0], self.order)

    def argmin(self) -> int:
        return aggregating.arg_extreme(self.sdf, self.columns[0], self.order, False)

    def astype(self, kind: str) -> Array:
        return self._each(lambda c: c.cast(kind))

    def flatten(self) -> Array:
        """Row by row into one vector."""
        placed = positions(self.sdf, self.order)
        out = placed.select(POSITION, F.posexplode(F.array(*[F.col(f"`{c}`") for c in self.columns])).alias("__k", "v"))
        return Array(out.select((F.col(POSITION) * len(self.columns) + F.col("__k")).alias("__i"), "v"), ["v"], ["__i"])

    ravel = flatten

    def transpose(self) -> Array:
        out = reshaping.transpose(positions(self.sdf, self.order).select(POSITION, *self.columns), POSITION)
        places = F.create_map(*[F.lit(x) for k, c in enumerate(self.columns) for x in (c, k)])
        out = out.withColumn("__i", places[F.col("key")]).drop("key")
        return Array(out, [c for c in out.columns if c != "__i"], ["__i"], True)

    T = property(transpose)

    def append(self, other: Array) -> Array:
        parts = [positions(a.sdf, a.order).select(F.struct(F.lit(k), F.col(POSITION)).alias("__i"), *[F.col(f"`{c}`").alias(d) for c, d in zip(a.columns, self.columns, strict=True)]) for k, a in enumerate((self, other))]
        return Array(parts[0].unionByName(parts[1]), self.columns, ["__i"], self.matrix)

    def hstack(self, other: Array) -> Array:
        theirs = other.sdf.select(*other.order, *[F.col(f"`{c}`").alias(f"__h{k}") for k, c in enumerate(other.columns)])
        out = joining.positional(self.sdf.select(*dict.fromkeys([*self.order, *self.columns])), theirs.withColumnsRenamed({c: f"__ro{k}" for k, c in enumerate(other.order)}), self.order, [f"__ro{k}" for k in range(len(other.order))])
        return Array(out, [*self.columns, *[f"__h{k}" for k in range(len(other.columns))]], self.order, True)

    def split(self, parts: int) -> list[Array]:
        """Equal runs of rows; an uneven split is an error."""
        n = len(self)
        if n % parts:
            raise ValueError("rows do not divide evenly")
        placed = positions(self.sdf, self.order)
        size = n // parts
        return [Array(placed.filter((F.col(POSITION) >= k * size) & (F.col(POSITION) < (k + 1) * size)), self.columns, [POSITION], self.matrix) for k in range(parts)]

    def dot(self, other: Array) -> float | Array:
        """Vector by vector: a number. Matrix by a vector held as rows: a vector; by a matrix: a matrix by joins on the shared axis."""
        if not self.matrix and not other.matrix:
            both = self._with(other, lambda a, b: a * b)
            return both.sdf.agg(F.sum(F.col(f"`{both.columns[0]}`"))).first()[0]
        left = positions(self.sdf, self.order).select(F.col(POSITION).alias("row"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])).alias("k", "x"))
        right = positions(other.sdf, other.order).select(F.col(POSITION).alias("k2"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in other.columns])).alias("col", "y"))
        cells = joining.dot(left, "row", "k", "x", right, "k2", "col", "y")
        wide = cells.groupBy("row").pivot("col", list(range(len(other.columns)))).agg(F.first("value"))
        return Array(wide, [str(k) for k in range(len(other.columns))], ["row"], other.matrix)

    __matmul__ = dot

    def __getitem__(self, key: Array | slice | int) -> Array:
        if isinstance(key, Array):
            both = self._with(key, lambda a, b: F.when(b, a))
            return Array(both.sdf.dropna(subset=both.columns), self.columns, self.order, self.matrix)
        from lumenframe.operators.selecting import iloc

        return Array(iloc(self.sdf, key, self.order), self.columns, self.order, self.matrix)

    def to_numpy(self) -> np.ndarray:
        out = self.sdf.orderBy(*self.order).select(*[f"`{c}`" for c in self.columns]).toPandas().to_numpy()
        return out if self.matrix else out[:, 0]

    def __abs__(self) -> Array:
        return self._each(F.abs)

    def __neg__(self) -> Array:
        return self._each(lambda c: -c)

    def __invert__(self) -> Array:
        return self._each(E.logical_not)


def array(spark: SparkSession, values: Sequence) -> Array:
    v = np.asarray(values)
    rows = [(i, *(r.tolist() if v.ndim == 2 else [r.item()])) for i, r in enumerate(v)]
    n = v.shape[1] if v.ndim == 2 else 1
    return Array(spark.createDataFrame(rows, ["__i", *[f"c{k}" for k in range(n)]]), [f"c{k}" for k in range(n)], ["__i"], v.ndim == 2)


def _of_two(f: Callable) -> Callable[[Array, Value], Array]:
    def call(a: Array, b: Value) -> Array:
        return a._with(b, f)

    return call


def _of_one(f: Callable) -> Callable[[Array], Array]:
    def call(a: Array) -> Array:
        return a._each(f)

    return call


add, subtract, multiply, divide, floor_divide, power, remainder = map(_of_two, (E.add, E.sub, E.mul, E.truediv, E.floordiv, E.power, E.mod))
greater, greater_equal, less, less_equal, equal, not_equal = map(_of_two, (E.gt, E.ge, E.lt, E.le, E.eq, E.ne))
logical_and, logical_or, logical_xor = map(_of_two, (E.logical_and, E.logical_or, E.logical_xor))
maximum, minimum = (_of_two(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))), _of_two(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))))
absolute, exp, sqrt, tanh, logical_not = map(_of_one, (F.abs, F.exp, F.sqrt, F.tanh, E.logical_not))
isfinite, isinf, isnan, isnat, isneginf, isposinf, iscomplex, isreal = map(_of_one, (E.isfinite, E.isinf, E.isnan, E.isna, E.isneginf, E.isposinf, E.iscomplex, E.isreal))
for _n, _f in {"add": add, "sub": subtract, "mul": multiply, "truediv": divide, "floordiv": floor_divide, "pow": power, "mod": remainder, "gt": greater, "ge": greater_equal, "lt": less, "le": less_equal, "eq": equal, "ne": not_equal}.items():
    setattr(Array, f"__{_n}__", _f)
for _n, _f in {"radd": E.radd, "rsub": E.rsub, "rmul": E.rmul, "rtruediv": E.rtruediv}.items():
    setattr(Array, f"__{_n}__", _of_two(_f))
Array.__hash__ = object.__hash__


def where(condition: Array, a: Value, b: Value) -> Array:
    """a where the condition holds, else b; arrays must be over the condition's rows."""
    pick = lambda x: F.col(f"`{x.columns[0]}`") if isinstance(x, Array) else F.lit(x)
    if all(not isinstance(x, Array) or x.sdf is condition.sdf for x in (a, b)):
        return condition._each(lambda c: F.when(c, pick(a)).otherwise(pick(b)))
    first = condition._with(a, lambda c, x: F.struct(c.alias("c"), x.cast("double").alias("a")))
    return first._with(b, lambda s, y: F.when(s["c"], s["a"]).otherwise(y))


def zeros_like(a: Array) -> Array:
    return a._each(lambda c: F.lit(0.0))


def ones_like(a: Array) -> Array:
    return a._each(lambda c: F.lit(1.0))


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> Array:
    """Ones on and below the k-th diagonal."""
    m = m or n
    rows = spark.range(n).select(F.col("id").alias("__i"), *[(F.col("id") + k >= j).cast("double").alias(f"c{j}") for j in range(m)])
    return Array(rows, [f"c{j}" for j in range(m)], ["__i"], True)


def norm(a: Array, axis: int | None = None) -> float | Array:
    squares = a._each(lambda c: c * c)
    total = squares.reduce("sum", axis)
    return total._each(F.sqrt) if isinstance(total, Array) else float(np.sqrt(total))
