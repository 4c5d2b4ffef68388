"""Sorts, top-k and positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.plans.ordering import POSITION, keys, positions


def order_keys(by: str | Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", key: Callable[[Column], Column] | None = None) -> list[Column]:
    by = [by] if isinstance(by, str) else list(by)
    ways = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    out = []
    for c, up in zip(by, ways, strict=True):
        x = key(F.col(f"`{c}`")) if key else F.col(f"`{c}`")
        out.append({(True, "last"): x.asc_nulls_last, (True, "first"): x.asc_nulls_first, (False, "last"): x.desc_nulls_last, (False, "first"): x.desc_nulls_first}[(up, na_position)]())
    return out


def sort_values(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", key: Callable[[Column], Column] | None = None, stable: Sequence[str] = ()) -> DataFrame:
    """Ranges of the keys, each sorted in its task; ties in the order of `stable`."""
    return df.orderBy(*order_keys(by, ascending, na_position, key), *keys(stable))


def sort_columns(df: DataFrame, row: Column, ascending: bool = True) -> DataFrame:
    """Columns in the order of the values that one row has in them."""
    first = df.filter(row).first()
    if first is None:
        raise KeyError("no such row")
    values = first.asDict()
    return df.select(*[f"`{c}`" for c in sorted(df.columns, key=lambda c: (values[c] is None, values[c]), reverse=not ascending)])


def nlargest(df: DataFrame, n: int, columns: str | Sequence[str], keep: str = "first", order: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The n rows of the largest values, missing ones never among them. `all` keeps every tie of the last one.

    Each task keeps its n best and only those meet, whatever the size of the table.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    rows = df.dropna(subset=columns)
    by = order_keys(columns, not largest)
    if keep == "all":
        last = rows.orderBy(*by).limit(n).select(F.struct(*columns).alias("k")).agg((F.min if largest else F.max)("k").alias("k"))
        edge = last.select(*[F.col(f"k.{c}").alias(f"__e_{c}") for c in columns])
        inside = (F.struct(*columns) >= F.struct(*[f"__e_{c}" for c in columns])) if largest else (F.struct(*columns) <= F.struct(*[f"__e_{c}" for c in columns]))
        return rows.join(F.broadcast(edge), inside).drop(*[f"__e_{c}" for c in columns])
    ties = keys(order) if keep == "first" else [F.col(c).desc() for c in order]
    return rows.orderBy(*by, *ties).limit(n)


def nsmallest(df: DataFrame, n: int, columns: str | Sequence[str], keep: str = "first", order: Sequence[str] = ()) -> DataFrame:
    return nlargest(df, n, columns, keep, order, False)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys(order)).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)


def argsort(df: DataFrame, column: str, order: Sequence[str], name: str = "argsort") -> DataFrame:
    """(rank, name): the position in `order` of the row that comes at each rank by value."""
    placed = positions(df.select(*dict.fromkeys([*order, column])), order).withColumnRenamed(POSITION, name)
    return positions(placed, [F.col(column).asc_nulls_last(), F.col(name).asc()]).select(F.col(POSITION).alias("rank"), name)


def searchsorted(df: DataFrame, column: str, values: Sequence[float], side: str = "left") -> DataFrame:
    """(value, position): how many rows come before each value."""
    c = F.col(column)
    counts = df.agg(*[F.count_if(c < F.lit(v) if side == "left" else c <= F.lit(v)).alias(f"v{k}") for k, v in enumerate(values)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"v{k}").alias("position")) for k, v in enumerate(values)])).alias("x")).select("x.*")


def reverse(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in order])


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Rows by a hash of their values and the seed; the same for reruns."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
