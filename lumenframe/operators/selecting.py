"""Projection, filters, label and position indexing, assignment and metadata over DataFrames with explicit index and order columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.dates import second_of_day
from lumenframe.plans.ordering import POSITION, keys, positions

_KINDS = {
    "number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "integer": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double"), "int64": ("bigint",), "int32": ("int",), "float64": ("double",),
    "object": ("string",), "string": ("string",), "bool": ("boolean",), "boolean": ("boolean",), "datetime": ("timestamp", "timestamp_ntz", "date"), "timedelta": ("interval",),
}


def select_dtypes(df: DataFrame, include: str | Sequence[str] = (), exclude: str | Sequence[str] = ()) -> DataFrame:
    def inside(kind: str, names: str | Sequence[str]) -> bool:
        names = [names] if isinstance(names, str) else names
        return any(kind.startswith(_KINDS.get(n, (n,))) for n in names)

    return df.select(*[f"`{c}`" for c, kind in df.dtypes if (not include or inside(kind, include)) and not inside(kind, exclude)])


def filter_labels(df: DataFrame, items: Sequence[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
    """Columns by name: those listed, those that contain a text, or those in which a pattern is found."""
    if items is not None:
        return df.select(*[f"`{c}`" for c in items if c in df.columns])
    return df.select(*[f"`{c}`" for c in df.columns if (like is not None and like in c) or (regex is not None and re.search(regex, c))])


def loc(df: DataFrame, index: str, label: object, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by label: one, a list, an inclusive slice, a condition, or a function of the frame that gives one of these."""
    if callable(label) and not isinstance(label, Column):
        label = label(df)
    c = F.col(f"`{index}`")
    if isinstance(label, slice):
        out = df if label.start is None else df.filter(c >= F.lit(label.start))
        out = out if label.stop is None else out.filter(c <= F.lit(label.stop))
    elif isinstance(label, Column):
        out = df.filter(label)
    elif isinstance(label, list | tuple | set):
        out = df.filter(c.isin(list(label)))
    else:
        out = df.filter(c == F.lit(label))
    return out.select(*[f"`{x}`" for x in columns]) if columns else out


def iloc(df: DataFrame, at: int | slice | Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows by position in the order, from the end if negative. A plain head needs no numbering."""
    if isinstance(at, slice) and at.start in (None, 0) and at.step in (None, 1) and at.stop is not None and at.stop >= 0:
        return df.orderBy(*keys(order)).limit(at.stop)
    if isinstance(at, int):
        at = [at]
    placed = positions(df, order)
    p = F.col(POSITION)
    if isinstance(at, slice):
        n = df.count() if any(x is not None and x < 0 for x in (at.start, at.stop)) else 0
        low = 0 if at.start is None else at.start if at.start >= 0 else max(0, n + at.start)
        high = None if at.stop is None else at.stop if at.stop >= 0 else n + at.stop
        test = (p >= low) & ((p - low) % (at.step or 1) == 0)
        placed = placed.filter(test if high is None else test & (p < high))
    else:
        n = df.count() if any(x < 0 for x in at) else 0
        placed = placed.filter(p.isin([x if x >= 0 else n + x for x in at]))
    return placed.drop(POSITION)


take = iloc


def xs(df: DataFrame, key: object, level: str, drop_level: bool = True) -> DataFrame:
    out = df.filter(F.col(f"`{level}`") == F.lit(key))
    return out.drop(level) if drop_level else out


def get(df: DataFrame, column: str, default: object = None) -> DataFrame | object:
    return df.select(f"`{column}`") if column in df.columns else default


def at(df: DataFrame, index: str, label: object, column: str) -> object:
    row = df.filter(F.col(index) == F.lit(label)).select(f"`{column}`").first()
    if row is None:
        raise KeyError(label)
    return row[0]


def iat(df: DataFrame, row: int, column: str, order: Sequence[str]) -> object:
    found = iloc(df, row, order).select(f"`{column}`").first()
    if found is None:
        raise IndexError(row)
    return found[0]


def between_time(df: DataFrame, on: str, start: str, end: str, inclusive: str = "both") -> DataFrame:
    """Rows by time of day; an end before the start goes over midnight."""
    s, a, b = second_of_day(F.col(on)) + F.date_part(F.lit("SECOND"), F.col(on)).cast("double") % 1, _seconds(start), _seconds(end)
    low = s >= a if inclusive in ("both", "left") else s > a
    high = s <= b if inclusive in ("both", "right") else s < b
    return df.filter(low & high if a <= b else low | high)


def at_time(df: DataFrame, on: str, time: str) -> DataFrame:
    return between_time(df, on, time, time)


def _seconds(time: str) -> int:
    h, m, *s = (int(x) for x in time.split(":"))
    return h * 3600 + m * 60 + (s[0] if s else 0)


def truncate(df: DataFrame, index: str, before: object = None, after: object = None) -> DataFrame:
    return loc(df, index, slice(before, after))


def first_span(df: DataFrame, on: str, micros: int, last: bool = False) -> DataFrame:
    """Rows of the first (last) time span of the table."""
    from lumenframe.functions.dates import micros as us

    edge = df.agg((F.max if last else F.min)(us(F.col(on))).alias("__edge"))
    joined = df.crossJoin(F.broadcast(edge))
    test = us(F.col(on)) > F.col("__edge") - micros if last else us(F.col(on)) < F.col("__edge") + micros
    return joined.filter(test).drop("__edge")


def valid_index(df: DataFrame, column: str, index: str, order: str, last: bool = False) -> DataFrame:
    """One row: the label of the first (last) value that is not missing."""
    place = F.when(F.col(f"`{column}`").isNotNull(), F.col(f"`{order}`"))
    return df.agg((F.max_by if last else F.min_by)(F.col(index), place).alias("label"))


def assign(df: DataFrame, **columns: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """New columns; a function gets the frame with those before it."""
    for name, value in columns.items():
        df = df.withColumn(name, value(df) if callable(value) and not isinstance(value, Column) else value if isinstance(value, Column) else F.lit(value))
    return df


def insert(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"{name} is there already")
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*cols[:at], value.alias(name), *cols[at:])


def set_where(df: DataFrame, mask: Column, columns: Sequence[str], value: object) -> DataFrame:
    return df.withColumns({c: F.when(mask, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(f"`{c}`")) for c in columns})


def set_positions(df: DataFrame, rows: Sequence[int], columns: Sequence[str], value: object, order: Sequence[str]) -> DataFrame:
    return set_where(positions(df, order), F.col(POSITION).isin(list(rows)), columns, value).drop(POSITION)


def drop_rows(df: DataFrame, index: str, labels: Sequence) -> DataFrame:
    return df.filter(~F.coalesce(F.col(index).isin(list(labels)), F.lit(False)))


def reindex(df: DataFrame, index: str, labels: Sequence | DataFrame, fill_value: object = None, method: str | None = None, order: bool = True) -> DataFrame:
    """Rows for the given labels in their order; gaps are missing, filled, or taken from the nearest label before or after."""
    if not isinstance(labels, DataFrame):
        labels = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], f"`{index}` {dict(df.dtypes)[index]}, __i int")
    if method:
        from lumenframe.operators.joining import merge_asof

        out = merge_asof(labels, df, on=index, direction={"ffill": "backward", "pad": "backward", "bfill": "forward", "nearest": "nearest"}[method])
    else:
        out = labels.join(df, index, "left")
    if fill_value is not None:
        out = out.fillna(fill_value, [c for c in df.columns if c != index])
    return out.drop("__i").select(*[f"`{c}`" for c in df.columns])


def rename(df: DataFrame, columns: dict[str, str] | Callable[[str], str]) -> DataFrame:
    names = columns if isinstance(columns, dict) else {c: columns(c) for c in df.columns}
    return df.withColumnsRenamed(names)


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return rename(df, lambda c: prefix + c)


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return rename(df, lambda c: c + suffix)


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, thresh=thresh, subset=list(subset) if subset else None)


def dropna_columns(df: DataFrame, how: str = "any", thresh: int | None = None) -> DataFrame:
    """Columns without (any, all) missing values; one aggregate counts them all."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(f"`{c}`").alias(c) for c in df.columns]).first().asDict()
    n = row["__n"]
    least = thresh if thresh is not None else n if how == "any" else 1
    return df.select(*[f"`{c}`" for c in df.columns if row[c] >= least])


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, replace: bool = False, weights: str | None = None, seed: int = 0) -> DataFrame:
    """A share, or n rows: those with the least hash of their values and the seed, or with weights by exponential keys; reruns agree."""
    if frac is not None:
        return df.sample(replace, frac, seed)
    u = (F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    if replace:
        total = df.count()
        return positions(df, [u]).join(df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias(POSITION)), POSITION).drop(POSITION)
    if weights is None:
        return df.orderBy(u).limit(n)
    return df.filter(F.col(weights) > 0).orderBy(-F.log(u) / F.col(weights)).limit(n)


def equals(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, each as often; missing values are equal."""
    return a.columns == b.columns and a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def compare(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """(index, column, self, other) for each cell that differs between rows of one label."""
    rest = [c for c in a.columns if c != index]
    other = b.select(F.col(index), *[F.col(f"`{c}`").alias(f"__r_{c}") for c in rest])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("self"), F.col(f"`__r_{c}`").cast("string").alias("other")) for c in rest])
    long = a.join(other, index).select(index, F.explode(cells).alias("x")).select(index, "x.*")
    return long.filter(~F.col("self").eqNullSafe(F.col("other")))


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns cast to the narrowest of bigint, double, boolean and timestamp that holds every value; one aggregate decides."""
    if not columns:
        return df
    kinds = ("bigint", "double", "boolean", "timestamp_ntz")
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in kinds]).first().asDict()
    out = df
    for i, c in enumerate(columns):
        kind = next((k for k in kinds if not bad[f"{i}_{k}"]), None)
        if kind and dict(df.dtypes)[c] == "string":
            out = out.withColumn(c, F.col(f"`{c}`").cast(kind))
    return out


def memory_usage(df: DataFrame) -> DataFrame:
    """(column, bytes) as the rows are held: sizes of texts, fixed widths of the others."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4}
    sizes = [(F.sum(F.octet_length(F.col(f"`{c}`"))) if k == "string" else F.count(F.lit(1)) * width.get(k, 8)).cast("bigint").alias(c) for c, k in df.dtypes]
    return df.agg(*sizes).unpivot([], df.columns, "column", "bytes")


def info(df: DataFrame) -> DataFrame:
    """(column, non_null, dtype)."""
    kinds = dict(df.dtypes)
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "non_null")
    return counts.withColumn("dtype", F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds[c])])[F.col("column")])
