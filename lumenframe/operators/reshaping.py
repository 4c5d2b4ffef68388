"""Reshapes and set-like operators: stacking, wide and long forms, dummies, bins, codes, duplicates.

Where the columns of a result are values of the data, one distinct count fetches them first; MOST_COLUMNS bounds how many.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import statistics as S
from lumenframe.functions.elementwise import cut as cut_column
from lumenframe.plans.ordering import POSITION, keys, positions

MOST_COLUMNS = 10_000


def _list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values, for results whose columns are values."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} distinct values, too many for columns")
    return sorted(found)


def concat(frames: Sequence[DataFrame | None], join: str = "outer", names: Sequence[str] | None = None, key: str = "key") -> DataFrame:
    """Frames one below another: all columns (outer) or the shared ones (inner). `names` tag the rows of each frame."""
    given = [(f, names[i] if names else None) for i, f in enumerate(frames) if f is not None]
    if not given:
        raise ValueError("nothing to concatenate")
    shared = [c for c in given[0][0].columns if all(c in f.columns for f, _ in given)]
    parts = [(f.select(*[f"`{c}`" for c in shared]) if join == "inner" else f).withColumns({key: F.lit(n)} if names else {}) for f, n in given]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=join == "outer"), parts)


def explode(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """A row for each element; a missing or empty list keeps its row with a missing value. Several columns go in step."""
    columns = _list(columns)
    if len(columns) == 1:
        return df.withColumn(columns[0], F.explode_outer(columns[0]))
    zipped = df.withColumn("__z", F.explode_outer(F.arrays_zip(*columns)))
    return zipped.withColumns({c: F.col(f"__z.{c}") for c in columns}).drop("__z")


def melt(df: DataFrame, id_vars: str | Sequence[str] | None = None, value_vars: str | Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    ids = _list(id_vars)
    return df.unpivot(ids, _list(value_vars) or [c for c in df.columns if c not in ids], var_name, value_name)


def pivot(df: DataFrame, index: str | Sequence[str], columns: str, values: str | Sequence[str]) -> DataFrame:
    """Long to wide; two rows for one cell are an error, found while aggregating."""
    index, values = _list(index), _list(values)
    heads = distinct_values(df, columns)
    if len(values) == 1:
        return df.groupBy(*index).pivot(columns, heads).agg(_once(values[0]))
    return df.groupBy(*index).pivot(columns, heads).agg(*[_once(v).alias(v) for v in values])


def _once(value: str) -> Column:
    """The only value of a cell; an error where a cell has several rows."""
    one = F.max(F.col(f"`{value}`"))
    return F.when(F.assert_true(F.count(F.lit(1)) <= 1, "index contains duplicate entries, cannot reshape").isNull(), one)


def pivot_table(df: DataFrame, values: str, index: str | Sequence[str], columns: str, aggfunc: str = "mean", fill_value: object = None, margins: bool = False, margins_name: str = "All", heads: Sequence | None = None) -> DataFrame:
    """Aggregated cells; with margins, totals over rows and columns from the rows themselves."""
    index = _list(index)
    heads = list(heads) if heads is not None else distinct_values(df, columns)
    rows = df.dropna(subset=[*index, columns])
    value = S.aggregate(aggfunc, F.col(f"`{values}`"))
    wide = rows.groupBy(*index).pivot(columns, heads).agg(value)
    if margins:
        wide = wide.join(rows.groupBy(*index).agg(value.alias(margins_name)), index)
        foot = rows.groupBy().pivot(columns, heads).agg(value).crossJoin(rows.agg(value.alias(margins_name)))
        foot = foot.select(F.lit(margins_name).alias(index[0]), *[F.lit("").alias(c) for c in index[1:]], *[f"`{h}`" for h in heads], margins_name)
        wide = wide.withColumns({c: F.col(c).cast("string") for c in index}).unionByName(foot)
    if fill_value is not None:
        wide = wide.fillna(fill_value, [str(h) for h in heads])
    return wide


def crosstab(df: DataFrame, index: str, columns: str, normalize: bool = False, values: str | None = None, aggfunc: str = "count") -> DataFrame:
    heads = distinct_values(df, columns)
    rows = df.dropna(subset=[index, columns])
    value = F.count(F.lit(1)) if values is None else S.aggregate(aggfunc, F.col(values))
    wide = rows.groupBy(index).pivot(columns, heads).agg(value).fillna(0)
    if normalize:
        n = rows.count()
        wide = wide.select(index, *[(F.col(f"`{h}`") / n).alias(str(h)) for h in heads])
    return wide


def stack(df: DataFrame, index: str | Sequence[str], level: str = "level", value: str = "value") -> DataFrame:
    """Columns to rows; missing cells have none."""
    return melt(df, index, None, level, value).dropna(subset=[value])


def unstack(df: DataFrame, index: str | Sequence[str], level: str, value: str, fill_value: object = None) -> DataFrame:
    out = df.groupBy(*_list(index)).pivot(level, distinct_values(df, level)).agg(F.first(value, ignorenulls=True))
    return out if fill_value is None else out.fillna(fill_value)


def get_dummies(df: DataFrame, columns: str | Sequence[str], prefix: str | None = None, sep: str = "_", drop_first: bool = False, dummy_na: bool = False) -> DataFrame:
    out = df
    for c in _list(columns):
        heads = distinct_values(df, c)[int(drop_first) :]
        made = {f"{prefix or c}{sep}{h}": F.coalesce(F.col(c) == F.lit(h), F.lit(False)) for h in heads}
        if dummy_na:
            made[f"{prefix or c}{sep}nan"] = F.col(c).isNull()
        out = out.withColumns(made).drop(c)
    return out


def wide_to_long(df: DataFrame, stubs: str | Sequence[str], i: str | Sequence[str], j: str, sep: str = "", suffix: str = r"\d+") -> DataFrame:
    """Columns `stub + sep + suffix` to rows with j = suffix."""
    import re

    stubs, i = _list(stubs), _list(i)
    found = sorted({m[1] for c in df.columns for s in stubs if (m := re.fullmatch(re.escape(s + sep) + f"({suffix})", c))}, key=lambda x: (len(x), x))
    rest = [c for c in df.columns if c not in i and not any(re.fullmatch(re.escape(s + sep) + suffix, c) for s in stubs)]
    rows = F.array(*[F.struct(F.lit(int(x) if x.isdigit() else x).alias(j), *[(F.col(f"`{s}{sep}{x}`") if f"{s}{sep}{x}" in df.columns else F.lit(None)).alias(s) for s in stubs]) for x in found])
    return df.select(*i, *rest, F.explode(rows).alias("__r")).select(*i, *rest, F.col(f"__r.{j}").alias(j), *[F.col(f"__r.{s}").alias(s) for s in stubs])


def lreshape(df: DataFrame, groups: dict[str, Sequence[str]], dropna: bool = True) -> DataFrame:
    rest = [c for c in df.columns if not any(c in g for g in groups.values())]
    n = len(next(iter(groups.values())))
    rows = F.array(*[F.struct(*[F.col(f"`{g[k]}`").alias(name) for name, g in groups.items()]) for k in range(n)])
    out = df.select(*rest, F.explode(rows).alias("__r")).select(*rest, *[F.col(f"__r.{name}").alias(name) for name in groups])
    return out.dropna(subset=list(groups)) if dropna else out


def cut(df: DataFrame, column: str, bins: int | Sequence[float], name: str, labels: Sequence | None = None, right: bool = True) -> DataFrame:
    """Bins by edges, or so many of equal width between the extremes (which one aggregate fetches; the low edge is widened by a thousandth)."""
    if isinstance(bins, int):
        low, high = (float(x) for x in df.agg(F.min(column), F.max(column)).first())
        edges = [low + (high - low) * k / bins for k in range(bins + 1)]
        if right:
            edges[0] -= (high - low) * 0.001
        else:
            edges[-1] += (high - low) * 0.001
    else:
        edges = list(bins)
    return df.withColumn(name, cut_column(F.col(f"`{column}`"), edges, labels if labels is not None else list(range(len(edges) - 1)), right))


def qcut(df: DataFrame, column: str, q: int | Sequence[float], name: str, labels: Sequence | None = None) -> DataFrame:
    """Bins by exact quantiles, whatever the size of the table."""
    from lumenframe.operators.aggregating import quantiles

    shares = [k / q for k in range(q + 1)] if isinstance(q, int) else list(q)
    edges = quantiles(df, [column], shares)[column]
    if edges[0] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, cut_column(F.col(f"`{column}`"), edges, labels if labels is not None else list(range(len(edges) - 1)), True, True))


def hist(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, count) of equal-width bins between the extremes, empty ones too."""
    low, high = (float(x) for x in df.agg(F.min(column), F.max(column)).first())
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def factorize(df: DataFrame, column: str, name: str, order: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Integer codes by first appearance in `order`, or by value; missing values have -1. The distinct values are numbered and joined back."""
    c = F.col(f"`{column}`")
    values = df.filter(c.isNotNull()).groupBy(c.alias("__v")).agg(F.min(F.struct(*order)).alias("__first") if order and not sort else F.lit(0).alias("__first"))
    numbered = positions(values, ["__v"] if sort or not order else [F.col("__first").asc()], name).select("__v", name)
    return df.join(numbered, c == F.col("__v"), "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("__v")


def unique(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Distinct values, a missing one too, with the place of their first appearance."""
    return df.groupBy(F.col(column)).agg(F.min(F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("first_seen"))


def drop_duplicates(df: DataFrame, subset: str | Sequence[str] | None = None, order: Sequence[str] = (), keep: str | bool = "first") -> DataFrame:
    """One row for each combination: the first or last in `order`; with keep False, only combinations of one row.

    first and last are grouped extremes with partial aggregation, so a combination with very many rows shuffles few.
    """
    subset = _list(subset) or [c for c in df.columns if c not in order]
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    place = F.struct(*order) if order else F.lit(0)
    if keep is False:
        pick, n = F.any_value(row), F.count(F.lit(1))
    else:
        pick, n = (F.min_by if keep == "first" else F.max_by)(row, place), F.lit(1)
    out = df.groupBy(*[F.col(f"`{c}`") for c in subset]).agg(pick.alias("__row"), n.alias("__n") if keep is False else F.first(n).alias("__n"))
    if keep is False:
        out = out.filter("__n = 1")
    return out.select(*[F.col(f"`{c}`") if c in subset else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def duplicated(df: DataFrame, subset: str | Sequence[str], order: Sequence[str], name: str = "duplicated", keep: str | bool = "first") -> DataFrame:
    """Whether an equal row comes before (first), after (last), or anywhere (False)."""
    subset = _list(subset)
    n = F.count(F.lit(1)) if keep is False else None
    place = F.struct(*order)
    marks = df.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(subset)]).agg((n if n is not None else (F.min if keep == "first" else F.max)(place)).alias("__m"))
    test = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(subset)])
    joined = df.join(marks, test)
    flag = F.col("__m") > 1 if keep is False else place != F.col("__m")
    return joined.withColumn(name, flag).drop("__m", *[f"__k{i}" for i in range(len(subset))])


def value_counts(df: DataFrame, subset: str | Sequence[str], normalize: bool = False, dropna: bool = True, sort: bool = True, ascending: bool = False, bins: int | None = None) -> DataFrame:
    subset = _list(subset)
    if bins:
        return hist(df, subset[0], bins)
    rows = df.dropna(subset=subset) if dropna else df
    out = rows.groupBy(*subset).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = rows.agg(F.count(F.lit(1)).alias("__all"))
        out = out.crossJoin(F.broadcast(total)).select(*subset, (F.col("count") / F.col("__all")).alias("proportion"))
    shown = "proportion" if normalize else "count"
    return out.orderBy(F.col(shown).asc() if ascending else F.col(shown).desc(), *keys(subset)) if sort else out


def transpose(df: DataFrame, index: str, most: int = MOST_COLUMNS) -> DataFrame:
    """Rows to columns; only for tables of few rows, as each becomes a column."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows cannot become columns")
    rest = [c for c in df.columns if c != index]
    long = df.unpivot([index], rest, "key", "value")
    return long.groupBy("key").pivot(index, [r[0] for r in df.select(index).orderBy(index).collect()]).agg(F.first("value"))


def repeat(df: DataFrame, times: int | Column) -> DataFrame:
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn("__i", F.explode(F.sequence(F.lit(1), n))).filter(n > 0).drop("__i") if isinstance(times, Column) else df.withColumn("__i", F.explode(F.array_repeat(F.lit(0), n))).drop("__i")


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "index", offset: int = 0) -> DataFrame:
    return positions(df, order).withColumn(name, F.col(POSITION) + offset).drop(POSITION)


def gather_every(df: DataFrame, n: int, order: Sequence[str], offset: int = 0) -> DataFrame:
    return positions(df, order).filter((F.col(POSITION) >= offset) & ((F.col(POSITION) - offset) % n == 0)).drop(POSITION)


def is_duplicated(df: DataFrame, name: str = "is_duplicated") -> DataFrame:
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(name, F.count(F.lit(1)).over(w) > 1)
