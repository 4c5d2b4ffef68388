"""Row order at scale: dense positions, running totals and sliding frames over a whole table without a single-task window.

A window without a partition would bring all rows into one task. Here the rows are dealt into ranges of the order, each
range is worked on by itself, and only one row of totals for each range, or a few rows next to a range's edge, cross over.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of a sliding frame, about.
BLOCK_ROWS = 200_000
#: Rows of a range, at least; ranges for each shuffle partition; sampled rows for each range.
RANGE_ROWS, RANGES, SAMPLED = 200_000, 4, 20
POSITION = "__pos"
#: A table of so many bytes, by the plan's estimate, may have a group of more than HOT_ROWS rows, which is dealt into ranges.
HOT_BYTES, HOT_ROWS = 1 << 30, 5_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Keep the rows as they are dealt, in spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def hot(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether some group of `by` is too large for one task.

    A table that is small by the plan's own estimate has none, and nothing is run to know it; else the groups are counted,
    which reads the columns of `by` alone.
    """
    if not by or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= HOT_BYTES:
        return False
    most = df.groupBy(*[F.col(f"`{c}`") for c in by]).count().agg(F.max("count")).first()[0]
    return (most or 0) > HOT_ROWS


def keys(order: Sequence[str | Column]) -> list[Column]:
    """Ascending, missing values last; a Column is taken as it is."""
    return [F.col(f"`{c}`").asc_nulls_last() if isinstance(c, str) else c for c in order]


def _plain_scan(df: DataFrame) -> bool:
    """Whether the plan is scans, projections and filters alone, which it is cheap to read again with fewer columns."""
    nodes = {re.match(r"[\s:+\-]*(\w+)", x)[1] for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.match(r"[\s:+\-]*\w", x)}
    return nodes <= {"Relation", "LogicalRelation", "Project", "Filter", "Range"}


def _number(df: DataFrame, key: str | Column) -> Column | None:
    """The key as a double in the same order; None where its kind has none."""
    kind = dict(df.dtypes).get(key) if isinstance(key, str) else None
    if kind is None:
        return None
    c = F.col(f"`{key}`")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return c.cast("double")
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else None


def sampled_bounds(df: DataFrame, number: Column) -> np.ndarray:
    """Bounds of ranges of the key with like numbers of rows, from a sample that the driver draws once; a count and the sample run here."""
    spark = df.sparkSession
    total = df.count()
    n = max(1, min(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS))
    if n == 1:
        return np.zeros(0)
    drawn = df.select(number.alias("k")).filter("k is not null")
    values = np.sort(np.array([r[0] for r in drawn.sample(min(1.0, SAMPLED * n / total), 17).collect()], np.float64))
    return values[np.linspace(0, len(values), n, endpoint=False).astype(int)[1:]] if len(values) else values


def placed(number: Column, bounds: np.ndarray) -> Column:
    """The number of the range that a key is in; a missing one is in the last."""
    if not len(bounds):
        return F.lit(0)

    @F.pandas_udf("int")  # type: ignore[call-overload]
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.fillna(np.inf).to_numpy(np.float64), side="right").astype(np.int32))

    return place(number)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """`df` with __range, the number of the range of the order that a row is in.

    Over a plain scan and a numeric or time key of many values the bounds are drawn from a sample of the first key, and nothing
    is written: what is done with the numbers reads the scan again, each time only the columns that it needs. Otherwise, and
    where one value of the first key has more than a range's rows, the rows are dealt by Spark's own range partitioning of the
    whole key, whose bounds differ from run to run, and checkpointed before a number is relied on; chains of such operators
    then compute nothing twice.
    """
    number = _number(df, order[0])
    if number is not None and _plain_scan(df):
        bounds = sampled_bounds(df, number)
        if len(np.unique(bounds)) == len(bounds):
            return df.withColumn("__range", placed(number, bounds))
    by = keys(order)
    return checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id()))


def _before(totals: DataFrame, what: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """What the ranges before each range add up to: a window over one row for each range."""
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__range", *[f(F.col(c)).over(w).alias(c) for c, f in what.items()])


def positions(df: DataFrame, order: Sequence[str | Column], name: str = POSITION) -> DataFrame:
    """`df` with the place of each row in the order, from 0 without gaps.

    Tied rows come in any order, which may change where a plain scan is read again: an order that must hold needs a last key
    that tells rows apart.
    """
    dealt = ranged(df, order)
    before = _before(dealt.groupBy("__range").agg(F.count("*").alias("__before")), {"__before": F.sum})
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys(order))) - 1
    numbered = dealt.withColumn("__within", within).join(F.broadcast(before), "__range")
    return numbered.withColumn(name, (F.col("__within") + F.coalesce("__before", F.lit(0))).cast("bigint")).drop("__range", "__within", "__before")


#: Whole aggregate, its form over totals, and how a total meets what a range has so far.
SCANS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "prod": (F.product, F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def scan(df: DataFrame, order: Sequence[str | Column], columns: dict[str, tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """`df` with running results: {name: (kind of SCANS, input)}; over each group of `by`, or over the whole table.

    With groups this is a plain window, unless a group is hot. Over the whole table, and with hot groups over ranges of the
    groups and the order, each range runs on from the totals of the ranges before it.
    """
    by = list(by)
    if by and not hot(df, by):
        w = Window.partitionBy(*by).orderBy(*keys(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: SCANS[k][0](c).over(w) for n, (k, c) in columns.items()})
    given = df.withColumns({f"__in_{n}": c for n, (_, c) in columns.items()})
    dealt = ranged(given, [*by, *order])
    within = Window.partitionBy("__range", *by).orderBy(*keys(order))
    totals = []
    if any(k == "last" for k, _ in columns.values()):
        dealt = dealt.withColumn("__place", F.row_number().over(within))
    for n, (k, _) in columns.items():
        value = F.col(f"__in_{n}")
        totals.append((F.max_by(value, F.when(value.isNotNull(), F.col("__place"))) if k == "last" else SCANS[k][0](value)).alias(f"__b_{n}"))
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.groupBy("__range", *by).agg(*totals)
    before = found.select(F.col("__range").alias("__of"), *[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(by)], F.count(F.lit(1)).over(w).alias("__earlier"), *[SCANS[k][1](F.col(f"__b_{n}")).over(w).alias(f"__b_{n}") for n, (k, _) in columns.items()])
    same = F.col("__range") == F.col("__of")
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}"))
    run = dealt.withColumns({f"__r_{n}": SCANS[k][0](F.col(f"__in_{n}")).over(within.rowsBetween(Window.unboundedPreceding, 0)) for n, (k, _) in columns.items()})
    # at most one group of a range began in an earlier one, so what is broadcast has no more rows than there are ranges
    run = run.join(F.broadcast(before.filter("__earlier > 0").drop("__earlier")), same, "left")
    run = run.withColumns({n: SCANS[k][2](F.col(f"__b_{n}"), F.col(f"__r_{n}")) for n, (k, _) in columns.items()})
    return run.drop("__range", "__of", "__place", *[f"__g{i}" for i in range(len(by))], *[f"__{x}_{n}" for n in columns for x in ("in", "b", "r")])


def sliding(df: DataFrame, order: Sequence[str | Column], columns: dict[str, Callable[[Window], Column]], before: int = 0, after: int = 0, by: Sequence[str] = (), block: int = BLOCK_ROWS) -> DataFrame:
    """`df` with window expressions that look at most `before` rows back and `after` rows ahead.

    Each value of `columns` makes an expression out of an ordered window without a frame. With groups this is a plain
    window, unless a group is hot. Over the whole table, and with hot groups over the groups and the order, rows are dealt into
    blocks by position; a row near an edge is a guest in the neighbouring block too.
    """
    by = list(by)
    if by and not hot(df, by):
        w = Window.partitionBy(*by).orderBy(*keys(order))
        return df.withColumns({n: f(w) for n, f in columns.items()})
    block = max(block, before + after + 1)
    placed = positions(df, [*by, *order])
    home = F.floor(F.col(POSITION) / block)
    ahead = F.floor((F.col(POSITION) + before) / block)
    behind = F.floor((F.col(POSITION) - after) / block)
    seats = F.array_distinct(F.array(home, ahead, F.greatest(behind, F.lit(0))))
    seated = placed.withColumn("__home", home).withColumn("__block", F.explode(seats))
    w = Window.partitionBy("__block", *by).orderBy(POSITION)
    return seated.withColumns({n: f(w) for n, f in columns.items()}).filter("__block = __home").drop("__block", "__home", POSITION)
