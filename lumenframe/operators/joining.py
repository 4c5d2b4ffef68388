"""Joins: equi-joins whose missing keys match, index joins, ordered and as-of merges, products and correlations across frames.

No side is broadcast by force: adaptive execution picks the strategy from measured sizes and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import statistics as S
from lumenframe.plans.ordering import scan

Names = str | Sequence[str]
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def names(x: Names | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _validate(df: DataFrame, on: list[str], side: str) -> None:
    if df.groupBy(*on).count().filter("count > 1").limit(1).count():
        raise ValueError(f"merge keys are not unique in the {side} table")


def merge(
    left: DataFrame, right: DataFrame, how: str = "inner", on: Names | None = None, left_on: Names | None = None, right_on: Names | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool | str = False, validate: str | None = None, null_keys: bool = True,
) -> DataFrame:
    """Equi-join. Keys of one name appear once, keys of two names both stay; other columns that both have get the suffixes.

    Missing keys match each other unless `null_keys` is off. Without `on` all shared columns are keys. `semi` and `anti` keep
    the left columns. `validate` (one_to_one, one_to_many, many_to_one) looks for repeated keys with a grouped count.
    """
    if how == "cross":
        shared = [c for c in left.columns if c in right.columns]
        a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
        return a.crossJoin(right.withColumnsRenamed({c: c + suffixes[1] for c in shared}))
    lk, rk = names(left_on) or names(on), names(right_on) or names(on)
    if not lk:
        lk = rk = [c for c in left.columns if c in right.columns]
    if not lk or len(lk) != len(rk):
        raise ValueError("a merge needs as many keys on the left as on the right, one at least")
    if validate in ("one_to_one", "1:1", "one_to_many", "1:m"):
        _validate(left, lk, "left")
    if validate in ("one_to_one", "1:1", "many_to_one", "m:1"):
        _validate(right, rk, "right")
    keyed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns])
    condition = None
    for a, b in zip(lk, rk, strict=True):
        x, y = left[f"`{a}`"], keyed[f"`__r_{b}`"]
        test = x.eqNullSafe(y) if null_keys else x == y
        condition = test if condition is None else condition & test
    if how in ("semi", "anti"):
        return left.join(keyed, condition, HOW[how])
    if indicator:
        left, keyed = left.withColumn("__in_left", F.lit(True)), keyed.withColumn("__in_right", F.lit(True))
    joined = left.join(keyed, condition, HOW[how])
    merged = {a for a, b in zip(lk, rk, strict=True) if a == b}
    out: list[Column] = []
    plain_left = [c for c in left.columns if c != "__in_left"]
    clash = {c for c in plain_left if c in right.columns and c not in merged}
    for c in plain_left:
        value = F.col(f"`{c}`")
        if c in merged and how in ("right", "outer", "full"):
            value = F.when(F.col("__in_left"), value).otherwise(F.col(f"`__r_{c}`")) if indicator else F.coalesce(value, F.col(f"`__r_{c}`"))
        out.append(value.alias(c + suffixes[0] if c in clash else c))
    for c in right.columns:
        if c not in merged:
            out.append(F.col(f"`__r_{c}`").alias(c + suffixes[1] if c in clash else c))
    if indicator:
        seen = F.when(F.col("__in_left") & F.col("__in_right"), "both").when(F.col("__in_left"), "left_only").otherwise("right_only")
        out.append(seen.alias(indicator if isinstance(indicator, str) else "_merge"))
    return joined.select(*out)


def merge_ordered(left: DataFrame, right: DataFrame, on: str, how: str = "outer", left_by: Names | None = None, fill_method: str | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Outer merge on an ordered key; with `ffill`, gaps are filled from the rows before, inside each `left_by` group.

    With groups, every group meets the whole right table on the key, which is a join on (group, key) of two tables.
    """
    by = names(left_by)
    if by:
        groups = left.select(*by).distinct()
        right = groups.crossJoin(right) if right.sparkSession is not None else right
    merged = merge(left, right, how, on=[*by, on], suffixes=suffixes)
    if fill_method == "ffill":
        from lumenframe.plans.ordering import scan

        rest = [c for c in merged.columns if c not in (*by, on)]
        tagged = merged if by else merged.withColumns({c: F.col(f"`{c}`") for c in rest})
        merged = scan(tagged, [on], {c: ("last", F.col(f"`{c}`")) for c in rest}, by)
    return merged.select(*[f"`{c}`" for c in merged.columns])


def merge_asof(
    left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by: Names | None = None,
    direction: str = "backward", tolerance: float | Column | None = None, allow_exact_matches: bool = True, suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Each left row with the last right row at or before it (backward), the next (forward) or the nearer of both (nearest).

    Both sides are stacked and one window over the key, inside each `by` group, carries the last right row along: one shuffle
    and no product of rows. Without groups the carrying is a scan over ranges. Ties among right rows take the last of them.
    """
    lt, rt, by = left_on or on, right_on or on, names(by)
    rest = [c for c in right.columns if c not in by and (c != rt or lt != rt)]
    clash = {c for c in rest if c in left.columns}
    asked = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"), F.lit(None).alias("__right"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)], F.col(f"`{lt}`").alias("__t"), F.lit(1).alias("__side"))
    held = right.filter(F.col(f"`{rt}`").isNotNull()).select(F.lit(None).alias("__left"), F.struct(F.col(f"`{rt}`").alias("__rt"), *[F.col(f"`{c}`").alias(f"__c_{c}") for c in rest]).alias("__right"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)], F.col(f"`{rt}`").alias("__t"), F.lit(0).alias("__side"))
    both = held.unionByName(asked)
    groups = [f"__k{i}" for i in range(len(by))]

    def carried(df: DataFrame, name: str, forward: bool) -> DataFrame:
        """The side tag decides ties: held rows come before asking rows where exact matches count, else after them."""
        tag = F.when(F.col("__side") == 0, 0 if allow_exact_matches else 2).otherwise(1)
        order = [F.col("__t").desc() if forward else F.col("__t").asc(), tag.asc()]
        if groups:
            return scan(df, order, {name: ("last", F.col("__right"))}, groups)
        return _carry(df, name, order)

    if direction in ("backward", "nearest"):
        both = carried(both, "__back", False)
    if direction in ("forward", "nearest"):
        both = carried(both, "__ahead", True)
    found = F.col("__back") if direction == "backward" else F.col("__ahead")
    if direction == "nearest":
        gap_back, gap_ahead = distance(F.col("__t"), F.col("__back.__rt")), distance(F.col("__ahead.__rt"), F.col("__t"))
        found = F.when(F.col("__ahead").isNull() | (gap_back <= gap_ahead), F.col("__back")).otherwise(F.col("__ahead"))
    out = both.filter("__side = 1").withColumn("__found", found)
    if tolerance is not None:
        near = F.abs(distance(F.col("__t"), F.col("__found.__rt"))) <= tolerance
        out = out.withColumn("__found", F.when(near, F.col("__found")))
    return out.select(*[F.col(f"__left.`{c}`").alias(c + suffixes[0] if c in clash else c) for c in left.columns], *[F.col(f"__found.`__c_{c}`").alias(c + suffixes[1] if c in clash else c) for c in rest])


def distance(a: Column, b: Column) -> Column:
    """a - b as a number: seconds for timestamps."""
    return a.cast("timestamp").cast("double") - b.cast("timestamp").cast("double")


def _carry(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """The last __right so far over the whole order: each range of rows runs on from the last one of the ranges before."""
    from lumenframe.plans.ordering import _before, ranged

    dealt = ranged(df, order)
    w = Window.partitionBy("__range").orderBy(*order)
    last = dealt.withColumn("__n", F.row_number().over(w)).groupBy("__range").agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__n"))).alias("__b"))
    before = _before(last, {"__b": lambda c: F.last(c, ignorenulls=True)})
    run = dealt.withColumn("__own", F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.join(F.broadcast(before), "__range").withColumn(name, F.coalesce("__own", "__b")).drop("__range", "__own", "__b")


def join_index(left: DataFrame, right: DataFrame, index: Names, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> DataFrame:
    clash = [c for c in left.columns if c in right.columns and c not in names(index)]
    if clash and not (lsuffix or rsuffix):
        raise ValueError(f"columns overlap without a suffix: {clash}")
    return merge(left, right, how, on=names(index), suffixes=(lsuffix, rsuffix))


def align(left: DataFrame, right: DataFrame, index: Names, join: str = "outer") -> tuple[DataFrame, DataFrame]:
    """Both frames with the same labels: all columns and rows of either (outer), or those of both (inner)."""
    on = names(index)
    labels = left.select(*on).join(right.select(*on), on, HOW[join] if join != "outer" else "full").distinct()
    every = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    if join == "inner":
        every = [c for c in left.columns if c in right.columns]

    def conformed(df: DataFrame) -> DataFrame:
        wide = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in every])
        return labels.join(wide, on, "left").select(*every)

    return conformed(left), conformed(right)


def overlay(left: DataFrame, right: DataFrame, index: Names, how: str = "update") -> DataFrame:
    """`update`: right's values where they are not missing, on the left's rows and columns. `combine_first`: left's values,
    gaps filled from the right, all rows and columns of both."""
    on = names(index)
    rest = [c for c in left.columns if c not in on]
    more = [c for c in right.columns if c not in on and c not in rest] if how == "combine_first" else []
    keyed = right.select(*on, *[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns if c not in on])
    joined = left.join(keyed, on, "full" if how == "combine_first" else "left")
    pick = {c: (F.coalesce(f"`__r_{c}`", f"`{c}`") if how == "update" else F.coalesce(f"`{c}`", f"`__r_{c}`")) if c in right.columns else F.col(f"`{c}`") for c in rest}
    return joined.select(*on, *[pick[c].alias(c) for c in rest], *[F.col(f"`__r_{c}`").alias(c) for c in more])


def combine(left: DataFrame, right: DataFrame, index: Names, func, fill: float | None = None) -> DataFrame:
    """func(left value, right value) for the columns that both have, over all labels of both."""
    on = names(index)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    keyed = right.select(*on, *[F.col(f"`{c}`").alias(f"__r_{c}") for c in shared])
    joined = left.select(*on, *shared).join(keyed, on, "full")
    side = lambda c: F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill))
    return joined.select(*on, *[func(side(f"`{c}`"), side(f"`__r_{c}`")).alias(c) for c in shared])


def dot(left: DataFrame, row: str, key: str, value: str, right: DataFrame, right_key: str, col: str, right_value: str) -> DataFrame:
    """Matrix product of two matrices in long form: (row, col, value)."""
    a = left.select(F.col(row).alias("row"), F.col(key).alias("k"), F.col(value).alias("x"))
    b = right.select(F.col(right_key).alias("k"), F.col(col).alias("col"), F.col(right_value).alias("y"))
    return a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def corrwith(left: DataFrame, right: DataFrame, index: Names, columns: Sequence[str]) -> DataFrame:
    """One row: the correlation of each column with its namesake, over the rows that both index."""
    on = names(index)
    keyed = right.select(*on, *[F.col(f"`{c}`").alias(f"__r_{c}") for c in columns])
    return left.join(keyed, on).agg(*[S.corr(F.col(f"`{c}`"), F.col(f"`__r_{c}`")).alias(c) for c in columns])


def positional(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Side by side by position; the shorter side is padded with missing values."""
    from lumenframe.plans.ordering import POSITION, positions

    a, b = positions(left, left_order), positions(right, right_order)
    return a.join(b, POSITION, "full").drop(POSITION)


__all__ = ["align", "combine", "corrwith", "dot", "join_index", "keys", "merge", "merge_asof", "merge_ordered", "overlay", "positional"]
