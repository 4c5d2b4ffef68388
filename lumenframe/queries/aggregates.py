"""Whole-table and grouped aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import statistics as S
from lumenframe.operators import aggregating, udfs
from lumenframe.operators.grouping import Groups
from lumenframe.queries.registry import EVENTS, events, r, register, rounded, table

# Whole tables


@register("reduce_basic", f"WITH {EVENTS} SELECT count(v) AS n, round(sum(v), 2) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, count(*) AS size, count(DISTINCT v) AS kinds, count(*) - count(v) AS missing FROM e")
def reduce_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return events(spark, sf_dir).agg(*[S.aggregate(h, v).alias(n) for h, n in (("count", "n"), ("size", "size"), ("nunique", "kinds"), ("null_count", "missing"), ("min", "low"), ("max", "high"))], r(S.total(v), 2).alias("total"), r(F.avg(v)).alias("mean"))


@register("reduce_moments", f"WITH {EVENTS} SELECT round(var_samp(v), 6) AS var, round(stddev_samp(v), 6) AS std, round(var_pop(v), 6) AS var0, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt FROM e")
def reduce_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return events(spark, sf_dir).agg(r(S.var(v)).alias("var"), r(S.std(v)).alias("std"), r(S.var(v, 0)).alias("var0"), r(S.sem(v)).alias("sem"), r(S.skew(v)).alias("skew"), r(S.kurt(v)).alias("kurt"))


@register("reduce_quantiles", f"WITH {EVENTS} SELECT round(median(v::DOUBLE), 6) AS median, round(quantile_cont(v::DOUBLE, 0.66), 6) AS q66, round(quantile_cont(v::DOUBLE, 0.01), 6) AS q01 FROM e")
def reduce_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregating.quantiles(events(spark, sf_dir), ["v"], [0.5, 0.66, 0.01])["v"]
    return rounded(spark.createDataFrame([tuple(found)], "median double, q66 double, q01 double"), "median", "q66", "q01")


@register("reduce_quantiles_ranked", f"WITH {EVENTS} SELECT round(median(v::DOUBLE), 6) AS median, round(quantile_cont(v::DOUBLE, 0.66), 6) AS q66, round(quantile_cont(v::DOUBLE, 0.01), 6) AS q01 FROM e")
def reduce_quantiles_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregating.ranked_quantiles(events(spark, sf_dir), "v", [0.5, 0.66, 0.01])
    return rounded(spark.createDataFrame([tuple(found)], "median double, q66 double, q01 double"), "median", "q66", "q01")


@register("quantile_interpolations", "WITH s AS (SELECT event_type, list(value ORDER BY value) AS l, (count(value) - 1) * 0.3::DOUBLE AS k FROM events GROUP BY ALL) SELECT event_type, list_extract(l, CAST(floor(k) AS INT) + 1) AS lower, list_extract(l, CAST(ceil(k) AS INT) + 1) AS higher, round((list_extract(l, CAST(floor(k) AS INT) + 1) + list_extract(l, CAST(ceil(k) AS INT) + 1)) / 2, 6) AS midpoint FROM s")
def quantile_interpolations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "events"), "event_type").agg(lower=("value", "quantile", {"q": 0.3, "interpolation": "lower"}), higher=("value", "quantile", {"q": 0.3, "interpolation": "higher"}), midpoint=r(S.quantile(F.col("value"), 0.3, "midpoint")))


@register("reduce_logic", "SELECT bool_or(value > 90) AS any_big, bool_and(value >= 0) AS all_positive, bool_or(false) AS none FROM events")
def reduce_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(S.any_(v > 90).alias("any_big"), S.all_(v >= 0).alias("all_positive"), S.any_(F.lit(False)).alias("none"))


@register("reduce_product_min_count", "SELECT user_id, round(ln(coalesce(product(1 + value / 100), 1)), 6) AS prod, CASE WHEN count(value) >= 20 THEN round(sum(value), 2) END AS total FROM events GROUP BY user_id")
def reduce_product_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(r(F.log(S.prod(1 + F.col("value") / 100))).alias("prod"), r(S.total(F.col("value"), 20), 2).alias("total"))


@register("reduce_empty", "SELECT 0.0::DOUBLE AS total, 1.0::DOUBLE AS prod, NULL::DOUBLE AS mean, 0::BIGINT AS n, false AS some, true AS every FROM region LIMIT 1")
def reduce_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").filter(F.lit(False)).agg(S.total(v).cast("double").alias("total"), S.prod(v).alias("prod"), F.avg(v).alias("mean"), F.count(v).alias("n"), S.any_(v > 0).alias("some"), S.all_(v > 0).alias("every"))


@register("reduce_skipna", f"WITH {EVENTS} SELECT NULL::DOUBLE AS v, round(sum(value), 2) AS value FROM e")
def reduce_skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.reduce_columns(events(spark, sf_dir), "sum", ["v", "value"], skipna=False), "v", "value", digits=2)


@register("idxmax_idxmin", "SELECT 'max' AS how, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_retailprice, arg_max(p_partkey, (p_size, -p_partkey)) AS p_size FROM part UNION ALL SELECT 'min', arg_min(p_partkey, (p_retailprice, p_partkey)), arg_min(p_partkey, (p_size, p_partkey)) FROM part")
def idxmax_idxmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    high = aggregating.extreme_label(p, ["p_retailprice", "p_size"], "p_partkey", "p_partkey").withColumn("how", F.lit("max"))
    return high.unionByName(aggregating.extreme_label(p, ["p_retailprice", "p_size"], "p_partkey", "p_partkey", False).withColumn("how", F.lit("min"))).select("how", "p_retailprice", "p_size")


@register("mode_all", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c)")
def mode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregating.mode(table(spark, sf_dir, "part"), "p_size")


@register(
    "describe_numeric",
    """SELECT 'l_quantity' AS "column", count(l_quantity)::DOUBLE AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS "25%", quantile_cont(l_quantity, 0.5) AS "50%", quantile_cont(l_quantity, 0.75) AS "75%", max(l_quantity) AS max FROM lineitem
    UNION ALL SELECT 'l_discount', count(l_discount)::DOUBLE, round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), max(l_discount) FROM lineitem""",
)
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), "mean", "std")


@register(
    "describe_objects",
    """WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), c AS (SELECT "column", v, count(*) AS n FROM l GROUP BY ALL)
    SELECT "column", sum(n)::BIGINT AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM c GROUP BY "column" """,
)
def describe_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregating.describe_objects(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("agg_lists", "SELECT 'sum' AS aggregate, sum(p_size)::DOUBLE AS p_size, round(sum(p_retailprice), 2) AS p_retailprice FROM part UNION ALL SELECT 'max', max(p_size), NULL FROM part UNION ALL SELECT 'mean', NULL, round(avg(p_retailprice), 2) FROM part")
def agg_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.agg(table(spark, sf_dir, "part"), {"p_size": ["sum", "max"], "p_retailprice": ["sum", "mean"]}), "p_size", "p_retailprice", digits=2)


@register("corr_pearson", "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0")
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.corr(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]), "corr")


@register("corr_spearman", "WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT 'p_size' AS x, 'p_retailprice' AS y, round(corr(a, b), 6) AS corr FROM k")
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.corr(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "spearman").filter("x = 'p_size' and y = 'p_retailprice'"), "corr")


@register(
    "corr_kendall",
    """WITH p AS (SELECT c_nationkey AS x, floor(c_acctbal / 1000) AS y, count(*) AS n FROM customer GROUP BY ALL)
    SELECT 'c_nationkey' AS x, 'band' AS y, round(sum(sign((a.x - b.x) * (a.y - b.y)) * a.n * b.n) / sqrt((sum(a.n * b.n) FILTER (a.x <> b.x))::DOUBLE * (sum(a.n * b.n) FILTER (a.y <> b.y))::DOUBLE), 6) AS corr FROM p a, p b""",
)
def corr_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000))
    return rounded(aggregating.corr(c, ["c_nationkey", "band"], "kendall").filter("x = 'c_nationkey' and y = 'band'"), "corr")


@register(
    "corr_kendall_whole",
    """WITH p AS (SELECT c_nationkey AS x, c_acctbal::DOUBLE AS y, count(*) AS n FROM customer GROUP BY ALL)
    SELECT 'c_nationkey' AS x, 'c_acctbal' AS y, round(sum(sign((a.x - b.x) * (a.y - b.y)) * a.n * b.n) / sqrt((sum(a.n * b.n) FILTER (a.x <> b.x))::DOUBLE * (sum(a.n * b.n) FILTER (a.y <> b.y))::DOUBLE), 6) AS corr FROM p a, p b""",
)
def corr_kendall_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.corr(table(spark, sf_dir, "customer"), ["c_nationkey", "c_acctbal"], "kendall").filter("x = 'c_nationkey' and y = 'c_acctbal'"), "corr")


@register("cov_matrix", f"WITH {EVENTS} SELECT 'v' AS x, 'user_id' AS y, round(covar_samp(v, user_id), 6) AS cov FROM e UNION ALL SELECT 'user_id', 'v', round(covar_samp(v, user_id), 6) FROM e UNION ALL SELECT 'v', 'v', round(var_samp(v), 6) FROM e UNION ALL SELECT 'user_id', 'user_id', round(var_samp(user_id), 6) FROM e")
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.cov(events(spark, sf_dir), ["v", "user_id"]), "cov")


@register("autocorr", "SELECT round(corr(value, p), 6) AS autocorr FROM (SELECT value, lag(value, 3) OVER (ORDER BY event_id) AS p FROM events)")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.autocorr(table(spark, sf_dir, "events"), "value", ["event_id"], 3), "autocorr")


@register("argmax_position", "SELECT (SELECT count(*) FROM events WHERE event_id < (SELECT arg_max(event_id, (value, -event_id)) FROM events))::BIGINT AS position")
def argmax_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(aggregating.arg_extreme(table(spark, sf_dir, "events"), "value", ["event_id"])).cast("bigint").alias("position"))


@register("is_unique_monotonic", "SELECT true AS unique_id, false AS unique_user, true AS rising FROM region LIMIT 1")
def is_unique_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.operators.windowing import is_monotonic

    e = table(spark, sf_dir, "events")
    a = aggregating.is_unique(e, "event_id").withColumnRenamed("is_unique", "unique_id")
    return a.crossJoin(aggregating.is_unique(e, "user_id").withColumnRenamed("is_unique", "unique_user")).crossJoin(is_monotonic(e, ["event_id"], "event_id").withColumnRenamed("is_monotonic", "rising"))


@register("entropy", "WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(-sum(p * ln(p)), 6) AS entropy FROM p")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregating.entropy(table(spark, sf_dir, "events").groupBy("event_type").count(), "count"), "entropy")


# Groups


def _events_by_type(spark: SparkSession, sf_dir: str, **options: object) -> Groups:
    return Groups(events(spark, sf_dir), "event_type", ["event_id"], **options)


@register("groupby_basic", f"WITH {EVENTS} SELECT event_type, count(v) AS count, count(*) AS size, round(sum(v), 2) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, count(DISTINCT v) AS nunique, bool_or(v > 99) AS any, bool_and(v > 0) AS \"all\" FROM e GROUP BY event_type")
def groupby_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _events_by_type(spark, sf_dir).agg(count=("v", "count"), size=(None, "size"), sum=r(S.total(v), 2), mean=r(F.avg(v)), min=("v", "min"), max=("v", "max"), nunique=("v", "nunique"), any=S.any_(v > 99), all=S.all_(v > 0))


@register("groupby_moments", f"WITH {EVENTS} SELECT user_id, round(var_samp(v), 6) AS var, round(stddev_samp(v), 6) AS std, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, round(skewness(v), 5) AS skew, round(kurtosis(v), 5) AS kurt, round(median(v::DOUBLE), 6) AS median, round(quantile_cont(v::DOUBLE, 0.9), 6) AS q90 FROM e GROUP BY user_id HAVING count(v) > 3")
def groupby_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    out = Groups(events(spark, sf_dir), "user_id").agg(n=("v", "count"), var=r(S.var(v)), std=r(S.std(v)), sem=r(S.sem(v)), skew=r(S.skew(v), 5), kurt=r(S.kurt(v), 5), median=r(F.percentile(v, F.lit(0.5))), q90=r(S.quantile(v, 0.9)))
    return out.filter("n > 3").drop("n")


@register("groupby_two_keys_size", "SELECT year(o_orderdate)::INT AS y, o_orderpriority, count(*) AS size FROM orders GROUP BY ALL")
def groupby_two_keys_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), ["y", "o_orderpriority"]).size()


@register("groupby_dropna", "WITH g AS (SELECT nullif(event_id % 4, 0) AS k, count(*) AS size FROM events GROUP BY ALL) SELECT 'kept' AS missing, * FROM g UNION ALL SELECT 'dropped', * FROM g WHERE k IS NOT NULL")
def groupby_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.expr("nullif(event_id % 4, 0)"))
    parts = [Groups(e, "k", dropna=d).size().select(F.lit(name).alias("missing"), "k", "size") for d, name in ((False, "kept"), (True, "dropped"))]
    return parts[0].union(parts[1])


@register("groupby_first_last_nth", f"WITH {EVENTS} SELECT user_id, arg_min(v, event_id) FILTER (v IS NOT NULL) AS first, arg_max(v, event_id) FILTER (v IS NOT NULL) AS last, (list(event_id ORDER BY event_id))[3] AS third, (list(event_id ORDER BY event_id DESC))[2] AS last_but_one FROM e GROUP BY user_id")
def groupby_first_last_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(events(spark, sf_dir), "user_id", ["event_id"])
    ends = g.agg(first=("v", "first"), last=("v", "last"))
    third, last = g.nth(2).select("user_id", F.col("event_id").alias("third")), g.nth(-2).select("user_id", F.col("event_id").alias("last_but_one"))
    return ends.join(third, "user_id", "left").join(last, "user_id", "left")


@register("groupby_idx_extremes", f"WITH {EVENTS} SELECT event_type, arg_max(event_id, (v, -event_id)) FILTER (v IS NOT NULL) AS top, arg_min(event_id, (v, event_id)) FILTER (v IS NOT NULL) AS low FROM e GROUP BY event_type")
def groupby_idx_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_by_type(spark, sf_dir).agg(top=("v", "idxmax", {"label": "event_id"}), low=("v", "idxmin", {"label": "event_id"}))


@register("groupby_ohlc", "SELECT event_type, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM events GROUP BY event_type")
def groupby_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_by_type(spark, sf_dir).ohlc("value")


@register("groupby_head_tail", "SELECT event_id, 'h' AS part FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 2 UNION ALL SELECT event_id, 't' FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def groupby_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "events"), "user_id", ["event_id"])
    return g.head(2).select("event_id", F.lit("h").alias("part")).union(g.tail(3).select("event_id", F.lit("t").alias("part")))


@register("groupby_nlargest", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def groupby_nlargest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"]).nlargest("c_acctbal", 3).select("c_nationkey", "c_custkey")


@register("groupby_cumulative", "SELECT event_id, row_number() OVER w - 1 AS n, round(sum(value) OVER w, 2) AS s, max(value) OVER w AS hi, min(value) OVER w AS lo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def groupby_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "events"), "user_id", ["event_id"])
    out = Groups(g.cumcount("n"), "user_id", ["event_id"]).cumulative({"s": ("cumsum", "value"), "hi": ("cummax", "value"), "lo": ("cummin", "value")})
    return out.select("event_id", "n", r("s", 2).alias("s"), "hi", "lo")


@register("groupby_cumprod", "SELECT event_id, round(product(1 + value / 1000) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS p FROM events")
def groupby_cumprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", 1 + F.col("value") / 1000)
    return Groups(e, "user_id", ["event_id"]).cumulative({"p": ("cumprod", "x")}).select("event_id", r("p").alias("p"))


@register("groupby_shift_diff", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS ahead, round(value - lag(value) OVER w, 6) AS diff, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def groupby_shift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    for f in (lambda g: g.shift({"before": "value"}), lambda g: g.shift({"ahead": "value"}, -2), lambda g: g.diff({"diff": "value"}), lambda g: g.pct_change({"pct": "value"})):
        e = f(Groups(e, "user_id", ["event_id"]))
    return e.select("event_id", "before", "ahead", r("diff").alias("diff"), r("pct").alias("pct"))


@register("groupby_rank", "SELECT p_partkey, (rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS average, dense_rank() OVER w::DOUBLE AS dense, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::DOUBLE AS first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def groupby_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    for how in ("average", "dense", "first"):
        p = Groups(p, "p_brand", ["p_partkey"]).rank("p_size", how, method=how)
    return p.select("p_partkey", "average", "dense", "first")


@register("groupby_fill", f"WITH {EVENTS} SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e")
def groupby_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"f": F.col("v"), "b": F.col("v")})
    e = Groups(e, "user_id", ["event_id"]).fill(["f"])
    return Groups(e, "user_id", ["event_id"]).fill(["b"], "bfill").select("event_id", "f", "b")


@register("groupby_ngroup", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS ngroup FROM orders")
def groupby_ngroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).ngroup().select("o_orderkey", "ngroup")


@register("groupby_transform", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS size, round(value - avg(value) OVER w, 6) AS centred FROM events WINDOW w AS (PARTITION BY event_type)")
def groupby_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events_by_type(spark, sf_dir)
    out = Groups(g.transform("mean", {"mean": "value"}), "event_type").transform("size", {"size": "value"})
    return out.select("event_id", r("mean").alias("mean"), "size", r(F.col("value") - F.col("mean")).alias("centred"))


@register("groupby_transform_nunique", "SELECT o_orderkey, k AS kinds FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY ALL) USING (o_custkey)")
def groupby_transform_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "orders"), "o_custkey").transform("nunique", {"kinds": "o_orderpriority"}).select("o_orderkey", F.col("kinds").cast("bigint").alias("kinds"))


@register("groupby_filter", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > 20 AND count(*) >= 10)")
def groupby_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "events"), "user_id").filter((F.avg("value") > 20) & (F.count("*") >= 10)).select("event_id")


@register("groupby_apply", "SELECT user_id, round(max(value) - min(value), 6) AS spread, count(*) AS n FROM events GROUP BY user_id")
def groupby_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "spread": [round(pdf["value"].max() - pdf["value"].min(), 6)], "n": [len(pdf)]})

    return Groups(table(spark, sf_dir, "events").select("user_id", "value"), "user_id").apply(spread, "user_id bigint, spread double, n bigint")


@register("groupby_value_counts", "SELECT event_type, user_id % 5 AS u, count(*) AS count FROM events GROUP BY ALL")
def groupby_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 5), "event_type").value_counts("u")


@register("groupby_describe", "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS \"25%\", round(quantile_cont(value, 0.5), 6) AS \"50%\", round(quantile_cont(value, 0.75), 6) AS \"75%\", max(value) AS max FROM events GROUP BY event_type")
def groupby_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events_by_type(spark, sf_dir).describe("value"), "mean", "std", "25%", "50%", "75%")


@register("groupby_corr_cov", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov FROM lineitem GROUP BY l_returnflag")
def groupby_corr_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return rounded(g.corr("l_quantity", "l_extendedprice"), "corr").join(rounded(g.cov("l_quantity", "l_extendedprice"), "cov", digits=3), "l_returnflag")


@register("groupby_groups", "SELECT o_orderstatus, list(o_orderkey ORDER BY o_orderkey) AS labels FROM orders GROUP BY o_orderstatus")
def groupby_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "orders"), "o_orderstatus").groups("o_orderkey")


@register("groupby_get_group", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 3")
def groupby_get_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "events"), ["event_type", "user_id"]).get_group("error", 3).select("event_id")


@register("groupby_unobserved", "SELECT k AS o_orderstatus, count(o_orderkey) AS size FROM (VALUES ('F'), ('O'), ('P'), ('X')) c(k) LEFT JOIN orders ON o_orderstatus = k GROUP BY k")
def groupby_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "orders"), "o_orderstatus", categories={"o_orderstatus": ["F", "O", "P", "X"]}, observed=False)
    return g.size().fillna(0, ["size"])


@register("groupby_mode", "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_quantity FROM c QUALIFY n = max(n) OVER (PARTITION BY l_returnflag)")
def groupby_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "lineitem"), "l_returnflag").mode("l_quantity")


@register("groupby_monotonic", "SELECT user_id, bool_and(coalesce(value >= p, n = 1)) AS is_monotonic FROM (SELECT user_id, value, lag(value) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def groupby_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(table(spark, sf_dir, "events"), "user_id", ["event_id"]).is_monotonic("value")


@register("groupby_sample", "SELECT user_id, least(count(*), 3) AS n FROM events GROUP BY user_id")
def groupby_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Groups(Groups(table(spark, sf_dir, "events"), "user_id").sample(3, key="event_id"), "user_id").size("n")


@register("groupby_user_aggregates", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_returnflag")
def groupby_user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return udfs.decomposed(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"qp": q * p}, {"a": F.sum("qp"), "b": F.sum(q)}, {"weighted": r(F.col("a") / F.col("b"), 4)})
