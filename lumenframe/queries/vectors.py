"""Arrays, columnar tables and vectors, verb by verb."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import arrays as A
from lumenframe.columnar import Table, Vector
from lumenframe.queries.registry import EVENTS, events, r, register, rounded, table


def _events(spark: SparkSession, sf_dir: str) -> Table:
    return Table(events(spark, sf_dir), ["event_id"])


def _with(v: Vector, name: str) -> Table:
    return v.table.with_columns(**{name: v.col})


# Arrays


def _pair(spark: SparkSession, sf_dir: str) -> A.Array:
    return A.Array(table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user")), ["value", "user"], ["event_id"])


@register("array_elementwise", "SELECT event_id, round(power(value, 2), 4) AS square, floor(value / 3) AS floored, round(value - 3 * floor(value / 3), 6) AS rest, round(exp(value / 50), 6) AS exp, greatest(value, 10) AS high, least(value, 10) AS low, value > 5 AND user_id <= 20 AS both, value > 5 OR user_id <= 20 AS either, (value > 5) <> (user_id <= 20) AS one FROM events")
def array_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events")
    names = ("square", "floored", "rest", "exp", "high", "low", "both", "either", "one")
    df = base.withColumns({n: F.col("value") for n in names}).withColumn("few", F.col("user_id") <= 20)
    made = {
        "square": lambda a: A.power(a, 2), "floored": lambda a: A.floor_divide(a, 3), "rest": lambda a: A.remainder(a, 3), "exp": lambda a: A.exp(A.divide(a, 50)), "high": lambda a: A.maximum(a, 10.0), "low": lambda a: A.minimum(a, 10.0),
    }
    for n, f in made.items():
        df = f(A.Array(df, [n], ["event_id"])).sdf
    for n, f in (("both", A.logical_and), ("either", A.logical_or), ("one", A.logical_xor)):
        big = A.greater(A.Array(df, [n], ["event_id"]), 5)
        df = f(big, A.Array(big.sdf, ["few"], ["event_id"])).sdf
    return df.select("event_id", r("square", 4).alias("square"), "floored", r("rest").alias("rest"), r("exp").alias("exp"), "high", "low", "both", "either", "one")


@register("array_comparisons", "SELECT event_id, value > 10 AS gt, value >= 10 AS ge, value < 10 AS lt, value <= 10 AS le, value = 10 AS eq, value <> 10 AS ne, NOT (value > 10) AS inv FROM events")
def array_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    for n, f in (("gt", A.greater), ("ge", A.greater_equal), ("lt", A.less), ("le", A.less_equal), ("eq", A.equal), ("ne", A.not_equal)):
        df = f(A.Array(df.withColumn(n, F.col("value")), [n], ["event_id"]), 10).sdf
    df = (~A.greater(A.Array(df.withColumn("inv", F.col("value")), ["inv"], ["event_id"]), 10)).sdf
    return df.select("event_id", "gt", "ge", "lt", "le", "eq", "ne", "inv")


@register("array_flatten", "SELECT 2 * p + k AS i, CASE k WHEN 0 THEN value ELSE user_id::DOUBLE END AS v FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), range(2) t(k)")
def array_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).flatten().sdf.select(F.col("__i").alias("i"), "v")


@register("array_append_hstack", "SELECT value, user_id::DOUBLE AS user, count(*) * 2 AS n FROM events GROUP BY ALL")
def array_append_hstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pair(spark, sf_dir)
    return a.append(a).sdf.groupBy("value", "user").agg(F.count("*").alias("n"))


@register("array_hstack", "SELECT event_id, value, user_id::DOUBLE AS other FROM events")
def array_hstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pair(spark, sf_dir)
    out = A.Array(a.sdf, ["value"], ["event_id"]).hstack(A.Array(a.sdf, ["user"], ["event_id"]))
    return out.sdf.select("event_id", "value", F.col("__h0").alias("other"))


@register("array_matrix_product", "SELECT sum(n_nationkey * n_nationkey)::DOUBLE AS aa, sum(n_nationkey * n_regionkey)::DOUBLE AS ab, sum(n_regionkey * n_regionkey)::DOUBLE AS bb FROM nation")
def array_matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.Array(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), "n_nationkey", "n_regionkey"), ["n_nationkey", "n_regionkey"], ["i"])
    rows = a.transpose().dot(a).sdf.orderBy("row").collect()
    return spark.createDataFrame([(round(rows[0]["0"], 2), round(rows[0]["1"], 2), round(rows[1]["1"], 2))], "aa double, ab double, bb double")


@register("array_axis_reductions", "SELECT max(value) AS hi, min(user_id)::DOUBLE AS lo, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, bool_and(value >= 0) AS every, bool_or(value > 99) AS some FROM events")
def array_axis_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pair(spark, sf_dir)
    v = A.Array(a.sdf, ["value"], a.order)
    row = lambda x: x.sdf.first()
    return spark.createDataFrame([(row(a.max(0))["value"], row(a.min(0))["user"], round(row(a.mean(0))["value"], 6), round(v.std(), 6), A.greater_equal(v, 0).all(), A.greater(v, 99).any())], "hi double, lo double, mean double, std double, every boolean, some boolean")


@register("array_constructors", "SELECT i, CASE WHEN i + 1 >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS c0, CASE WHEN i + 1 >= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS c1, CASE WHEN i + 1 >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS c2 FROM range(4) t(i)")
def array_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tri(spark, 4, 3, 1).sdf.withColumnRenamed("__i", "i")


@register("array_row_reductions", "SELECT event_id, round(value + user_id, 6) AS sum, greatest(value, user_id) AS max, least(value, user_id) AS min, round((value + user_id) / 2, 6) AS mean FROM events")
def array_row_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pair(spark, sf_dir)
    df = a.sdf
    for how in ("sum", "max", "min", "mean"):
        df = A.Array(df, a.columns, a.order).reduce(how, 1).sdf.withColumnRenamed("__row", how)
    return rounded(df.select("event_id", "sum", "max", "min", "mean"), "sum", "mean")


# Tables


@register("table_sort_slice", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS p FROM events) WHERE p >= 10 AND p < 25")
def table_sort_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])
    return t.sort("value", "event_id", descending=[True, False]).slice(10, 15).sdf.select("event_id", "value")


@register("table_top_bottom", "(SELECT event_id, 'top' AS part FROM events ORDER BY value DESC, event_id LIMIT 5) UNION ALL (SELECT event_id, 'bottom' FROM events ORDER BY value, event_id LIMIT 5)")
def table_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["event_id"])
    return t.top_k(5, "value").sdf.select("event_id", F.lit("top").alias("part")).union(t.bottom_k(5, "value").sdf.select("event_id", F.lit("bottom").alias("part")))


@register("table_unique_duplicated", "SELECT user_id, event_type, count(*) > 1 AS again, count(*) AS n FROM events GROUP BY ALL")
def table_unique_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("user_id", "event_type"))
    return t.is_duplicated().sdf.groupBy("user_id", "event_type").agg(F.bool_or("is_duplicated").alias("again"), F.count("*").alias("n"))


@register("table_counts", "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS kinds, false AS empty FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events")).select("user_id", "event_type")
    return spark.createDataFrame([(t.height, t.n_unique(), t.is_empty())], "rows bigint, kinds bigint, empty boolean")


@register("table_reductions", f"WITH {EVENTS} SELECT round(sum(v), 2) AS sum, round(avg(v), 6) AS mean, max(v) AS max, min(v) AS min, round(stddev_samp(v), 6) AS std, round(var_samp(v), 6) AS var, round(median(v::DOUBLE), 6) AS median FROM e")
def table_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select("v")
    value = {h: getattr(t, h)().sdf.first()[0] for h in ("sum", "mean", "max", "min", "std", "var", "median")}
    return rounded(rounded(spark.createDataFrame([tuple(value.values())], ", ".join(f"{h} double" for h in value)), "mean", "std", "var", "median"), "sum", digits=2)


@register("table_shift_rows", "SELECT event_id, lag(value, 2) OVER (ORDER BY event_id) AS value FROM events")
def table_shift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"]).shift(2).sdf.select("event_id", "value")


@register("table_horizontal", f"WITH {EVENTS} SELECT event_id, greatest(v, value) AS max, least(v, value) AS min, round(coalesce(v, 0) + value, 6) AS sum, round((coalesce(v, 0) + value) / (1 + (v IS NOT NULL)::INT), 6) AS mean FROM e")
def table_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir)
    for how in ("max", "min", "sum", "mean"):
        t = t.horizontal(how, ["v", "value"])
    return rounded(t.sdf.select("event_id", "max", "min", "sum", "mean"), "sum", "mean")


@register("table_fold_struct", "SELECT round(value + user_id, 6) AS fold FROM events")
def table_fold_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Table(table(spark, sf_dir, "events").select("value", "user_id")).to_struct("s").unnest("s").fold(lambda a, b: a + b).sdf, "fold")


@register("table_fill_strategies", f"WITH {EVENTS} SELECT event_id, coalesce(v, 0.0) AS zero, round(coalesce(v, (SELECT avg(v) FROM e)), 6) AS mean, coalesce(v, (SELECT max(v) FROM e)) AS max FROM e")
def table_fill_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select("event_id", "v")
    out = t.sdf.select("event_id")
    for how in ("zero", "mean", "max"):
        out = out.join(t.fill_null(strategy=how).sdf.select("event_id", F.col("v").alias(how)), "event_id")
    return rounded(out, "mean")


KINDS = ("click", "error", "purchase", "signup", "view")


@register("table_pivot_unstack", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 2) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def table_pivot_unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Table(table(spark, sf_dir, "events")).pivot("event_type", "user_id", "value", "sum").sdf
    return rounded(out.select("user_id", *[F.when(F.col(k) != 0, F.col(k)).alias(k) for k in KINDS]), *KINDS, digits=2)


@register("table_group_reductions", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, round(median(value), 6) AS median, round(sum(value), 2) AS sum, count(value) AS count FROM events GROUP BY event_type")
def table_group_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Table(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_id"]).group_by("event_type")
    out = None
    for how in ("mean", "max", "min", "median", "sum", "count"):
        one = getattr(g, how)().sdf.select("event_type", F.col("value").alias(how))
        out = one if out is None else out.join(one, "event_type")
    return rounded(rounded(out, "mean", "median"), "sum", digits=2)


@register("table_group_ends", "SELECT event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def table_group_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Table(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id"), ["event_id"]).group_by("event_type")
    ends = g.first().sdf.select("event_type", F.col("value").alias("first")).join(g.last().sdf.select("event_type", F.col("value").alias("last")), "event_type")
    return ends.join(g.n_unique().sdf.select("event_type", F.col("user_id").alias("users")), "event_type")


@register("table_partition_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def table_partition_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Table(table(spark, sf_dir, "events")).partition_by("event_type")
    out = None
    for name, t in parts.items():
        one = t.sdf.agg(F.lit(name).alias("event_type"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@register("table_stacks", "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE value > 20) GROUP BY event_id")
def table_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])
    return t.vstack(t.filter(F.col("value") > 20)).group_by("event_id").len("n").sdf


@register("table_map_rows", "SELECT n_nationkey * 2 AS a, upper(n_name) AS b FROM nation")
def table_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "nation")).map_rows(lambda row: (row["n_nationkey"] * 2, row["n_name"].upper()), "a int, b string").sdf


@register("table_rolling_time", "SELECT event_id, round(sum(value) OVER w, 2) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def table_rolling_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["ts"]).rolling("ts", "1D", {"s": ("sum", "value")}, ["user_id"])
    return rounded(t.sdf.select("event_id", "s"), "s", digits=2)


@register("table_upsample", "WITH d AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY 1) SELECT s.ts, d.n FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 8 HOUR)) AS ts FROM d) s LEFT JOIN d USING (ts)")
def table_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    return Table(d, ["ts"]).upsample("ts", "8h").sdf


@register("table_join_asof", "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click') SELECT p.event_id, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts")
def table_join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p, c = Table(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")), Table(e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts"))
    return p.join_asof(c, on="ts", by="user_id", strategy="forward").select("event_id", "click_id").sdf


@register("table_update", "SELECT n_nationkey, coalesce(b.n_name, a.n_name) AS n_name FROM nation a LEFT JOIN (SELECT n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_regionkey = 1) b USING (n_nationkey)")
def table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return Table(n.select("n_nationkey", "n_name")).update(Table(n.filter("n_regionkey = 1").select("n_nationkey", F.lower("n_name").alias("n_name"))), "n_nationkey").sdf


# Vectors


@register("vector_running", f"WITH {EVENTS} SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 2) END AS s, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo, count(v) OVER w AS n FROM e WINDOW w AS (ORDER BY event_id)")
def vector_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select("event_id", "v")
    for name, f in (("s", Vector.cum_sum), ("hi", Vector.cum_max), ("lo", Vector.cum_min), ("n", Vector.cum_count)):
        t = Table(_with(f(t["v"]), name).sdf.drop("__w"), t.order)
    return rounded(t.sdf.select("event_id", "s", "hi", "lo", "n"), "s", digits=2)


@register("vector_rolling", "SELECT event_id, " + ", ".join(f"CASE WHEN event_id >= 3 THEN round({f} OVER w, 6) END AS {n}" for n, f in (("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("sum", "sum(value)"), ("std", "stddev_samp(value)"), ("median", "median(value)"))) + " FROM events WINDOW w AS (ORDER BY event_id ROWS 3 PRECEDING)")
def vector_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])
    for how in ("mean", "max", "min", "sum", "std", "median"):
        t = Table(_with(getattr(t["value"], f"rolling_{how}")(4), how).sdf.drop("__w"), t.order)
    return rounded(t.sdf.drop("value"), "mean", "max", "min", "sum", "std", "median")


@register("vector_tests", f"WITH {EVENTS} SELECT event_id, v IS NULL AS null, v IS NOT NULL AS some, coalesce(v BETWEEN 10 AND 20, false) AS mid, event_type IN ('click') AS click, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1 AS last FROM e")
def vector_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir)
    last = t["event_type"].is_last_distinct()
    t = Table(_with(last, "last").sdf, t.order)
    return t.select("event_id", "last", null=t["v"].is_null().col, some=t["v"].is_not_null().col, mid=t["v"].is_between(10, 20).col, click=t["event_type"].is_in(["click"]).col).sdf


@register("vector_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events"), ["event_id"])["event_type"].value_counts().sdf


@register("vector_unique_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def vector_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events"), ["event_id"])["event_type"].unique_counts().sdf


@register("vector_arg_unique", "SELECT min(p) AS index FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) GROUP BY event_type")
def vector_arg_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events"), ["event_id"])["event_type"].arg_unique().sdf


@register("vector_bins", "WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events) SELECT event_id, CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS band, CASE WHEN value <= e[1] THEN 0 WHEN value <= e[2] THEN 1 WHEN value <= e[3] THEN 2 ELSE 3 END AS quarter FROM events, q")
def vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])
    quarter = t["value"].qcut(4)
    t = Table(_with(quarter, "quarter").sdf, t.order)
    return t.select("event_id", "quarter", band=t["value"].cut([10, 50], ["low", "mid", "high"]).col).sdf


@register("vector_scatter_set", "SELECT event_id, CASE WHEN event_id IN (2, 5) THEN -1.0 ELSE value END AS scattered, CASE WHEN value > 50 THEN 0.0 ELSE value END AS capped, CASE WHEN value > 50 THEN value ELSE user_id::DOUBLE END AS zipped FROM events")
def vector_scatter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["event_id"])
    s = t["value"].scatter([2, 5], -1.0)
    t = s.table.with_columns(scattered=s.col, big=F.col("value") > 50, user=F.col("user_id").cast("double"))
    return t.select("event_id", "scattered", capped=t["value"].set(t["big"], 0.0).col, zipped=t["value"].zip_with(t["big"], t["user"]).col).sdf


@register("vector_extensions", "SELECT value, count(*) AS n FROM (SELECT value FROM events UNION ALL SELECT 1.5 FROM range(3) UNION ALL SELECT value FROM events) GROUP BY value")
def vector_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Table(table(spark, sf_dir, "events"), ["event_id"])["value"]
    return v.extend_constant(1.5, 3).sdf.union(v.append(v).sdf.exceptAll(v.table_of().sdf.select("value"))).groupBy("value").agg(F.count("*").alias("n"))


@register("vector_hash_replace", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' ELSE event_type END AS replaced, CASE event_type WHEN 'click' THEN 'c' END AS strict, round(power(value, 1.5), 4) AS pow, event_type IS NOT DISTINCT FROM 'click' AS same FROM events")
def vector_hash_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["event_id"])
    k = t["event_type"]
    return t.select("event_id", replaced=k.replace({"click": "c"}).col, strict=k.replace_strict({"click": "c"}).col, pow=r(t["value"].pow(1.5).col, 4), same=k.eq_missing("click").col).sdf


@register("vector_kurtosis_entropy", "SELECT round(kurtosis_pop(value), 6) AS kurt, round(-sum(value / t * ln(value / t)) FILTER (value > 0), 6) AS entropy, max(value) AS nan_max FROM events, (SELECT sum(value) AS t FROM events)")
def vector_kurtosis_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Table(table(spark, sf_dir, "events"), ["event_id"])["value"]
    return spark.createDataFrame([(round(v.kurtosis(), 6), round(v.entropy(), 6), v.nan_max())], "kurt double, entropy double, nan_max double")


@register("vector_interpolate_by", "WITH g AS (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN value END AS v FROM events), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS i0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS i1, first_value(v IGNORE NULLS) OVER n AS v1 FROM g WINDOW p AS (ORDER BY event_id), n AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (event_id - i0) / (i1 - i0) END, 6) AS w FROM k")
def vector_interpolate_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, F.col("value")).alias("v"))
    return rounded(_with(Table(e, ["event_id"])["v"].interpolate_by("event_id"), "w").sdf.select("event_id", "w"), "w")


@register("vector_implode", "SELECT list(event_id ORDER BY event_id) AS event_id FROM events")
def vector_implode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events"), ["event_id"])["event_id"].implode().sdf


@register("vector_map_elements", "SELECT event_id, length(event_type)::BIGINT AS n FROM events")
def vector_map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["event_id"])
    return t.select("event_id", n=t["event_type"].map_elements(len, "bigint").col).sdf
