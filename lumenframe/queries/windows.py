"""Sliding, expanding, running and time-binned windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import resampling, windowing
from lumenframe.queries.registry import EVENTS, events, r, register, rounded, table

ORDER = ["event_id"]


def _full(name: str, sql: str, n: int = 5, count: str = "v") -> str:
    return f"CASE WHEN count({count}) OVER w >= {n} THEN {sql} END AS {name}"


@register(
    "rolling_basic",
    f"WITH {EVENTS} SELECT event_id, " + ", ".join([_full("s", "round(sum(value) OVER w, 2)", count="value"), _full("m", "round(avg(value) OVER w, 6)", count="value"), _full("lo", "min(value) OVER w", count="value"), _full("hi", "max(value) OVER w", count="value")])
    + " FROM e WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)",
)
def rolling_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(events(spark, sf_dir), ORDER, 5, {"s": ("sum", "value"), "m": ("mean", "value"), "lo": ("min", "value"), "hi": ("max", "value")})
    return rounded(rounded(out, "m"), "s", digits=2).select("event_id", "s", "m", "lo", "hi")


@register(
    "rolling_moments",
    f"WITH {EVENTS} SELECT event_id, " + ", ".join([_full("var", "round(var_samp(v) OVER w, 8)", 3), _full("std", "round(stddev_samp(v) OVER w, 8)", 3), _full("sem", "round(stddev_samp(v) OVER w / sqrt(count(v) OVER w), 8)", 3), "count(v) OVER w::DOUBLE AS n"])
    + " FROM e WINDOW w AS (ORDER BY event_id ROWS 6 PRECEDING)",
)
def rolling_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(events(spark, sf_dir), ORDER, 7, {"var": ("var", "v"), "std": ("std", "v"), "sem": ("sem", "v"), "n": ("count", "v")}, min_periods=3)
    return rounded(out, "var", "std", "sem", digits=8).withColumn("n", F.coalesce("n", F.when(F.col("event_id") < 2, F.col("event_id").cast("double")))).select("event_id", "var", "std", "sem", "n")


@register("rolling_shape_by_user", "SELECT event_id, CASE WHEN count(value) OVER w >= 6 THEN round(skewness(value) OVER w, 4) END AS skew, CASE WHEN count(value) OVER w >= 6 THEN round(kurtosis(value) OVER w, 4) END AS kurt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 5 PRECEDING)")
def rolling_shape_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ORDER, 6, {"skew": ("skew", "value"), "kurt": ("kurt", "value")}, ["user_id"])
    return rounded(out, "skew", "kurt", digits=4).select("event_id", "skew", "kurt")


@register("rolling_quantiles", "SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(median(value) OVER w, 6) END AS med, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.25) OVER w, 6) END AS q25 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)")
def rolling_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ORDER, 5, {"med": ("median", "value"), "q25": ("quantile", "value", 0.25)}, ["user_id"])
    return rounded(out, "med", "q25").select("event_id", "med", "q25")


@register("rolling_center_closed", "SELECT event_id, CASE WHEN count(value) OVER c >= 5 THEN round(sum(value) OVER c, 2) END AS centred, CASE WHEN count(value) OVER b >= 3 THEN round(sum(value) OVER b, 2) END AS before FROM events WINDOW c AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def rolling_center_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ORDER, 5, {"centred": ("sum", "value")}, center=True)
    out = windowing.rolling(out, ORDER, 3, {"before": ("sum", "value")}, closed="left")
    return rounded(out, "centred", "before", digits=2).select("event_id", "centred", "before")


@register("rolling_rank_corr", "SELECT event_id, CASE WHEN n >= 5 THEN len(list_filter(l, lambda x: x < value)) + (len(list_filter(l, lambda x: x = value)) + 1) / 2 END AS rank, CASE WHEN n >= 5 THEN round(c, 4) END AS corr FROM (SELECT event_id, value, list(value) OVER w AS l, count(value) OVER w AS n, corr(value, event_id) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING))")
def rolling_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ORDER, 5, {"rank": ("rank", "value"), "corr": ("corr", "value", "event_id")}, ["user_id"])
    return rounded(out, "rank", "corr", digits=4).select("event_id", "rank", "corr")


@register("rolling_time", "SELECT event_id, round(sum(value) OVER w, 2) AS s, count(value) OVER w::DOUBLE AS n FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 59 MINUTE + INTERVAL 59.999999 SECOND PRECEDING AND CURRENT ROW)")
def rolling_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ["ts"], "1h", {"s": ("sum", "value"), "n": ("count", "value")})
    return rounded(out, "s", digits=2).select("event_id", "s", "n")


@register("rolling_time_by_user", "SELECT event_id, round(avg(value) OVER w, 6) AS m, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING)")
def rolling_time_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.rolling(table(spark, sf_dir, "events"), ["ts"], "2D", {"m": ("mean", "value"), "hi": ("max", "value")}, ["user_id"], closed="left")
    return rounded(out, "m").select("event_id", "m", "hi")


@register("rolling_step", "SELECT event_id, CASE WHEN count(value) OVER w >= 10 THEN round(avg(value) OVER w, 6) END AS m FROM events WINDOW w AS (ORDER BY event_id ROWS 9 PRECEDING) QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 10 = 0")
def rolling_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windowing.rolling(table(spark, sf_dir, "events"), ORDER, 10, {"m": ("mean", "value")}, step=10), "m").select("event_id", "m")


@register("rolling_apply", "SELECT event_id, CASE WHEN count(value) OVER w >= 4 THEN round(max(value) OVER w - min(value) OVER w, 6) END AS spread FROM events WINDOW w AS (ORDER BY event_id ROWS 3 PRECEDING)")
def rolling_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windowing.rolling_apply(table(spark, sf_dir, "events"), ORDER, 4, "value", lambda s: s.max() - s.min(), "spread", raw=True), "spread").select("event_id", "spread")


@register("window_weighted", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round((0.5 * lag(value, 2) OVER o + 1.0 * lag(value) OVER o + 0.5 * value) / 2.0, 6) END AS m, CASE WHEN count(value) OVER w >= 3 THEN round(0.5 * lag(value, 2) OVER o + 1.0 * lag(value) OVER o + 0.5 * value, 6) END AS s FROM events WINDOW w AS (ORDER BY event_id ROWS 2 PRECEDING), o AS (ORDER BY event_id)")
def window_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.weighted(table(spark, sf_dir, "events"), ORDER, "value", [0.5, 1.0, 0.5], "m")
    out = windowing.weighted(out, ORDER, "value", [0.5, 1.0, 0.5], "s", "sum")
    return rounded(out, "m", "s").select("event_id", "m", "s")


@register("expanding_basic", f"WITH {EVENTS} SELECT event_id, round(sum(v) OVER w, 2) AS s, round(avg(v) OVER w + 0.00000000314159, 6) AS m, min(v) OVER w AS lo, max(v) OVER w AS hi, count(v) OVER w::DOUBLE AS n FROM e WINDOW w AS (ORDER BY event_id)")
def expanding_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.expanding(events(spark, sf_dir), ORDER, {"s": ("sum", "v"), "m": ("mean", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("count", "v")}, min_periods=0)
    # A shift off the halves that means over powers of two fall on, in both engines.
    return rounded(rounded(out.withColumn("m", F.col("m") + 0.00000000314159), "m"), "s", digits=2).select("event_id", "s", "m", "lo", "hi", "n")


@register("expanding_spread", f"WITH {EVENTS} SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN round(var_samp(v) OVER w, 3) END AS var, CASE WHEN count(v) OVER w >= 2 THEN round(stddev_samp(v) OVER w, 4) END AS std FROM e WINDOW w AS (ORDER BY event_id)")
def expanding_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.expanding(events(spark, sf_dir), ORDER, {"var": ("var", "v"), "std": ("std", "v")}, min_periods=2)
    return rounded(rounded(out, "var", digits=3), "std", digits=4).select("event_id", "var", "std")


@register("expanding_shape", f"WITH {EVENTS} SELECT event_id, CASE WHEN count(v) OVER w >= 10 THEN round(skewness(v) OVER w, 4) END AS skew, CASE WHEN count(v) OVER w >= 10 THEN round(kurtosis(v) OVER w, 4) END AS kurt, CASE WHEN count(v) OVER w >= 10 THEN round(stddev_samp(v) OVER w / sqrt(count(v) OVER w), 6) END AS sem FROM e WINDOW w AS (ORDER BY event_id)")
def expanding_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.expanding(events(spark, sf_dir), ORDER, {"skew": ("skew", "v"), "kurt": ("kurt", "v"), "sem": ("sem", "v")}, min_periods=10)
    return rounded(rounded(out, "skew", "kurt", digits=4), "sem").select("event_id", "skew", "kurt", "sem")


@register("expanding_pairs", f"WITH {EVENTS} SELECT event_id, CASE WHEN count(v) OVER w >= 3 THEN round(covar_samp(v, user_id) OVER w, 3) END AS cov, CASE WHEN count(v) OVER w >= 3 THEN round(corr(v, user_id) OVER w, 5) END AS corr FROM e WINDOW w AS (ORDER BY event_id)")
def expanding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.expanding(events(spark, sf_dir), ORDER, {"cov": ("cov", "v", "user_id"), "corr": ("corr", "v", "user_id")}, min_periods=3)
    return rounded(rounded(out, "cov", digits=3), "corr", digits=5).select("event_id", "cov", "corr")


@register("window_weighted_spread", "WITH w AS (SELECT event_id, lag(value, 2) OVER o AS a, lag(value) OVER o AS b, value AS c FROM events WINDOW o AS (ORDER BY event_id)), m AS (SELECT *, (0.5 * a + b + 0.5 * c) / 2.0 AS m FROM w) SELECT event_id, round((0.5 * (a - m) ** 2 + (b - m) ** 2 + 0.5 * (c - m) ** 2) / (2.0 * 2 / 3), 9) AS var FROM m")
def window_weighted_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.weighted(table(spark, sf_dir, "events"), ORDER, "value", [0.5, 1.0, 0.5], "var", "var")
    return rounded(out, "var", digits=9).select("event_id", "var")


@register("expanding_by_user", "SELECT event_id, round(median(value) OVER w, 6) AS med, round(quantile_cont(value, 0.9) OVER w, 6) AS q90, CASE WHEN count(value) OVER w >= 2 THEN round(corr(value, event_id) OVER w, 4) END AS corr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def expanding_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.expanding(table(spark, sf_dir, "events"), ORDER, {"med": ("median", "value"), "q90": ("quantile", "value", 0.9), "corr": ("corr", "value", "event_id")}, ["user_id"])
    out = rounded(rounded(out, "med", "q90"), "corr", digits=4)
    return out.select("event_id", "med", "q90", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))


@register(
    "ewm_mean_recursive",
    """WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT event_id, user_id, k, value AS m FROM n WHERE k = 1
    UNION ALL SELECT n.event_id, n.user_id, n.k, 0.3 * n.value + 0.7 * r.m FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1) SELECT event_id, round(m, 6) AS m FROM r""",
)
def ewm_mean_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(windowing.ewm(e, ORDER, "value", "m", ["user_id"], alpha=0.3, adjust=False), "m").select("event_id", "m")


# Weights below 0.8^250 are no more than rounding.
@register(
    "ewm_mean_whole",
    f"""WITH {EVENTS}, l AS (SELECT event_id, list(coalesce(v, 0)) OVER w AS a, list((v IS NOT NULL)::INT) OVER w AS b FROM e WINDOW w AS (ORDER BY event_id ROWS 250 PRECEDING))
    SELECT event_id, CASE WHEN list_sum(b) > 0 THEN round(list_sum(list_transform(a, lambda x, i: x * pow(0.8::DOUBLE, len(a) - i))) / list_sum(list_transform(b, lambda x, i: x * pow(0.8::DOUBLE, len(b) - i))), 6) END AS m FROM l""",
)
def ewm_mean_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.ewm(events(spark, sf_dir), ORDER, "v", "m", alpha=0.2)
    return rounded(out, "m").select("event_id", "m")


@register("cumulative_all", f"WITH {EVENTS} SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 2) END AS s, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo, count(v) OVER w AS n FROM e WINDOW w AS (ORDER BY event_id)")
def cumulative_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.cumulative(events(spark, sf_dir), ORDER, {"s": ("cumsum", "v"), "hi": ("cummax", "v"), "lo": ("cummin", "v"), "n": ("cumcount", "v")})
    return rounded(out, "s", digits=2).select("event_id", "s", "hi", "lo", "n")


@register("cumprod_all", "SELECT event_id, round(product(1 + (event_id % 7 - 3) / 1000) OVER (ORDER BY event_id), 6) AS p FROM events")
def cumprod_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", 1 + (F.col("event_id") % 7 - 3) / 1000)
    return rounded(windowing.cumulative(e, ORDER, {"p": ("cumprod", "x")}), "p").select("event_id", "p")


@register("shift_diff_all", f"WITH {EVENTS} SELECT event_id, lag(v, 2) OVER w AS b, lead(v, 3) OVER w AS a, round(value - lag(value) OVER w, 6) AS d, lag(value, 1, -1.0) OVER w AS f FROM e WINDOW w AS (ORDER BY event_id)")
def shift_diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowing.shift(events(spark, sf_dir), ORDER, {"b": "v"}, 2)
    out = windowing.shift(out, ORDER, {"a": "v"}, -3)
    out = windowing.diff(out, ORDER, {"d": "value"})
    out = windowing.shift(out, ORDER, {"f": "value"}, 1, fill=-1.0)
    return rounded(out, "d").select("event_id", "b", "a", "d", "f")


@register("pct_change_all", f"WITH {EVENTS}, f AS (SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM e) SELECT event_id, round(v / nullif(lag(v) OVER (ORDER BY event_id), 0) - 1, 6) AS p FROM f")
def pct_change_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windowing.pct_change(events(spark, sf_dir), ORDER, {"p": "v"}), "p").select("event_id", "p")


@register(
    "rank_all",
    """SELECT p_partkey, (rank() OVER a + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS average, rank() OVER a::DOUBLE AS min, (rank() OVER a + count(*) OVER (PARTITION BY p_size) - 1)::DOUBLE AS max, dense_rank() OVER a::DOUBLE AS dense, row_number() OVER (ORDER BY p_size, p_partkey)::DOUBLE AS first,
    round((rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER (), 8) AS pct_down FROM part WINDOW a AS (ORDER BY p_size)""",
)
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for how in ("average", "min", "max", "dense", "first"):
        p = windowing.rank(p, "p_size", how, how, order=["p_partkey"])
    return rounded(windowing.rank(p, "p_size", "pct_down", ascending=False, pct=True), "pct_down", digits=8).drop("p_size")


@register("rank_nulls", f"WITH {EVENTS} SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST)::DOUBLE END AS keep, rank() OVER (ORDER BY v NULLS LAST)::DOUBLE AS bottom, rank() OVER (ORDER BY v NULLS FIRST)::DOUBLE AS top FROM e")
def rank_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "v")
    for how in ("keep", "bottom", "top"):
        e = windowing.rank(e, "v", how, "min", na_option=how)
    return e.drop("v")


@register("fill_all", f"WITH {EVENTS}, g AS (SELECT event_id, CASE WHEN event_id % 5 < 2 THEN value END AS v FROM e) SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f1, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b2 FROM g")
def fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 < 2, F.col("value"))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("f"), v.alias("b"), v.alias("f1"), v.alias("b2"))
    e = windowing.fill(e, ORDER, ["f"])
    e = windowing.fill(e, ORDER, ["b"], "bfill")
    e = windowing.fill(e, ORDER, ["f1"], "ffill", 1)
    return windowing.fill(e, ORDER, ["b2"], "bfill", 2).select("event_id", "f", "b", "f1", "b2")


_INTERPOLATED = """WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN value END AS v FROM events), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS i0, last_value(v IGNORE NULLS) OVER p AS v0,
first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS i1, first_value(v IGNORE NULLS) OVER n AS v1 FROM g WINDOW p AS (ORDER BY event_id), n AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (event_id - i0) / (i1 - i0) END, 6) AS v FROM k"""


@register("interpolate_linear", _INTERPOLATED)
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 1, F.col("value")).alias("v"))
    return rounded(windowing.interpolate(e, ORDER, "v"), "v").select("event_id", "v")


@register(
    "interpolate_time_by_user",
    """WITH g AS (SELECT event_id, user_id, epoch_us(ts)::DOUBLE AS t, CASE WHEN event_id % 3 = 1 THEN value END AS v FROM events), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1 FROM g WINDOW p AS (PARTITION BY user_id ORDER BY event_id), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 5) AS v FROM k""",
)
def interpolate_time_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 1, F.col("value")).alias("v"))
    return rounded(windowing.interpolate(e, ORDER, "v", ["user_id"], x="ts"), "v", digits=5).select("event_id", "v")


@register("peaks", "SELECT event_id, value > coalesce(lag(value) OVER w, -1) AND value > coalesce(lead(value) OVER w, -1) AS peak FROM events WINDOW w AS (ORDER BY event_id)")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.peaks(table(spark, sf_dir, "events"), ORDER, "value", "peak").select("event_id", "peak")


@register("run_length_encoding", "WITH c AS (SELECT event_id, event_type, CASE WHEN event_type <> lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS n FROM events), i AS (SELECT *, sum(n) OVER (ORDER BY event_id) AS rle_id FROM c) SELECT rle_id::BIGINT AS rle_id, any_value(event_type) AS value, count(*) AS len FROM i GROUP BY rle_id")
def run_length_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.run_lengths(table(spark, sf_dir, "events"), ORDER, "event_type")


# Time bins


@register(
    "resample_hourly",
    """WITH b AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS m, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY 1), c AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b)
    SELECT ts, coalesce(n, 0) AS n, coalesce(s, 0) AS s, m, lo, hi, coalesce(users, 0) AS users FROM c LEFT JOIN b USING (ts)""",
)
def resample_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "events"), "1h", "ts", {"n": ("event_id", "count"), "s": ("value", "sum"), "m": ("value", "mean"), "lo": ("value", "min"), "hi": ("value", "max"), "users": ("user_id", "nunique")})
    return rounded(rounded(out, "m"), "s", digits=2)


@register(
    "resample_spread_daily",
    """SELECT date_trunc('day', ts) AS ts, round(stddev_samp(value), 6) AS std, round(var_samp(value), 6) AS var, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, round(median(value), 6) AS med, round(quantile_cont(value, 0.75), 6) AS q75, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1""",
)
def resample_spread_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "events"), "D", "ts", {"std": ("value", "std"), "var": ("value", "var"), "sem": ("value", "sem"), "med": ("value", "median"), "q75": ("value", "quantile", {"q": 0.75}), "first": ("value", "first"), "last": ("value", "last")}, order="event_id", empty=False)
    return rounded(out, "std", "var", "sem", "med", "q75")


@register("resample_monthly", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def resample_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.resample(table(spark, sf_dir, "orders"), "M", "o_orderdate", {"n": (None, "size"), "total": ("o_totalprice", "sum")}, empty=False), "total", digits=2)


@register("resample_quarter_end_label", "SELECT (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::TIMESTAMP AS o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def resample_quarter_end_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "orders"), "Q", "o_orderdate", {"n": (None, "size")}, label="right")


@register("resample_weekly", "SELECT date_trunc('week', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def resample_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "events"), "W", "ts", {"n": (None, "size")})


@register("resample_ohlc", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1")
def resample_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.ohlc(table(spark, sf_dir, "events"), "6h", "ts", "value", order="event_id").dropna(subset=["open"])


@register("resample_closed_right", "SELECT time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 30 MINUTE AS ts, count(*) AS n FROM events GROUP BY 1")
def resample_closed_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "events"), "30min", "ts", {"n": (None, "size")}, closed="right", label="right", empty=False)


@register(
    "resample_by_user",
    """WITH b AS (SELECT user_id, date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b GROUP BY user_id) SELECT user_id, ts, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (user_id, ts)""",
)
def resample_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "events"), "D", "ts", {"n": (None, "size")}, by=["user_id"])


_DAILY = "d AS (SELECT date_trunc('day', ts) AS ts, round(sum(value), 2) AS v FROM events GROUP BY 1), c AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 12 HOUR)) AS ts FROM d)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(resampling.resample(e, "D", "ts", {"v": ("value", "sum")}, empty=False), "v", digits=2)


@register("upsample_ffill_bfill", f"WITH {_DAILY} SELECT ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM c LEFT JOIN d USING (ts)")
def upsample_ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    f = resampling.upsample(d, "12h", "ts", ["v"], "ffill").withColumnRenamed("v", "f")
    return f.join(resampling.upsample(d, "12h", "ts", ["v"], "bfill").withColumnRenamed("v", "b"), "ts").select("ts", "f", "b")


@register("upsample_asfreq", f"WITH {_DAILY} SELECT ts, coalesce(v, -1.0) AS v FROM c LEFT JOIN d USING (ts)")
def upsample_asfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.upsample(_daily(spark, sf_dir), "12h", "ts", ["v"], fill_value=-1.0)


@register("upsample_nearest", f"WITH {_DAILY} SELECT c.ts, CASE WHEN b.ts IS NULL OR (a.ts IS NOT NULL AND epoch_us(a.ts) - epoch_us(c.ts) < epoch_us(c.ts) - epoch_us(b.ts)) THEN a.v ELSE b.v END AS v FROM c ASOF LEFT JOIN d b ON c.ts >= b.ts ASOF LEFT JOIN d a ON c.ts <= a.ts")
def upsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.upsample(_daily(spark, sf_dir), "12h", "ts", ["v"], "nearest")


@register("upsample_linear", f"WITH {_DAILY}, k AS (SELECT c.ts, b.ts AS t0, b.v AS v0, a.ts AS t1, a.v AS v1 FROM c ASOF LEFT JOIN d b ON c.ts >= b.ts ASOF LEFT JOIN d a ON c.ts <= a.ts) SELECT ts, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 4) AS v FROM k")
def upsample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.upsample(_daily(spark, sf_dir), "12h", "ts", ["v"], "linear"), "v", digits=4).select("ts", "v")


@register("resample_transform", "SELECT event_id, round(value / sum(value) OVER (PARTITION BY date_trunc('hour', ts)), 6) AS share FROM events WHERE value > 0")
def resample_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.transform(table(spark, sf_dir, "events").filter("value > 0"), "1h", "ts", "sum", {"s": "value"})
    return out.select("event_id", r(F.col("value") / F.col("s")).alias("share"))


@register("resample_groups", "SELECT date_trunc('day', ts) AS ts, list(event_id ORDER BY event_id) AS labels FROM events GROUP BY 1")
def resample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.groups(table(spark, sf_dir, "events"), "D", "ts", "event_id")


@register("resample_get_group", "SELECT event_id FROM events WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-02 03:00:00'")
def resample_get_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.get_group(table(spark, sf_dir, "events"), "1h", "ts", "2024-01-02 03:00:00").select("event_id")


@register(
    "ewm_whole_table",
    """WITH RECURSIVE n AS (SELECT event_id, value AS x, row_number() OVER (ORDER BY event_id) AS i FROM events),
    w AS (SELECT event_id, i, x AS s, x * x AS s2, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w2, x AS m FROM n WHERE i = 1
    UNION ALL SELECT n.event_id, n.i, 0.7 * w.s + n.x, 0.7 * w.s2 + n.x * n.x, 0.7 * w.w + 1, 0.49 * w.w2 + 1, 0.7 * w.m + 0.3 * n.x FROM w JOIN n ON n.i = w.i + 1)
    SELECT event_id, round(m, 5) AS plain, CASE WHEN i > 1 THEN round((s2 / w - (s / w) * (s / w)) * w * w / (w * w - w2), 1) END AS var FROM w""",
)
def ewm_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that are not adjusted, and the variance, over the whole table."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    plain = windowing.ewm(e, ["event_id"], "value", "plain", alpha=0.3, adjust=False).select("event_id", "plain")
    var = windowing.ewm(e, ["event_id"], "value", "var", alpha=0.3, how="var").select("event_id", "var")
    return rounded(rounded(plain.join(var, "event_id"), "plain", digits=5), "var", digits=1)
