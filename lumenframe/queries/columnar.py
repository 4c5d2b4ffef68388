"""The expression-based columnar table: its verbs and the methods of its vectors, each held against SQL over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.columnar import Table, Vector
from lumenframe.queries.registry import EVENTS, events, folder, r, register, rounded, table


def _events(spark: SparkSession, sf_dir: str) -> Table:
    """(event_id, user_id, event_type, value, v) in the order of event_id; v is missing in every seventh row."""
    return Table(events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "v"), ["event_id"])


def _orders(spark: SparkSession, sf_dir: str) -> Table:
    return Table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])


def _of(v: Vector, name: str, *keys: str) -> DataFrame:
    """The keys and the vector under a name."""
    return v.table.sdf.select(*keys, v.col.alias(name))


def _beside(first: DataFrame, *more: DataFrame, on: str = "event_id") -> DataFrame:
    for m in more:
        first = first.join(m, on)
    return first


# Verbs


@register("table_missing", f"WITH {EVENTS} SELECT 'rows' AS what, count(v)::BIGINT AS n, round(sum(v), 2) AS s FROM e UNION ALL SELECT 'filled', count(*)::BIGINT, round(sum(CASE WHEN event_id % 7 = 0 THEN -1 ELSE v END), 2) FROM e")
def table_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_nulls over missing values, fill_nan over NaN in the same places."""
    t = _events(spark, sf_dir)
    nan = t.with_columns(v=F.coalesce("v", F.lit(float("nan")))).fill_nan(-1.0)
    parts = [x.sdf.agg(F.count("v").alias("n"), r(F.sum("v"), 2).alias("s")).select(F.lit(what).alias("what"), "n", "s") for what, x in (("rows", t.drop_nulls(["v"])), ("filled", nan))]
    return parts[0].unionByName(parts[1])


@register("table_limit_gather_every", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, i < 100 AS first, i % 5 = 2 AS fifth, (n - 1 - i)::BIGINT AS back, (i + 10)::BIGINT AS place FROM n")
def table_limit_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    first = t.limit(100).sdf.select("event_id", F.lit(True).alias("first"))
    fifth = t.gather_every(5, 2).sdf.select("event_id", F.lit(True).alias("fifth"))
    back = t.reverse().with_row_index("back").sdf.select("event_id", "back")
    out = t.clone().lazy().with_row_index("place", 10).sdf.select("event_id", "place").join(back, "event_id").join(first, "event_id", "left").join(fifth, "event_id", "left")
    return out.select("event_id", F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("fifth", F.lit(False)).alias("fifth"), "back", "place")


@register("table_unique_rows", "SELECT user_id, event_type, count(*) = 1 AS alone FROM events GROUP BY ALL")
def table_unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("user_id", "event_type"))
    return t.is_unique().sdf.select("user_id", "event_type", F.col("is_unique").alias("alone")).distinct()


@register("table_approx_distinct", "SELECT true AS users, true AS kinds FROM (SELECT 1)")
def table_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of the numbers of distinct values lie within a sixth of the exact ones."""
    t = Table(table(spark, sf_dir, "events").select("user_id", "event_type"))
    exact = t.sdf.agg(F.count_distinct("user_id").alias("u"), F.count_distinct("event_type").alias("k"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) / 6
    return t.approx_n_unique().sdf.crossJoin(exact).select(near("user_id", "u").alias("users"), near("event_type", "k").alias("kinds"))


@register("table_explode", "SELECT vec_id, label, unnest(embedding) AS embedding FROM embeddings")
def table_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["vec_id"]).explode("embedding").sdf


@register("table_extend_merge", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def table_extend_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extend and merge_sorted hold the same rows; the latter in the order of the key."""
    c = Table(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))
    s = Table(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    both = c.extend(s).group_by("k").len("n").sdf
    return both.join(c.merge_sorted(s, "k").group_by("k").len("m").sdf, "k").filter("n = m").select("k", "n")


@register("table_interpolate", "WITH f AS (SELECT event_id, CASE WHEN event_id % 3 <> 1 OR event_id <= 1 THEN value END AS v, value FROM events), g AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER (ORDER BY event_id) AS a, min(CASE WHEN v IS NOT NULL THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f) SELECT g.event_id, round(coalesce(g.v, CASE WHEN y.v IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (g.event_id - a) / (b - a) END), 6) AS v FROM g LEFT JOIN f x ON x.event_id = a LEFT JOIN f y ON y.event_id = b")
def table_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", F.when((F.col("event_id") % 3 != 1) | (F.col("event_id") <= 1), F.col("value")).alias("v")), ["event_id"])
    return rounded(t.interpolate("v").sdf.select("event_id", "v"), "v")


@register("table_melt", "SELECT s_suppkey, 'acctbal' AS field, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 'twice', 2 * s_acctbal FROM supplier")
def table_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Table(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"), (2 * F.col("s_acctbal")).alias("twice")))
    a = s.melt(["s_suppkey"], ["acctbal", "nation"], "field", "amount")
    return a.extend(s.unpivot(["s_suppkey"], ["twice"], "field", "amount")).sdf


@register("table_unstack", "SELECT o_orderpriority, " + ", ".join(f"max(CASE WHEN o_orderstatus = '{s}' THEN n END) AS {s}" for s in "FOP") + " FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def table_unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "orders")).group_by("o_orderpriority", "o_orderstatus").len("n")
    return t.unstack("o_orderpriority", "o_orderstatus", "n").sdf


@register("table_dummies", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def table_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Table(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).to_dummies("c_mktsegment").sdf
    return out.select("c_custkey", *[F.col(c).cast("int").alias(c) for c in out.columns if c != "c_custkey"])


@register("table_equals_sample", "SELECT true AS same, true AS other, true AS part, true AS keys")
def table_equals_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """equals; a sample of n rows has n different rows of the table; hash_rows and hash tell keys apart and agree with themselves."""
    t = Table(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])
    part = t.sample(50, seed=3)
    some = part.join(t, on="c_custkey", how="semi").n_unique() == 50
    keys = t.hash_rows(7).sdf.distinct().count() == t.height and t["c_custkey"].hash(7).n_unique() == t.height
    return spark.createDataFrame([(t.equals(t.clone()), not t.equals(t.with_columns(c_acctbal=F.col("c_acctbal") + 1)), some, keys)], "same boolean, other boolean, part boolean, keys boolean")


@register("table_rename_describe", "SELECT count(amount)::DOUBLE AS count, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max, round(quantile_cont(amount, 0.5), 6) AS \"50%\" FROM (SELECT o_totalprice AS amount FROM orders)")
def table_rename_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe of a renamed column; the vector's own describe says the same."""
    t = _orders(spark, sf_dir).rename({"o_totalprice": "amount"}).select("amount")
    names = ["count", "mean", "std", "min", "max", "50%"]
    first, again = (x.sdf.select(*[r(F.col(f"`{n}`")).alias(n) for n in names]) for x in (t.describe(), t["amount"].describe()))
    return first.intersect(again)


@register("table_product_quantile", "SELECT 'product' AS how, round(exp(sum(ln(1 + l_tax / 1000))), 6) AS x FROM lineitem UNION ALL SELECT 'quantile', round(quantile_cont(l_quantity, 0.25), 6) FROM lineitem")
def table_product_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    product = Table(li.select((1 + F.col("l_tax") / 1000).alias("x"))).product().sdf
    quantile = Table(li.select(F.col("l_quantity").alias("x"))).quantile(0.25, "linear").sdf
    return product.select(F.lit("product").alias("how"), r("x").alias("x")).union(quantile.select(F.lit("quantile"), r("x")))


@register("table_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_discount, l_quantity), 6) AS dq FROM lineitem")
def table_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Table(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")).corr().sdf
    pick = lambda a, b: r(F.max(F.when((F.col("x") == a) & (F.col("y") == b), F.col("corr"))))
    return c.agg(pick("l_quantity", "l_extendedprice").alias("qp"), pick("l_discount", "l_quantity").alias("dq"))


@register("table_rows_dict", "SELECT r_regionkey, r_name FROM region")
def table_rows_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows() and to_dict() hand the five regions to the driver; both say the same."""
    t = Table(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    rows, columns = t.rows(), t.to_dict()
    if sorted(zip(columns["r_regionkey"], columns["r_name"], strict=True)) != sorted(rows):
        raise ValueError("rows() and to_dict() differ")
    return spark.createDataFrame(rows, "r_regionkey int, r_name string")


@register("table_write_csv", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def table_write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    Table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")).write_csv(path)
    return spark.read.csv(path, header=True, schema="s_suppkey bigint, s_nationkey int, s_acctbal double")


@register("table_group_quantile", "SELECT o_orderstatus, round(quantile_disc(o_totalprice, 0.5), 2) > 0 AS some, (SELECT count(*) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus)::BIGINT AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders o GROUP BY o_orderstatus")
def table_group_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantile of groups lies within them; map_groups runs a Python function over each group."""
    t = Table(_orders(spark, sf_dir).sdf.select("o_orderstatus", "o_totalprice"))
    median = t.group_by("o_orderstatus").quantile(0.5).sdf.select("o_orderstatus", (F.col("o_totalprice") > 0).alias("some"))

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderstatus": g["o_orderstatus"].iloc[:1], "n": [len(g)], "spread": [round(float(g["o_totalprice"].max() - g["o_totalprice"].min()), 2)]})

    mapped = t.group_by("o_orderstatus").map_groups(spread, "o_orderstatus string, n bigint, spread double").sdf
    return mapped.join(median, "o_orderstatus").select("o_orderstatus", "some", "n", "spread")


# Vectors


@register("vector_extremes", "SELECT arg_min(event_id, (value, event_id)) AS low, arg_max(event_id, (value, -event_id)) AS high, min(value) AS nan_min, max(value) AS nan_max FROM events")
def vector_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir)["value"]
    return spark.createDataFrame([(v.arg_min(), v.arg_max(), v.nan_min(), v.nan_max())], "low bigint, high bigint, nan_min double, nan_max double")


@register("vector_arg_true", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation QUALIFY n_nationkey % 4 = 1")
def vector_arg_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 4 == 1).alias("x")), ["n_nationkey"])
    return spark.createDataFrame([(i,) for i in t["x"].arg_true()], "i bigint")


@register("vector_mode", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type FROM c WHERE n = (SELECT max(n) FROM c)")
def vector_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)["event_type"].mode().sdf.select("event_type")


@register(
    "vector_cumulative",
    f"WITH {EVENTS} SELECT event_id, round(sum(v) OVER o, 2) * (CASE WHEN v IS NULL THEN NULL ELSE 1 END) AS cs, CASE WHEN v IS NULL THEN NULL ELSE max(v) OVER o END AS hi, CASE WHEN v IS NULL THEN NULL ELSE min(v) OVER o END AS lo, count(v) OVER o AS n, CASE WHEN v IS NULL THEN NULL ELSE round(exp(sum(ln(1 + v / 1e6)) OVER o), 6) END AS cp, round(sum(value) OVER o, 2) AS total FROM e WINDOW o AS (ORDER BY event_id)",
)
def vector_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir)
    v = t["v"]
    small = t.with_columns(v=1 + F.col("v") / 1e6)["v"]
    parts = {"cs": v.cum_sum(), "hi": v.cum_max(), "lo": v.cum_min(), "n": v.cum_count(), "cp": small.cum_prod(), "total": t["value"].cumulative_eval("sum")}
    out = _beside(*[_of(x, n, "event_id") for n, x in parts.items()])
    return rounded(rounded(out, "cs", "total", digits=2), "cp").select("event_id", *[F.col(n).cast("bigint").alias(n) if n == "n" else n for n in parts])


@register("vector_change_peaks", "SELECT event_id, round(value / lag(value) OVER o - 1, 6) AS change, coalesce(value > lag(value) OVER o, true) AND coalesce(value > lead(value) OVER o, true) AS top, coalesce(value < lag(value) OVER o, true) AND coalesce(value < lead(value) OVER o, true) AS low FROM events WINDOW o AS (ORDER BY event_id)")
def vector_change_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir)["value"]
    return rounded(_beside(_of(v.pct_change(), "change", "event_id"), _of(v.peak_max(), "top", "event_id"), _of(v.peak_min(), "low", "event_id")), "change")


@register("vector_rle", "WITH b AS (SELECT event_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AS new FROM events), g AS (SELECT event_type, sum(new::INT) OVER (ORDER BY event_id) - 1 AS run FROM b) SELECT run::BIGINT AS run, event_type, count(*) AS n FROM g GROUP BY ALL")
def vector_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by rle_id, counted, and rle itself, which must have the same lengths."""
    v = _events(spark, sf_dir)["event_type"]
    runs = _of(v.rle_id(), "run", "event_type").groupBy("run", "event_type").agg(F.count("*").alias("n"))
    same = v.rle().sdf.select(F.col("rle_id").alias("run"), F.col("len").alias("m"))
    return runs.join(same, "run").filter("n = m").select(F.col("run").cast("bigint").alias("run"), "event_type", "n")


@register("vector_rolling_quantile", "SELECT event_id, CASE WHEN i >= 5 THEN round(quantile_cont(value, 0.25) OVER w, 6) END AS q, CASE WHEN i >= 5 THEN round(max(value) OVER w - min(value) OVER w, 6) END AS spread FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)")
def vector_rolling_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir)["value"]
    return rounded(_beside(_of(v.rolling_quantile(0.25, 5), "q", "event_id"), _of(v.rolling_map(lambda x: float(x.max() - x.min()), 5, raw=True), "spread", "event_id")), "q", "spread")


@register("vector_search", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 50000)::BIGINT AS a, (SELECT count(*) FROM orders WHERE o_totalprice < 150000)::BIGINT AS b, true AS sorted, false AS mixed")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    by_price = t.sort("o_totalprice")
    found = sorted(x[-1] for x in by_price["o_totalprice"].search_sorted([50000.0, 150000.0]).sdf.collect())
    return spark.createDataFrame([(*found, t["o_orderkey"].is_sorted(), t["o_totalprice"].is_sorted())], "a bigint, b bigint, sorted boolean, mixed boolean")


@register("vector_finite", "SELECT event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AS fin, event_id % 3 = 0 AS inf, event_id % 3 <> 0 AND event_id % 5 = 0 AS nan, NOT (event_id % 3 <> 0 AND event_id % 5 = 0) AS number, event_id % 7 = 0 OR user_id <> event_id AS other FROM events")
def vector_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    odd = F.when(k % 3 == 0, F.lit(float("inf"))).when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    t = Table(table(spark, sf_dir, "events").select("event_id", odd.alias("x"), F.when(k % 7 != 0, F.col("user_id")).alias("u")), ["event_id"])
    x = t["x"]
    return t.sdf.select("event_id", x.is_finite().col.alias("fin"), x.is_infinite().col.alias("inf"), x.is_nan().col.alias("nan"), x.is_not_nan().col.alias("number"), t["u"].ne_missing(t["event_id"]).col.alias("other"))


@register("vector_log", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log2(p_retailprice), 6) AS two FROM part")
def vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_partkey"])
    return rounded(t.sdf.select("p_partkey", t["p_retailprice"].log().col.alias("ln"), t["p_retailprice"].log(2.0).col.alias("two")), "ln", "two")


@register("vector_arg_sort", "WITH p AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT row_number() OVER (ORDER BY s_acctbal, i) - 1 AS place, i FROM p")
def vector_arg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"])
    out = t["s_acctbal"].arg_sort().sdf
    place, i = out.columns[0], out.columns[-1]
    return out.select(F.col(place).cast("bigint").alias("place"), F.col(i).cast("bigint").alias("i"))


@register("vector_gather_reverse", "WITH p AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT n_name, i IN (0, 3, 7) AS picked, (n - 1 - i)::BIGINT AS back FROM p")
def vector_gather_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gather by places, reverse, and a shuffle that has the same values."""
    t = Table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    v = t["n_name"]
    picked = v.gather([0, 3, 7]).sdf.select("n_name", F.lit(True).alias("picked"))
    reverse = v.reverse().sdf.select("n_nationkey", "n_name").select("n_name", (F.lit(24) - F.col("n_nationkey")).cast("bigint").alias("back"))
    out = v.shuffle(5).sdf.select("n_name").join(picked, "n_name", "left").join(reverse, "n_name")
    return out.select("n_name", F.coalesce("picked", F.lit(False)).alias("picked"), "back")


@register("vector_hist", "WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT least(floor((l_quantity - lo) / (hi - lo) * 7), 6)::BIGINT AS bin, count(*) AS n FROM lineitem, b GROUP BY ALL")
def vector_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Table(table(spark, sf_dir, "lineitem").select("l_quantity"))["l_quantity"].hist(7).sdf
    return out.select(F.col(out.columns[0]).cast("bigint").alias("bin"), F.col("count").alias("n")) if "count" in out.columns else out


@register("vector_shrink", "SELECT 'tinyint' AS nation, 'smallint' AS supplier")
def vector_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Table(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("x")))["x"].shrink_dtype()
    s = Table(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 1 + 1000).cast("bigint").alias("x")))["x"].shrink_dtype()
    kind = lambda v: v.table.sdf.select(v.col.alias("x")).dtypes[0][1]
    return spark.createDataFrame([(kind(n), kind(s))], "nation string, supplier string")


@register(
    "vector_ewm",
    """WITH RECURSIVE n AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id FROM events),
    m AS (SELECT a.user_id, a.event_id, sum(b.x * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)) AS mean, sum(pow(0.7, a.i - b.i)) AS w, sum(pow(0.49, a.i - b.i)) AS w2, sum(b.x * b.x * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)) AS sq, a.i FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY ALL)
    SELECT event_id, round(mean, 5) AS mean, CASE WHEN i > 1 THEN round((sq - mean * mean) * w * w / (w * w - w2), 1) END AS var, CASE WHEN i > 1 THEN round(sqrt(greatest((sq - mean * mean) * w * w / (w * w - w2), 0)), 2) END AS std FROM m""",
)
def vector_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir)["value"]
    out = v.ewms(("mean", "var", "std"), ["user_id"], alpha=0.3).sdf.select("event_id", "mean", "var", "std")
    return rounded(rounded(rounded(out, "mean", digits=5), "var", digits=1), "std", digits=2)


@register(
    "vector_ewm_by_time",
    """WITH RECURSIVE n AS (SELECT user_id, value AS x, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events),
    w AS (SELECT user_id, event_id, i, t, x AS m FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, n.t, (1 - pow(2, -(n.t - w.t) / 3.6e9)) * n.x + pow(2, -(n.t - w.t) / 3.6e9) * w.m FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
    SELECT event_id, round(m, 5) AS mean FROM w""",
)
def vector_ewm_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["ts", "event_id"])
    return rounded(_of(t["value"].ewm_mean_by("ts", "1h", ["user_id"]), "mean", "event_id"), "mean", digits=5)
