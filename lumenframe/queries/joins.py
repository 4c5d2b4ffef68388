"""Joins and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.columnar import Table
from lumenframe.functions import nested
from lumenframe.operators import joining
from lumenframe.queries.registry import r, register, table


def _orders_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@register("merge_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_small(spark, sf_dir)
    c = joining.merge(o, table(spark, sf_dir, "customer"), left_on="o_custkey", right_on="c_custkey")
    return joining.merge(c, table(spark, sf_dir, "nation"), left_on="c_nationkey", right_on="n_nationkey").select("o_orderkey", "c_name", "n_name")


@register("merge_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_small(spark, sf_dir)
    return joining.merge(table(spark, sf_dir, "customer").select("c_custkey"), o, "left", left_on="c_custkey", right_on="o_custkey").select("c_custkey", "o_orderkey")


@register("merge_right", "SELECT c_name, o_custkey AS k FROM (SELECT c_custkey AS k, c_name FROM customer) c RIGHT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c.k = o.o_custkey")
def merge_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return joining.merge(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), "right", on="k").select("c_name", "k")


@register(
    "merge_outer_indicator",
    """SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge
    FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT c_custkey AS k, c_nationkey + 1 AS v FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k""",
)
def merge_outer_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 1).alias("v"))
    return joining.merge(a, b, "outer", on="k", indicator=True)


@register("merge_null_keys", "SELECT nullif(user_id % 25, 0) AS k, event_id, n_name FROM events JOIN (SELECT nullif(n_nationkey, 0)::BIGINT AS k, n_name FROM nation) n ON nullif(user_id % 25, 0) IS NOT DISTINCT FROM n.k")
def merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.expr("nullif(user_id % 25, 0)").alias("k"), "event_id")
    return joining.merge(a, table(spark, sf_dir, "nation").select(F.expr("nullif(n_nationkey, 0)").cast("bigint").alias("k"), "n_name"), on="k")


@register("merge_cross", "SELECT a.r_name AS r_name_x, b.r_name AS r_name_y FROM region a, region b")
def merge_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "region").select("r_name")
    return joining.merge(one, one, "cross")


@register("merge_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS big FROM customer")
def merge_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    semi = joining.merge(c, o, "semi", left_on="c_custkey", right_on="o_custkey").withColumn("big", F.lit(True))
    return semi.union(joining.merge(c, o, "anti", left_on="c_custkey", right_on="o_custkey").withColumn("big", F.lit(False)))


@register("merge_validate", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def merge_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joining.merge(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), left_on="s_nationkey", right_on="n_nationkey", validate="many_to_one").select("s_suppkey", "n_name")


@register("join_index", "SELECT a.doc_id, a.n_chars AS n_chars_l, b.quality, b.toxic FROM documents a LEFT JOIN labels b USING (doc_id)")
def join_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n_chars_l"))
    return joining.join_index(d, table(spark, sf_dir, "labels"), "doc_id")


@register("merge_ordered", "SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderpriority = '5-LOW') b ON a.k = b.k")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return joining.merge_ordered(a, o.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")), "k")


@register(
    "merge_ordered_ffill",
    """SELECT k, last_value(x IGNORE NULLS) OVER (ORDER BY k) AS x, last_value(y IGNORE NULLS) OVER (ORDER BY k) AS y FROM (SELECT coalesce(a.k, b.k) AS k, a.v AS x, b.v AS y
    FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderpriority = '5-LOW') b ON a.k = b.k)""",
)
def merge_ordered_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    return joining.merge_ordered(a, o.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("y")), "k", fill_method="ffill")


_ASOF_SIDES = "p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts, value AS click_value FROM events WHERE event_type = 'click')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts", F.col("value").alias("click_value"))


@register("merge_asof_backward", f"WITH {_ASOF_SIDES} SELECT p.event_id, c.click_id, c.click_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def merge_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _sides(spark, sf_dir)
    return joining.merge_asof(p, c, on="ts", by="user_id").select("event_id", "click_id", "click_value")


@register("merge_asof_forward", f"WITH {_ASOF_SIDES} SELECT p.event_id, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts < c.ts")
def merge_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _sides(spark, sf_dir)
    return joining.merge_asof(p, c, on="ts", by="user_id", direction="forward", allow_exact_matches=False).select("event_id", "click_id")


@register("merge_asof_global", f"WITH {_ASOF_SIDES} SELECT p.event_id, CASE WHEN p.ts - c.ts <= INTERVAL 5 MINUTE THEN c.click_id END AS click_id FROM p ASOF LEFT JOIN c ON p.ts >= c.ts")
def merge_asof_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _sides(spark, sf_dir)
    return joining.merge_asof(p, c.drop("user_id"), on="ts", tolerance=300.0).select("event_id", "click_id")


@register(
    "merge_asof_nearest",
    f"""WITH {_ASOF_SIDES} SELECT p.event_id, CASE WHEN b.ts IS NULL THEN a.click_id WHEN a.ts IS NULL OR epoch_us(p.ts) - epoch_us(b.ts) <= epoch_us(a.ts) - epoch_us(p.ts) THEN b.click_id ELSE a.click_id END AS click_id
    FROM p ASOF LEFT JOIN c b ON p.user_id = b.user_id AND p.ts >= b.ts ASOF LEFT JOIN c a ON p.user_id = a.user_id AND p.ts <= a.ts""",
)
def merge_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _sides(spark, sf_dir)
    return joining.merge_asof(p, c, on="ts", by="user_id", direction="nearest").select("event_id", "click_id")


@register("align_outer", "SELECT k, a.n_name AS left_name, b.n_name AS right_name FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey <= 2) a FULL JOIN (SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey >= 2) b USING (k)")
def align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    a, b = joining.align(n.filter("n_regionkey <= 2").drop("n_regionkey"), n.filter("n_regionkey >= 2").drop("n_regionkey"), "k")
    return a.select("k", F.col("n_name").alias("left_name")).join(b.select("k", F.col("n_name").alias("right_name")), "k")


@register(
    "update_combine_first",
    """WITH a AS (SELECT event_id AS k, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events WHERE value > 10), b AS (SELECT event_id AS k, CASE WHEN event_id % 5 <> 0 THEN -value END AS v FROM events WHERE event_type <> 'view')
    SELECT 'update' AS how, a.k, coalesce(b.v, a.v) AS v FROM a LEFT JOIN b USING (k) UNION ALL SELECT 'first', k, coalesce(a.v, b.v) FROM a FULL JOIN b USING (k)""",
)
def update_combine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.filter("value > 10").select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    b = e.filter("event_type <> 'view'").select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 5 != 0, -F.col("value")).alias("v"))
    shown = lambda how, d: d.select(F.lit(how).alias("how"), "k", "v")
    return shown("update", joining.overlay(a, b, "k")).union(shown("first", joining.overlay(a, b, "k", "combine_first")))


@register("combine_frames", "SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT c_custkey AS k, 5000.0 AS v FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k")
def combine_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a, b = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.lit(5000.0).alias("v"))
    return joining.combine(a, b, "k", F.greatest, 0.0)


@register("dot_long", "SELECT l_returnflag AS row, p_brand AS col, round(sum(l_quantity * p_retailprice), 3) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def dot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joining.dot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "l_quantity", table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_retailprice")
    return out.select("row", "col", r("value", 3).alias("value"))


@register("corrwith", "SELECT round(corr(a.value, b.value), 6) AS value, round(corr(a.user_id, b.user_id), 6) AS user_id FROM events a JOIN events b ON a.event_id = b.event_id + 1")
def corrwith(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    out = joining.corrwith(e, e.withColumn("event_id", F.col("event_id") + 1), "event_id", ["value", "user_id"])
    return out.select(r("value").alias("value"), r("user_id").alias("user_id"))


@register("join_verbs", "SELECT n_name, r_name, n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def join_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g, s = (Table(table(spark, sf_dir, x)) for x in ("nation", "region", "supplier"))
    kept = n.join(s, how="semi", left_on="n_nationkey", right_on="s_nationkey")
    return kept.join(g.filter(F.col("r_regionkey") > 1), how="left", left_on="n_regionkey", right_on="r_regionkey").select("n_name", "r_name", "n_regionkey").sdf


@register("vector_products", "SELECT a.vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN a.embedding]), 6) AS square, len(a.embedding) AS width FROM embeddings a")
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r(nested.dot(e, e)).alias("square"), nested.list_len(e).cast("bigint").alias("width"))
