"""Reshapes, set-like operators, bins and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.categories import Categorical
from lumenframe.operators import reshaping
from lumenframe.queries.registry import EVENTS, events, r, register, rounded, table


@register("concat_outer", "SELECT r_regionkey AS k, r_name AS name, NULL::INT AS extra, 'r' AS key FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey, 'n' FROM nation")
def concat_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return reshaping.concat([a, None, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("extra"))], names=["r", "x", "n"])


@register("concat_inner", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation")
def concat_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "k")
    return reshaping.concat([a, table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "k")], "inner")


@register("explode_list", "SELECT vec_id, unnest(embedding[1:4])::DOUBLE AS x FROM embeddings")
def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("x"))
    return reshaping.explode(e, "x").withColumn("x", F.col("x").cast("double"))


@register("explode_list_whole", "SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def explode_list_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return reshaping.explode(e, "x").withColumn("x", F.col("x").cast("double"))


@register("melt", "SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.melt(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"])


@register("pivot", "SELECT conv_id, " + ", ".join(f"max(length(text)) FILTER (turn = {k})::INT AS t{k}" for k in range(8)) + " FROM conversations GROUP BY conv_id")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), "turn").alias("t"), F.char_length("text").alias("n"))
    return reshaping.pivot(c, "conv_id", "t", "n")


@register("pivot_table", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshaping.pivot_table(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus"), "F", "O")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("pivot_table_margins", "SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS \"{p}\"" for p in PRIORITIES) + ", round(sum(o_totalprice), 2) AS \"All\" FROM orders GROUP BY ROLLUP (o_orderstatus)")
def pivot_table_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshaping.pivot_table(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority", "sum", margins=True), *PRIORITIES, "All", digits=2)


@register("crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_normalized", "SELECT l_returnflag, round(count(*) FILTER (l_linestatus = 'F') / (SELECT count(*) FROM lineitem), 6) AS F, round(count(*) FILTER (l_linestatus = 'O') / (SELECT count(*) FROM lineitem), 6) AS O FROM lineitem GROUP BY l_returnflag")
def crosstab_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshaping.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", normalize=True), "F", "O")


@register("stack", f"WITH {EVENTS} SELECT event_id, 'v' AS level, v AS value FROM e WHERE v IS NOT NULL UNION ALL SELECT event_id, 'value', value FROM e")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.stack(events(spark, sf_dir).select("event_id", "v", "value"), "event_id")


@register("unstack", "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{x}') AS \"{x}\"" for x in SEGMENTS) + " FROM customer GROUP BY c_nationkey")
def unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").count()
    return reshaping.unstack(c, "c_nationkey", "c_mktsegment", "count", 0)


@register("get_dummies", "SELECT o_orderkey, o_orderstatus = 'F' AS o_orderstatus_F, o_orderstatus = 'O' AS o_orderstatus_O, o_orderstatus = 'P' AS o_orderstatus_P FROM orders")
def get_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.get_dummies(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@register("wide_to_long", "SELECT n_nationkey, 1 AS j, n_regionkey * 10 AS x, n_name AS y FROM nation UNION ALL SELECT n_nationkey, 2, n_regionkey * 20, NULL FROM nation")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") * 10).alias("x1"), (F.col("n_regionkey") * 20).alias("x2"), F.col("n_name").alias("y1"))
    return reshaping.wide_to_long(n, ["x", "y"], "n_nationkey", "j")


@register("lreshape", "SELECT n_nationkey, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 2 FROM nation WHERE n_nationkey > 5")
def lreshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("a"), F.when(F.col("n_nationkey") > 5, F.col("n_nationkey") * 2).alias("b"))
    return reshaping.lreshape(n, {"v": ["a", "b"]})


@register("cut_edges", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'mid' WHEN o_totalprice <= 600000 THEN 'high' END AS band FROM orders")
def cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.cut(table(spark, sf_dir, "orders"), "o_totalprice", [0, 100000, 300000, 600000], "band", ["low", "mid", "high"]).select("o_orderkey", "band")


@register("cut_equal_width", "WITH m AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, greatest(0, ceil((p_size - lo) / ((hi - lo) / 4)) - 1)::INT AS bin FROM part, m")
def cut_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.cut(table(spark, sf_dir, "part"), "p_size", 4, "bin").select("p_partkey", "bin")


@register("qcut_quartiles", "WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS e FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= e[1] THEN 0 WHEN c_acctbal <= e[2] THEN 1 WHEN c_acctbal <= e[3] THEN 2 ELSE 3 END AS bin FROM customer, q")
def qcut_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.qcut(table(spark, sf_dir, "customer"), "c_acctbal", 4, "bin").select("c_custkey", "bin")


@register("factorize_first_seen", "WITH f AS (SELECT p_brand, dense_rank() OVER (ORDER BY m) - 1 AS code FROM (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY p_brand)) SELECT p_partkey, code FROM part JOIN f USING (p_brand)")
def factorize_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.factorize(table(spark, sf_dir, "part"), "p_brand", "code", ["p_partkey"]).select("p_partkey", "code")


@register("factorize_sorted", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def factorize_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.factorize(table(spark, sf_dir, "part"), "p_type", "code", sort=True).select("p_partkey", "code")


@register("unique_first_seen", "SELECT p_type, min(p_partkey) AS first_seen FROM part GROUP BY p_type")
def unique_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.unique(table(spark, sf_dir, "part"), "p_type", ["p_partkey"])


@register("drop_duplicates", "SELECT 'first' AS keep, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus UNION ALL SELECT 'last', max(o_orderkey) FROM orders GROUP BY o_custkey, o_orderstatus UNION ALL SELECT 'none', min(o_orderkey) FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) = 1")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = [reshaping.drop_duplicates(o, ["o_custkey", "o_orderstatus"], ["o_orderkey"], keep).select(F.lit(name).alias("keep"), "o_orderkey") for name, keep in (("first", "first"), ("last", "last"), ("none", False))]
    return parts[0].union(parts[1]).union(parts[2])


@register("duplicated", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS again, count(*) OVER (PARTITION BY text) > 1 AS shared FROM documents")
def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reshaping.duplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"], "again")
    return reshaping.duplicated(d, "text", ["doc_id"], "shared", False).select("doc_id", "again", "shared")


@register("value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("value_counts_normalized", f"WITH {EVENTS} SELECT floor(v / 10) AS band, round(count(*) / (SELECT count(v) FROM e), 8) AS proportion FROM e WHERE v IS NOT NULL GROUP BY 1")
def value_counts_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("band", F.floor(F.col("v") / 10).cast("double"))
    return rounded(reshaping.value_counts(e, "band", normalize=True), "proportion", digits=8)


@register("hist_bins", "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 8)), 7)::INT AS bin, count(*) AS n FROM events, m GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS count FROM range(8) t(i) LEFT JOIN c ON bin = i")
def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshaping.hist(table(spark, sf_dir, "events"), "value", 8)


@register("transpose_small", "SELECT 'r_regionkey' AS key, " + ", ".join(f"max(r_regionkey::VARCHAR) FILTER (r_regionkey = {k}) AS \"{k}\"" for k in range(5)) + " FROM region UNION ALL SELECT 'r_name', " + ", ".join(f"max(r_name) FILTER (r_regionkey = {k})" for k in range(5)) + " FROM region")
def transpose_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name")
    return reshaping.transpose(n, "r")


@register("row_index_every", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 + 10 AS i, o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 = 3")
def row_index_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = reshaping.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "i", 10)
    return reshaping.gather_every(o, 50, ["o_orderkey"], 3)


@register("categorical_codes", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE -1 END AS code, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD') THEN c_mktsegment IN ('MACHINERY', 'BUILDING') END AS before FROM customer")
def categorical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cat = Categorical.of(c, "c_mktsegment").set_categories(["MACHINERY", "BUILDING", "HOUSEHOLD"]).as_ordered()
    return c.select("c_custkey", cat.codes().alias("code"), cat.less("HOUSEHOLD").alias("before"))


@register("categorical_rename", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def categorical_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", Categorical.of(o, "o_orderstatus").rename_categories({"F": "final", "O": "open"}).column.alias("status"))


@register("describe_wide", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY p_brand")
def describe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(r(F.avg("p_retailprice")).alias("mean"), F.count("*").alias("n"))
