"""Projection, filters, indexing, assignment, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import elementwise as E
from lumenframe.operators import reshaping, selecting, sorting, udfs
from lumenframe.plans import expressions
from lumenframe.queries.registry import EVENTS, events, r, register, table
from lumenframe.sources.readers import read_parquet


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 3) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base_price"), r(F.sum(price), 4).alias("sum_disc_price"), r(F.sum(price * (1 + F.col("l_tax"))), 3).alias("sum_charge"),
        r(F.avg("l_quantity")).alias("avg_qty"), r(F.avg("l_extendedprice")).alias("avg_price"), F.count("*").alias("n"),
    )


@register("project_filter", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_extendedprice"], "l_quantity > 45 and l_returnflag = 'R'")


@register("query_expression", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus IN ('F', 'P')) OR NOT (o_orderpriority <> '1-URGENT') AND floor(o_totalprice / 1000) % 2 = 1")
def query_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expressions.query(table(spark, sf_dir, "orders"), "(o_totalprice > @low and o_orderstatus in ['F', 'P']) or not (o_orderpriority != '1-URGENT') and o_totalprice // 1000 % 2 == 1", low=100000)
    return found.select("o_orderkey", "o_totalprice")


@register("query_chained", "SELECT p_partkey FROM part WHERE 10 < p_size AND p_size <= 30 AND p_name LIKE '%red%' AND p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def query_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expressions.query(table(spark, sf_dir, "part"), "10 < p_size <= 30 and p_name.str.contains('red') and p_retailprice > p_retailprice.mean()").select("p_partkey")


@register("eval_assign", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 5) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross, round(sqrt(l_quantity), 6) AS root FROM lineitem")
def eval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expressions.evaluate(table(spark, sf_dir, "lineitem"), "net = l_extendedprice * (1 - l_discount)\ngross = net * (1 + l_tax)\nroot = sqrt(l_quantity)")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("net", 5).alias("net"), r("gross", 7).alias("gross"), r("root").alias("root"))


@register("loc_slice", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def loc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.loc(table(spark, sf_dir, "orders"), "o_orderkey", slice(100, 200), ["o_orderkey", "o_orderstatus"])


@register("loc_list_mask", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 9, 77) OR (o_orderstatus = 'P' AND o_totalprice > 400000)")
def loc_list_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    listed = selecting.loc(o, "o_orderkey", [1, 5, 9, 77], ["o_orderkey"])
    return listed.union(selecting.loc(o, "o_orderkey", (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), ["o_orderkey"])).distinct()


@register("iloc_slice", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) WHERE p >= 100 AND p < 400 AND (p - 100) % 3 = 0")
def iloc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.iloc(table(spark, sf_dir, "orders"), slice(100, 400, 3), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@register("iloc_list_negative", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p IN (0, 7, n - 1, n - 5)")
def iloc_list_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.iloc(table(spark, sf_dir, "orders"), [0, 7, -1, -5], ["o_orderkey"]).select("o_orderkey")


@register("xs_at", "SELECT conv_id, role, text FROM conversations WHERE turn = 1")
def xs_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.xs(table(spark, sf_dir, "conversations"), 1, "turn")


@register("filter_labels", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def filter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.filter_labels(table(spark, sf_dir, "lineitem"), regex="key$")


@register("select_dtypes", "SELECT c_acctbal, c_custkey, c_nationkey FROM customer")
def select_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.select_dtypes(table(spark, sf_dir, "customer"), include="number", exclude="object")


@register("where_mask_casewhen", f"WITH {EVENTS} SELECT event_id, CASE WHEN value > 20 THEN value ELSE 0.0 END AS kept, CASE WHEN NOT (value > 20) THEN value END AS masked, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE event_type END AS band FROM e")
def where_mask_casewhen(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", E.where(v, v > 20, 0.0).alias("kept"), E.mask(v, v > 20).alias("masked"), E.case_when(F.col("event_type"), [(v < 5, "low"), (v < 20, "mid")]).alias("band"))


@register("isin_between", f"WITH {EVENTS} SELECT event_id, event_type IN ('click', 'error') AS listed, coalesce(v BETWEEN 5 AND 25, false) AS inside, coalesce(v >= 5 AND v < 25, false) AS half_open, v IS NULL AS missing_in FROM e")
def isin_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return events(spark, sf_dir).select("event_id", E.isin(F.col("event_type"), ["click", "error"]).alias("listed"), E.between(v, 5, 25).alias("inside"), E.between(v, 5, 25, "left").alias("half_open"), E.isin(v, [None]).alias("missing_in"))


@register("between_time", "SELECT event_id FROM events WHERE ts::TIME BETWEEN TIME '09:30:00' AND TIME '11:00:00'")
def between_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.between_time(table(spark, sf_dir, "events"), "ts", "09:30", "11:00").select("event_id")


@register("between_time_overnight", "SELECT event_id FROM events WHERE ts::TIME >= TIME '23:00:00' OR ts::TIME <= TIME '01:00:00'")
def between_time_overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.between_time(table(spark, sf_dir, "events"), "ts", "23:00", "01:00").select("event_id")


@register("truncate_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09'")
def truncate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    return selecting.truncate(table(spark, sf_dir, "events"), "ts", ntz("2024-01-05"), ntz("2024-01-09")).select("event_id")


@register("first_last_span", "SELECT event_id, 'first' AS part FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAY UNION ALL SELECT event_id, 'last' FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 HOUR")
def first_last_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = selecting.first_span(e, "ts", 2 * 86_400_000_000).select("event_id", F.lit("first").alias("part"))
    return a.union(selecting.first_span(e, "ts", 3 * 3_600_000_000, True).select("event_id", F.lit("last").alias("part")))


@register("valid_index", f"WITH {EVENTS} SELECT min(event_id) AS label FROM e WHERE v IS NOT NULL UNION ALL SELECT max(event_id) FROM e WHERE v IS NOT NULL")
def valid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return selecting.valid_index(e, "v", "event_id", "event_id").union(selecting.valid_index(e, "v", "event_id", "event_id", True))


@register("assign_insert", "SELECT p_partkey, upper(p_name) AS shout, p_name, p_size * 2 AS double_size FROM part")
def assign_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selecting.assign(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), double_size=lambda d: d.p_size * 2)
    return selecting.insert(out, 1, "shout", F.upper("p_name")).drop("p_size")


@register("masked_assignment", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN p IN (3, 5) THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)")
def masked_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = selecting.set_where(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P", ["o_totalprice"], 0.0)
    return selecting.set_positions(o, [3, 5], ["o_orderpriority"], "x", ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("drop_rows_columns", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 4, 5)")
def drop_rows_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.drop_rows(table(spark, sf_dir, "nation"), "n_nationkey", [3, 4, 5]).drop("n_regionkey")


@register("reindex_labels", "SELECT l.k::INT AS n_nationkey, coalesce(n_name, 'none') AS n_name FROM (VALUES (2), (99), (7), (2)) l(k) LEFT JOIN nation ON n_nationkey = l.k")
def reindex_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.reindex(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [2, 99, 7, 2], "none")


@register("reindex_ffill", "SELECT l.k::BIGINT AS o_orderkey, o.o_orderstatus FROM (VALUES (-1), (10), (100000000)) l(k) ASOF LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders) o ON o.o_orderkey <= l.k")
def reindex_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.reindex(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", [-1, 10, 100000000], method="ffill")


@register("rename_prefix_suffix", "SELECT n_nationkey AS a_key_z, n_name AS a_n_name_z, n_regionkey AS a_n_regionkey_z FROM nation")
def rename_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.add_suffix(selecting.add_prefix(selecting.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "key"}), "a_"), "_z")


@register("astype_cast", "SELECT p_partkey::INT AS p_partkey, p_size::DOUBLE AS p_size, trunc(p_retailprice)::BIGINT AS p_retailprice, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, try_cast(p_type AS DOUBLE) AS no_number FROM part")
def astype_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("int"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("bigint"), E.to_numeric(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("brand_no"), E.to_numeric(F.col("p_type"), "coerce").alias("no_number"))


@register("to_datetime_timedelta", "SELECT event_id, make_timestamp(event_id * 3600000000) AS at_hour, strptime('2024-02-0' || (1 + event_id % 9)::VARCHAR, '%Y-%m-%d') AS parsed, (event_id * 90)::BIGINT AS secs FROM events")
def to_datetime_timedelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.functions.dates import total_seconds

    k = F.col("event_id")
    text = F.concat(F.lit("2024-02-0"), (1 + k % 9).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", E.to_datetime(k, unit="h").alias("at_hour"), E.to_datetime(text, "%Y-%m-%d").alias("parsed"), total_seconds(E.to_timedelta(k * 90)).cast("bigint").alias("secs"))


@register("dropna_fillna", f"WITH {EVENTS} SELECT event_id, coalesce(v, -1.0) AS v FROM e WHERE event_id % 14 <> 0")
def dropna_fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "v", F.when(F.col("event_id") % 14 != 0, 1).alias("mark"))
    return selecting.dropna(e, subset=["mark"]).select("event_id", E.fillna(F.col("v"), -1.0).alias("v"))


@register("dropna_thresh", f"WITH {EVENTS} SELECT event_id FROM e WHERE (v IS NOT NULL)::INT + (event_id % 3 <> 0)::INT + 1 >= 2")
def dropna_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "v", F.when(F.col("event_id") % 3 != 0, 1).alias("mark"))
    return selecting.dropna(e, thresh=2).select("event_id")


@register("equals_compare", "SELECT c_custkey, 'c_acctbal' AS \"column\", c_acctbal::BIGINT::VARCHAR AS self, (c_acctbal::BIGINT + 1)::VARCHAR AS other FROM customer WHERE c_custkey % 10 = 0")
def equals_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.rint("c_acctbal").cast("bigint").alias("c_acctbal"), "c_name")
    other = c.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0))
    return selecting.compare(c, other, "c_custkey")


@register("info_counts", "SELECT 'event_id' AS \"column\", count(event_id) AS non_null, 'bigint' AS dtype FROM events UNION ALL SELECT 'v', count(*) FILTER (event_id % 7 <> 0), 'double' FROM events UNION ALL SELECT 'event_type', count(event_type), 'string' FROM events")
def info_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.info(events(spark, sf_dir).select("event_id", "v", "event_type"))


@register("memory_usage", "SELECT 'n_nationkey' AS \"column\", count(*) * 4 AS bytes FROM nation UNION ALL SELECT 'n_name', sum(strlen(n_name))::BIGINT FROM nation UNION ALL SELECT 'n_regionkey', count(*) * 4 FROM nation")
def memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.memory_usage(table(spark, sf_dir, "nation"))


@register("infer_types", "SELECT event_id::BIGINT AS a, event_id / 2 AS b, event_id % 2 = 0 AS c, 'k' || event_id::VARCHAR AS d FROM events")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    texts = table(spark, sf_dir, "events").select(k.cast("string").alias("a"), (k / 2).cast("string").alias("b"), (k % 2 == 0).cast("string").alias("c"), F.concat(F.lit("k"), k.cast("string")).alias("d"))
    return selecting.infer_types(texts, ["a", "b", "c", "d"])


@register("repeat_rows", "SELECT n_nationkey FROM nation, range(3) UNION ALL SELECT n_nationkey + 100 FROM nation, range(5) t(i) WHERE i < n_nationkey % 3")
def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return reshaping.repeat(n, 3).union(reshaping.repeat(n, F.col("n_nationkey") % 3).select(F.col("n_nationkey") + 100))


@register("sort_mixed", "SELECT o_orderkey, rank AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) - 1 AS rank FROM orders)")
def sort_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sorting.order_keys(["o_orderstatus", "o_totalprice", "o_orderkey"], [False, True, True])
    return selecting.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), keys, "rank").select("o_orderkey", "rank")


@register("sort_nulls", f"WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS rank FROM e")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.positions(events(spark, sf_dir).select("event_id", "v"), [*sorting.order_keys("v", False), F.col("event_id").asc()], "rank").select("event_id", "rank")


@register("nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def nlargest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.nlargest(table(spark, sf_dir, "orders"), 25, "o_totalprice", order=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@register("nlargest_ties", "SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10))")
def nlargest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.nlargest(table(spark, sf_dir, "part"), 10, "p_size", keep="all").select("p_partkey", "p_size")


@register("nsmallest_two_keys", "SELECT c_custkey FROM customer ORDER BY c_nationkey, c_acctbal, c_custkey LIMIT 15")
def nsmallest_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.nsmallest(table(spark, sf_dir, "customer"), 15, ["c_nationkey", "c_acctbal"], order=["c_custkey"]).select("c_custkey")


@register("head_tail", "(SELECT event_id FROM events ORDER BY event_id LIMIT 5) UNION ALL (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5)")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return sorting.head(e, 5, ["event_id"]).union(sorting.tail(e, 5, ["event_id"]))


@register("argsort", "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS rank, event_id AS argsort FROM events")
def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.argsort(table(spark, sf_dir, "events"), "value", ["event_id"])


@register("searchsorted", "SELECT x::DOUBLE AS value, (SELECT count(*) FROM events WHERE value < x) AS position FROM (VALUES (1), (10), (50)) t(x)")
def searchsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.searchsorted(table(spark, sf_dir, "events"), "value", [1.0, 10.0, 50.0])


@register("train_test_split", "SELECT count(*) AS rows, 0 AS both FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = udfs.train_test_split(o, 0.25, 7, "o_orderkey")
    n = a.select("o_orderkey").union(b.select("o_orderkey")).agg(F.count("*").alias("rows"))
    return n.crossJoin(a.join(b, "o_orderkey").agg(F.count("*").cast("int").alias("both")))


@register("sample_rows", "SELECT 100::BIGINT AS n, 100::BIGINT AS kinds FROM orders LIMIT 1")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.sample(table(spark, sf_dir, "orders"), 100, seed=3).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("kinds"))
