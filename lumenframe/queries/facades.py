"""The labelled frame, the array and the columnar table over the same engine, and what they read, write and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import arrays as A
from lumenframe.columnar import Table
from lumenframe.frame import Frame, crosstab
from lumenframe.queries.registry import EVENTS, events, folder, r, register, rounded, table
from lumenframe.sources import readers, writers
from lumenframe.streaming import windows as W


def _frame(spark: SparkSession, sf_dir: str, name: str, index: str, order: str | None = None) -> Frame:
    return Frame(table(spark, sf_dir, name), index, order or index)


@register("frame_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS disc_price, round(avg(l_quantity), 6) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def frame_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "lineitem"))
    f = f[f["l_shipdate"] <= F.lit("1998-09-02").cast("timestamp_ntz")]
    f = f.assign(disc_price=f["l_extendedprice"] * (1 - f["l_discount"].col))
    out = f.groupby(["l_returnflag", "l_linestatus"]).agg(disc_price=("disc_price", "sum"), qty=("l_quantity", "mean")).spark()
    return rounded(rounded(out, "qty"), "disc_price", digits=4)


@register("frame_yearly_counts", "SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) AS size FROM orders GROUP BY ALL")
def frame_yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frame(spark, sf_dir, "orders", "o_orderkey")
    return f.assign(year=f["o_orderdate"].dt.year()).groupby(["year", "o_orderstatus"]).size().sort_values(["year", "size"], [True, False]).spark()


@register("frame_windows", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS running, round(value - lag(value) OVER (ORDER BY event_id), 6) AS step, CASE WHEN event_id >= 2 THEN round(avg(value) OVER (ORDER BY event_id ROWS 2 PRECEDING), 6) END AS smooth FROM events")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frame(spark, sf_dir, "events", "event_id")[["value"]]
    f = f.assign(running=f["value"].cumsum())
    f = f.assign(step=f["value"].diff())
    smooth = f[["value"]].rolling(3).mean()
    f = f.assign(smooth=smooth["value"])
    return rounded(rounded(f.spark(), "step", "smooth"), "running", digits=2).drop("value")


@register("frame_join_chain", "SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' GROUP BY n_name HAVING sum(c_acctbal) > 0")
def frame_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _frame(spark, sf_dir, "customer", "c_custkey").query("c_mktsegment != 'BUILDING'")
    out = c.merge(_frame(spark, sf_dir, "nation", "n_nationkey"), left_on="c_nationkey", right_on="n_nationkey").groupby("n_name").agg(balance=("c_acctbal", "sum"))
    return rounded(out[out["balance"] > 0].spark(), "balance", digits=2)


@register("frame_set_index_align", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN round(2 * c_acctbal, 2) END AS c_acctbal FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING' ")
def frame_set_index_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "customer"), order="c_custkey").set_index("c_custkey")
    return rounded((f[f["c_acctbal"] > 0][["c_acctbal"]] + f[f["c_mktsegment"] == "BUILDING"][["c_acctbal"]]).spark(), "c_acctbal", digits=2)


@register("frame_crosstab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"2-HIGH\", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS \"3-MEDIUM\", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS \"4-NOT SPECIFIED\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY o_orderstatus")
def frame_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frame(spark, sf_dir, "orders", "o_orderkey")
    return crosstab(f["o_orderstatus"], f["o_orderpriority"]).spark()


# Arrays


def _matrix(spark: SparkSession, sf_dir: str) -> A.Array:
    return A.Array(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


@register("array_reductions", "WITH f AS (SELECT unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) SELECT round(sum(x), 2) AS s, round(avg(x), 6) AS m, round(var_pop(x), 6) AS v, max(x) AS hi, min(x) AS lo FROM f")
def array_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return spark.createDataFrame([(round(m.sum(), 2), round(m.mean(), 6), round(m.var(), 6), m.max(), m.min())], "s double, m double, v double, hi double, lo double")


@register("array_axis", "SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def array_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_matrix(spark, sf_dir).sum(0).sdf.drop("__i"), "l_quantity", "l_discount", "l_tax", digits=2)


@register("array_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(abs(l_quantity * 2 - 30)), 6) AS l_quantity, round(tanh(l_discount), 6) AS t FROM lineitem")
def array_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.Array(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_orderkey", "l_linenumber"])
    out = A.sqrt(A.absolute(q * 2 - 30))
    both = A.tanh(A.Array(out.sdf, ["l_discount"], out.order))
    return rounded(both.sdf.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_discount").alias("t")), "l_quantity", "t")


@register("array_where_row_sums", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount + l_tax, 6) AS total, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS big FROM lineitem")
def array_where_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir).sum(1)
    flag = A.where(A.greater(A.Array(m.sdf.withColumn("big", F.col("l_quantity")), ["big"], m.order), 25), 1.0, 0.0)
    return flag.sdf.select("l_orderkey", "l_linenumber", "l_partkey", r("__row").alias("total"), "big")


@register("array_dot_norm", "SELECT round(sum(l_quantity * l_discount), 2) AS dot, round(sqrt(sum(l_quantity * l_quantity)), 4) AS norm FROM lineitem")
def array_dot_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, d = A.Array(li, ["l_quantity"], ["l_orderkey"]), A.Array(li, ["l_discount"], ["l_orderkey"])
    return spark.createDataFrame([(round(q.dot(d), 2), round(A.norm(q), 4))], "dot double, norm double")


@register("array_argmax_split", "SELECT arg_max(event_id, (value, -event_id)) AS top, (SELECT round(sum(value), 2) FROM events WHERE event_id < (SELECT count(*) / 2 FROM events)) AS front FROM events")
def array_argmax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.Array(table(spark, sf_dir, "events"), ["value"], ["event_id"])
    return spark.createDataFrame([(a.argmax(), round(a.split(2)[0].sum(), 2))], "top bigint, front double")


# Columnar tables


@register("table_verbs", f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum(coalesce(v, 0)), 2) AS total FROM e WHERE value > 5 AND event_type <> 'error' GROUP BY event_type")
def table_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(events(spark, sf_dir), ["event_id"])
    out = t.filter(F.col("value") > 5, F.col("event_type") != "error").with_columns(v=F.coalesce("v", F.lit(0.0))).group_by("event_type").agg(n=("event_id", "count"), total=("v", "sum"))
    return rounded(out.sdf, "total", digits=2)


@register("table_sql", "SELECT event_type, max(value) AS hi FROM events GROUP BY event_type")
def table_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events")).sql("SELECT event_type, max(value) AS hi FROM self GROUP BY event_type").sdf


@register("table_null_counts", f"WITH {EVENTS} SELECT count(*) - count(v) AS v, 0::BIGINT AS value FROM e")
def table_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(events(spark, sf_dir)).select("v", "value").null_count().sdf


@register("table_fill_null", f"WITH {EVENTS} SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM e")
def table_fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(events(spark, sf_dir), ["event_id"]).select("event_id", "v").fill_null(strategy="forward").select("event_id", "v").sdf


@register("table_unique_none", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def table_unique_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_custkey", "o_orderkey").unique("o_custkey", "none").select("o_custkey", "o_orderkey").sdf


@register("table_group_lists", "SELECT o_orderpriority, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def table_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return t.group_by("o_orderpriority").all().sdf.select("o_orderpriority", "o_orderkey")


@register("table_dynamic_groups", "SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def table_dynamic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "events"), ["ts"]).group_by_dynamic("ts", "1h", {"n": (None, "size")}).sdf


@register("vector_methods", "SELECT event_id, value BETWEEN 5 AND 20 AS mid, (rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)::DOUBLE AS rank, row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 AS first FROM events")
def vector_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_id"])
    t = t.with_columns(mid=t["value"].is_between(5, 20).col)
    ranked = t["value"].rank(descending=True)
    t = ranked.table.with_columns(rank=ranked.col)
    first = t["event_type"].is_first_distinct()
    return first.table.with_columns(first=first.col).select("event_id", "mid", "rank", "first").sdf


@register("vector_statistics", "SELECT round(skewness(value) * (n - 2) / sqrt(n * (n - 1)), 6) AS skew, n AS n_unique_ids, round(x, 2) AS dot FROM (SELECT value, count(*) OVER () AS n, sum(value * user_id) OVER () AS x FROM events) GROUP BY n, x")
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(table(spark, sf_dir, "events"), ["event_id"])
    return spark.createDataFrame([(round(t["value"].skew(), 6), t["event_id"].n_unique(), round(t["value"].dot(t["user_id"]), 2))], "skew double, n_unique_ids bigint, dot double")


# Files


@register("io_csv", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal FROM customer")
def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.read_csv(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double")


@register("io_table_fwf", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_table_fwf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    n = table(spark, sf_dir, "nation")
    writers.to_text(n.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 30, " "), F.lpad(F.col("n_regionkey").cast("string"), 3, " ")).alias("line")), path, "line")
    return readers.read_fwf(spark, path, widths=[4, 30, 3], schema="n_nationkey int, n_name string, n_regionkey int")


@register("io_json", "SELECT event_id, event_type, value FROM events")
def io_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return readers.read_json(spark, path, schema="event_id bigint, event_type string, value double")


@register("io_orc", "SELECT p_partkey, p_name FROM part")
def io_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_orc(table(spark, sf_dir, "part"), path)
    return readers.read_orc(spark, path, ["p_partkey", "p_name"])


@register("io_xml", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def io_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_xml(table(spark, sf_dir, "region"), path)
    return readers.read_xml(spark, path, schema="r_regionkey bigint, r_name string")


@register("io_parquet_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def io_parquet_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_parquet(table(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    return readers.read_parquet(spark, path, ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'P'")


@register("io_custom_text", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def io_custom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_text(table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("line")), path, "line")

    def parse(line: str) -> dict | None:
        k, _, kind = line.partition("|")
        return {"event_id": int(k), "event_type": kind} if kind != "error" else None

    return readers.read_custom_text(spark, path, parse, "event_id bigint, event_type string")


# Streams


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = W.tumbling(e, "ts", "1 day", {"n": F.count("*"), "total": r(F.sum("value"), 2)}, ["event_type"])
    return out.drop("end")


@register("stream_sliding", "WITH s AS (SELECT value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start FROM events, range(2) t(k)) SELECT start, count(*) AS n FROM s GROUP BY start")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(table(spark, sf_dir, "events"), "ts", "12 hours", {"n": F.count("*")}, slide="6 hours").drop("end")


@register(
    "stream_sessions",
    "WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(table(spark, sf_dir, "events"), "ts", "8 hours", {"n": F.count("*")}, ["user_id"]).select("user_id", "start", "n")


@register("stream_running_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    e = table(spark, sf_dir, "events")
    name = f"running_{uuid.uuid4().hex}"
    stream = W.read_stream(spark, sf_dir, e.schema, only="events.parquet")
    W.run_once(W.running(stream, "user_id", "value"), name, folder(spark), "update")
    return rounded(spark.table(name).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")), "total", digits=2)
