"""What the other modules leave of the API: text, dates, categories, arrays, sources, frames and groups, each against SQL over whole tables."""

from __future__ import annotations

import operator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import arrays as A
from lumenframe.frame import Frame
from lumenframe.functions import dates as D
from lumenframe.functions import elementwise as E
from lumenframe.functions import strings as T
from lumenframe.functions.categories import Categorical
from lumenframe.operators import selecting, sorting, udfs
from lumenframe.operators.grouping import Groups
from lumenframe.operators.resampling import resample
from lumenframe.queries.registry import events, folder, r, register, rounded, table
from lumenframe.sources import readers, writers

# Text


@register(
    "text_padding",
    "SELECT n_nationkey, repeat('*', (20 - length(n_name)) // 2) || n_name || repeat('*', 20 - length(n_name) - (20 - length(n_name)) // 2) AS wide, lpad(n_name, 16, '.') AS left_, rpad(n_name, 16, '.') AS right_, lower(n_name) AS folded FROM nation",
)
def text_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    centred = T.center(n, 20, "*")
    spare = F.lit(20) - F.length(n)
    same = (F.length(centred) == 20) & (F.abs(F.instr(centred, F.substring(n, 1, 1)) - 1 - F.floor(spare / 2)) <= 1)
    even = F.concat(F.repeat(F.lit("*"), F.floor(spare / 2).cast("int")), n, F.repeat(F.lit("*"), (spare - F.floor(spare / 2)).cast("int")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(same, even).alias("wide"), T.pad(n, 16, "left", ".").alias("left_"), T.pad(n, 16, "right", ".").alias("right_"), T.casefold(n).alias("folded"))


@register("text_places", "SELECT o_orderkey, instr(o_orderpriority, '-') - 1 AS first, length(o_orderpriority) - instr(reverse(o_orderpriority), '-') AS last FROM orders")
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index and rindex: places of a part that every text has."""
    t = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.index(t, "-").cast("bigint").alias("first"), T.rindex(t, "-").cast("bigint").alias("last"))


@register("text_kinds", "SELECT p_partkey, regexp_full_match(x, '[0-9]+') AS decimal, regexp_full_match(x, '[0-9]+') AS numeric FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS x FROM part)")
def text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.isdecimal(x).alias("decimal"), T.isnumeric(x).alias("numeric"))


@register("text_extractall", "SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+)', 1)) AS found FROM documents")
def text_extractall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.extractall(F.col("text"), "([0-9]+)")).alias("found"))


@register("text_wrap", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS line FROM customer")
def text_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at most 20 characters; joined again by spaces they are the text."""
    wrapped = T.wrap(F.concat_ws(" ", "c_name", "c_mktsegment"), 20)
    lines = F.split(wrapped, "\n")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.forall(lines, lambda x: F.length(x) <= 20), F.array_join(lines, " ")).alias("line"))


# Dates


@register(
    "dates_clock",
    "SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS time, strftime(ts, '%H:%M:%S.%f') AS timetz, 0 AS nanosecond, isodow(ts) - 1 AS weekday, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, year(ts) AS qyear, day(last_day(ts)) AS daysinmonth, date_trunc('second', ts) AS seconds FROM events",
)
def dates_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    whole = lambda c: c.cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", D.time(t).alias("time"), D.timetz(t).alias("timetz"), D.nanosecond(t).alias("nanosecond"), whole(D.weekday(t)).alias("weekday"), whole(D.day_of_week(t)).alias("day_of_week"), whole(D.day_of_year(t)).alias("day_of_year"), whole(D.qyear(t)).alias("qyear"),
        whole(D.daysinmonth(t)).alias("daysinmonth"), D.as_unit(t, "s").cast("timestamp_ntz").alias("seconds"),
    )


@register("dates_periods", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS start, date_trunc('quarter', o_orderdate) AS quarter, date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS ends FROM orders")
def dates_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.start_time(t).alias("start"), D.to_timestamp(t, "S", "Q").alias("quarter"), D.to_timestamp(t, "E", "Y").alias("ends"))


@register("dates_durations", "SELECT event_id, (epoch_us(ts) % 1000000)::BIGINT AS micro, 0 AS nano FROM events")
def dates_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the time since the first day of 1970, as an interval."""
    d = F.col("ts").cast("timestamp") - F.lit("1970-01-01").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", D.microseconds(d).cast("bigint").alias("micro"), D.nanoseconds(d).alias("nano"))


# Categories


@register(
    "categories_edited",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END AS code, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS less,
    5 AS categories, 5 AS used, 6 AS more FROM customer""",
)
def categories_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reorder_categories, remove_categories, add_categories, remove_unused_categories, as_ordered and as_unordered of the segments."""
    c = table(spark, sf_dir, "customer")
    segments = Categorical.of(c, "c_mktsegment")
    moved = segments.reorder_categories(["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]).as_ordered().as_unordered()
    more = segments.add_categories(["SPACE"])
    used = more.remove_unused_categories(c)
    size = lambda x: F.lit(len(x.categories))
    return c.select("c_custkey", moved.codes().alias("code"), segments.remove_categories(["FURNITURE"]).values().alias("less"), size(segments).alias("categories"), size(used).alias("used"), size(more).alias("more"))


# Arrays


def _prices(spark: SparkSession, sf_dir: str) -> A.Array:
    return A.Array(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x")), ["x"], ["l_orderkey", "l_linenumber"])


@register(
    "array_ufuncs",
    "SELECT l_orderkey, l_linenumber, l_quantity * 3 AS multiply, l_quantity - 3 AS subtract, l_quantity < 25 AS less, l_quantity <= 25 AS less_equal, l_quantity = 25 AS equal, l_quantity <> 25 AS not_equal, (l_quantity < 25) <> (l_quantity <> 10) AS logical_xor, l_quantity < 25 OR l_quantity = 30 AS logical_or, true AS isfinite, l_quantity::BIGINT AS astype FROM lineitem",
)
def array_ufuncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each as a column over the same rows: arithmetic, comparison, logic, kinds."""
    sdf, order = _prices(spark, sf_dir).sdf, ["l_orderkey", "l_linenumber"]
    of = {"multiply": lambda a: A.multiply(a, 3), "subtract": lambda a: A.subtract(a, 3), "less": lambda a: A.less(a, 25), "less_equal": lambda a: A.less_equal(a, 25), "equal": lambda a: A.equal(a, 25), "not_equal": lambda a: A.not_equal(a, 25), "isfinite": A.isfinite, "astype": lambda a: a.astype("bigint")}
    for name, f in of.items():
        sdf = f(A.Array(sdf.withColumn(name, F.col("x")), [name], order)).sdf
    sdf = sdf.withColumns({"logical_xor": F.col("x") < 25, "logical_or": F.col("x") < 25, "ten": F.col("x") != 10, "thirty": F.col("x") == 30})
    for name, f, other in (("logical_xor", A.logical_xor, "ten"), ("logical_or", A.logical_or, "thirty")):
        sdf = f(A.Array(sdf, [name], order), A.Array(sdf, [other], order)).sdf
    return sdf.select(*order, *of, "logical_xor", "logical_or")


@register("array_numbers", "SELECT (SELECT round(exp(sum(ln(1 + l_tax / 1000))), 6) FROM lineitem) AS prod, (SELECT arg_min(event_id, (value, event_id)) FROM events) AS argmin, (SELECT 2 * count(*) FROM supplier)::BIGINT AS raveled")
def array_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = A.Array(table(spark, sf_dir, "lineitem").select("l_orderkey", (1 + F.col("l_tax") / 1000).alias("x")), ["x"], ["l_orderkey"])
    value = A.Array(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], ["event_id"])
    pair = A.Array(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("n")), ["s_acctbal", "n"], ["s_suppkey"])
    return spark.createDataFrame([(round(tax.prod(), 6), value.argmin(), pair.ravel().shape[0])], "prod double, argmin bigint, raveled bigint")


@register("array_odd_values", "SELECT event_id, event_id % 3 = 0 AS inf, event_id % 3 <> 0 AND event_id % 5 = 0 AS nan, event_id % 3 = 0 AND event_id % 2 = 0 AS pos, event_id % 3 = 0 AND event_id % 2 = 1 AS neg FROM events")
def array_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    odd = F.when((k % 3 == 0) & (k % 2 == 0), F.lit(float("inf"))).when(k % 3 == 0, F.lit(float("-inf"))).when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    a = A.Array(table(spark, sf_dir, "events").select("event_id", odd.alias("x")), ["x"], ["event_id"])
    out = None
    for name, f in {"inf": A.isinf, "nan": A.isnan, "pos": A.isposinf, "neg": A.isneginf}.items():
        part = f(a).sdf.select("event_id", F.col("x").alias(name))
        out = part if out is None else out.join(part, "event_id")
    return out


# Sources


@register("io_table_glob", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io_table_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated parts in two folders, read by one pattern."""
    path = folder(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    for k in range(2):
        writers.to_csv(s.filter(F.col("s_suppkey") % 2 == k), f"{path}/part{k}", sep="\t")
    return readers.read_table(spark, f"{path}/part*", schema="s_suppkey bigint, s_name string, s_acctbal double")


@register("io_local_frames", "SELECT 'pandas' AS way, r_regionkey, r_name FROM region UNION ALL SELECT 'arrow', r_regionkey, r_name FROM region UNION ALL SELECT 'interchange', r_regionkey, r_name FROM region")
def io_local_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_pandas, from_arrow and from_dataframe of the five regions, which to_pandas and to_arrow hand out."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    made = {"pandas": readers.from_pandas(spark, writers.to_pandas(region)), "arrow": readers.from_arrow(spark, writers.to_arrow(region)), "interchange": readers.from_dataframe(spark, writers.to_arrow(region))}
    out = None
    for way, df in made.items():
        part = df.select(F.lit(way).alias("way"), F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
        out = part if out is None else out.unionByName(part)
    return out


@register("io_from_map", "SELECT i, i * i AS square FROM range(40) t(i)")
def io_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.from_map(spark, lambda k: pd.DataFrame({"i": range(10 * k, 10 * k + 10), "square": [i * i for i in range(10 * k, 10 * k + 10)]}), range(4), "i bigint, square bigint")


@register("io_html_tables", "SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def io_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of markup for each nation, read again."""
    n = table(spark, sf_dir, "nation")
    page = n.select("n_nationkey", F.format_string("<p>x</p><table><tr><th>name</th><th>region</th></tr><tr><td>%s</td><td>%d</td></tr></table>", "n_name", "n_regionkey").alias("html"))
    rows = readers.read_html(page, "html", ["n_nationkey"]).filter("row = 1")
    return rows.select("n_nationkey", F.element_at("cells", 1).alias("n_name"), F.element_at("cells", 2).alias("n_regionkey"))


@register("io_rendered", "SELECT 5 AS html, 5 AS markdown, 5 AS latex, 5 AS string, 5 AS records, 5 AS dict, 5 AS list")
def io_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings and local copies of the five regions; how many regions each names."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    names = writers.to_list(region, "r_name")
    seen = lambda text: sum(n in text for n in names)
    row = (seen(writers.to_html(region)), seen(writers.to_markdown(region)), seen(writers.to_latex(region)), seen(writers.to_string(region)), len(writers.to_records(region)), seen(str(writers.to_dict(region))), len(names))
    return spark.createDataFrame([row], "html int, markdown int, latex int, string int, records int, dict int, list int")


@register("io_pickle_parts", "SELECT event_id, event_type, value FROM events")
def io_pickle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    writers.to_pickle_parts(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return readers.read_pickle_parts(spark, path, "event_id bigint, event_type string, value double")


# Frames


@register("frame_reflected", "SELECT c_custkey, 5 + c_nationkey AS a, 5 * c_nationkey AS m, 100 // (c_nationkey + 1) AS f, 100 % (c_nationkey + 1) AS d, 2 ** c_nationkey AS p, c_acctbal AS c FROM customer")
def frame_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey").cast("bigint")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.radd(n, 5).alias("a"), E.rmul(n, 5).alias("m"), E.rfloordiv(n + 1, 100).cast("bigint").alias("f"), E.rmod(n + 1, 100).cast("bigint").alias("d"), E.rpow(n, 2).cast("double").alias("p"), E.conj(F.col("c_acctbal")).alias("c")
    )


@register("frame_logic_reflected", "SELECT c_custkey, c_acctbal > 0 AND true AS a, c_acctbal > 0 OR false AS o, (c_acctbal > 0) <> true AS x FROM customer")
def frame_logic_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frame(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    s = f["c_acctbal"] > 0
    return f.assign(a=operator.and_(True, s), o=operator.or_(False, s), x=operator.xor(True, s)).spark().select("c_custkey", "a", "o", "x")


@register("frame_columns", "SELECT n_nationkey, n_name, n_regionkey AS popped FROM nation")
def frame_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get, pop and convert_dtypes; a column that is not there gives the default."""
    f = Frame(table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string")), "n_nationkey")
    got = f.get("n_regionkey"), f.get("n_missing", "none")
    if got[1] != "none":
        raise ValueError("a missing column must give the default")
    popped, rest = f.pop("n_regionkey")
    typed = popped.to_frame("popped").convert_dtypes().infer_objects().spark()
    return rest.spark().join(typed, "n_nationkey").select("n_nationkey", "n_name", F.col("popped").cast("int").alias("popped"))


@register("frame_levels", "SELECT l_linenumber, l_orderkey, l_quantity FROM lineitem")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """swaplevel, reorder_levels and droplevel of a two-level index, then sort_index."""
    f = Frame(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])
    swapped = f.swaplevel().reorder_levels(["l_orderkey", "l_linenumber"]).swaplevel()
    if list(swapped.index) != ["l_linenumber", "l_orderkey"] or list(f.droplevel("l_linenumber").index) != ["l_orderkey"]:
        raise ValueError("levels are not where they should be")
    return swapped.sort_index().spark()


@register("frame_take", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i IN (0, 5, 17)")
def frame_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selecting.take(table(spark, sf_dir, "events").select("event_id", "value"), [0, 5, 17], ["event_id"])


@register("frame_map", "SELECT s_suppkey, round(s_acctbal * 2, 2) AS s_acctbal, CASE s_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS named FROM supplier")
def frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of each value, by applymap; map of a column by a dictionary, values without an entry missing."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    f = Frame(s, "s_suppkey")
    doubled = udfs.applymap(s, lambda x: round(x * 2, 2), ["s_acctbal"], "double").select("s_suppkey", "s_acctbal")
    named = f.assign(named=f["s_nationkey"].map({1: "one", 2: "two"})).spark().select("s_suppkey", "named")
    return doubled.join(named, "s_suppkey")


@register("frame_apply_specs", "SELECT round(sum(l_quantity), 2) AS total, min(l_tax) AS low, max(l_tax) AS high FROM lineitem")
def frame_apply_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apply by a dictionary of names: one row for each aggregate."""
    f = Frame(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"))
    out = f.apply({"l_quantity": ["sum"], "l_tax": ["min", "max"]}).spark()
    key = out.columns[0]
    pick = lambda how, c: F.max(F.when(F.col(key) == how, F.col(c)))
    return out.agg(r(pick("sum", "l_quantity"), 2).alias("total"), pick("min", "l_tax").alias("low"), pick("max", "l_tax").alias("high"))


@register("frame_batches", "SELECT (SELECT count(*) FROM supplier)::BIGINT AS rows, (SELECT round(sum(s_acctbal), 2) FROM supplier) AS total, (SELECT count(*) FROM supplier)::BIGINT AS dealt, 'n' AS extension")
def frame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches for a local consumer, the rows of each partition, and a user's own function under a name."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    parts = list(udfs.batches(s, 64))
    udfs.register_extension("name_of_query")(lambda df: "n")
    return spark.createDataFrame([(sum(map(len, parts)), round(float(sum(p["s_acctbal"].sum() for p in parts)), 2), udfs.partitions(s).agg(F.sum("rows")).first()[0], udfs.extension("name_of_query")(s))], "rows bigint, total double, dealt bigint, extension string")


@register("sort_columns_by_row", "SELECT 'c,a,b' AS ordered")
def sort_columns_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in the order of their values in one row."""
    li = table(spark, sf_dir, "lineitem").agg(F.max("l_quantity").alias("a"), (F.max("l_quantity") + 5).alias("b"), F.min("l_tax").alias("c"))
    return spark.createDataFrame([(",".join(sorting.sort_columns(li, F.lit(True)).columns),)], "ordered string")


# Groups, windows, time bins


@register("groupby_products", "SELECT l_returnflag, round(exp(sum(ln(1 + l_tax / 1000))), 6) AS x, 'x' AS rest, round(corr(l_quantity, l_extendedprice), 6) AS q FROM lineitem GROUP BY l_returnflag")
def groupby_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groupby.prod, dtypes, pipe and corrwith."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (1 + F.col("l_tax") / 1000).alias("x"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    g = Groups(li.select("l_returnflag", "x"), ["l_returnflag"])
    products = g.pipe(lambda groups: groups.agg(x=("x", "prod")))
    rest = ",".join(n for n, _ in g.dtypes())
    return rounded(products.join(Groups(li, ["l_returnflag"]).corrwith(["q"], "p"), "l_returnflag"), "x", "q").withColumn("rest", F.lit(rest))


@register(
    "groupby_extremes",
    "SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER hi <= 3 AS top, row_number() OVER lo <= 2 AS low, row_number() OVER k = 2 AS second FROM orders WINDOW hi AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey), lo AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), k AS (PARTITION BY o_orderstatus ORDER BY o_orderkey) QUALIFY row_number() OVER hi <= 3 OR row_number() OVER lo <= 2 OR row_number() OVER k = 2",
)
def groupby_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nlargest, nsmallest and take (one place) of groups."""
    g = Groups(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], ["o_orderkey"])
    parts = [df.select("*", F.lit(n).alias("n")) for n, df in (("top", g.nlargest("o_totalprice", 3)), ("low", g.nsmallest("o_totalprice", 2)), ("second", g.take(1)))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("o_orderstatus", "o_orderkey", "o_totalprice").agg(*[F.bool_or(F.col("n") == n).alias(n) for n in ("top", "low", "second")])


@register("groupby_series_unique", "SELECT n_regionkey, list_sort(list(DISTINCT substr(n_name, 1, 1)))::VARCHAR AS firsts FROM nation GROUP BY n_regionkey")
def groupby_series_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "nation").select("n_regionkey", F.substring("n_name", 1, 1).alias("x")), ["n_regionkey"])
    out = g.agg(x=("x", "unique"))
    return out.select("n_regionkey", F.format_string("[%s]", F.array_join(F.sort_array("x"), ", ")).alias("firsts"))


@register(
    "groupby_ordered",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT a.event_id, round(sum(b.value), 2) AS total, round(sum(b.value * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)), 5) AS smooth FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY ALL",
)
def groupby_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expanding and ewm inside groups."""
    g = Groups(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"])
    totals = g.expanding({"total": ("sum", "value")}).select("event_id", "total")
    smooth = g.ewm("value", "smooth", alpha=0.3).select("event_id", "smooth")
    return rounded(rounded(totals.join(smooth, "event_id"), "total", digits=2), "smooth", digits=5)


@register("groupby_resample", "SELECT event_type, date_trunc('day', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def groupby_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Groups(table(spark, sf_dir, "events").select("event_type", "ts", "value"), ["event_type"])
    return rounded(g.resample("1D", "ts", {"value": ("value", "sum")}, empty=False), "value", digits=2)


@register("resample_prod_pipe", "SELECT date_trunc('day', ts) AS ts, round(exp(sum(ln(1 + value / 1e6))), 6) AS value FROM events GROUP BY ALL")
def resample_prod_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", (1 + F.col("value") / 1e6).alias("value"))
    f = Frame(resample(e, "1D", "ts", {"value": ("value", "prod")}, empty=False), "ts")
    return rounded(f.pipe(lambda x: x.spark()), "value")


@register(
    "windows_aggregate",
    "SELECT event_id, CASE WHEN i >= 4 THEN round(sum(value) OVER w, 2) END AS roll_sum, CASE WHEN i >= 4 THEN max(value) OVER w END AS roll_max, round(sum(value) OVER o, 2) AS grow_sum, min(value) OVER o AS grow_min FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) WINDOW w AS (ORDER BY event_id ROWS 3 PRECEDING), o AS (ORDER BY event_id)",
)
def windows_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several aggregates of one sliding and one growing window."""
    f = Frame(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    part = lambda w, how, name: w.agg(how).spark().select("event_id", F.col("value").alias(name))
    parts = [part(f.rolling(4), "sum", "roll_sum"), part(f.rolling(4), "max", "roll_max"), part(f.expanding(), "sum", "grow_sum"), part(f.expanding(), "min", "grow_min")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "event_id")
    return rounded(out, "roll_sum", "grow_sum", digits=2)


@register("frame_asof", "WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), w AS (SELECT make_timestamp(lo + n * (hi - lo) // 10) AS moment FROM b, range(1, 10) t(n)) SELECT moment, (SELECT arg_max(value, (ts, event_id)) FROM events WHERE ts <= moment) AS value FROM w")
def frame_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row at or before each of nine moments."""
    e = events(spark, sf_dir).select("event_id", "ts", "value")
    low, high = e.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    at = spark.createDataFrame([(low + n * (high - low) // 10,) for n in range(1, 10)], "us bigint").select(D.from_micros(F.col("us")).cast("timestamp_ntz").alias("at"))
    f = Frame(e, "event_id", ["ts", "event_id"])
    out = f.asof(Frame(at.withColumnRenamed("at", "ts")), "ts").spark()
    return out.select(F.col("ts").alias("moment"), "value")
