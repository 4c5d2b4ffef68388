"""Element-wise arithmetic, comparison, mathematics, text, dates, lists, structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import dates as D
from lumenframe.functions import elementwise as E
from lumenframe.functions import nested as N
from lumenframe.functions import strings as T
from lumenframe.operators import udfs
from lumenframe.queries.registry import EVENTS, events, r, register, table
from lumenframe.sources.readers import json_normalize


@register(
    "arithmetic",
    f"WITH {EVENTS} SELECT event_id, round(v + user_id, 6) AS add, round(v - user_id, 6) AS sub, round(v * user_id, 6) AS mul, round(pow(v, 2), 4) AS pow, round(user_id - v, 6) AS rsub, round(coalesce(v, 0) + user_id, 6) AS filled, -v AS neg, abs(v - 20) AS abs FROM e",
)
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("v"), F.col("user_id")
    return events(spark, sf_dir).select("event_id", r(E.add(v, u)).alias("add"), r(E.sub(v, u)).alias("sub"), r(E.mul(v, u)).alias("mul"), r(E.power(v, 2), 4).alias("pow"), r(E.rsub(v, u)).alias("rsub"), r(E.add(v, u, 0)).alias("filled"), E.negative(v).alias("neg"), E.absolute(v - 20).alias("abs"))


@register(
    "division",
    """SELECT event_id, CASE WHEN d <> 0 THEN round(n / d, 6) WHEN n > 0 THEN 'inf'::DOUBLE WHEN n < 0 THEN '-inf'::DOUBLE END AS truediv, CASE WHEN d <> 0 THEN floor(n / d) WHEN n > 0 THEN 'inf'::DOUBLE WHEN n < 0 THEN '-inf'::DOUBLE END AS floordiv,
    CASE WHEN d <> 0 THEN n - d * floor(n / d)::BIGINT END AS mod, CASE WHEN n <> 0 THEN round(d / n, 6) WHEN d > 0 THEN 'inf'::DOUBLE WHEN d < 0 THEN '-inf'::DOUBLE END AS rdiv FROM (SELECT event_id, event_id % 11 - 5 AS n, user_id % 7 - 3 AS d FROM events)""",
)
def division(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 11 - 5).alias("n"), (F.col("user_id") % 7 - 3).alias("d"))
    n, d = F.col("n"), F.col("d")
    whole, rest = E.divmod_(n, d)
    return e.select("event_id", r(E.truediv(n, d)).alias("truediv"), whole.alias("floordiv"), rest.alias("mod"), r(E.rtruediv(n, d)).alias("rdiv"))


@register("comparison", f"WITH {EVENTS} SELECT event_id, coalesce(v = 10, false) AS eq, coalesce(v <> 10, true) AS ne, coalesce(v < 10, false) AS lt, coalesce(v <= 10, false) AS le, coalesce(v > 10, false) AS gt, coalesce(v >= 10, false) AS ge, v IS NOT DISTINCT FROM NULL AS eq_missing FROM e")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return events(spark, sf_dir).select("event_id", *[getattr(E, k)(v, 10).alias(k) for k in ("eq", "ne", "lt", "le", "gt", "ge")], E.eq_missing(v, None).alias("eq_missing"))


@register("logic_bits", "SELECT event_id, (event_id % 2 = 0) AND (user_id % 3 = 0) AS a, (event_id % 2 = 0) OR (user_id % 3 = 0) AS o, (event_id % 2 = 0) <> (user_id % 3 = 0) AS x, NOT (event_id % 2 = 0) AS n, event_id & 12 AS ba, event_id | 12 AS bo, xor(event_id, 12) AS bx, ~event_id AS bn FROM events")
def logic_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    p, q = k % 2 == 0, F.col("user_id") % 3 == 0
    twelve = F.lit(12).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", E.logical_and(p, q).alias("a"), E.logical_or(p, q).alias("o"), E.logical_xor(p, q).alias("x"), E.logical_not(p).alias("n"), E.bit_and(k, twelve).alias("ba"), E.bit_or(k, twelve).alias("bo"), E.bit_xor(k, twelve).alias("bx"), E.invert_bits(k).alias("bn"))


@register(
    "mathematics",
    """SELECT event_id, round(sqrt(x), 6) AS sqrt, round(exp(x / 100), 6) AS exp, round(ln(x + 1), 6) AS log1p, round(log10(x + 1), 6) AS log10, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos, round(tan(x / 1000), 6) AS tan, round(asin(x / 1000), 6) AS arcsin, round(acos(x / 1000), 6) AS arccos, round(atan(x), 6) AS arctan,
    round(sinh(x / 100), 6) AS sinh, round(cosh(x / 100), 6) AS cosh, round(tanh(x / 100), 6) AS tanh, round(asinh(x), 6) AS arcsinh, round(acosh(x + 1), 6) AS arccosh, round(atanh(x / 1000), 6) AS arctanh, round(cbrt(x), 6) AS cbrt, sign(x - 10)::DOUBLE AS sign, ceil(x) AS ceil, floor(x) AS floor, round(cot(x + 0.5), 5) AS cot FROM (SELECT event_id, value AS x FROM events)""",
)
def mathematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    made = {
        "sqrt": E.sqrt(x), "exp": E.exp(x / 100), "log1p": E.log1p(x), "log10": E.log10(x + 1), "sin": E.sin(x), "cos": E.cos(x), "tan": E.tan(x / 1000), "arcsin": E.arcsin(x / 1000), "arccos": E.arccos(x / 1000), "arctan": E.arctan(x), "sinh": E.sinh(x / 100),
        "cosh": E.cosh(x / 100), "tanh": E.tanh(x / 100), "arcsinh": E.arcsinh(x), "arccosh": E.arccosh(x + 1), "arctanh": E.arctanh(x / 1000), "cbrt": E.cbrt(x),
    }
    return table(spark, sf_dir, "events").select("event_id", *[r(c).alias(n) for n, c in made.items()], E.sign(x - 10).alias("sign"), E.ceil(x).alias("ceil"), E.floor(x).alias("floor"), r(E.cot(x + 0.5), 5).alias("cot"))


@register("rounding", "SELECT event_id, round_even(event_id / 2, 0) AS half, round_even(event_id * 125 / 1000, 2) AS two, round_even(event_id::BIGINT, -1)::BIGINT AS tens FROM events")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", E.round_(k / 2).alias("half"), E.round_(k * 125 / 1000, 2).alias("two"), E.round_(k, -1).alias("tens"))


@register("clip_replace", f"WITH {EVENTS} SELECT event_id, CASE WHEN v IS NOT NULL THEN least(greatest(v, 5), 20) END AS clipped, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'e' ELSE event_type END AS replaced, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS mapped, regexp_replace(event_type, '[aeiou]', '_', 'g') AS pattern FROM e")
def clip_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return events(spark, sf_dir).select("event_id", E.clip(F.col("v"), 5.0, 20.0).alias("clipped"), E.replace(t, {"click": "c", "error": "e"}).alias("replaced"), E.map_values(t, {"click": 1, "view": 2}).alias("mapped"), E.replace_regex(t, "[aeiou]", "_").alias("pattern"))


@register("missing_tests", f"WITH {EVENTS} SELECT event_id, v IS NULL AS isna, v IS NOT NULL AS notna, coalesce(v, -1.0) AS filled, v IS NOT NULL AS finite, false AS inf FROM e")
def missing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return events(spark, sf_dir).select("event_id", E.isna(v).alias("isna"), E.notna(v).alias("notna"), E.fillna(v, -1.0).alias("filled"), E.isfinite(v).alias("finite"), E.isinf(v).alias("inf"))


@register("infinities", "SELECT event_id, event_id % 3 = 0 AS pos, event_id % 3 = 1 AS neg, event_id % 3 < 2 AS inf, event_id % 3 = 2 AS finite FROM events")
def infinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    x = F.when(k % 3 == 0, F.lit(float("inf"))).when(k % 3 == 1, F.lit(float("-inf"))).otherwise(F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", E.isposinf(x).alias("pos"), E.isneginf(x).alias("neg"), E.isinf(x).alias("inf"), E.isfinite(x).alias("finite"))


@register("horizontal", f"WITH {EVENTS} SELECT event_id, greatest(v, value, user_id) AS hi, least(v, value, user_id) AS lo, round(coalesce(v, 0) + value + user_id, 6) AS s, round((coalesce(v, 0) + value + user_id) / (2 + (v IS NOT NULL)::INT), 6) AS m, 2 + (v IS NOT NULL)::BIGINT AS n FROM e")
def horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("v"), F.col("value"), F.col("user_id").cast("double")]
    return events(spark, sf_dir).select("event_id", E.horizontal(cols, "max").alias("hi"), E.horizontal(cols, "min").alias("lo"), r(E.horizontal(cols, "sum")).alias("s"), r(E.horizontal(cols, "mean")).alias("m"), E.horizontal(cols, "count").alias("n"))


@register("significant_figures", "SELECT p_partkey, round_even(p_retailprice / pow(10, floor(log10(p_retailprice)) - 1), 0) * pow(10, floor(log10(p_retailprice)) - 1) AS two FROM part")
def significant_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", E.round_sig_figs(F.col("p_retailprice"), 2).alias("two"))


# Text


@register(
    "str_case",
    "SELECT doc_id, lower(t) AS lower, upper(t) AS upper, upper(t[1]) || lower(t[2:]) AS capitalize, length(t) AS len, reverse(t) AS reversed FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM documents)",
)
def str_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z ]", "").alias("t"))
    t = F.col("t")
    return d.select("doc_id", T.lower(t).alias("lower"), T.upper(t).alias("upper"), T.capitalize(t).alias("capitalize"), T.length(t).cast("bigint").alias("len"), T.slice_(t, None, None, -1).alias("reversed"))


#: Without SQL: DuckDB has no upper case of ß. tests/test_operators.py holds it against Python.
@register("str_case_whole")
def str_case_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.lower(t).alias("lower"), T.upper(t).alias("upper"), T.capitalize(t).alias("capitalize"), T.length(t).cast("bigint").alias("len"), T.slice_(t, None, None, -1).alias("reversed"))


@register("str_title_swapcase", "SELECT p_partkey, list_aggregate([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], 'string_agg', ' ') AS title, upper(p_name) AS swapped FROM part")
def str_title_swapcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title(F.col("p_name")).alias("title"), T.swapcase(F.col("p_name")).alias("swapped"))


@register(
    "str_search",
    "SELECT doc_id, contains(text, 'the ') AS plain, regexp_matches(text, '[0-9]{3,}') AS pattern, starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends, len(regexp_extract_all(text, 'an'))::BIGINT AS n, strpos(text, 'an')::BIGINT - 1 AS find, regexp_matches(text, '^[A-Z][a-z]+ ') AS match, regexp_full_match(text, '[A-Za-z ]+') AS fullmatch FROM documents",
)
def str_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.contains(t, "the ", False).alias("plain"), T.contains(t, "[0-9]{3,}").alias("pattern"), T.startswith(t, "T").alias("starts"), T.endswith(t, ".").alias("ends"), T.count(t, "an").cast("bigint").alias("n"), T.find(t, "an").cast("bigint").alias("find"),
        T.match(t, "[A-Z][a-z]+ ").alias("match"), T.fullmatch(t, "[A-Za-z ]+").alias("fullmatch"),
    )


@register("str_fullmatch_whole", "SELECT doc_id, regexp_full_match(text, '[A-Za-z ]+') AS letters, regexp_full_match(text, '[^0-9]+') AS no_digit FROM documents")
def str_fullmatch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.fullmatch(t, "[A-Za-z ]+").alias("letters"), T.fullmatch(t, "[^0-9]+").alias("no_digit"))


@register("str_rfind_get", "SELECT p_partkey, length(p_name) - strpos(reverse(p_name), 'e') - (strpos(reverse(p_name), 'e') = 0)::INT * (length(p_name) + 1) AS rfind, nullif(p_name[3], '') AS third, p_name[-2] AS last_but_one FROM part")
def str_rfind_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.rfind(n, "e").cast("bigint").alias("rfind"), T.get(n, 2).alias("third"), T.get(n, -2).alias("last_but_one"))


@register("str_slices", "SELECT p_partkey, p_name[3:6] AS mid, p_name[-4:] AS tail, p_name[:2] || 'XX' || p_name[5:] AS replaced FROM part")
def str_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.slice_(n, 2, 6).alias("mid"), T.slice_(n, -4).alias("tail"), T.slice_replace(n, 2, 4, "XX").alias("replaced"))


@register("str_strip_pad", "SELECT p_partkey, trim(s) AS strip, ltrim(s) AS lstrip, rtrim(s) AS rstrip, rpad(p_type, greatest(12, length(p_type))::INT, '.') AS ljust, lpad(p_type, greatest(12, length(p_type))::INT, '.') AS rjust, lpad(p_size::VARCHAR, 5, '0') AS zfill, repeat(p_type, 2) AS twice FROM (SELECT *, '  ' || p_type || ' ' AS s FROM part)")
def str_strip_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    s = F.concat(F.lit("  "), t, F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip(s).alias("strip"), T.lstrip(s).alias("lstrip"), T.rstrip(s).alias("rstrip"), T.ljust(t, 12, ".").alias("ljust"), T.rjust(t, 12, ".").alias("rjust"), T.zfill(F.col("p_size").cast("string"), 5).alias("zfill"), T.repeat(t, 2).alias("twice"))


@register("str_affixes", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#') THEN p_brand[7:] ELSE p_brand END AS no, CASE WHEN ends_with(p_type, 'Y') THEN p_type[:-2] ELSE p_type END AS cut, replace(p_brand, '#', '-') AS dashed, translate(p_brand, 'Bra', 'b') AS translated FROM part")
def str_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.removeprefix(b, "Brand#").alias("no"), T.removesuffix(F.col("p_type"), "Y").alias("cut"), T.replace(b, "#", "-").alias("dashed"), T.translate(b, {"B": "b", "r": None, "a": None}).alias("translated"))


@register("str_split", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, len(string_split(p_name, ' '))::BIGINT AS n, array_to_string(string_split(p_name, ' '), '+') AS joined FROM part")
def str_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.split(F.col("p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", N.get(parts, 0).alias("first"), N.get(parts, -1).alias("last"), N.list_len(parts).cast("bigint").alias("n"), T.join(parts, "+").alias("joined"))


@register("str_partition", "SELECT c_custkey, string_split(c_name, '#')[1] AS head, '#' AS sep, string_split(c_name, '#')[2] AS tail FROM customer")
def str_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.partition(F.col("c_name"), "#")
    return table(spark, sf_dir, "customer").select("c_custkey", p[0].alias("head"), p[1].alias("sep"), p[2].alias("tail"))


@register("str_rsplit_rpartition", "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS front, regexp_extract(url, '/([^/]*)$', 1) AS back, string_split(url, '/')[-1] AS last FROM pages")
def str_rsplit_rpartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p, s = T.rpartition(u, "/"), T.rsplit(u, "/", 1)
    return table(spark, sf_dir, "pages").select("page_id", p[0].alias("front"), p[2].alias("back"), s[1].alias("last"))


@register("str_extract", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host, CASE WHEN regexp_matches(url, '[?&]page=([0-9]+)') THEN regexp_extract(url, '[?&]page=([0-9]+)', 1) END AS page, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers FROM pages")
def str_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.extract(u, "^https?://([^/]+)/").alias("host"), T.extract(u, "[?&]page=([0-9]+)").alias("page"), T.join(T.findall(u, "[0-9]+"), ",").alias("numbers"))


@register("str_cat_dummies", "SELECT p_partkey, p_brand || '/' || p_type AS both, list_contains(string_split(p_name, ' '), 'red')::BIGINT AS red, list_contains(string_split(p_name, ' '), 'small')::BIGINT AS small FROM part")
def str_cat_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.cat([F.col("p_brand"), F.col("p_type")], "/").alias("both"), *T.get_dummies(F.col("p_name"), " ", ["red", "small"]))


@register("str_tests", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9]+') AS alnum, regexp_full_match(p_type, '[A-Za-z]+') AS alpha, regexp_full_match(p_size::VARCHAR, '[0-9]+') AS digit, p_name = lower(p_name) AS lower, p_type = upper(p_type) AS upper, false AS space, p_brand[1] = upper(p_brand[1]) AS title FROM part")
def str_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t, n, z = F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", T.isalnum(b).alias("alnum"), T.isalpha(t).alias("alpha"), T.isdigit(z).alias("digit"), T.islower(n).alias("lower"), T.isupper(t).alias("upper"), T.isspace(b).alias("space"), T.istitle(b).alias("title"))


@register("str_encode", "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, md5(text) AS md5 FROM documents")
def str_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.encode(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(b).cast("bigint").alias("bytes"), F.md5(T.encode(T.decode(b))).alias("md5"))


@register("str_normalize", "SELECT doc_id, nfc_normalize(text) = text AS same FROM documents")
def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (T.normalize(F.col("text")) == F.col("text")).alias("same"))


# Dates


@register(
    "dt_parts",
    "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, (epoch_us(ts) % 1000000)::INT AS us, quarter(ts)::INT AS q, dayofyear(ts)::INT AS doy, (isodow(ts) - 1)::INT AS wd, ts::DATE AS date FROM events",
)
def dt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    made = {"y": D.year(t), "mo": D.month(t), "d": D.day(t), "h": D.hour(t), "mi": D.minute(t), "s": D.second(t), "us": D.microsecond(t), "q": D.quarter(t), "doy": D.dayofyear(t), "wd": D.dayofweek(t), "date": D.date(t)}
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


@register(
    "dt_flags",
    """SELECT o_orderkey, day(d) = 1 AS ms, d = last_day(d) AS me, day(d) = 1 AND month(d) % 3 = 1 AS qs, d = last_day(d) AND month(d) % 3 = 0 AS qe, dayofyear(d) = 1 AS ys, month(d) = 12 AND day(d) = 31 AS ye, day(last_day(d))::INT AS dim, (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS leap
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
)
def dt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    made = {"ms": D.is_month_start(d), "me": D.is_month_end(d), "qs": D.is_quarter_start(d), "qe": D.is_quarter_end(d), "ys": D.is_year_start(d), "ye": D.is_year_end(d), "dim": D.days_in_month(d), "leap": D.is_leap_year(d)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in made.items()])


@register("dt_names_format", "SELECT o_orderkey, monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name, strftime(o_orderdate, '%Y/%m/%d at %H:%M') AS shown FROM orders")
def dt_names_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.month_name(d).alias("month_name"), D.day_name(d).alias("day_name"), D.strftime(d, "%Y/%m/%d at %H:%M").alias("shown"))


@register(
    "dt_rounding",
    "SELECT event_id, date_trunc('hour', ts) AS floor, CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ceil, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS near, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter, date_trunc('day', ts)::TIMESTAMP AS normal FROM events",
)
def dt_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", D.floor(t, "h").alias("floor"), D.ceil(t, "h").alias("ceil"), D.round_(t, "h").alias("near"), D.floor(t, "min", 15).alias("quarter"), D.normalize(t).alias("normal"))


@register("dt_isocalendar", "SELECT o_orderkey, isoyear(o_orderdate)::INT AS y, week(o_orderdate)::INT AS w, isodow(o_orderdate)::INT AS d FROM orders")
def dt_isocalendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w, d = D.isocalendar(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", y.cast("int").alias("y"), w.alias("w"), d.alias("d"))


@register("dt_periods", "SELECT o_orderkey, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end, last_day(o_orderdate)::TIMESTAMP AS last_day FROM orders")
def dt_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.to_period(d, "Q").alias("q"), D.end_time(d, "M").alias("month_end"), D.asfreq(d, "D", "E", "M").alias("last_day"))


@register("dt_zones", "SELECT event_id, ts + INTERVAL 9 HOUR AS tokyo, ts - INTERVAL 9 HOUR AS utc FROM events")
def dt_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", D.tz_convert(t, "Asia/Tokyo").alias("tokyo"), D.tz_localize(t, "Asia/Tokyo").alias("utc"))


@register("dt_durations", "SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS days, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 86400000000 // 1000000 AS secs, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 % 24 AS hours FROM events")
def dt_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("ts") - F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", D.interval_micros(gap).alias("us"), D.days(gap).alias("days"), D.seconds(gap).cast("bigint").alias("secs"), D.components(gap)["hours"].alias("hours"))


# Lists, structs, JSON


@register("list_access", "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, len(embedding[2:5])::BIGINT AS n FROM embeddings")
def list_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", N.get(e, 0).cast("double").alias("first"), N.get(e, -1).cast("double").alias("last"), F.size(N.slice_(e, 1, 5)).cast("bigint").alias("n"))


@register("struct_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", N.field(N.parsed(F.col("props"), "k bigint"), "k").alias("k"))


@register("json_normalize", "SELECT event_id AS \"event.id\", (props->>'$.k')::BIGINT AS \"event.props.k\" FROM events")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.struct(F.col("event_id").alias("id"), N.parsed(F.col("props"), "k bigint").alias("props")).alias("event"))
    return json_normalize(e)


# Python functions


@register("udf_elements", "SELECT p_partkey, length(p_name)::BIGINT * 2 AS n, round(p_retailprice * 1.5, 4) AS price FROM part")
def udf_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", udfs.map_elements(F.col("p_name"), lambda s: len(s) * 2, "bigint").alias("n"), r(udfs.map_series(F.col("p_retailprice"), lambda s: s * 1.5, "double"), 4).alias("price"))


@register("udf_rows", "SELECT n_nationkey AS k, n_name || ':' || n_regionkey::VARCHAR AS label FROM nation")
def udf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.apply_rows(table(spark, sf_dir, "nation"), lambda row: {"k": row["n_nationkey"], "label": f"{row['n_name']}:{row['n_regionkey']}"}, "k int, label string")


@register("udf_pipeline", "SELECT copy, count(*) AS n, round(sum(value * (copy + 1)), 2) AS total FROM events, range(3) t(copy) WHERE value > 10 GROUP BY copy")
def udf_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[pdf["value"] > 10]

    def scaled(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
        return pdf.assign(value=pdf["value"] * (k + 1))

    line = udfs.Pipeline(table(spark, sf_dir, "events").select("event_id", "value"))
    line.stage(keep, "event_id bigint, value double").fan_out(scaled, 3, "event_id bigint, value double, copy int")
    return line.reduce_by(["copy"], n=F.count("*"), total=r(F.sum("value"), 2)).compute()["result"].withColumn("copy", F.col("copy").cast("bigint"))
