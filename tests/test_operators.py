"""Operators at their edges: empty tables, ties, missing keys, bounds, plans, files and streams."""

from __future__ import annotations

import datetime
import sqlite3

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe import arrays as A
from lumenframe.columnar import Table
from lumenframe.functions import dates, elementwise, strings
from lumenframe.functions.categories import Categorical
from lumenframe.operators import aggregating, joining, resampling, reshaping, selecting, sorting, udfs, windowing
from lumenframe.operators.grouping import Groups
from lumenframe.plans import expressions, inspection, ordering
from lumenframe.sources import readers, writers
from lumenframe.streaming import windows as W


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(5000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(50))).alias("v"), F.when(F.col("id") % 9 != 4, F.col("id") * 0.5).alias("x")).repartition(6)


def test_positions_are_dense(numbers):
    got = ordering.positions(numbers, ["v", "id"]).orderBy("v", "id").select("__pos").collect()
    assert [r[0] for r in got] == list(range(5000))


def test_sliding_blocks_agree_with_one_window(numbers):
    out = ordering.sliding(numbers, ["id"], {"s": lambda w: F.sum("v").over(w.rowsBetween(-4, 2))}, 4, 2, block=97)
    got = {r.id: r.s for r in out.collect()}
    v = [r.v for r in numbers.orderBy("id").collect()]
    assert got == {i: sum(v[max(0, i - 4) : i + 3]) for i in range(5000)}


def test_scan_agrees_with_one_window(numbers):
    out = ordering.scan(numbers, ["id"], {"s": ("sum", F.col("v")), "l": ("last", F.col("x")), "n": ("count", F.col("x"))}).orderBy("id").collect()
    total, last, n = 0, None, 0
    for r in out:
        total += r.v
        last = r.x if r.x is not None else last
        n += r.x is not None
        assert (r.s, r.l, r.n) == (total, last, n)


def test_sampled_ranges(spark, monkeypatch):
    """Over a plain scan ranges come from a sample; positions and totals are the same as over checkpointed ones."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 300)
    df = spark.range(4000).select(F.when(F.col("id") % 10 != 3, F.pmod(F.xxhash64("id"), F.lit(700))).alias("k"), F.col("id").alias("i"))
    assert ordering._plain_scan(df) and ordering.ranged(df, ["k", "i"]).select("__range").distinct().count() > 3
    rows = sorted(df.collect(), key=lambda r: (r.k is None, r.k or 0, r.i))
    got = ordering.positions(df, ["k", "i"]).orderBy("__pos").collect()
    assert [(r.k, r.i, r["__pos"]) for r in got] == [(r.k, r.i, n) for n, r in enumerate(rows)]
    run = {r.i: r.s for r in ordering.scan(df, ["k", "i"], {"s": ("sum", F.col("i"))}).collect()}
    total = 0
    for r in rows:
        total += r.i
        assert run[r.i] == total


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(3)
    v = pd.Series(np.where(rng.random(700) < 0.1, np.nan, rng.integers(0, 90, 700)))
    df = readers.from_pandas(spark, pd.DataFrame({"v": v}))
    for how in ("linear", "lower", "higher", "midpoint", "nearest"):
        want = [v.quantile(q, how) for q in (0, 0.13, 0.5, 0.77, 1)]
        assert aggregating.ranked_quantiles(df, "v", (0, 0.13, 0.5, 0.77, 1), how) == pytest.approx(want), how
    assert aggregating.quantiles(df, ["v"], [0.13])["v"] == pytest.approx([v.quantile(0.13)])
    assert aggregating.ranked_quantiles(df.limit(0), "v", [0.5]) == [None] and aggregating.quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


def test_exponential_weights_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(1500).select("id", F.when(F.col("id") % 11 != 2, F.pmod(F.xxhash64("id"), F.lit(70)).cast("double")).alias("v"))
    got = [r.m for r in windowing.ewm(df, ["id"], "v", "m", halflife=20).orderBy("id").collect()]
    want = pd.Series([r.v for r in df.orderBy("id").collect()], dtype=float).ewm(halflife=20).mean()
    assert got == pytest.approx(want.tolist())


def test_no_window_gathers_the_table(numbers):
    """Global windows run over ranges or blocks, so no exchange goes to one partition but for rows of totals."""
    out = ordering.sliding(numbers, ["id"], {"s": lambda w: F.lag("v").over(w)}, 1, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    above = [k for k, x in enumerate(lines) if "SinglePartition" in x]
    assert all("HashAggregate(keys=[__range" in lines[k + 1] for k in above)


def test_filters_and_columns_reach_the_scan(spark, sf):
    found = inspection.report(expressions.query(readers.read_parquet(spark, f"{sf}/lineitem.parquet"), "l_quantity > 45").select("l_orderkey"))
    assert set(found.read_columns) == {"l_orderkey", "l_quantity"} and found.exchanges == 0 and found.python == 0
    native = inspection.report(readers.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45))
    assert any("GreaterThan(l_quantity,45" in p for p in native.pushed)


def test_merge_asof_ties_and_order(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "i int, t int")
    right = spark.createDataFrame([(10, "a"), (15, "b"), (30, "c")], "t int, r string")
    asof = lambda **k: {r.i: r.r for r in joining.merge_asof(left, right, on="t", **k).collect()}
    frames = pd.DataFrame({"i": [3, 1, 2], "t": [5, 10, 20]}), pd.DataFrame({"t": [10, 15, 30], "r": list("abc")})
    assert asof() == {1: "a", 2: "b", 3: None} and asof(allow_exact_matches=False) == {1: None, 2: "b", 3: None}
    assert asof(direction="forward") == {1: "a", 2: "c", 3: "a"}
    near = pd.merge_asof(*frames, on="t", direction="nearest")
    assert near["r"].tolist() == [joined for _, joined in sorted(asof_cast(spark, left, right).items(), key=lambda x: {3: 0, 1: 1, 2: 2}[x[0]])]


def asof_cast(spark, left, right):
    ts = lambda d: d.withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))
    return {r.i: r.r for r in joining.merge_asof(ts(left), ts(right), on="t", direction="nearest").collect()}


def test_pivot_refuses_two_rows_for_a_cell(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k int, c string, v int")
    with pytest.raises(Exception, match="duplicate entries"):
        reshaping.pivot(df, "k", "c", "v").collect()


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k bigint, g string, v double, t timestamp_ntz")
    assert windowing.rolling(e, ["k"], 3, {"m": ("mean", "v")}).count() == 0
    assert windowing.rank(e, "v").count() == 0 and windowing.fill(e, ["k"], ["v"], "bfill").count() == 0
    assert resampling.resample(e, "1h", "t", {"s": ("v", "sum")}).count() == 0
    assert Groups(e, "g", ["k"]).agg(s=("v", "sum"), f=("v", "first")).count() == 0
    assert joining.merge_asof(e, e.select("k", F.col("v").alias("w")), on="k").count() == 0
    assert reshaping.value_counts(e, "g").count() == 0 and reshaping.get_dummies(e, "g").columns == ["k", "v", "t"]
    assert sorting.nlargest(e, 3, "v", keep="all").count() == 0


def test_expressions_refuse_code(spark):
    df = spark.range(3)
    for text in ("__import__('os')", "id.__class__", "[x for x in id]", "lambda: id", "open('x')", "nope > 1"):
        with pytest.raises((NameError, SyntaxError, KeyError)):
            expressions.query(df, text)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-6, 6)), min_size=1, max_size=12))
def test_division_like_python(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", elementwise.floordiv(a, b).alias("q"), elementwise.mod(a, b).alias("m"), elementwise.truediv(a, b).alias("d")).collect():
        if r.b:
            assert (r.q, r.m) == (r.a // r.b, r.a % r.b) and r.d == r.a / r.b
        else:
            assert r.m is None and r.d == (None if r.a == 0 else np.sign(r.a) * np.inf)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB1 é-x", max_size=9), min_size=1, max_size=8))
def test_strings_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    made = {
        "center": (strings.center(t, 6, "*"), lambda s: s.center(6, "*")), "title": (strings.title(t), str.title), "swap": (strings.swapcase(t), str.swapcase), "zfill": (strings.zfill(t, 7), lambda s: s.zfill(7)), "cap": (strings.capitalize(t), str.capitalize),
        "part": (strings.partition(t, "x"), lambda s: list(s.partition("x"))), "rpart": (strings.rpartition(t, "x"), lambda s: list(s.rpartition("x"))), "rfind": (strings.rfind(t, "B1"), lambda s: s.rfind("B1")), "back": (strings.slice_(t, -1, None, -2), lambda s: s[-1::-2]),
        "split": (strings.split(t), str.split), "rsplit": (strings.rsplit(t, "x", 1), lambda s: s.rsplit("x", 1)), "suffix": (strings.removesuffix(t, "x"), lambda s: s.removesuffix("x")), "slice": (strings.slice_(t, 1, -1), lambda s: s[1:-1]),
    }
    for r in df.select("t", *[c.alias(n) for n, (c, _) in made.items()]).collect():
        for n, (_, f) in made.items():
            assert r[n] == f(r.t), (n, r.t)


def test_date_edges(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 2, 29, 23, 59, 59, 999999),), (datetime.datetime(1969, 12, 31, 23, 0),), (None,)], "t timestamp_ntz")
    t = F.col("t")
    rows = df.select(dates.floor(t, "h").alias("f"), dates.ceil(t, "h").alias("c"), dates.is_month_end(t).alias("e"), dates.end_time(t, "Y").alias("y"), dates.strftime(t, "%d.%m.%y %Hh").alias("s")).collect()
    assert tuple(rows[0]) == (datetime.datetime(2024, 2, 29, 23), datetime.datetime(2024, 3, 1), True, datetime.datetime(2024, 12, 31, 23, 59, 59, 999999), "29.02.24 23h")
    assert rows[1].f == rows[1].c == datetime.datetime(1969, 12, 31, 23) and tuple(rows[2]) == (None,) * 5


def test_resample_like_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"t": pd.Timestamp("2023-12-30") + pd.to_timedelta(rng.integers(0, 86400 * 40, 200), unit="s"), "v": rng.integers(0, 50, 200).astype(float)}).sort_values("t")
    df = spark.createDataFrame(pdf)
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    for rule, theirs in (("6h", "6h"), ("D", "D"), ("M", "MS"), ("Y", "YS"), ("2D", None)):
        got = resampling.resample(df, rule, "t", {"s": ("v", "sum"), "n": ("v", "count")}).orderBy("t").toPandas()
        want = pdf.resample(theirs, on="t")["v"].agg(["sum", "count"]) if theirs else pdf.resample("2D", on="t", origin="epoch")["v"].agg(["sum", "count"])
        assert got["s"].tolist() == want["sum"].tolist() and got["n"].tolist() == want["count"].tolist(), rule
        assert got["t"].tolist() == want.index.tolist()


def test_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "c string")
    cat = Categorical.of(df, "c").add_categories(["q"]).remove_categories(["z"]).reorder_categories(["b", "a", "q"], True)
    assert [r[0] for r in df.select(cat.codes()).collect()] == [0, 1, -1, -1]
    assert cat.remove_unused_categories(df).categories == ("b", "a")
    with pytest.raises(TypeError):
        cat.as_unordered().less("a")


def test_arrays_like_numpy(spark):
    v = np.array([[1.0, -2.0, 3.0], [4.0, 5.5, -6.0], [0.0, 2.0, 2.0]])
    a = A.array(spark, v)
    assert a.shape == v.shape and a.sum() == v.sum() and a.var() == pytest.approx(v.var()) and a.prod() == pytest.approx(v.prod())
    assert np.allclose(A.absolute(a * 2 - 1).to_numpy(), np.abs(v * 2 - 1)) and np.allclose(A.maximum(a, 1.0).to_numpy(), np.maximum(v, 1))
    assert np.allclose(a.dot(a.transpose()).to_numpy(), v @ v.T) and np.allclose(a.transpose().to_numpy(), v.T)
    assert np.allclose(a.flatten().to_numpy(), v.ravel()) and np.allclose(a.append(a).to_numpy(), np.append(v, v, axis=0)) and np.allclose(a.hstack(a).to_numpy(), np.hstack((v, v)))
    assert np.allclose(a.mean(0).to_numpy(), v.mean(0)) and np.allclose(a.mean(1).to_numpy(), v.mean(1)) and A.norm(a) == pytest.approx(np.linalg.norm(v))
    one = A.array(spark, v[:, 0])
    assert one.argmax() == 1 and one.dot(one) == (v[:, 0] ** 2).sum() and np.allclose(A.where(one > 0, 1.0, -1.0).to_numpy(), np.where(v[:, 0] > 0, 1, -1))
    assert np.allclose(A.tri(spark, 3, 4, 1).to_numpy(), np.tri(3, 4, 1)) and np.allclose(A.zeros_like(a).to_numpy(), 0) and [x.to_numpy().tolist() for x in one.split(3)] == [[1.0], [4.0], [0.0]]


def test_columnar_verbs(spark):
    t = Table(spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (3, "a", 1.0), (4, None, 1.0)], "i int, g string, v double"), ["i"])
    assert t.shape == (4, 3) and t.slice(1, 2)["i"].to_list() == [2, 3] and t.tail(1).rows() == [(4, None, 1.0)] and t.row(-1) == (4, None, 1.0)
    assert t.sort("v").rows()[0][0] == 2 and t.sort("v", nulls_last=True).rows()[-1][0] == 2 and t.sort("v", "i", descending=[True, False], nulls_last=True).slice(1, 2)["i"].to_list() == [3, 4]
    assert t["v"].cum_sum().to_list() == [3.0, None, 4.0, 5.0] and t["v"].rank().to_list() == [3.0, None, 1.5, 1.5]
    assert t["g"].is_first_distinct().to_list() == [True, True, False, True] and t["v"].rle_id().to_list() == [0, 1, 2, 2]
    assert t["i"].peak_max().to_list() == [False, False, False, True]
    assert t.n_unique() == 4 and t["v"].null_count() == 1 and t["v"].arg_max() == 0 and t["i"].search_sorted([2.5]).rows() == [(2.5, 2)]
    assert sorted(t.group_by("g").len().rows(), key=str) == [("a", 2), ("b", 1), (None, 1)]
    assert t.join(t, on="g", how="semi").height == 3 and t.join(t, on="g", how="anti", join_nulls=True).height == 0 and t.join(t.select("i", "g"), on="g", how="full").height >= 6
    assert t.fill_null(strategy="forward")["v"].to_list() == [3.0, 3.0, 1.0, 1.0] and t.reverse().rows()[0][0] == 4
    assert t.sql("SELECT max(v) AS m FROM self").rows() == [(3.0,)] and t.filter(g="a").height == 2 and t.with_row_index().rows()[2][-1] == 2
    assert t["v"].entropy() > 0 and t["v"].skew() == pytest.approx(pd.Series([3.0, 1, 1]).skew(), rel=1) and t["i"].shrink_dtype().table is t
    assert t["v"].shift(1).to_list() == [None, 3.0, None, 1.0] and t["i"].gather([0, 3]).rows() == [(1,), (4,)] and t["v"].interpolate_by("i").to_list() == [3.0, 2.0, 1.0, 1.0]


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"", 1.5), (2, None, None)], "i bigint, s string, v double")
    writers.to_csv(df, f"{tmp_path}/c", single=True)
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/c").collect())) == [(1, 'a, "b"', 1.5), (2, None, None)]
    writers.to_feather(df, f"{tmp_path}/f.arrow")
    assert readers.read_feather(spark, f"{tmp_path}/f.arrow").orderBy("i").collect() == df.orderBy("i").collect()
    writers.to_pickle(df, f"{tmp_path}/p.pkl")
    assert readers.read_pickle(spark, f"{tmp_path}/p.pkl").count() == 2
    writers.to_pickle_parts(df, f"{tmp_path}/pp")
    assert readers.read_pickle_parts(spark, f"{tmp_path}/pp", df.schema).orderBy("i").collect() == df.orderBy("i").collect()
    writers.to_stata(df.select("i", "v"), f"{tmp_path}/s.dta")
    assert readers.read_stata(spark, f"{tmp_path}/s.dta").count() == 2
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2\n")
    assert readers.read_table(spark, f"{tmp_path}/t.tsv").collect()[0].y == 2
    (tmp_path / "bad.csv").write_text("x,y\n1,2\nz,3\n")
    assert readers.read_csv(spark, f"{tmp_path}/bad.csv", schema="x int, y int", on_bad_lines="skip").collect() == [(1, 2)]
    assert "<table" in writers.to_html(df) and writers.to_markdown(df).startswith("| i |") and "tabular" in writers.to_latex(df) and "a" in writers.to_string(df)
    assert writers.to_records(df.filter("i = 2")) == [(2, None, None)] and writers.to_list(df.orderBy("i"), "i") == [1, 2] and writers.to_arrow(df).num_rows == 2


def test_read_sql_over_a_connection(spark, tmp_path):
    path = f"{tmp_path}/d.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (i INTEGER, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"s{k}") for k in range(100)])
    got = readers.read_sql_connection(spark, "SELECT * FROM t WHERE i < 90", lambda: sqlite3.connect(path), "i", 0, 99, 7, "i bigint, s string")
    assert sorted(map(tuple, got.collect())) == sorted((k, f"s{k}") for k in range(90))


def test_read_html_tables(spark):
    page = "<table><tr><th>A<th>B</tr><tr><td>1</td><td>2 <b>x</b></td></tr></table><p>no</p><table><tr><td>z</td></tr></table>"
    got = readers.read_html(spark.createDataFrame([(7, page), (8, None)], "id int, html string"), keep=["id"]).orderBy("table", "row").collect()
    assert [(r.id, r.table, r.row, r.cells) for r in got] == [(7, 0, 0, ["A", "B"]), (7, 0, 1, ["1", "2 x"]), (7, 1, 0, ["z"])]


def test_python_functions(spark):
    df = spark.range(10)
    assert sorted(r.d for r in udfs.applymap(df, lambda x: x * 2.0, ["id"], "double").withColumnRenamed("id", "d").collect()) == [2.0 * k for k in range(10)]
    mean = udfs.user_aggregate(lambda s: float(s.max() - s.min()))
    assert df.groupBy((F.col("id") % 2).alias("g")).agg(mean("id").alias("m")).orderBy("g").collect()[0].m == 8.0
    made = udfs.from_map(spark, lambda k: pd.DataFrame({"k": [k] * k}), [1, 2, 3], "k bigint")
    assert made.count() == 6 and [len(b) for b in udfs.batches(df, 4)] == [4, 4, 2]
    assert udfs.partitions(df).agg(F.sum("rows")).first()[0] == 10

    @udfs.register_extension("double")
    def double(d, c):
        return d.withColumn(c, F.col(c) * 2)

    assert udfs.extension("double")(df, "id").agg(F.sum("id")).first()[0] == 90


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stream = W.read_stream(spark, sf, e.schema, only="events.parquet")
    W.run_once(W.tumbling(stream, "ts", "1 day", {"n": F.count("*")}, late="2 days"), "tumbled", f"{tmp_path}/a", "complete")
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == e.count()
    W.run_once(W.distinct(stream, "ts", ["user_id"], "1 hour"), "firsts", f"{tmp_path}/b")
    assert spark.table("firsts").select("user_id").distinct().count() == e.select("user_id").distinct().count()


def test_group_sample_and_selection(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    g = Groups(df, "g", ["id"])
    assert g.sample(4).groupBy("g").count().agg(F.max("count")).first()[0] == 4 and g.sample(frac=0.5).count() in (49, 50, 51)
    assert sorted(map(tuple, g.nth(0).collect())) == [(0, 0), (1, 1), (2, 2)] and g.ngroups() == 3
    assert selecting.sample(df, 10, seed=1).collect() == selecting.sample(df, 10, seed=1).collect()
    assert selecting.sample(df, 10, weights="id", seed=1).count() == 10 and selecting.sample(df, 150, replace=True).count() == 150
    assert selecting.equals(df, df) and not selecting.equals(df, df.limit(5)) and selecting.dropna_columns(df.withColumn("n", F.lit(None))).columns == ["id", "g"]
    assert selecting.at(df, "id", 7, "g") == 1 and selecting.iat(df, 5, "g", ["id"]) == 2


def test_kendall_of_many_points(spark):
    """More distinct points than can be compared one by one, with ties, a hot value and repeated points."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random(24_000) < 0.3, 5.0, rng.normal(0, 9, 24_000))
    y = np.where(rng.random(24_000) < 0.1, 1.0, 0.3 * x + rng.normal(0, 9, 24_000))
    x, y = np.concatenate((x, x[:2000])), np.concatenate((y, y[:2000]))
    s = dx = dy = 0
    for k in range(len(x)):
        a, b = np.sign(x - x[k]), np.sign(y - y[k])
        s, dx, dy = s + (a * b).sum(), dx + (a != 0).sum(), dy + (b != 0).sum()
    points = spark.createDataFrame(pd.DataFrame({"a": x, "b": y, "one": 1.0}))
    got = {(r.x, r.y): r["corr"] for r in aggregating.corr(points, ["a", "b", "one"], "kendall").collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(s / np.sqrt(float(dx) * float(dy)), abs=1e-12)
    assert got[("a", "a")] == 1 and got[("a", "one")] is None


def test_text_functions_take_whole_texts(spark, sf):
    from lumenframe import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.QUERIES["str_case_whole"](spark, sf).collect()
    assert len(got) == len(texts) and any(not t.isascii() for t in texts.values()) and max(map(len, texts.values())) > 60
    for r in got:
        t = texts[r.doc_id]
        assert (r.lower, r.upper, r.capitalize, r.len, r.reversed) == (t.lower(), t.upper(), t[:1].upper() + t[1:].lower(), len(t), t[::-1])
    odd = spark.createDataFrame([("abc defghi",), ("abcdefgh9",), ("abc\n",), ("",)], "t string")
    assert [r[0] for r in odd.select(strings.fullmatch(F.col("t"), "[A-Za-z ]+")).collect()] == [True, False, False, False]


def test_whole_lists_are_exploded(spark, sf):
    from lumenframe import catalog

    lists = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = sorted((r.vec_id, float(x)) for r in lists for x in r.embedding)
    assert sorted(tuple(r) for r in catalog.QUERIES["explode_list_whole"](spark, sf).collect()) == want
