"""Queries and steps that a review found to fail, to differ from SQL, or to grow faster than their input."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from lumenframe import catalog
from lumenframe.operators import aggregating, joining, windowing
from lumenframe.operators.grouping import Groups


@pytest.fixture
def events(spark, tmp_path):
    """Events of three users, of whom one has the same value throughout and one has runs of it; zeros among the values."""
    n = 60
    value = [5.0 if i % 3 == 0 else 2.5 if i % 3 == 1 and i % 20 < 16 else 0.0 if i % 5 == 0 else i * 1.25 for i in range(n)]
    e = pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([i * 7 // 2 * 60 for i in range(n)], unit="s"), "user_id": [i % 3 for i in range(n)], "event_type": "view", "value": value, "props": "{}"})
    spark.createDataFrame(e).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (part,) = (tmp_path / "events.parquet").glob("*.parquet")
    part.rename(tmp_path / "one")
    for left in (tmp_path / "events.parquet").glob("*"):
        left.unlink()
    for left in (tmp_path / "events.parquet").glob(".*"):
        left.unlink()
    (tmp_path / "events.parquet").rmdir()
    (tmp_path / "one").rename(tmp_path / "events.parquet")
    return str(tmp_path)


def held(spark, sf_dir: str, name: str) -> str:
    return differences(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.ORACLE[name])


@pytest.mark.parametrize("name", ["expanding_by_user", "rolling_rank_corr"])
def test_windows_of_equal_values_have_no_correlation(spark, events, name):
    assert held(spark, events, name) == ""


def test_correlations_of_columns_that_do_not_vary(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 7.0), (2, 1, 2.0, 8.0), (3, 2, 1.0, 5.0), (4, 2, 3.0, 9.0), (5, 2, None, 1.0)], "id int, g int, x double, y double")
    assert {r.g: r["corr"] for r in Groups(df, ["g"], ["id"]).corr("x", "y").collect()} == {1: None, 2: pytest.approx(1.0)}
    assert {r.g: r.x for r in Groups(df, ["g"], ["id"]).corrwith(["x"], "y").collect()} == {1: None, 2: pytest.approx(1.0)}
    flat = df.filter("g = 1")
    assert {(r.x, r.y): r["corr"] for r in aggregating.corr(flat, ["x", "y"]).collect()} == {("x", "x"): None, ("x", "y"): None, ("y", "x"): None, ("y", "y"): pytest.approx(1.0)}
    assert aggregating.autocorr(flat, "x", ["id"]).first()[0] is None
    assert joining.corrwith(flat, flat, "id", ["x", "y"]).first() == (None, pytest.approx(1.0))


def test_equal_values_in_many_parts_have_no_correlation(spark):
    """Merged variances of equal values may be a little above zero, whatever they are of."""
    df = spark.range(0, 2000, 1, 7).selectExpr("id", "id % 40 AS g", "(id % 40) * 0.1D + 0.07D AS x", "CAST(id * id % 97 AS DOUBLE) AS y")
    assert {r["corr"] for r in Groups(df, ["g"], ["id"]).corr("x", "y").collect()} == {None}
    assert {r.x for r in Groups(df, ["g"], ["id"]).corrwith(["x"], "y").collect()} == {None}


def test_running_correlations_of_equal_values_are_missing(spark):
    """Over a whole table, where a table begins with equal values of one column or of both."""
    df = spark.range(0, 120, 1, 3).selectExpr("id", "CASE WHEN id < 60 THEN 29.27D ELSE id * 1.1D END AS x", "CASE WHEN id < 80 THEN 235 ELSE id END AS y", "id % 7 AS z")
    out = windowing.expanding(df, ["id"], {"xy": ("corr", "x", "y"), "xz": ("corr", "x", "z")}).collect()
    assert {r.xy for r in out if r.id < 80} == {r.xz for r in out if r.id < 60} == {None}
    f = pd.DataFrame(out, columns=["id", "x", "y", "z", "xy", "xz"]).sort_values("id")
    for name, other in (("xy", "y"), ("xz", "z")):
        np.testing.assert_allclose(f[name].to_numpy(float)[80:], [np.corrcoef(f["x"][:k], f[other][:k])[0, 1] for k in range(81, 121)], rtol=1e-9)


def test_sliding_correlations_round_as_in_sql(spark, tmp_path):
    """Correlations that lie on a half of the last digit, which other orders of the same sums put on either side of it."""
    frames = {
        (2, 2, 1, 2, 0): (481028, 481036, 481052, 481064, 481070), (2, 2, 0, 1, 0): (199476, 199480, 199523, 199534, 199572), (0, 1, 2, 0, 0): (32230, 32232, 32236, 32248, 32249),
        (0, 1, 0, 2, 2): (247476, 247483, 247486, 247508, 247512), (0, 2, 2, 2, 2): (68141, 68167, 68173, 68184, 68185), (1, 0, 2, 0, 2): (131346, 131348, 131356, 131360, 131365),
    }
    e = pd.DataFrame([(i, u, v / 10) for u, (values, ids) in enumerate(frames.items()) for i, v in zip(ids, values, strict=True)], columns=["event_id", "user_id", "value"])
    e.to_parquet(f"{tmp_path}/events.parquet")
    assert held(spark, str(tmp_path), "rolling_rank_corr") == ""


def test_zeros_keep_their_sign_in_division(spark):
    """The quotient of a zero and a negative number is a negative zero, in the rounded query and in floors alike."""
    from lumenframe.functions import elementwise as E
    from lumenframe.queries.registry import r

    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(0, -2), (0, 2), (-1, 3), (5, -3)], "a bigint, b bigint")
    got = [[math.copysign(x, x) if x else math.copysign(1, x) * 0.0 for x in row] for row in df.select(r(E.truediv(a, b), 2), E.floordiv(a, b)).collect()]
    assert [[str(x) for x in row] for row in got] == [["-0.0", "-0.0"], ["0.0", "0.0"], ["-0.33", "-1.0"], ["-1.67", "-2.0"]]
    big = spark.createDataFrame([(1e300, 1.0), (-7.5, 0.5), (1.0, 0.0)], "a double, b double")
    assert [x[0] for x in big.select(E.floordiv(a, b)).collect()] == [1e300, -15.0, math.inf]


def test_changes_against_zero(spark, events):
    assert held(spark, events, "vector_change_peaks") == ""
    assert held(spark, events, "pct_change_all") == ""


@pytest.mark.parametrize("closed", ["right", "left", "both", "neither"])
@pytest.mark.parametrize("by", [[], ["g"]], ids=["whole", "groups"])
def test_frames_of_time_from_two_running_results(spark, closed, by):
    """Every aggregate against each frame's own rows: ties, gaps longer than a frame, missing values and times, times before 1970."""
    rng = np.random.default_rng(3)
    n = 240
    at = np.sort(rng.choice(np.arange(-400, 400), n)) * 1000
    v = np.where(rng.random(n) < 0.2, np.nan, np.round(rng.normal(2, 1, n), 2))
    late = [i % 31 == 0 for i in range(n)]
    rows = [(i, None if late[i] else int(at[i]), i % 3, None if np.isnan(v[i]) else float(v[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, us bigint, g int, v double").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    hows = ("sum", "count", "mean", "min", "max", "prod", "var", "std", "sem")
    out = windowing.rolling(df, ["ts"], "20ms", {h: (h, "v") for h in hows}, by, closed=closed)
    low, high = {"right": (-19_999, 0), "left": (-20_000, -1), "both": (-20_000, 0), "neither": (-19_999, -1)}[closed]
    for r in out.collect():
        _, t, g, _ = rows[r.id]
        seen = [x for x in rows if (not by or x[2] == g) and ((x[1] is None) if t is None else x[1] is not None and t + low <= x[1] <= t + high)]
        s = pd.Series([x[3] for x in seen], dtype=float)
        for h in hows:
            want = (float(s.count()) if len(seen) else None) if h == "count" else getattr(s, h)() if s.count() else None
            assert r[h] == pytest.approx(want) if want is not None and want == want else r[h] is None, (r, h, want)


def test_frames_of_time_look_at_no_row_for_each_frame_it_is_in(spark, events):
    """The plan has running frames alone, whose time does not grow with the rows of a frame."""
    plan = catalog.QUERIES["rolling_time"](spark, events)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan and "RangeFrame, -" not in plan
    assert held(spark, events, "rolling_time") == ""


@pytest.mark.parametrize("adjust", [True, False])
def test_exponential_weights_of_groups_over_many_batches(spark, adjust):
    """Groups that end in a batch and ones that go on over several, missing values and a missing key; one shuffle for all results."""
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", "c", "d", None], n, p=[0.7, 0.1, 0.1, 0.05, 0.05]), "v": np.where(rng.random(n) < 0.2, np.nan, np.round(rng.normal(50, 9, n), 2))})
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = windowing.ewms(df, ["id"], "v", {"m": "mean", "s": "std", "d": "var"}, ["g"], 0.3, adjust)
        got = out.toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for name, how in (("m", "mean"), ("s", "std"), ("d", "var")):
        want = frame.groupby("g", dropna=False)["v"].transform(lambda s, how=how: getattr(s.ewm(alpha=0.3, adjust=adjust), how)())
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_exponential_queries_shuffle_once(spark, events):
    df = catalog.QUERIES["vector_ewm"](spark, events)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan
    for name in ("vector_ewm", "ewm_mean_recursive", "vector_ewm_by_time"):
        assert held(spark, events, name) == ""


def test_python_functions_of_frames_get_arrays(spark):
    """With `raw` a frame is an array, without it a Series; frames that are short or have missing values give none."""
    df = spark.createDataFrame([(i, None if i == 7 else float(i * i)) for i in range(20)], "id int, v double").repartition(3)
    x = pd.Series([np.nan if i == 7 else float(i * i) for i in range(20)])
    want = x.rolling(3).apply(lambda s: s.max() - s.min())
    for raw, kind in ((True, np.ndarray), (False, pd.Series)):
        out = windowing.rolling_apply(df, ["id"], 3, "v", lambda s, kind=kind: s.max() - s.min() if isinstance(s, kind) else -1.0, "o", raw=raw)
        got = pd.Series({r.id: r.o for r in out.collect()}, dtype=float).sort_index()
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


def test_texts_in_normal_form_stay_out_of_python(spark):
    """Texts of every kind against Python, and batches of whole texts bounded by bytes."""
    import textwrap
    import unicodedata

    from lumenframe.functions import strings

    kinds = ["", "plain", "café ſĲ", "é", "ẛ̣", "Ω 가 가", "\U0001d15e", "ﬁ", None]
    df = spark.createDataFrame(list(enumerate(kinds)), "id int, t string").coalesce(1)
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        got = {r.id: r.n for r in df.select("id", strings.normalize(F.col("t"), form).alias("n")).collect()}
        assert got == {i: None if t is None else unicodedata.normalize(form, t) for i, t in enumerate(kinds)}
    # no code point below U+0300 changes in form C, and none is the second of a pair that composes
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x300)) and all(int(p[1], 16) >= 0x300 for p in pairs if len(p) == 2 and p[0][0] != "<")
    assert df.filter("id = 1").select(strings.wrap(F.repeat("t", F.lit(5)), 7)).first()[0] == "\n".join(textwrap.wrap("plain" * 5, 7))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == strings.BATCH_BYTES
