"""Groups that hold a third of all rows and more: the results are those of plain windows, and no task sees more than its range."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import joining, windowing
from lumenframe.operators.grouping import Groups
from lumenframe.plans import ordering

N = 4000


@pytest.fixture(scope="module")
def frame() -> pd.DataFrame:
    rng = np.random.default_rng(8)
    g = np.where(rng.random(N) < 0.6, "hot", rng.choice(["a", "b", None], N)).astype(object)
    v = np.round(rng.normal(50, 20, N), 2)
    v[rng.random(N) < 0.1] = np.nan
    return pd.DataFrame({"id": range(N), "g": g, "v": v, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(10 * 86400, N, replace=False)), unit="s"), "k": rng.integers(0, 9, N)})


@pytest.fixture
def df(spark, frame):
    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def hot(request, monkeypatch, many_parts):
    if request.param:
        monkeypatch.setattr(ordering, "HOT_BYTES", 0)
        monkeypatch.setattr(ordering, "HOT_ROWS", 500)
        monkeypatch.setattr(ordering, "RANGE_ROWS", 250)
        monkeypatch.setattr(ordering, "BLOCK_ROWS", 300)
    return request.param


def same(out, column: str, want: pd.Series) -> None:
    got = pd.Series({r.id: r[column] for r in out.select("id", column).collect()}, dtype=float).sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_running(df, frame, hot):
    by = frame.groupby("g", dropna=False)["v"]
    out = windowing.cumulative(df, ["id"], {"s": ("cumsum", "v"), "m": ("cummax", "v")}, ["g"])
    same(out, "s", by.cumsum())
    same(out, "m", by.cummax())
    same(windowing.cumcount(df, ["id"], ["g"], "n"), "n", frame.groupby("g", dropna=False).cumcount())
    same(windowing.fill(df, ["id"], ["v"], by=["g"]), "v", by.ffill())


def test_sliding(df, frame, hot):
    by = frame.groupby("g", dropna=False)["v"]
    same(windowing.shift(df, ["id"], {"o": "v"}, 3, ["g"]), "o", by.shift(3))
    same(windowing.rolling(df, ["id"], 5, {"o": ("sum", "v")}, ["g"], 2), "o", by.rolling(5, 2).sum().reset_index(level=0, drop=True).sort_index())


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
def test_ranks(df, frame, hot, method):
    want = frame.groupby("g", dropna=False)["k"].rank(method)
    same(windowing.rank(df, "k", "o", method, by=["g"], order=["id"]), "o", want)


def test_frames_of_time(df, frame, hot):
    at = frame.set_index("ts")
    want = at.groupby("g", dropna=False)["v"].rolling("3h").sum()
    got = sorted((str(r.g), r.ts, round(r.o or 0.0, 6)) for r in windowing.rolling(df, ["ts"], "3h", {"o": ("sum", "v")}, ["g"]).collect())
    assert got == sorted((str(None if g is None or g != g else g), t.to_pydatetime(), round(0.0 if x != x else x, 6)) for (g, t), x in want.items())
    whole = at["v"].rolling("3h").mean()
    same(windowing.rolling(df, ["ts"], "3h", {"o": ("mean", "v")}), "o", pd.Series(whole.to_numpy()).groupby(frame["ts"]).transform("last"))


def test_asof(spark, df, frame, hot):
    left = df.select("id", "g", "ts", "v").filter("id % 3 = 0 and g is not null")
    right = df.select("g", "ts", F.col("id").alias("other")).filter("id % 3 = 1 and g is not null")
    got = {r.id: r.other for r in joining.merge_asof(left, right, on="ts", by="g").collect()}
    known = frame[frame["g"].notna()]
    want = {}
    for i, g, t in known[known["id"] % 3 == 0][["id", "g", "ts"]].itertuples(index=False):
        before = known[(known["id"] % 3 == 1) & (known["g"] == g) & (known["ts"] <= t)]
        want[i] = set(before[before["ts"] == before["ts"].max()]["id"]) or {None}
    assert got.keys() == want.keys() and all(got[i] in want[i] for i in got)


def test_transform(df, frame, hot):
    by = frame.groupby("g", dropna=False)["v"]
    for how in ("sum", "mean", "median", "nunique", "std", "size", "max"):
        same(Groups(df, ["g"], ["id"], dropna=False).transform(how, {"o": "v"}), "o", by.transform(how))


def test_no_task_has_a_hot_group(spark, df, hot):
    """The windows over ranges see at most some ranges' rows, the plain ones the whole group."""
    if hot:
        dealt = ordering.ranged(df, ["g", "id"])
        most = dealt.groupBy("__range").count().agg(F.max("count")).first()[0]
        assert most <= N // 2


def test_low_first_keys_do_not_share_a_range(spark, monkeypatch, many_parts):
    """An order that begins with a column of few values is cut by its whole key."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 500)
    df = spark.range(0, 8000, 1, 4).select((F.col("id") % 2).alias("low"), "id")
    most = ordering.ranged(df, ["low", "id"]).groupBy("__range").count().agg(F.max("count")).first()[0]
    assert most < 3900
    assert [r.id for r in ordering.positions(df, ["low", "id"]).orderBy(ordering.POSITION).limit(3).collect()] == [0, 2, 4]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("how", ["mean", "var", "std"])
def test_exponential_weights_over_the_whole_table(spark, frame, monkeypatch, how, adjust):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 300)
    holes = frame.assign(v=np.where((frame["id"] < 3) | frame["id"].between(700, 1900), np.nan, frame["v"]))
    df = spark.createDataFrame(holes[["id", "v"]]).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for bias in (False, True) if how != "mean" else (False,):
        e = holes["v"].ewm(alpha=0.2, adjust=adjust)
        want = e.mean() if how == "mean" else getattr(e, how)(bias=bias)
        out = windowing.ewm(df.repartitionByRange(5, "id"), ["id"], "v", "o", alpha=0.2, adjust=adjust, how=how, bias=bias)
        got = pd.Series({r.id: r.o for r in out.select("id", "o").collect()}, dtype=float).sort_index()
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-6, atol=1e-6)
