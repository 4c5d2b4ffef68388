"""The labelled frame against pandas on the same small data, missing values and ties included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pandas.testing import assert_frame_equal

from lumenframe import frame as L
from lumenframe.frame import Frame


@pytest.fixture(scope="module")
def pdf() -> pd.DataFrame:
    rng = np.random.default_rng(1)
    n = 60
    out = pd.DataFrame({"k": np.arange(n), "g": rng.choice(list("abc"), n), "x": rng.integers(0, 9, n).astype(float), "y": rng.random(n).round(3), "s": rng.choice(["Foo bar", "baz", "qUx-1"], n)})
    out.loc[[3, 10, 11, 40], "x"] = np.nan
    out.loc[[5, 40], "s"] = None
    return out


@pytest.fixture(scope="module")
def f(spark, pdf) -> Frame:
    return Frame.of(pdf, spark, "k", "k")


@pytest.fixture(scope="module")
def p(pdf) -> pd.DataFrame:
    return pdf.set_index("k")


def same(a: Frame | L.Series, b: pd.DataFrame | pd.Series) -> None:
    got = a.to_pandas()
    if isinstance(b, pd.Series):
        got, b = got.to_frame("v"), b.to_frame("v")
    assert list(got.columns) == list(b.columns)
    plain = lambda d: d.astype(object).where(d.notna(), None).map(lambda v: float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v)
    assert_frame_equal(plain(got).reset_index(drop=True), plain(b).reset_index(drop=True), check_dtype=False, rtol=1e-9)


CASES = {
    "getitem_list": (lambda f: f[["x", "y"]], lambda p: p[["x", "y"]]),
    "mask": (lambda f: f[f["x"] > 4], lambda p: p[p["x"] > 4]),
    "mask_and": (lambda f: f[(f["x"] > 2) & (f["g"] == "a")], lambda p: p[(p["x"] > 2) & (p["g"] == "a")]),
    "loc": (lambda f: f.loc(slice(5, 12)), lambda p: p.loc[5:12]),
    "iloc": (lambda f: f.iloc(slice(-5, None)), lambda p: p.iloc[-5:]),
    "iloc_step": (lambda f: f.iloc(slice(2, 30, 7)), lambda p: p.iloc[2:30:7]),
    "head": (lambda f: f.head(3), lambda p: p.head(3)),
    "query": (lambda f: f.query("x > @a and g in ['a', 'b']", a=3), lambda p: p.query("x > 3 and g in ['a', 'b']")),
    "assign": (lambda f: f.assign(z=f["x"] * 2 + f["y"]), lambda p: p.assign(z=p["x"] * 2 + p["y"])),
    "eval": (lambda f: f.eval("z = x ** 2 - y % 0.3"), lambda p: p.eval("z = x ** 2 - y % 0.3")),
    "dropna": (lambda f: f.dropna(), lambda p: p.dropna()),
    "fillna": (lambda f: f[["x"]].fillna(0.0), lambda p: p[["x"]].fillna(0.0)),
    "ffill": (lambda f: f[["x"]].ffill(), lambda p: p[["x"]].ffill()),
    "bfill_limit": (lambda f: f[["x"]].bfill(1), lambda p: p[["x"]].bfill(limit=1)),
    "interpolate": (lambda f: f[["x"]].interpolate(), lambda p: p[["x"]].interpolate()),
    "isna": (lambda f: f[["x", "s"]].isna(), lambda p: p[["x", "s"]].isna()),
    "clip": (lambda f: f[["x", "y"]].clip(0.2, 5.0), lambda p: p[["x", "y"]].clip(0.2, 5.0)),
    "round": (lambda f: f[["y"]].round(1), lambda p: p[["y"]].round(1)),
    "where": (lambda f: f[["x"]].where(f["x"] > 4, -1.0), lambda p: p[["x"]].where(p["x"] > 4, -1.0)),
    "sort": (lambda f: f.sort_values(["g", "x"], [True, False]), lambda p: p.sort_values(["g", "x"], ascending=[True, False], kind="stable")),
    "nlargest": (lambda f: f.nlargest(7, "x").sort_index(), lambda p: p.nlargest(7, "x").sort_index()),
    "drop_duplicates": (lambda f: f.drop_duplicates(["g", "x"]), lambda p: p.drop_duplicates(["g", "x"])),
    "drop_duplicates_last": (lambda f: f.drop_duplicates("g", "last"), lambda p: p.drop_duplicates("g", keep="last")),
    "rename": (lambda f: f.rename({"x": "xx"}), lambda p: p.rename(columns={"x": "xx"})),
    "add_prefix": (lambda f: f.add_prefix("p_"), lambda p: p.add_prefix("p_")),
    "select_dtypes": (lambda f: f.select_dtypes("number"), lambda p: p.select_dtypes("number")),
    "filter_like": (lambda f: f.filter(regex="^[xy]$"), lambda p: p.filter(regex="^[xy]$")),
    "cumsum": (lambda f: f[["x", "y"]].cumsum(), lambda p: p[["x", "y"]].cumsum()),
    "cummax": (lambda f: f[["x"]].cummax(), lambda p: p[["x"]].cummax()),
    "cumprod": (lambda f: f[["y"]].cumprod(), lambda p: p[["y"]].cumprod()),
    "shift": (lambda f: f[["x", "g"]].shift(2), lambda p: p[["x", "g"]].shift(2)),
    "diff": (lambda f: f[["x"]].diff(), lambda p: p[["x"]].diff()),
    "pct_change": (lambda f: f[["y"]].pct_change(), lambda p: p[["y"]].pct_change()),
    "rank": (lambda f: f[["x", "y"]].rank(), lambda p: p[["x", "y"]].rank()),
    "rank_dense_pct": (lambda f: f[["x"]].rank("dense", False, True), lambda p: p[["x"]].rank(method="dense", ascending=False, pct=True)),
    "rolling_mean": (lambda f: f[["x"]].rolling(4, 2).mean(), lambda p: p[["x"]].rolling(4, 2).mean()),
    "rolling_std": (lambda f: f[["y"]].rolling(5).std(), lambda p: p[["y"]].rolling(5).std()),
    "rolling_skew": (lambda f: f[["y"]].rolling(6).skew(), lambda p: p[["y"]].rolling(6).skew()),
    "rolling_kurt": (lambda f: f[["y"]].rolling(6).kurt(), lambda p: p[["y"]].rolling(6).kurt()),
    "rolling_quantile": (lambda f: f[["y"]].rolling(5).quantile(0.3), lambda p: p[["y"]].rolling(5).quantile(0.3)),
    "rolling_center": (lambda f: f[["y"]].rolling(5, center=True).sum(), lambda p: p[["y"]].rolling(5, center=True).sum()),
    "ewm": (lambda f: f[["x"]].ewm("x", span=4), lambda p: p[["x"]].ewm(span=4).mean()),
    "expanding_mean": (lambda f: f[["x"]].expanding().mean(), lambda p: p[["x"]].expanding().mean()),
    "expanding_std": (lambda f: f[["y"]].expanding(2).std(), lambda p: p[["y"]].expanding(2).std()),
    "expanding_skew": (lambda f: f[["x", "y"]].expanding(3).skew(), lambda p: p[["x", "y"]].expanding(3).skew()),
    "expanding_kurt": (lambda f: f[["x", "y"]].expanding(4).kurt(), lambda p: p[["x", "y"]].expanding(4).kurt()),
    "expanding_sem": (lambda f: f[["y"]].expanding(2).std(), lambda p: p[["y"]].expanding(2).std()),
    "groupby_sum": (lambda f: f.groupby("g")[["x", "y"]].sum(), lambda p: p.groupby("g")[["x", "y"]].sum()),
    "groupby_agg": (lambda f: f.groupby("g").agg(a=("x", "mean"), b=("y", "std"), c=("x", "count"), d=("s", "nunique")), lambda p: p.groupby("g").agg(a=("x", "mean"), b=("y", "std"), c=("x", "count"), d=("s", "nunique"))),
    "groupby_median": (lambda f: f.groupby("g")[["x"]].median(), lambda p: p.groupby("g")[["x"]].median()),
    "groupby_first": (lambda f: f.groupby("g")[["x", "s"]].first(), lambda p: p.groupby("g")[["x", "s"]].first()),
    "groupby_skew": (lambda f: f.groupby("g")[["x"]].skew(), lambda p: p.groupby("g")[["x"]].skew()),
    "groupby_size": (lambda f: f.groupby("g").size(), lambda p: p.groupby("g").size().to_frame("size")),
    "groupby_cumsum": (lambda f: f.groupby("g")[["x"]].cumsum(), lambda p: p.groupby("g")[["x"]].cumsum()),
    "groupby_transform": (lambda f: f.groupby("g")[["x"]].transform("mean"), lambda p: p.groupby("g")[["x"]].transform("mean")),
    "groupby_shift": (lambda f: f.groupby("g")[["y"]].shift(), lambda p: p.groupby("g")[["y"]].shift()),
    "groupby_head": (lambda f: f.groupby("g").head(2), lambda p: p.groupby("g").head(2)),
    "str_title": (lambda f: f["s"].str.title(), lambda p: p["s"].str.title()),
    "str_swapcase": (lambda f: f["s"].str.swapcase(), lambda p: p["s"].str.swapcase()),
    "str_center": (lambda f: f["s"].str.center(10, "*"), lambda p: p["s"].str.center(10, "*")),
    "str_slice_step": (lambda f: f["s"].str.slice(1, 6, 2), lambda p: p["s"].str.slice(1, 6, 2)),
    "str_slice_back": (lambda f: f["s"].str.slice(-2, 0, -1), lambda p: p["s"].str.slice(-2, 0, -1)),
    "str_replace_n": (lambda f: f["s"].str.replace("o", "0", n=1), lambda p: p["s"].str.replace("o", "0", n=1)),
    "str_zfill": (lambda f: f["s"].str.zfill(9), lambda p: p["s"].str.zfill(9)),
    "str_rfind": (lambda f: f["s"].str.rfind("a"), lambda p: p["s"].str.rfind("a")),
    "series_map": (lambda f: f["g"].map({"a": 1, "b": 2}), lambda p: p["g"].map({"a": 1, "b": 2})),
    "row_sum": (lambda f: f[["x", "y"]].sum(axis=1), lambda p: p[["x", "y"]].sum(axis=1)),
    "floordiv_mod": (lambda f: (f["x"] // 2) + (f["y"] % -0.7), lambda p: (p["x"] // 2) + (p["y"] % -0.7)),
    "rsub_neg": (lambda f: 1 - f["y"] + (-f["x"]), lambda p: 1 - p["y"] + (-p["x"])),
    "factorize": (lambda f: f["g"].factorize(), lambda p: pd.Series(pd.factorize(p["g"])[0], p.index)),
    "duplicated": (lambda f: f["x"].duplicated(), lambda p: p["x"].duplicated()),
    "cut": (lambda f: L.cut(f["y"], 4), lambda p: pd.Series(pd.cut(p["y"], 4, labels=False), p.index)),
    "qcut": (lambda f: L.qcut(f["y"], 5), lambda p: pd.Series(pd.qcut(p["y"], 5, labels=False), p.index)),
}


@pytest.mark.parametrize("name", CASES)
def test_like_pandas(f, p, name):
    ours, theirs = CASES[name]
    same(ours(f), theirs(p))


def test_series_numbers(f, p):
    for how in ("sum", "mean", "median", "std", "var", "sem", "skew", "kurt", "min", "max", "count", "prod"):
        assert getattr(f["x"], how)() == pytest.approx(getattr(p["x"], how)()), how
    assert f["x"].nunique() == p["x"].nunique() and f["x"].nunique(False) == p["x"].nunique(dropna=False)
    assert f["y"].quantile(0.37) == pytest.approx(p["y"].quantile(0.37)) and f["x"].mode() == p["x"].mode().tolist()
    assert f["y"].idxmax() == p["y"].idxmax() and f["y"].argmin() == p["y"].argmin() and f["x"].unique()[:3] == p["x"].unique()[:3].tolist()
    assert f["x"].corr(f["y"]) == pytest.approx(p["x"].corr(p["y"])) and f["y"].autocorr(2) == pytest.approx(p["y"].autocorr(2))
    assert f["x"].hasnans and not f["y"].hasnans and not f["y"].is_monotonic_increasing
    assert len(f) == len(p) and f.shape == p.shape and not f.empty and "x" in f


def test_describe_and_corr(f, p):
    d = f[["x", "y"]].describe().to_pandas()
    want = p[["x", "y"]].describe().T
    assert np.allclose(d.loc[want.index, want.columns].astype(float), want)
    c = f[["x", "y"]].corr().to_pandas()
    assert c[(c["x"] == "x") & (c["y"] == "y")]["corr"].iloc[0] == pytest.approx(p[["x", "y"]].corr().loc["x", "y"])


def test_merges(spark):
    a = pd.DataFrame({"k": [1, 2, 2, None], "v": [1, 2, 3, 4]})
    b = pd.DataFrame({"k": [2, 3, None], "v": [5, 6, 7]})
    fa, fb = Frame.of(a, spark), Frame.of(b, spark)
    for how in ("inner", "left", "right", "outer"):
        got = fa.merge(fb, how, on="k").spark().toPandas().sort_values(["k", "v_x", "v_y"]).astype(float).reset_index(drop=True)
        want = a.merge(b, how, on="k").sort_values(["k", "v_x", "v_y"]).astype(float).reset_index(drop=True)
        assert_frame_equal(got, want, check_dtype=False)
    with pytest.raises(ValueError, match="not unique"):
        fa.merge(fb, on="k", validate="one_to_one")


def test_concat_and_reshape(spark, f, p):
    both = L.concat([f[["x"]], None, f[["y"]]])
    want = pd.concat([p[["x"]], p[["y"]]])
    same(both, want)
    m = f.melt(["g"], ["x", "y"]).spark().toPandas()
    assert len(m) == 2 * len(p) and set(m.columns) == {"g", "variable", "value"}
    t = f.pivot_table("y", "g", "s", "sum").to_pandas()
    want = p.pivot_table(values="y", index="g", columns="s", aggfunc="sum")
    assert np.allclose(t[want.columns].astype(float), want, equal_nan=True)


def test_alignment_by_index(f, p):
    got = (f[f["x"] > 3][["y"]] + f[f["x"] < 6][["y"]]).to_pandas()
    want = p[p["x"] > 3][["y"]] + p[p["x"] < 6][["y"]]
    assert_frame_equal(got.astype(float), want, check_names=False)


def test_changed_column_is_not_taken_for_the_old_one(f, p):
    smooth = f[["y"]].rolling(3).mean()
    same(f[["y"]].assign(z=smooth["y"]), p[["y"]].assign(z=p["y"].rolling(3).mean()))


def test_nan_and_null_are_one(spark):
    f = Frame.of(spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "k int, x double"), index="k", order="k")
    assert f["x"].count() == 1 and f["x"].sum() == 1.0 and f["x"].isna().to_list() == [True, True, False]


def test_empty_frame(spark):
    f = Frame(spark.createDataFrame([], "k int, x double"), "k", "k")
    assert f.empty and len(f) == 0 and f["x"].sum() == 0 and f["x"].mean() is None
    assert len(f[["x"]].cumsum()) == 0 and len(f[["x"]].rolling(3).mean()) == 0 and len(f.groupby("k").sum()) == 0
