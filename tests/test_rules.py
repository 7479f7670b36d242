"""No caps, no dropped rows: cases that a limit or a silent filter would get wrong."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import discretize as dz
from riskpanel.operators import features as fx
from riskpanel.operators import metrics as mt
from riskpanel.operators import structure as stx
from riskpanel.operators import walkforward as wf


def test_hill_climb_has_no_parent_limit(spark):
    rows = [("k", a, b, c, int(a + b + c >= 2)) for a in (0, 1) for b in (0, 1) for c in (0, 1) for _ in range(250)]
    df = spark.createDataFrame(rows, "key string, a int, b int, c int, y int")
    nodes = ["a", "b", "c", "y"]
    scores = stx.bic_scores(stx.joint_counts(df, nodes, keys=["key"]), nodes, keys=["key"])
    assert scores.count() == 4 * 8
    edges = {(r.parent, r.child) for r in stx.hill_climb(scores, nodes, keys=["key"]).collect()}
    assert edges == {("a", "y"), ("b", "y"), ("c", "y")}


def test_kmeans_runs_to_the_fixed_point(spark):
    rnd = random.Random(1)
    vals = [rnd.lognormvariate(0, 1.2) for _ in range(2500)]
    df = spark.createDataFrame([("k", i, "v", v) for i, v in enumerate(vals)], "key string, date int, col_name string, value double")
    got = dz.kmeans_long(df, keys=["key"], k=3, centroids_out="cent")
    cent = np.array(got.select("cent").first()[0])
    label = {r.date: r.state for r in got.collect()}
    near = [int(np.argmin(np.abs(v - cent))) for v in vals]
    assert [label[i] for i in range(len(vals))] == near
    again = [np.mean([v for v, j in zip(vals, near) if j == c]) for c in range(3)]
    assert np.allclose(again, cent, rtol=1e-12)


def test_confusion_matrix_keeps_every_label(spark):
    pairs = [(0, 0), (0, 7), (7, 7), (-3, 0), (7, 0), (7, 7), (None, 1), (1, None)]
    df = spark.createDataFrame([("k", a, b) for a, b in pairs], "key string, t int, p int")
    got = {(r.y_true, r.y_pred): r.n for r in mt.confusion_matrix(df, "t", "p", keys=["key"]).collect()}
    assert got == {(a, b): pairs.count((a, b)) for a in (0, 7, -3) for b in (0, 7, -3)}


def test_two_slice_keeps_pairs_with_nulls(spark):
    rows = [("k", 1, None, 1), ("k", 2, 5, None), ("k", 3, None, 3), ("k", 4, 6, 4), ("j", 1, 1, 1)]
    df = spark.createDataFrame(rows, "key string, date int, x int, y int")
    for nodes in (["x", "y"], ["y", "x"]):
        got = sorted((r.date, r.x_t0, r.x_t1, r.y_t0, r.y_t1) for r in wf.two_slice(df, nodes, keys=["key"]).collect())
        assert len(got) == 3 and got[0] == (2, None, 5, 1, None)


def test_trailing_months_includes_the_boundary(spark):
    days = [dt.date(2020, 3, 30), dt.date(2020, 3, 31), dt.date(2020, 7, 1), dt.date(2021, 11, 30)]
    df = spark.createDataFrame([("k", d) for d in days] + [("j", dt.date(1999, 1, 1))], "key string, date date")
    got = sorted(r.date for r in fx.trailing_months(df, 20, keys=["key"]).where("key = 'k'").collect())
    assert got == days  # 20 months before 2021-11-30 is 2020-03-30


def test_missing_label_is_an_error(spark):
    want = spark.createDataFrame([("k", dt.date(2020, 1, 1)), ("k", dt.date(2020, 2, 1))], "key string, date date")
    table = spark.createDataFrame([("k", dt.date(2020, 1, 1), 1.0), ("k", dt.date(2020, 3, 1), 3.0)], "key string, date date, r double")
    assert fx.lookup_required(want.limit(1), table, keys=["key"]).count() == 1
    with pytest.raises(Exception, match="no row for label k 2020-02-01"):
        fx.lookup_required(want, table, keys=["key"]).collect()


def test_ensure_lags_takes_existing_lags(spark):
    df = spark.createDataFrame([("k", 1, 1.0, 5.0, 0.5, 1), ("k", 2, 2.0, 6.0, 0.6, 0)], "key string, date int, a double, b double, a_1 double, REGIME int")
    out = fx.ensure_lags(df, keys=["key"])
    assert out.columns == ["key", "date", "a", "b", "a_1", "b_1", "REGIME"]
    assert [tuple(r) for r in out.collect()] == [("k", 2, 2.0, 6.0, 0.6, 5.0, 0)]
    assert fx.ensure_lags(out, keys=["key"]).count() == 1


def test_special_functions():
    x = np.array([1e-6, 0.3, 1.0, 2.5, 7.0, 41.5, 1000.25])
    assert np.allclose(stx.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)
    assert np.isnan(stx.log_gamma(np.array([0.0, -1.0]))).all()
    # closed forms and a numeric integral of the density
    assert stx.chi2_survival([3.0, 0.0, 3.0], [2, 4, 0])[:2].tolist() == [math.exp(-1.5), 1.0]
    for k in (1, 3, 4, 9, 26):
        for v in (0.5, 4.0, 20.0, 60.0):
            t = np.linspace(v, v + 400, 400_001)
            f = np.exp((k / 2 - 1) * np.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
            assert abs(stx.chi2_survival([v], [k])[0] - np.trapezoid(f, t)) < 2e-7


def test_release_deletes_tables(spark):
    from riskpanel import session
    before = len(session._WRITTEN)
    t = session.materialize(spark.range(5).where(F.col("id") > 1))
    assert t.count() == 3 and len(session._WRITTEN) == before + 1
    path = session._WRITTEN[-1]
    session._WRITTEN[:] = [path]
    assert session.release(spark) == 1 and session.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_savgol_window_follows_each_series(spark):
    """Keys longer and shorter than seven months, against a direct sum."""
    from riskpanel.operators import interpolate as ip
    rnd = random.Random(6)
    series = {"long": 400, "short": 100, "tiny": 7}
    data = {k: [rnd.gauss(0, 1) for _ in range(n)] for k, n in series.items()}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), v) for k, ys in data.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "key string, date date, y double")
    out = ip.savgol(df, "y", "s", keys=["key"], months=7, polyorder=3)
    assert out.columns == ["key", "date", "y", "s"]
    got = {(r.key, r.date): r.s for r in out.collect()}
    for k, ys in data.items():
        width = ip.savgol_window(7, 3, len(ys))
        assert width <= len(ys) and width % 2
        c, h = ip.savgol_coefficients(width, 3), width // 2
        for i in range(len(ys)):
            want = sum(c[j + h] * ys[min(max(i + j, 0), len(ys) - 1)] for j in range(-h, h + 1))
            assert abs(got[k, dt.date(2020, 1, 1) + dt.timedelta(i)] - want) < 1e-9
