"""Golden values (FIXTURES.md section 3) and brute-force checks for the
series operators: W3, W6, W7, W9, W12, D1, D2, A10, A15, F3, I2."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from riskpanel.functions import calendar as cal
from riskpanel.operators import discretize as dz
from riskpanel.operators import features as fx
from riskpanel.operators import metrics as mt
from riskpanel.operators import regime as rg

N = None


def _series(spark, vals, key="k", start=dt.date(2020, 1, 1), vtype="double"):
    rows = [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, f"key string, date date, v {vtype}")


def _col(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_pct_change_pad(spark):
    out = fx.pct_change(_series(spark, [1, N, 2, N]), "v", "p", keys=["key"])
    assert _col(out, "p") == [None, 0.0, 1.0, 0.0]
    none = fx.pct_change(_series(spark, [1, N, 2, N]), "v", "p", keys=["key"], fill="none")
    assert _col(none, "p") == [None, None, None, None]


def test_centered_rolling_mean(spark):
    out = _col(fx.rolling_mean(_series(spark, range(30)), "v", "m", 12, keys=["key"], center=True), "m")
    valid = [i for i, v in enumerate(out) if v is not None]
    assert valid[0] == 6 and out[6] == 5.5 and valid[-1] == 24


def test_trailing_rolling_mean_needs_full_window(spark):
    out = _col(fx.rolling_mean(_series(spark, [1, 2, N, 4, 5, 6]), "v", "m", 3, keys=["key"]), "m")
    assert out == [None, None, None, None, None, 5.0]


def test_missing_span_mask(spark):
    vals = [N, N, 1, N, N, N]  # all-null rows: T,T,F,T,T,T
    df = _series(spark, vals).withColumn("w", F.col("v"))
    out = _col(rg.missing_span_mask(df, ["v", "w"], keys=["key"], out="m"), "m")
    assert out == [False, True, False, False, True, True]


def _hysteresis_loop(lab, h):
    sm = list(lab)
    for t in range(1, len(lab)):
        prev, cur = sm[t - 1], sm[t]
        if cur is None:
            continue
        if cur != prev:
            window = lab[t:t + h + 1]
            if sum(1 for x in window if x == cur) < h + 1:
                sm[t] = prev
    return sm


@pytest.mark.parametrize("h", [0, 1, 2, 3])
def test_hysteresis_matches_loop(spark, h):
    rnd = random.Random(h)
    series = {f"s{i}": [rnd.choice([0, 1, 2, 1, None]) for _ in range(rnd.randint(1, 40))] for i in range(40)}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for k, vals in series.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "key string, date date, lab int")
    out = rg.hysteresis(df, "lab", "sm", keys=["key"], h=h).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.key, r.date)):
        got.setdefault(r.key, []).append(r.sm)
    for k, vals in series.items():
        assert got[k] == _hysteresis_loop(vals, h), k


def test_rule_label_precedence(spark):
    df = spark.createDataFrame([(30.0, 0.0), (10.0, -0.5), (10.0, 0.5), (20.0, 0.0), (None, 0.5), (None, None)],
                               "vix double, chg double")
    got = [r[0] for r in df.select(rg.rule_label("vix", "chg")).collect()]
    assert got == [0, 2, 0, 1, 0, 1]


def _d2(spark, vals, k=3):
    lg = _series(spark, vals).withColumn("col_name", F.lit("v")).withColumnRenamed("v", "value")
    return _col(dz.equal_freq_long(lg, keys=["key"], k=k), "state")


def test_equal_freq_goldens(spark):
    assert _d2(spark, range(5)) == [0, 0, 1, 2, 2]
    assert _d2(spark, range(7)) == [0, 0, 1, 1, 2, 2, 2]
    assert _d2(spark, [1] * 6 + [0] * 2 + [1] * 4) == [0, 0, 1, 1, 1, 1, 0, 0, 2, 2, 2, 2]
    assert _d2(spark, [3.0]) == [None]


def _lloyd(vals, k=3):
    import numpy as np
    x = np.array([v for v in vals if v is not None], float)
    cent = np.array([np.percentile(x, 100 * (j + 0.5) / k) for j in range(k)])
    ux, cnt = np.unique(x, return_counts=True)
    while True:
        j = np.argmin(np.abs(ux[:, None] - cent[None, :]), axis=1)
        new = np.array([(ux[j == c] * cnt[j == c]).sum() / cnt[j == c].sum() if (j == c).any() else cent[c]
                        for c in range(k)])
        if np.array_equal(new, cent):
            break
        cent = new
    return [None if v is None else int(np.argmin(np.abs(v - cent))) for v in vals]


def test_kmeans_matches_reference_loop(spark):
    rnd = random.Random(3)
    vals = [round(rnd.gauss(0, 1) + (3 if i % 3 == 0 else 0), 3) for i in range(300)] + [None]
    lg = _series(spark, vals).withColumn("col_name", F.lit("v")).withColumnRenamed("v", "value")
    got = _col(dz.kmeans_long(lg, keys=["key"], k=3), "state")
    assert got == _lloyd(vals)


def test_kmeans_low_cardinality_uses_rank_bins(spark):
    vals = [1] * 6 + [0] * 2 + [1] * 4
    lg = _series(spark, vals).withColumn("col_name", F.lit("v")).withColumnRenamed("v", "value")
    assert _col(dz.kmeans_long(lg, keys=["key"], k=3), "state") == [0, 0, 1, 1, 1, 1, 0, 0, 2, 2, 2, 2]


def test_max_drawdown_golden(spark):
    df = _series(spark, [-0.1, 0.05, -0.02])
    assert abs(mt.max_drawdown(df, "v", keys=["key"]).first().max_drawdown - (-0.02)) < 1e-12


def test_sortino_single_negative_is_null(spark):
    r = mt.sharpe_sortino(_series(spark, [0.1, -0.05, 0.02]), "v", keys=["key"]).first()
    assert r.sortino is None and r.sharpe is not None
    ex = [0.1, -0.05, 0.02]
    mean = sum(ex) / 3
    sd = math.sqrt(sum((e - mean) ** 2 for e in ex) / 2)
    assert abs(r.sharpe - math.sqrt(12) * mean / sd) < 1e-12


def test_auc_and_f1_brute_force(spark):
    rnd = random.Random(5)
    rows = [("k", rnd.choice([0, 1, 2]), rnd.choice([0, 1, 2]), rnd.choice([0.1, 0.2, 0.3, 0.5, 0.9]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, y int, yhat int, p double")
    r = mt.classification_metrics(df, "y", "yhat", "p", keys=["k"]).first()
    pos = [p for _, y, _, p in rows if y == 0]
    neg = [p for _, y, _, p in rows if y != 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(r.auc_off - auc) < 1e-12
    labels = sorted({y for _, y, _, _ in rows} | {yh for _, _, yh, _ in rows})
    f1s = []
    for lab in labels:
        tp = sum(1 for _, y, yh, _ in rows if y == lab and yh == lab)
        fp = sum(1 for _, y, yh, _ in rows if y != lab and yh == lab)
        fn = sum(1 for _, y, yh, _ in rows if y == lab and yh != lab)
        f1s.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    assert abs(r.f1_macro - sum(f1s) / len(f1s)) < 1e-12
    brier = sum((p - (y == 0)) ** 2 for _, y, _, p in rows) / len(rows)
    assert abs(r.brier_off - brier) < 1e-12


def test_two_digit_year_pivot(spark):
    df = spark.createDataFrame([("Apr-87",), ("Apr-69",), ("Apr-68",), ("junk",)], "s string")
    got = [r[0] for r in df.select(cal.parse_date("s", "MMM-yy", two_digit_year=True)).collect()]
    assert [d.year if d else None for d in got] == [1987, 1969, 2068, None]


def test_time_interpolation_golden(spark):
    from riskpanel.operators import interpolate as ip
    out = ip.interpolate_time(_series(spark, [N, 1, N, 3, N]), "v", "o", keys=["key"])
    assert _col(out, "o") == [None, 1.0, 2.0, 3.0, 3.0]


def test_months_to_odd_days():
    assert cal.months_to_odd_days(3.0, 2, 1000) == 91
    assert cal.months_to_odd_days(3.0, 2, 50) == 49
    assert cal.months_to_odd_days(0.01, 2, 1000) == 5


def test_gmm_states_separates_clusters(spark):
    rnd = random.Random(8)
    rows = []
    for key in ("a", "b"):
        for i in range(150):
            c = i % 3
            rows.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=i), rnd.gauss(c * 5, 0.3),
                         rnd.gauss(-c * 5, 0.3), float(c)))
    df = spark.createDataFrame(rows, "key string, date date, f1 double, f2 double, ret double")
    out = rg.gmm_states(df, ["f1", "f2"], keys=["key"], ret_col="ret").collect()
    # states ordered by mean return, so state == true cluster index
    assert all(r.gmm_state == int(r.ret) for r in out)


@pytest.mark.parametrize("h", [1, 2, 3])
def test_blocked_hysteresis_equals_plain(spark, h):
    from riskpanel.operators import blocks
    rnd = random.Random(10 + h)
    rows = []
    for key in ("a", "b"):
        for i in range(400):
            rows.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=i), rnd.choice([0, 1, 1, 2, None])))
    df = spark.createDataFrame(rows, "key string, date date, lab int").withColumn(
        "blk", (F.dayofyear("date") / 2).cast("int") + F.year("date") * 1000)   # many tiny blocks (1-2 rows)
    plain = {(r.key, r.date): r.sm for r in rg.hysteresis(df, "lab", "sm", keys=["key"], h=h).collect()}
    blocked = {(r.key, r.date): r.sm for r in
               blocks.hysteresis(df, "lab", "sm", keys=["key"], order=["date"], block="blk", h=h).collect()}
    assert blocked == plain


def test_blocked_pct_change_equals_plain(spark):
    rnd = random.Random(2)
    rows = [("k", dt.date(2000, 1, 1) + dt.timedelta(days=i), None if rnd.random() < 0.3 else rnd.uniform(1, 2))
            for i in range(500)]
    df = spark.createDataFrame(rows, "key string, date date, v double").withColumn("blk", F.month("date") + F.year("date") * 100)
    plain = {r.date: r.p for r in fx.pct_change(df, "v", "p", keys=["key"]).collect()}
    blocked = {r.date: r.p for r in fx.pct_change(df, "v", "p", keys=["key"], block="blk").collect()}
    assert blocked == plain


def test_drop_all_null_columns_and_ensure_lags(spark):
    df = spark.createDataFrame([("k", dt.date(2020, 1, 1), 1.0, None, 5.0), ("k", dt.date(2020, 1, 2), 2.0, None, 6.0),
                                ("k", dt.date(2020, 1, 3), 3.0, None, 7.0)],
                               "key string, date date, a double, empty double, REGIME double")
    assert fx.drop_all_null_columns(df).columns == ["key", "date", "a", "REGIME"]
    ev = fx.ensure_lags(df.drop("empty"), keys=["key"], drop_col="REGIME")
    assert ev.columns == ["key", "date", "a", "a_1"]
    assert [(r.a, r.a_1) for r in ev.orderBy("date").collect()] == [(2.0, 1.0), (3.0, 2.0)]
