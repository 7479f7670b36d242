"""Registered queries: one per operator of the survey inventory, each a
Spark plan over the driver tables plus (where SQL can say it) the DuckDB
oracle. Doubles are rounded identically on both sides where summation
order may differ.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.operators import features as fx
from riskpanel.operators import regime as rg
from riskpanel.plans import panels, sqlparts as sp
from riskpanel.plans.feature_table import build_feature_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROUND = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def q(c, digits: int = ROUND):
    """Round as round(x * 10^d) / 10^d: the scaled product is the same IEEE
    double in Spark and DuckDB and both round its halves away from zero."""
    col = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.round(col * F.lit(s), 0) / F.lit(s)


def qs(expr: str, digits: int = ROUND) -> str:
    return f"(round(({expr}) * 1e{digits}) / 1e{digits})"


def rnd(df: DataFrame, cols: list[str], digits: int = ROUND) -> DataFrame:
    return df.withColumns({c: q(c, digits) for c in cols})


def rsql(cols: list[str], digits: int = ROUND, alias_prefix: str = "") -> str:
    return ", ".join(f"{qs(alias_prefix + c, digits)} AS {c}" for c in cols)


# ------------------------------------------------------------------ shared panels
def nation_features(spark, sf_dir) -> DataFrame:
    return build_feature_table(panels.nation_month_long(spark, sf_dir), keys=["nation"])


def flag_features(spark, sf_dir) -> DataFrame:
    return build_feature_table(panels.flag_day_long(spark, sf_dir), keys=["flag"])


def nation_regime(spark, sf_dir, h: int = 1) -> DataFrame:
    return rg.hybrid_regime(nation_features(spark, sf_dir), keys=["nation"], vix_col="vix",
                            spread_chg_col="ig_spread_chg", h=h, out="regime")


def flag_regime(spark, sf_dir, h: int = 1) -> DataFrame:
    return rg.hybrid_regime(flag_features(spark, sf_dir), keys=["flag"], vix_col="vix",
                            spread_chg_col="ig_spread_chg", h=h, out="regime")


F8 = panels.FEATURES
NM = "WITH RECURSIVE " + sp.NATION_MONTH + "," + sp.features("nation")
FD = "WITH RECURSIVE " + sp.FLAG_DAY + "," + sp.features("flag")


# ------------------------------------------------------------------ X1 / D5 / P10 / W12
@register("q_x1_feature_table", NM + f"SELECT nation, date, {rsql(F8)} FROM feat")
def q_x1_feature_table(spark, sf_dir):
    return rnd(nation_features(spark, sf_dir), F8)


@register("q_d5_regime_summary", NM + "," + sp.regime("nation") + f"""
SELECT regime, count(*) AS n_rows, count(DISTINCT nation) AS n_keys,
       {qs("avg(spx_ret)")} AS avg_spx_ret, {qs("avg(bond_ret)")} AS avg_bond_ret,
       {qs("avg(vix)")} AS avg_vix
FROM reg GROUP BY regime""")
def q_d5_regime_summary(spark, sf_dir):
    reg = nation_regime(spark, sf_dir)
    return (reg.groupBy("regime")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("nation").alias("n_keys"),
                 q(F.avg("spx_ret")).alias("avg_spx_ret"),
                 q(F.avg("bond_ret")).alias("avg_bond_ret"),
                 q(F.avg("vix")).alias("avg_vix")))


@register("q_p10_rule_labels", NM + f"""
SELECT nation, date, {rsql(["vix", "ig_spread_chg"])},
       CASE WHEN vix < 15.0 AND ig_spread_chg < -0.20 THEN 2
            WHEN vix > 25.0 OR ig_spread_chg > 0.40 THEN 0 ELSE 1 END AS rule_state
FROM feat""")
def q_p10_rule_labels(spark, sf_dir):
    f = nation_features(spark, sf_dir)
    out = f.select("nation", "date", "vix", "ig_spread_chg",
                   rg.rule_label("vix", "ig_spread_chg").alias("rule_state"))
    return rnd(out, ["vix", "ig_spread_chg"])


@register("q_w12_hysteresis", FD + "," + sp.regime("flag", h=1) + f"""
SELECT flag, date, {rsql(["vix", "ig_spread_chg"])}, regime FROM reg""")
def q_w12_hysteresis(spark, sf_dir):
    r = flag_regime(spark, sf_dir, h=1)
    return rnd(r.select("flag", "date", "vix", "ig_spread_chg", "regime"), ["vix", "ig_spread_chg"])


@register("q_w12_hysteresis_blocked", FD + "," + sp.regime("flag", h=1) + f"""
SELECT flag, date, {rsql(["vix", "ig_spread_chg"])}, regime FROM reg""")
def q_w12_hysteresis_blocked(spark, sf_dir):
    """Same labels as q_w12_hysteresis through the blocked scan (block = year):
    the form for one very long series or a hot key."""
    f = flag_features(spark, sf_dir).withColumn("year", F.year("date"))
    r = rg.hybrid_regime(f, keys=["flag"], vix_col="vix", spread_chg_col="ig_spread_chg", h=1, out="regime",
                         block="year")
    return rnd(r.select("flag", "date", "vix", "ig_spread_chg", "regime"), ["vix", "ig_spread_chg"])


@register("q_w12_hysteresis_h3", FD + "," + sp.regime("flag", h=3) + """
SELECT flag, date, regime FROM reg""")
def q_w12_hysteresis_h3(spark, sf_dir):
    return flag_regime(spark, sf_dir, h=3).select("flag", "date", "regime")


_GAP = "day(date) BETWEEN 6 AND 9"


@register("q_j5_when_fired_gaps", FD + f""", base AS (SELECT flag, date, CASE WHEN {_GAP} THEN NULL ELSE vix END AS vix,
    CASE WHEN {_GAP} THEN NULL ELSE ig_spread_chg END AS ig_spread_chg, CASE WHEN day(date) <> 20 THEN month(date) % 3 END AS state FROM feat),"""
          + sp.regime("flag", src="base", h=1, base="state") + f"SELECT flag, date, {rsql(['vix', 'ig_spread_chg'])}, state, regime FROM reg")
def q_j5_when_fired_gaps(spark, sf_dir):
    """J5, W7 and W12 over spans without inputs: a state of the calendar stands for the mixture's label, days 6 to 9 of
    each month have no inputs (no rule fires and the span is masked from its second day on), day 20 has no state."""
    gap = F.expr(_GAP)
    f = flag_features(spark, sf_dir).select(
        "flag", "date", F.when(~gap, F.col("vix")).alias("vix"), F.when(~gap, F.col("ig_spread_chg")).alias("ig_spread_chg"),
        F.when(F.day("date") != 20, F.month("date") % 3).alias("state"))
    out = rg.hybrid_regime(f, keys=["flag"], vix_col="vix", spread_chg_col="ig_spread_chg", h=1, out="regime",
                           override="when_fired", base_col="state")
    return rnd(out.select("flag", "date", "vix", "ig_spread_chg", "state", "regime"), ["vix", "ig_spread_chg"])


# ------------------------------------------------------------------ quality on raw events
from riskpanel.operators import quality as qa  # noqa: E402

EV = """WITH ev AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events)"""
EVW = "(PARTITION BY user_id ORDER BY ts, event_id)"
UD = EV + ", ud AS (SELECT DISTINCT user_id, date FROM ev)"


def _runs_sql(col: str) -> str:
    return (f"CAST(sum(CASE WHEN {col} IS NULL AND coalesce(lead({col} IS NULL) OVER {EVW}, FALSE)"
            f" AND NOT coalesce(lag({col} IS NULL) OVER {EVW}, FALSE) THEN 1 ELSE 0 END) AS BIGINT)")


@register("q_q1_null_runs", EV + f""",
fl AS (SELECT user_id,
    value IS NULL AND coalesce(lead(value IS NULL) OVER {EVW}, FALSE) AND NOT coalesce(lag(value IS NULL) OVER {EVW}, FALSE) AS sv,
    event_type IS NULL AND coalesce(lead(event_type IS NULL) OVER {EVW}, FALSE) AND NOT coalesce(lag(event_type IS NULL) OVER {EVW}, FALSE) AS se
  FROM ev),
agg AS (SELECT user_id, CAST(sum(CAST(sv AS INT)) AS BIGINT) AS value, CAST(sum(CAST(se AS INT)) AS BIGINT) AS event_type FROM fl GROUP BY user_id)
SELECT user_id, 'value' AS col_name, value AS n_runs FROM agg
UNION ALL SELECT user_id, 'event_type' AS col_name, event_type AS n_runs FROM agg""")
def q_q1_null_runs(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.count_null_runs(ev, ["value", "event_type"], keys=["user_id"], order=["ts", "event_id"], block="date")


@register("q_q1_null_run_spans", EV + f""",
fl AS (SELECT user_id, ts, row_number() OVER {EVW} AS pos,
    value IS NULL AS nv, coalesce(lag(value IS NULL) OVER {EVW}, FALSE) AS pv, coalesce(lead(value IS NULL) OVER {EVW}, FALSE) AS xv,
    event_type IS NULL AS ne, coalesce(lag(event_type IS NULL) OVER {EVW}, FALSE) AS pe, coalesce(lead(event_type IS NULL) OVER {EVW}, FALSE) AS xe
  FROM ev),
ed AS (SELECT user_id, 'value' AS col_name, ts, pos, (nv AND xv AND NOT pv) AS s FROM fl WHERE (nv AND xv AND NOT pv) OR (nv AND pv AND NOT xv)
       UNION ALL
       SELECT user_id, 'event_type' AS col_name, ts, pos, (ne AND xe AND NOT pe) AS s FROM fl WHERE (ne AND xe AND NOT pe) OR (ne AND pe AND NOT xe)),
pr AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, col_name ORDER BY pos) AS ets,
              lead(pos) OVER (PARTITION BY user_id, col_name ORDER BY pos) AS epos FROM ed)
SELECT user_id, col_name, ts AS run_start, ets AS run_end, CAST(epos - pos + 1 AS BIGINT) AS length FROM pr WHERE s""")
def q_q1_null_run_spans(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.null_run_spans(ev, ["value", "event_type"], keys=["user_id"], order=["ts", "event_id"], block="date")


@register("q_a1_null_profile", EV + f""",
fl AS (SELECT user_id, CAST(value IS NULL AS INT) + CAST(event_type IS NULL AS INT) AS nn,
    CAST(value IS NULL AND coalesce(lead(value IS NULL) OVER {EVW}, FALSE) AND NOT coalesce(lag(value IS NULL) OVER {EVW}, FALSE) AS INT)
  + CAST(event_type IS NULL AND coalesce(lead(event_type IS NULL) OVER {EVW}, FALSE) AND NOT coalesce(lag(event_type IS NULL) OVER {EVW}, FALSE) AS INT) AS runs
  FROM ev)
SELECT user_id, CAST(sum(nn) AS BIGINT) AS total_nulls, CAST(sum(runs) AS BIGINT) AS null_runs,
       CAST(sum(CASE WHEN nn >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS rows_ge2_nulls,
       CAST(sum(CASE WHEN nn >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS rows_any_null,
       sum(CASE WHEN nn >= 1 THEN 1 ELSE 0 END) <= 15 AS detail_listed
FROM fl GROUP BY user_id""")
def q_a1_null_profile(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.null_profile(ev, ["value", "event_type"], keys=["user_id"], order=["ts", "event_id"], block="date")


@register("q_p9_rows_with_nulls", EV + """
SELECT event_id, user_id, date, value, event_type FROM ev WHERE value IS NULL OR event_type IS NULL""")
def q_p9_rows_with_nulls(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir).select("event_id", "user_id", "date", "value", "event_type")
    return qa.rows_with_nulls(ev, ["value", "event_type"])


@register("q_u1_duplicate_dates", EV + """
SELECT event_id, user_id, date, value, CAST(count(*) OVER (PARTITION BY user_id, date) AS BIGINT) AS n_dup
FROM ev QUALIFY count(*) OVER (PARTITION BY user_id, date) > 1""")
def q_u1_duplicate_dates(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir).select("event_id", "user_id", "date", "value")
    return qa.find_duplicate_dates(ev, keys=["user_id"], date_col="date")


@register("q_a2_duplicate_summary", EV + """,
per AS (SELECT user_id, date, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS dup_rows,
       CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS dup_dates,
       CAST(sum(n) - count(*) AS BIGINT) AS extra_copies
FROM per GROUP BY user_id""")
def q_a2_duplicate_summary(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.duplicate_summary(ev, keys=["user_id"], date_col="date")


@register("q_u3_keep_first", EV + """
SELECT user_id, date, event_id, ts, value, event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts, event_id) = 1""")
def q_u3_keep_first(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.resolve_duplicates(ev, "first", keys=["user_id"], date_col="date", tiebreak=["ts", "event_id"])


@register("q_u4_keep_last", EV + """
SELECT user_id, date, event_id, ts, value, event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1""")
def q_u4_keep_last(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    return qa.resolve_duplicates(ev, "last", keys=["user_id"], date_col="date", tiebreak=["ts", "event_id"])


@register("q_a3_take_mean", EV + f""",
fst AS (SELECT user_id, date, ts, event_type FROM ev
        QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts, event_id) = 1),
mn AS (SELECT user_id, date, avg(event_id) AS event_id, avg(value) AS value FROM ev GROUP BY 1, 2)
SELECT user_id, date, {qs("mn.event_id")} AS event_id, ts, {qs("mn.value")} AS value, event_type
FROM fst JOIN mn USING (user_id, date)""")
def q_a3_take_mean(spark, sf_dir):
    ev = panels.user_events(spark, sf_dir)
    out = qa.resolve_duplicates(ev, "mean", keys=["user_id"], date_col="date", tiebreak=["ts", "event_id"])
    return rnd(out, ["event_id", "value"])


@register("q_w13_unusual_gaps", UD + """,
g AS (SELECT user_id, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS prev_date, date AS next_date FROM ud),
g2 AS (SELECT *, CAST(next_date - prev_date AS INTEGER) AS gap_days FROM g),
g3 AS (SELECT *, coalesce(isodow(prev_date) = 5 AND isodow(next_date) = 1 AND gap_days = 3, FALSE) AS wk FROM g2)
SELECT user_id, prev_date, next_date, gap_days FROM g3 WHERE coalesce(gap_days > 1 AND NOT wk, FALSE)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY next_date) <= 10""")
def q_w13_unusual_gaps(spark, sf_dir):
    ud = panels.user_events(spark, sf_dir).select("user_id", "date").distinct()
    return qa.unusual_gaps(ud, keys=["user_id"], date_col="date", limit=10)


@register("q_a4_gap_histogram", UD + """,
g AS (SELECT user_id, CAST(date - lag(date) OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS gap_days FROM ud)
SELECT user_id, gap_days, count(*) AS n FROM g WHERE gap_days IS NOT NULL GROUP BY 1, 2""")
def q_a4_gap_histogram(spark, sf_dir):
    ud = panels.user_events(spark, sf_dir).select("user_id", "date").distinct()
    return qa.gap_histogram(ud, keys=["user_id"], date_col="date")


_GAPSTATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@register("q_u5_gap_report", UD + f""",
g AS (SELECT user_id, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS prev_date, date FROM ud),
g2 AS (SELECT *, CAST(date - prev_date AS INTEGER) AS gap_days FROM g),
g3 AS (SELECT *, coalesce(isodow(prev_date) = 5 AND isodow(date) = 1 AND gap_days = 3, FALSE) AS wk FROM g2),
c AS (SELECT user_id, CAST(sum(CAST(wk AS INT)) AS BIGINT) AS weekend_gaps,
             CAST(sum(CAST(coalesce(gap_days > 1 AND NOT wk, FALSE) AS INT)) AS BIGINT) AS unusual_gaps FROM g3 GROUP BY 1),
d AS (SELECT user_id, count(gap_days) AS count, avg(gap_days) AS mean, stddev_samp(gap_days) AS std,
             CAST(min(gap_days) AS DOUBLE) AS min, quantile_cont(gap_days, 0.25) AS p25, quantile_cont(gap_days, 0.5) AS p50,
             quantile_cont(gap_days, 0.75) AS p75, CAST(max(gap_days) AS DOUBLE) AS max
      FROM g3 WHERE gap_days IS NOT NULL GROUP BY 1)
SELECT c.user_id, weekend_gaps, unusual_gaps, count, {rsql(_GAPSTATS, alias_prefix="d.")}
FROM c LEFT JOIN d USING (user_id)""")
def q_u5_gap_report(spark, sf_dir):
    ud = panels.user_events(spark, sf_dir).select("user_id", "date").distinct()
    return rnd(qa.gap_report(ud, keys=["user_id"], date_col="date"), _GAPSTATS)


@register("q_a6_valid_span", EV + """
SELECT user_id, min(date) AS first_valid, max(date) AS last_valid FROM ev WHERE value IS NOT NULL GROUP BY 1""")
def q_a6_valid_span(spark, sf_dir):
    return qa.valid_span(panels.user_events(spark, sf_dir), "value", keys=["user_id"], date_col="date")


@register("q_a21_monotonic", """
SELECT user_id, bool_and(coalesce(ts >= lag_ts, TRUE)) AS monotonic FROM (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_ts FROM events) GROUP BY 1""")
def q_a21_monotonic(spark, sf_dir):
    ev = panels.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    ev = ev.withColumn("arrival_block", F.floor(F.col("event_id") / 1000))
    return qa.is_monotonic(ev, "ts", keys=["user_id"], arrival="event_id", block="arrival_block")


# ------------------------------------------------------------------ series preparation
from riskpanel.functions import calendar as cal  # noqa: E402

FDW = "WITH RECURSIVE " + sp.FLAG_DAY
FLW = "(PARTITION BY flag ORDER BY date)"
FLR = "(PARTITION BY flag ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def flag_wide_gappy(spark, sf_dir) -> DataFrame:
    """Daily flag panel with deterministic holes: spx_px NULL on days 6, 12,
    18, 24, 30 of each month (exercises pad semantics and interpolation)."""
    w = panels.flag_day_wide(spark, sf_dir)
    return w.withColumn("spx_px", F.when(F.dayofmonth("date") % 6 != 0, F.col("spx_px")))


GAPPY = FDW + ", gw AS (SELECT * REPLACE (CASE WHEN dayofmonth(date) % 6 <> 0 THEN spx_px END AS spx_px) FROM wide)"


@register("q_w3_pct_change", GAPPY + f""",
f AS (SELECT flag, date, spx_px, last_value(spx_px IGNORE NULLS) OVER {FLR} AS pf FROM gw)
SELECT flag, date, {qs("spx_px", 4)} AS spx_px,
       {qs(f"pf / NULLIF(lag(pf) OVER {FLW}, 0) - 1")} AS ret_pad,
       {qs(f"spx_px / NULLIF(lag(spx_px) OVER {FLW}, 0) - 1")} AS ret_none
FROM f""")
def q_w3_pct_change(spark, sf_dir):
    w = flag_wide_gappy(spark, sf_dir).select("flag", "date", "spx_px")
    w = fx.pct_change(w, "spx_px", "ret_pad", keys=["flag"], fill="pad")
    w = fx.pct_change(w, "spx_px", "ret_none", keys=["flag"], fill="none")
    return w.withColumns({"spx_px": q("spx_px", 4), "ret_pad": q("ret_pad"), "ret_none": q("ret_none")})


@register("q_w1_w2_lag_diff", FDW + f"""
SELECT flag, date, {qs("vix")} AS vix, {qs(f"lag(vix) OVER {FLW}")} AS vix_1,
       {qs(f"vix - lag(vix) OVER {FLW}")} AS vix_diff, {qs(f"lag(vix, 5) OVER {FLW}")} AS vix_5
FROM wide""")
def q_w1_w2_lag_diff(spark, sf_dir):
    w = panels.flag_day_wide(spark, sf_dir).select("flag", "date", "vix")
    w = fx.add_lags(w, ["vix"], keys=["flag"], n=1)
    w = fx.diff(w, "vix", "vix_diff", keys=["flag"])
    w = fx.add_lags(w, ["vix"], keys=["flag"], n=5)
    return rnd(w, ["vix", "vix_1", "vix_diff", "vix_5"])


def _roll_sql(col, lo, hi, need):
    frame = f"(PARTITION BY flag ORDER BY date ROWS BETWEEN {lo} AND {hi})"
    return f"CASE WHEN count({col}) OVER {frame} >= {need} THEN {qs(f'avg({col}) OVER {frame}')} END"


@register("q_w5_w6_rolling_means", FDW + f"""
SELECT flag, date, {_roll_sql("vix", "29 PRECEDING", "CURRENT ROW", 30)} AS vix_ma30,
       {_roll_sql("vix", "6 PRECEDING", "5 FOLLOWING", 12)} AS vix_c12,
       {_roll_sql("vix", "2 PRECEDING", "2 FOLLOWING", 3)} AS vix_c5_min3
FROM wide""")
def q_w5_w6_rolling_means(spark, sf_dir):
    w = panels.flag_day_wide(spark, sf_dir).select("flag", "date", "vix")
    w = fx.rolling_mean(w, "vix", "vix_ma30", 30, keys=["flag"])
    w = fx.rolling_mean(w, "vix", "vix_c12", 12, keys=["flag"], center=True)
    w = fx.rolling_mean(w, "vix", "vix_c5_min3", 5, keys=["flag"], center=True, min_periods=3)
    return rnd(w.drop("vix"), ["vix_ma30", "vix_c12", "vix_c5_min3"])


@register("q_j1_outer_align", f"""
WITH a AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS booked FROM orders GROUP BY 1)
SELECT date, {qs("revenue", 2)} AS revenue, {qs("booked", 2)} AS booked FROM a FULL OUTER JOIN b USING (date)""")
def q_j1_outer_align(spark, sf_dir):
    li = panels.table(spark, sf_dir, "lineitem")
    od = panels.table(spark, sf_dir, "orders")
    a = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    b = od.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("booked"))
    out = fx.outer_align(a, b, keys=[], date_col="date")
    return out.withColumns({"revenue": q("revenue", 2), "booked": q("booked", 2)})


@register("q_j4_reindex_daily", FDW + f""",
b AS (SELECT flag, min(date) AS lo, max(date) AS hi FROM wide GROUP BY 1),
sp AS (SELECT flag, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT sp.flag, sp.date, {qs("w.vix")} AS vix, w.cpu IS NULL AS filled FROM sp LEFT JOIN wide w USING (flag, date)""")
def q_j4_reindex_daily(spark, sf_dir):
    w = panels.flag_day_wide(spark, sf_dir).select("flag", "date", "vix", "cpu")
    spine = fx.daily_spine(w, keys=["flag"])
    out = fx.reindex(w, spine, keys=["flag"])
    return rnd(out.select("flag", "date", "vix", F.col("cpu").isNull().alias("filled")), ["vix"])


@register("q_j3_returns_on_evidence", NM + f""",
ev AS (SELECT nation, date FROM feat WHERE vix > 25.0)
SELECT nation, date, {qs("spx_ret")} AS equity_ret, {qs("bond_ret")} AS bond_ret FROM feat JOIN ev USING (nation, date)""")
def q_j3_returns_on_evidence(spark, sf_dir):
    f = nation_features(spark, sf_dir)
    ev = f.where(F.col("vix") > 25.0).select("nation", "date")
    ret = f.select("nation", "date", F.col("spx_ret").alias("equity_ret"), F.col("bond_ret").alias("bond_ret"))
    return rnd(fx.lookup_required(ev, ret, keys=["nation"]), ["equity_ret", "bond_ret"])


@register("q_t2_head_tail", NM + f"""
SELECT 'head' AS part, nation, date, {qs("vix")} AS vix FROM feat QUALIFY row_number() OVER (PARTITION BY nation ORDER BY date) <= 5
UNION ALL
SELECT 'tail' AS part, nation, date, {qs("vix")} AS vix FROM feat QUALIFY row_number() OVER (PARTITION BY nation ORDER BY date DESC) <= 5""")
def q_t2_head_tail(spark, sf_dir):
    f = nation_features(spark, sf_dir).select("nation", "date", q("vix").alias("vix"))
    h = fx.head_tail(f, 5, keys=["nation"]).withColumn("part", F.lit("head"))
    t = fx.head_tail(f, 5, keys=["nation"], tail=True).withColumn("part", F.lit("tail"))
    return h.unionByName(t)


@register("q_t4_unpivot_long", NM + f""",
lg AS (UNPIVOT feat ON {", ".join(F8)} INTO NAME series_id VALUE value)
SELECT nation, date, series_id, {qs("value")} AS value FROM lg""")
def q_t4_unpivot_long(spark, sf_dir):
    f = nation_features(spark, sf_dir)
    return rnd(fx.to_long(f, F8, keys=["nation"]), ["value"])


@register("q_p8_trailing_months", NM + f"""
SELECT nation, date, {qs("vix")} AS vix FROM feat
QUALIFY date >= CAST(max(date) OVER (PARTITION BY nation) - INTERVAL 20 MONTH AS DATE)""")
def q_p8_trailing_months(spark, sf_dir):
    f = nation_features(spark, sf_dir).select("nation", "date", q("vix").alias("vix"))
    return fx.trailing_months(f, 20, keys=["nation"])


@register("q_f_calendar", FDW + """
SELECT flag, date, last_day(date) AS month_end, CAST(date_trunc('week', date) AS DATE) AS week_start,
       CAST(isodow(date) - 1 AS INTEGER) AS weekday,
       CAST(date - min(date) OVER (PARTITION BY flag) AS INTEGER) AS day_offset,
       CAST(date + INTERVAL (-20) MONTH AS DATE) AS minus_20m,
       CAST(date_trunc('month', date) AS DATE) AS month_start,
       CAST(month(date) AS INTEGER) AS month_no
FROM wide""")
def q_f_calendar(spark, sf_dir):
    w = panels.flag_day_wide(spark, sf_dir).select("flag", "date")
    label = F.date_format("date", "MMM-yy")            # e.g. 'Apr-97' (2-digit year text)
    ym = F.concat_ws("-", F.year("date").cast("string"), F.lpad(F.month("date").cast("string"), 2, "0"))
    return w.select(
        "flag", "date", cal.month_end("date").alias("month_end"),
        cal.period_start("date", "week").alias("week_start"),
        F.weekday("date").alias("weekday"),
        cal.days_since_first("date", ["flag"]).alias("day_offset"),
        F.add_months("date", -20).alias("minus_20m"),
        cal.parse_date(label, "MMM-yy", two_digit_year=True).alias("month_start"),
        cal.month_lookup(F.date_format("date", "MMM")).alias("month_no"),
    ).where(cal.parse_date(ym, "yyyy-MM") == F.trunc("date", "month"))


# ------------------------------------------------------------------ discretisation
from riskpanel.operators import discretize as dz  # noqa: E402

NODES = panels.NODES
FEAT7 = NODES[:-1]


def flag_long(spark, sf_dir) -> DataFrame:
    return fx.to_long(flag_features(spark, sf_dir).select("flag", "date", *FEAT7), FEAT7, keys=["flag"],
                      series_col="col_name")


FDL = FD + f", lg AS (UNPIVOT (SELECT flag, date, {', '.join(FEAT7)} FROM feat) ON {', '.join(FEAT7)} INTO NAME col_name VALUE value)"


@register("q_d2_equal_freq", FDL + "," + sp.equal_freq_long("flag") + """
SELECT flag, date, col_name, state FROM ef""")
def q_d2_equal_freq(spark, sf_dir):
    return dz.equal_freq_long(flag_long(spark, sf_dir), keys=["flag"], k=3).drop("value")


@register("q_d1_kmeans_bins", FDL + "," + sp.kmeans_long("flag") + """
SELECT flag, date, col_name, state FROM km""")
def q_d1_kmeans_bins(spark, sf_dir):
    return dz.kmeans_long(flag_long(spark, sf_dir), keys=["flag"], k=3).drop("value")


@register("q_d1_kmeans_centroids", FDL + "," + sp.kmeans_long("flag") + f"""
SELECT flag, col_name, {rsql(["c0", "c1", "c2"], alias_prefix="cent.")} FROM cent JOIN seeds USING (flag, col_name) WHERE nd > 3""")
def q_d1_kmeans_centroids(spark, sf_dir):
    lab = dz.kmeans_long(flag_long(spark, sf_dir), keys=["flag"], k=3, centroids_out="cent")
    c = lab.where(F.col("cent").isNotNull()).groupBy("flag", "col_name").agg(F.first("cent").alias("cent"))
    return c.select("flag", "col_name", *[q(F.col("cent")[j]).alias(f"c{j}") for j in range(3)])


@register("q_a20_distinct_counts", FD + f"""
SELECT flag, {", ".join(f"count(DISTINCT {c}) AS {c}" for c in FEAT7)} FROM feat GROUP BY flag""")
def q_a20_distinct_counts(spark, sf_dir):
    return dz.distinct_counts(flag_features(spark, sf_dir), FEAT7, keys=["flag"])


# ------------------------------------------------------------------ metrics
from riskpanel.operators import metrics as mt  # noqa: E402

NWR = "(PARTITION BY nation ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("q_a9_a10_sharpe_sortino", NM + f"""
SELECT nation,
  {qs("sqrt(12) * avg(spx_ret) / NULLIF(stddev_samp(spx_ret), 0)")} AS sharpe,
  {qs("sqrt(12) * avg(spx_ret) / NULLIF(stddev_samp(CASE WHEN spx_ret < 0 THEN spx_ret END), 0)")} AS sortino
FROM feat GROUP BY nation""")
def q_a9_a10_sharpe_sortino(spark, sf_dir):
    return rnd(mt.sharpe_sortino(nation_features(spark, sf_dir), "spx_ret", keys=["nation"]), ["sharpe", "sortino"])


WEALTH = NM + f""",
wl AS (SELECT nation, date, spx_ret, CASE WHEN spx_ret IS NOT NULL THEN product(1 + spx_ret) OVER {NWR} END AS wealth FROM feat),
dd AS (SELECT *, max(wealth) OVER {NWR} AS peak FROM wl)"""


@register("q_w8_w9_drawdown_series", WEALTH + f"""
SELECT nation, date, {rsql(["wealth", "peak"])}, {qs("wealth / peak - 1")} AS drawdown FROM dd""")
def q_w8_w9_drawdown_series(spark, sf_dir):
    f = nation_features(spark, sf_dir).select("nation", "date", "spx_ret")
    out = mt.wealth_drawdown(f, "spx_ret", keys=["nation"])
    return rnd(out.drop("spx_ret"), ["wealth", "peak", "drawdown"])


@register("q_w9_max_drawdown", WEALTH + f"""
SELECT nation, {qs("min(wealth / peak - 1)")} AS max_drawdown FROM dd GROUP BY nation""")
def q_w9_max_drawdown(spark, sf_dir):
    f = nation_features(spark, sf_dir).select("nation", "date", "spx_ret")
    return rnd(mt.max_drawdown(f, "spx_ret", keys=["nation"]), ["max_drawdown"])


def doc_predictions(spark, sf_dir) -> DataFrame:
    """Class labels 0..2 = quality + toxic; prediction from document length;
    p_off = 1000 / (1000 + n_chars) scores class 0."""
    lab = panels.table(spark, sf_dir, "labels")
    doc = panels.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "lang", (F.col("quality") + F.col("toxic")).alias("y_true"),
                    F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 5000, 1).otherwise(2).alias("y_pred"),
                    (F.lit(1000.0) / (F.lit(1000.0) + F.col("n_chars"))).alias("p_off"))


DOCP = """WITH base AS (SELECT doc_id, lang, quality + toxic AS y_true,
    CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 5000 THEN 1 ELSE 2 END AS y_pred,
    1000.0 / (1000.0 + n_chars) AS p_off FROM labels JOIN documents USING (doc_id))"""


@register("q_a11_a15_classification", DOCP + f""",
acc AS (SELECT lang, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n,
               count(DISTINCT CASE WHEN y_true IN (0, 1, 2) THEN y_true END) = 3 AS all3,
               avg(power(p_off - CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END, 2)) AS brier FROM base GROUP BY 1),
cc AS (SELECT lang, y_true, y_pred, count(*) AS n FROM base GROUP BY ALL),
per AS (SELECT lang, l, sum(nt) AS nt, sum(np) AS np, sum(tp) AS tp FROM (
          SELECT lang, y_true AS l, n AS nt, 0 AS np, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM cc
          UNION ALL SELECT lang, y_pred AS l, 0 AS nt, n AS np, 0 AS tp FROM cc) GROUP BY ALL),
f1 AS (SELECT lang, avg(coalesce(2.0 * tp / NULLIF(nt + np, 0), 0.0)) AS f1_macro FROM per GROUP BY 1),
s AS (SELECT lang, p_off AS p, sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS pos, count(*) AS cnt FROM base GROUP BY ALL),
s2 AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (cnt + 1) / 2.0 AS rk FROM s),
a AS (SELECT lang, CAST(sum(pos * rk) AS DOUBLE) AS sr, CAST(sum(pos) AS DOUBLE) AS n1, CAST(sum(cnt) AS DOUBLE) AS nn FROM s2 GROUP BY 1)
SELECT lang, {qs("accuracy")} AS accuracy, n, {qs("f1_macro")} AS f1_macro,
       CASE WHEN all3 THEN {qs("brier")} END AS brier_off,
       CASE WHEN all3 AND n1 > 0 AND nn > n1 THEN {qs("(sr - n1 * (n1 + 1) / 2.0) / (n1 * (nn - n1))")} END AS auc_off
FROM acc JOIN f1 USING (lang) JOIN a USING (lang)""")
def q_a11_a15_classification(spark, sf_dir):
    out = mt.classification_metrics(doc_predictions(spark, sf_dir), "y_true", "y_pred", "p_off", keys=["lang"])
    return rnd(out, ["accuracy", "f1_macro", "brier_off", "auc_off"])


@register("q_a13_confusion", DOCP + """,
cc AS (SELECT lang, y_true, y_pred, count(*) AS n FROM base GROUP BY ALL),
lb AS (SELECT DISTINCT lang, l FROM (SELECT lang, y_true AS l FROM cc UNION ALL SELECT lang, y_pred AS l FROM cc))
SELECT a.lang, a.l AS y_true, b.l AS y_pred, coalesce(cc.n, 0) AS n
FROM lb a JOIN lb b ON a.lang = b.lang LEFT JOIN cc ON cc.lang = a.lang AND cc.y_true = a.l AND cc.y_pred = b.l""")
def q_a13_confusion(spark, sf_dir):
    return mt.confusion_matrix(doc_predictions(spark, sf_dir), "y_true", "y_pred", keys=["lang"])


# ------------------------------------------------------------------ structure tables
from riskpanel.operators import structure as stx  # noqa: E402


def flag_labelled(spark, sf_dir) -> DataFrame:
    return flag_regime(spark, sf_dir).dropna(subset=["regime", "spx_ret", "bond_ret"])


def flag_disc(spark, sf_dir) -> DataFrame:
    """Discretised node table, materialised once per query: every structure and
    walk-forward plan reads it several times."""
    from riskpanel.session import materialize
    lab = flag_labelled(spark, sf_dir).select("flag", "date", *NODES)
    return materialize(dz.discretize_frame(lab, keys=["flag"], method="kmeans", k=3, cols=NODES))


_PIVOT = ", ".join(f"max(CASE WHEN col_name = '{c}' THEN state END) AS {c}" for c in NODES)
DISC = (FD + "," + sp.regime("flag") + f""",
lab AS (SELECT * FROM reg WHERE regime IS NOT NULL AND spx_ret IS NOT NULL AND bond_ret IS NOT NULL),
lg AS (UNPIVOT (SELECT flag, date, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NODES)} FROM lab)
       ON {", ".join(NODES)} INTO NAME col_name VALUE value),""" + sp.kmeans_long("flag") + f""",
disc AS (SELECT flag, date, {_PIVOT} FROM km GROUP BY flag, date)""")
JC = DISC + f", jc AS MATERIALIZED (SELECT flag, {', '.join(NODES)}, count(*) AS n FROM disc GROUP BY ALL)"


@register("q_d3_discretize_frame", DISC + f"""
SELECT flag, date, {", ".join(NODES)} FROM disc""")
def q_d3_discretize_frame(spark, sf_dir):
    return flag_disc(spark, sf_dir)


@register("q_a23_joint_counts", JC + f"""
SELECT flag, {", ".join(NODES)}, n FROM jc""")
def q_a23_joint_counts(spark, sf_dir):
    return stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])


# every family of the eight nodes, and the number of configurations of its parents
FAM = f"""
fam AS {sp.values_table([(c, stx.subset_key(ps), stx.subset_key((*ps, c))) for c, ps in stx.families(NODES)],
                        ["child", "parents", "family"])},
card AS (SELECT flag, subset AS v, cells AS r FROM st WHERE subset <> '' AND NOT contains(subset, ',')),
cfg AS (SELECT card.flag, p.parents, product(card.r) AS q FROM (SELECT DISTINCT parents FROM fam) p
        JOIN card ON list_contains(string_split(p.parents, ','), card.v) GROUP BY ALL)"""


@register("q_d6_bic_scores", JC + "," + sp.subset_stats("flag", NODES, max_size=len(NODES)) + "," + FAM + f""",
s AS (SELECT f.flag, fam.child, fam.parents, f.g - p.g AS ll, f.total AS nn,
             c.r AS rc, coalesce(cfg.q, 1) AS q
      FROM st f JOIN fam ON f.subset = fam.family
      JOIN st p ON p.flag = f.flag AND p.subset = fam.parents
      JOIN card c ON c.flag = f.flag AND c.v = fam.child
      LEFT JOIN cfg ON cfg.flag = f.flag AND cfg.parents = fam.parents)
SELECT flag, child, parents, {qs("ll")} AS loglik, {qs("ll - 0.5 * ln(nn) * CAST(q AS DOUBLE) * CAST(rc - 1 AS DOUBLE)")} AS bic FROM s""")
def q_d6_bic_scores(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return rnd(stx.bic_scores(jc, NODES, keys=["flag"]), ["loglik", "bic"])


def _test_rows(given):
    from itertools import combinations
    rows = []
    for z in given:
        for x, y in combinations(sorted(NODES), 2):
            if z in (x, y):
                continue
            zs = () if z is None else (z,)
            rows.append((x, y, z, stx.subset_key((x, y, *zs)), stx.subset_key((x, *zs)), stx.subset_key((y, *zs)),
                         stx.subset_key(zs)))
    return rows


@register("q_d8_independence", JC + "," + sp.subset_stats("flag", NODES) + f""",
tests AS {sp.values_table(_test_rows([None, "regime"]), ["x", "y", "z", "sxy", "sx", "sy", "sz"])},
card AS (SELECT flag, subset AS v, cells AS r FROM st WHERE subset <> '' AND NOT contains(subset, ','))
SELECT a.flag, t.x, t.y, t.z, {qs("2.0 * (a.g - b.g - c.g + d.g)")} AS g2,
       CAST((rx.r - 1) * (ry.r - 1) * coalesce(rz.r, 1) AS BIGINT) AS dof
FROM st a JOIN tests t ON a.subset = t.sxy
JOIN st b ON b.flag = a.flag AND b.subset = t.sx JOIN st c ON c.flag = a.flag AND c.subset = t.sy
JOIN st d ON d.flag = a.flag AND d.subset = t.sz
LEFT JOIN card rx ON rx.flag = a.flag AND rx.v = t.x LEFT JOIN card ry ON ry.flag = a.flag AND ry.v = t.y
LEFT JOIN card rz ON rz.flag = a.flag AND rz.v = t.z""")
def q_d8_independence(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return rnd(stx.independence_tests(jc, NODES, keys=["flag"], given=[None, "regime"]), ["g2"])


_MODES = DISC + f""",
lgm AS (UNPIVOT (SELECT flag, {", ".join(NODES)} FROM disc) ON {", ".join(NODES)} INTO NAME col_name VALUE v),
cm AS (SELECT flag, col_name, v, count(*) AS c FROM lgm GROUP BY ALL),
modes AS (SELECT flag, col_name, v AS mode FROM cm QUALIFY row_number() OVER (PARTITION BY flag, col_name ORDER BY c DESC, v ASC) = 1)"""


@register("q_a16_column_modes", _MODES + """
SELECT flag, col_name, mode FROM modes""")
def q_a16_column_modes(spark, sf_dir):
    return stx.column_modes(flag_disc(spark, sf_dir), NODES, keys=["flag"])


def _mi_sql(pairs, src):
    sel = " UNION ALL ".join(f"SELECT flag, '{a}' AS x_name, '{b}' AS y_name, {a} AS x, {b} AS y FROM {src}"
                             for a, b in pairs)
    return f"""
pr AS ({sel}),
cx AS (SELECT flag, x_name, y_name, x, y, CAST(count(*) AS DOUBLE) AS nxy FROM pr GROUP BY ALL),
cx2 AS (SELECT *, sum(nxy) OVER (PARTITION BY flag, x_name, y_name, x) AS nx,
               sum(nxy) OVER (PARTITION BY flag, x_name, y_name, y) AS ny,
               sum(nxy) OVER (PARTITION BY flag, x_name, y_name) AS nn FROM cx),
mi AS (SELECT flag, x_name, y_name, sum(nxy / nn * ln(nn * nxy / (nx * ny))) AS mi FROM cx2 GROUP BY ALL)"""


_FILLED = _MODES + ", filled AS (SELECT flag, date, " + ", ".join(
    f"coalesce({c}, (SELECT mode FROM modes m WHERE m.flag = disc.flag AND m.col_name = '{c}')) AS {c}" for c in NODES) + \
    " FROM disc)"


@register("q_a17_mutual_info", _FILLED + "," + _mi_sql([(c, "regime") for c in FEAT7], "filled") + f""",
mx AS (SELECT *, max(mi) OVER (PARTITION BY flag) AS mmax FROM mi)
SELECT flag, x_name AS node, {qs("mi")} AS mi,
       {qs("300.0 + 5000.0 * CASE WHEN mmax > 0 THEN mi / mmax ELSE mi END")} AS size FROM mx""")
def q_a17_mutual_info(spark, sf_dir):
    nodes_tab, _ = stx.node_importance(flag_disc(spark, sf_dir), NODES, "regime", stx.DEFAULT_TEMPORAL, keys=["flag"])
    return rnd(nodes_tab, ["mi", "size"])


@register("q_a18_a19_edge_widths", DISC + ", z AS (SELECT flag, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in NODES) + " FROM disc)," + _mi_sql(stx.DEFAULT_TEMPORAL, "z") + f"""
SELECT flag, x_name AS parent, y_name AS child, {qs("mi")} AS mi, {qs("1.0 + 6.0 * mi")} AS width FROM mi""")
def q_a18_a19_edge_widths(spark, sf_dir):
    _, edges = stx.node_importance(flag_disc(spark, sf_dir), NODES, "regime", stx.DEFAULT_TEMPORAL, keys=["flag"])
    return rnd(edges, ["mi", "width"])


@register("q_a22_cpt", DISC + f""",
c AS (SELECT flag, vix, ig_spread_chg, regime, count(*) AS n FROM disc
      WHERE vix IS NOT NULL AND ig_spread_chg IS NOT NULL AND regime IS NOT NULL GROUP BY ALL)
SELECT flag, vix, ig_spread_chg, regime, n,
       {qs("n / sum(n) OVER (PARTITION BY flag, vix, ig_spread_chg)")} AS p FROM c""")
def q_a22_cpt(spark, sf_dir):
    cpt = stx.fit_cpt(flag_disc(spark, sf_dir), "regime", ["vix", "ig_spread_chg"], keys=["flag"])
    return rnd(cpt, ["p"])


@register("q_d7_hill_climb")
def q_d7_hill_climb(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    scores = stx.bic_scores(jc, NODES, keys=["flag"])
    return stx.hill_climb(scores, NODES, keys=["flag"])


@register("q_d9_dbn_template")
def q_d9_dbn_template(spark, sf_dir):
    return stx.dbn_template(q_d7_hill_climb(spark, sf_dir), stx.DEFAULT_TEMPORAL, keys=["flag"])


# ------------------------------------------------------------------ walk-forward
from riskpanel.functions.text import decision_code  # noqa: E402
from riskpanel.operators import walkforward as wf  # noqa: E402


def flag_backtest(spark, sf_dir) -> DataFrame:
    disc = flag_disc(spark, sf_dir)
    rets = flag_labelled(spark, sf_dir).select("flag", "date", F.col("spx_ret").alias("equity_ret"), "bond_ret")
    return wf.walk_forward(disc, rets, FEAT7, "regime", keys=["flag"])


_EV = [f"{c}_1" for c in FEAT7]
FLW2 = "(PARTITION BY flag ORDER BY date)"
WFSQL = JC + f""",
dl AS (SELECT flag, date, {", ".join(NODES)}, {", ".join(f"lag({c}) OVER {FLW2} AS {c}_1" for c in FEAT7)} FROM disc),
dbn AS (SELECT *, row_number() OVER {FLW2} - 1 AS pos, count(*) OVER (PARTITION BY flag) AS n FROM dl
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*NODES, *_EV])}),
sch AS (SELECT *, CASE WHEN n > 121 THEN 120 ELSE 1 END AS start FROM dbn),
mem0 AS (SELECT *, CAST(greatest(0, ceil((pos - start + 1) / 12.0)) AS INTEGER) AS bmin,
                CAST(least(floor((pos - start + 119) / 12.0), ceil((n - start) / 12.0) - 1) AS INTEGER) AS bmax FROM sch),
mem AS (SELECT *, unnest(generate_series(bmin, bmax)) AS block FROM mem0 WHERE pos >= 1 AND bmin <= bmax),
cpt AS (SELECT flag, block, {", ".join(_EV)}, count(*) AS n_cfg, sum(CASE WHEN regime = 0 THEN 1 ELSE 0 END) AS n_state
        FROM mem GROUP BY ALL),
steps AS (SELECT flag, date, CAST(floor((pos - start) / 12) AS INTEGER) AS block, {", ".join(_EV)} FROM sch WHERE pos >= start),
post AS (SELECT s.flag, s.date, s.block, coalesce(c.n_state / c.n_cfg, 1.0 / 3) AS p_off
         FROM steps s LEFT JOIN cpt c ON c.flag = s.flag AND c.block = s.block AND {" AND ".join(f"c.{e} = s.{e}" for e in _EV)}),
bt0 AS (SELECT p.*, l.spx_ret AS equity_ret, l.bond_ret, l.regime AS y_true FROM post p JOIN lab l USING (flag, date)),
bt AS (SELECT *, CASE WHEN p_off >= 0.5 THEN 'risk_off' WHEN p_off <= 0.33 THEN 'risk_on' ELSE 'risk_neut' END AS decision FROM bt0),
btn AS (SELECT *, CASE decision WHEN 'risk_off' THEN bond_ret WHEN 'risk_on' THEN equity_ret
                  ELSE 0.5 * (equity_ret + bond_ret) END AS net FROM bt)"""


@register("q_j6_two_slice", DISC + f"""
SELECT flag, date, {", ".join(f"lag({c}) OVER {FLW2} AS {c}_t0" for c in NODES)},
       {", ".join(f"{c} AS {c}_t1" for c in NODES)} FROM disc QUALIFY row_number() OVER {FLW2} > 1""")
def q_j6_two_slice(spark, sf_dir):
    return wf.two_slice(flag_disc(spark, sf_dir), NODES, keys=["flag"])


@register("q_j8_window_membership", WFSQL + """
SELECT flag, block, CAST(count(*) AS BIGINT) AS n_pairs, min(pos) AS first_pos, max(pos) AS last_pos FROM mem GROUP BY ALL""")
def q_j8_window_membership(spark, sf_dir):
    dbn = wf.schedule(wf.lagged_evidence(flag_disc(spark, sf_dir), FEAT7, "regime", keys=["flag"]))
    m = wf.model_membership(dbn)
    return m.groupBy("flag", "block").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("pos").alias("first_pos"),
                                          F.max("pos").alias("last_pos"))


@register("q_d11_block_cpts", WFSQL + f"""
SELECT flag, block, {", ".join(_EV)}, n_cfg, CAST(n_state AS BIGINT) AS n_state, {qs("n_state / n_cfg")} AS p_state FROM cpt""")
def q_d11_block_cpts(spark, sf_dir):
    dbn = wf.schedule(wf.lagged_evidence(flag_disc(spark, sf_dir), FEAT7, "regime", keys=["flag"]))
    return rnd(wf.fit_block_cpts(wf.model_membership(dbn), FEAT7, "regime", keys=["flag"]), ["p_state"])


@register("q_d14_backtest", WFSQL + f"""
SELECT flag, date, block, {qs("p_off")} AS p_off, decision, {rsql(["equity_ret", "bond_ret", "net"])} FROM btn""")
def q_d14_backtest(spark, sf_dir):
    return rnd(flag_backtest(spark, sf_dir), ["p_off", "equity_ret", "bond_ret", "net"])


@register("q_d16_report", WFSQL + f""",
btc AS (SELECT *, CASE lower(decision) WHEN 'risk_off' THEN 0 WHEN 'risk_neut' THEN 1 WHEN 'risk_on' THEN 2
                  WHEN 'off' THEN 0 WHEN 'neutral' THEN 1 WHEN 'on' THEN 2 END AS y_pred FROM btn),
wl AS (SELECT flag, date, net, product(1 + net) OVER (PARTITION BY flag ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM btc),
dd AS (SELECT flag, min(w / pk - 1) AS max_drawdown FROM (SELECT *, max(w) OVER (PARTITION BY flag ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM wl) GROUP BY 1),
pf AS (SELECT flag, sqrt(12) * avg(net) / NULLIF(stddev_samp(net), 0) AS sharpe,
              sqrt(12) * avg(net) / NULLIF(stddev_samp(CASE WHEN net < 0 THEN net END), 0) AS sortino,
              avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n,
              count(DISTINCT CASE WHEN y_true IN (0, 1, 2) THEN y_true END) = 3 AS all3,
              avg(power(p_off - CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END, 2)) AS brier FROM btc GROUP BY 1),
cc AS (SELECT flag, y_true, y_pred, count(*) AS n FROM btc GROUP BY ALL),
per AS (SELECT flag, l, sum(nt) AS nt, sum(np) AS np, sum(tp) AS tp FROM (
          SELECT flag, y_true AS l, n AS nt, 0 AS np, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM cc
          UNION ALL SELECT flag, y_pred AS l, 0 AS nt, n AS np, 0 AS tp FROM cc) GROUP BY ALL),
f1 AS (SELECT flag, avg(coalesce(2.0 * tp / NULLIF(nt + np, 0), 0.0)) AS f1_macro FROM per GROUP BY 1),
s AS (SELECT flag, p_off AS p, sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS pos, count(*) AS cnt FROM btc GROUP BY ALL),
s2 AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY flag ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + (cnt + 1) / 2.0 AS rk FROM s),
a AS (SELECT flag, CAST(sum(pos * rk) AS DOUBLE) AS sr, CAST(sum(pos) AS DOUBLE) AS n1, CAST(sum(cnt) AS DOUBLE) AS nn FROM s2 GROUP BY 1)
SELECT flag, {rsql(["sharpe", "sortino", "max_drawdown", "accuracy"])}, n, {qs("f1_macro")} AS f1_macro,
       CASE WHEN all3 THEN {qs("brier")} END AS brier_off,
       CASE WHEN all3 AND n1 > 0 AND nn > n1 THEN {qs("(sr - n1 * (n1 + 1) / 2.0) / (n1 * (nn - n1))")} END AS auc_off
FROM pf JOIN dd USING (flag) JOIN f1 USING (flag) JOIN a USING (flag)""")
def q_d16_report(spark, sf_dir):
    bt = flag_backtest(spark, sf_dir)
    truth = flag_labelled(spark, sf_dir).select("flag", "date", "regime")
    bt = bt.join(truth, ["flag", "date"]).withColumn("decision_code", decision_code("decision"))
    rep = mt.performance_report(bt, keys=["flag"], y_true="regime", y_pred="decision_code")
    return rnd(rep, ["sharpe", "sortino", "max_drawdown", "accuracy", "f1_macro", "brier_off", "auc_off"])


# ------------------------------------------------------------------ interpolation (month -> day)
from riskpanel.operators import interpolate as ip  # noqa: E402


def nation_month_vix(spark, sf_dir) -> DataFrame:
    """Monthly knots per nation (axis = all aligned months, knots = non-null vix)."""
    wide = fx.align_series(panels.nation_month_long(spark, sf_dir), panels.SERIES, keys=["nation"])
    return wide.select("nation", "date", "vix")


NMK = "WITH " + sp.NATION_MONTH + ", src AS (SELECT nation, date, vix FROM wide)," + sp.knots("nation", "src", "vix")


@register("q_i1_daily_grid", "WITH " + sp.NATION_MONTH + f""",
b AS (SELECT nation, min(date) AS lo, max(date) AS hi FROM wide GROUP BY 1),
g AS (SELECT nation, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT g.nation, g.date, {qs("w.vix")} AS vix FROM g LEFT JOIN wide w USING (nation, date)""")
def q_i1_daily_grid(spark, sf_dir):
    return rnd(ip.daily_grid(nation_month_vix(spark, sf_dir), keys=["nation"]), ["vix"])


@register("q_i2_time_linear", NMK + f", r AS ({sp.time_linear('nation', 'v')}) SELECT nation, date, {qs('v')} AS vix_time FROM r")
def q_i2_time_linear(spark, sf_dir):
    return rnd(ip.interpolate_time(nation_month_vix(spark, sf_dir), "vix", "vix_time", keys=["nation"]), ["vix_time"])


@register("q_i3_index_linear", GAPPY + f""",
g AS (SELECT flag, date, spx_px, row_number() OVER {FLW} AS i FROM gw),
p AS (SELECT *, last_value(CASE WHEN spx_px IS NOT NULL THEN struct_pack(i := i, v := spx_px) END IGNORE NULLS)
                  OVER (PARTITION BY flag ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
               first_value(CASE WHEN spx_px IS NOT NULL THEN struct_pack(i := i, v := spx_px) END IGNORE NULLS)
                  OVER (PARTITION BY flag ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM g)
SELECT flag, date, {qs("spx_px", 4)} AS spx_px, {qs('''CASE WHEN spx_px IS NOT NULL THEN spx_px WHEN pv IS NULL THEN NULL
    WHEN nv IS NULL THEN pv.v ELSE pv.v + (nv.v - pv.v) * CAST(i - pv.i AS DOUBLE) / CAST(nv.i - pv.i AS DOUBLE) END''', 4)} AS spx_fill
FROM p""")
def q_i3_index_linear(spark, sf_dir):
    g = flag_wide_gappy(spark, sf_dir).select("flag", "date", "spx_px")
    out = ip.interpolate_index(g, "spx_px", "spx_fill", keys=["flag"])
    return out.withColumns({"spx_px": q("spx_px", 4), "spx_fill": q("spx_fill", 4)})


@register("q_i4_pchip", NMK + "," + sp.pchip_slopes("nation") + f""",
r AS ({sp.hermite("nation", "pk3", "v", True)}) SELECT nation, date, {qs("v")} AS vix_pchip FROM r""")
def q_i4_pchip(spark, sf_dir):
    return rnd(ip.pchip(nation_month_vix(spark, sf_dir), "vix", "vix_pchip", keys=["nation"]), ["vix_pchip"])


@register("q_i5_akima", NMK + "," + sp.akima_slopes("nation") + f""",
r AS ({sp.hermite("nation", "ak7", "v", False)}) SELECT nation, date, {qs("v")} AS vix_akima FROM r""")
def q_i5_akima(spark, sf_dir):
    return rnd(ip.akima(nation_month_vix(spark, sf_dir), "vix", "vix_akima", keys=["nation"]), ["vix_akima"])


SAVGOL_WINDOW = 91   # months_window = 3.0 -> round(3 * 30.44) = 91 days (odd); every key spans > 91 days


def _savgol_sql(key: str, src: str, col: str, window: int, polyorder: int) -> str:
    half = window // 2
    coef = ip.savgol_coefficients(window, polyorder)
    w = f"(PARTITION BY {key} ORDER BY date)"
    terms = []
    for j, c in zip(range(-half, half + 1), coef):
        if j < 0:
            yj = f"(CASE WHEN i + ({j}) < 0 THEN y0 ELSE lag({col}, {-j}) OVER {w} END)"
        elif j > 0:
            yj = f"(CASE WHEN i + {j} > nn - 1 THEN yl ELSE lead({col}, {j}) OVER {w} END)"
        else:
            yj = col
        terms.append(f"{sp.dbl(c)} * {yj}")
    return f"""sg0 AS (SELECT *, row_number() OVER {w} - 1 AS i, count(*) OVER (PARTITION BY {key}) AS nn,
        first_value({col}) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0,
        last_value({col}) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS yl FROM {src}),
sg AS (SELECT {key}, date, {" + ".join(terms)} AS sg FROM sg0)"""


@register("q_i6_savgol", NMK + f", lin AS ({sp.time_linear('nation', 'v')})," + _savgol_sql("nation", "lin", "v", SAVGOL_WINDOW, 2)
          + f" SELECT nation, date, {qs('sg')} AS vix_savgol FROM sg")
def q_i6_savgol(spark, sf_dir):
    daily = ip.interpolate_time(nation_month_vix(spark, sf_dir), "vix", "v", keys=["nation"])
    out = ip.savgol(daily, "v", "vix_savgol", keys=["nation"], window=SAVGOL_WINDOW, polyorder=2)
    return rnd(out.drop("v"), ["vix_savgol"])


SAVGOL_WIDE = ip.savgol_window(7, 3, 10_000)  # seven months, as long as no series is shorter


@register("q_i6_savgol_months", NMK + f", lin AS ({sp.time_linear('nation', 'v')})," + _savgol_sql("nation", "lin", "v", SAVGOL_WIDE, 3)
          + f" SELECT nation, date, {qs('sg')} AS vix_savgol FROM sg")
def q_i6_savgol_months(spark, sf_dir):
    daily = ip.interpolate_time(nation_month_vix(spark, sf_dir), "vix", "v", keys=["nation"])
    return rnd(ip.savgol(daily, "v", "vix_savgol", keys=["nation"], months=7, polyorder=3).drop("v"), ["vix_savgol"])


@register("q_i9_method_compare", NMK + "," + sp.pchip_slopes("nation") + "," + sp.akima_slopes("nation") + f""",
a AS ({sp.time_linear("nation", "v")}), b AS ({sp.hermite("nation", "pk3", "v", True)}), c AS ({sp.hermite("nation", "ak7", "v", False)})
SELECT nation, date, 'time' AS method, {qs("v")} AS value FROM a
UNION ALL SELECT nation, date, 'pchip' AS method, {qs("v")} AS value FROM b
UNION ALL SELECT nation, date, 'akima' AS method, {qs("v")} AS value FROM c""")
def q_i9_method_compare(spark, sf_dir):
    knots = nation_month_vix(spark, sf_dir)
    runs = {"time": ip.interpolate_time, "pchip": ip.pchip, "akima": ip.akima}
    parts = [fn(knots, "vix", "value", keys=["nation"]).withColumn("method", F.lit(name)) for name, fn in runs.items()]
    return rnd(fx.union_all(parts), ["value"])


def _lowess_sql(frac: float) -> str:
    """One local-line round ``{name}`` over rows (nation, date, y, x, i, n, k, rw) of ``{src}``."""
    one = """{name} AS (SELECT c.nation, c.date, c.y, c.x, c.i, c.n, c.k, any_value(c.h) AS h,
    sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * y2) AS u0, sum(w * t * y2) AS u1
  FROM (SELECT a.*, b.y AS y2, (b.x - a.x) / a.h AS t, b.rw * pow(1 - pow(least(abs(b.x - a.x) / a.h, 1), 3), 3) AS w
        FROM (SELECT e.*, greatest(e.x - l.x, r.x - e.x, 1) AS h FROM (SELECT *, greatest(0, least(i - k // 2, n - k)) AS a FROM {src}) e
              JOIN {src} l ON l.nation = e.nation AND l.i = e.a JOIN {src} r ON r.nation = e.nation AND r.i = e.a + e.k - 1) a
        JOIN {src} b ON b.nation = a.nation AND b.i BETWEEN a.a AND a.a + a.k - 1) c GROUP BY ALL),
{name}f AS (SELECT *, CASE WHEN s0 <= 1e-12 THEN y WHEN s2 - s1 * s1 / s0 <= 1e-12 * s0 THEN u0 / s0
    ELSE u0 / s0 - s1 / s0 * (u1 - s1 * u0 / s0) / (s2 - s1 * s1 / s0) END AS fit FROM {name})"""
    return f"""ly AS (SELECT nation, date, v AS y FROM lin WHERE v IS NOT NULL),
l0 AS (SELECT *, CAST(least(n, greatest(2, floor(n * {sp.dbl(frac)}))) AS BIGINT) AS k, CAST(1 AS DOUBLE) AS rw FROM (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n,
         CAST(date - min(date) OVER (PARTITION BY nation) AS DOUBLE) AS x FROM ly)),
{one.format(name="p0", src="l0")},
m0 AS (SELECT nation, median(abs(y - fit)) AS med FROM p0f GROUP BY 1),
l1 AS (SELECT p.nation, p.date, p.y, p.x, p.i, p.n, p.k, CASE WHEN med <= 0 THEN 1 WHEN abs(y - fit) < 6 * med
    THEN pow(1 - pow((y - fit) / (6 * med), 2), 2) ELSE 0 END AS rw FROM p0f p JOIN m0 USING (nation)),
{one.format(name="p1", src="l1")}
SELECT lin.nation, lin.date, {qs("p1f.fit", 4)} AS vix_lowess FROM lin LEFT JOIN p1f ON p1f.nation = lin.nation AND p1f.date = lin.date"""


@register("q_i7_lowess", NMK + f", lin AS ({sp.time_linear('nation', 'v')})," + _lowess_sql(0.15))
def q_i7_lowess(spark, sf_dir):
    daily = ip.interpolate_time(nation_month_vix(spark, sf_dir), "vix", "v", keys=["nation"])
    return rnd(ip.lowess(daily, "v", "vix_lowess", keys=["nation"], frac=0.15, it=1).drop("v"), ["vix_lowess"], 4)


@register("q_i8_spline_orders")
def q_i8_spline_orders(spark, sf_dir):
    knots = nation_month_vix(spark, sf_dir)
    parts = [ip.spline(knots, "vix", "value", order=o, keys=["nation"]).withColumn("order", F.lit(o))
             for o in (2, 3, 7)]
    return fx.union_all(parts)


# ------------------------------------------------------------------ mixture states and the documented-intent hybrid
GMM_FEATURES = ["spx_ret", "vix", "ig_spread_chg"]


@register("q_d4_gmm_states")
def q_d4_gmm_states(spark, sf_dir):
    f = nation_features(spark, sf_dir)
    return rg.gmm_states(f, GMM_FEATURES, keys=["nation"], ret_col="spx_ret").select("nation", "date", "gmm_state")


@register("q_d5_hybrid_when_fired")
def q_d5_hybrid_when_fired(spark, sf_dir):
    from riskpanel.session import materialize
    f = nation_features(spark, sf_dir)
    base = materialize(rg.gmm_states(f, GMM_FEATURES, keys=["nation"], ret_col="spx_ret"))
    return rg.hybrid_regime(base, keys=["nation"], vix_col="vix", spread_chg_col="ig_spread_chg", h=1,
                            override="when_fired", base_col="gmm_state").select("nation", "date", "gmm_state", "regime")


# ------------------------------------------------------------------ HTML tables in landed pages
from riskpanel import sources as srcs  # noqa: E402


@register("q_s4_html_table_rows")
def q_s4_html_table_rows(spark, sf_dir):
    pages = panels.table(spark, sf_dir, "pages")
    return srcs.html_tables(pages).select("page", "table_no", "row_no", F.size("cells").alias("n_cells"))


# ------------------------------------------------------------------ readers over files rendered from the tables
# Each query renders the monthly or daily order counts of every order priority as one published-style file per
# priority in the shared scratch folder, and reads the files back; the oracle counts in the table itself.
_PRIO = "substr(o_orderpriority, 1, 1)"
_MONTHLY = f"SELECT {_PRIO} AS prio, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL"
_DAILY = f"SELECT {_PRIO} AS prio, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL"
_FILE_PRIO = r"/prio=([^/]+)/"


def order_counts(spark, sf_dir, monthly: bool) -> DataFrame:
    o = panels.table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.groupBy(F.expr(_PRIO).alias("prio"), (F.trunc(day, "month") if monthly else day).alias("date")).agg(
        F.count(F.lit(1)).alias("n"))


def rendered(spark, texts: DataFrame, encoding: str = "UTF-8") -> str:
    """A folder with one file for each (prio, value); the value is the whole file."""
    import uuid
    from riskpanel.session import _WRITTEN, checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskpanel-files-{uuid.uuid4().hex}"
    texts.select("prio", "value").write.partitionBy("prio").option("encoding", encoding).text(path)
    _WRITTEN.append(path)
    return path


def joined_lines(df: DataFrame, line: str, *order: str, sep: str = "\n") -> DataFrame:
    """(prio, body): each priority's lines in order; a priority has at most one line a day."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.expr(line).alias("__line"))))
    return df.groupBy("prio").agg(F.array_join(F.transform(rows, lambda x: x["__line"]), sep).alias("body"))


def file_prio() -> Column:
    return F.regexp_extract("file", _FILE_PRIO, 1).alias("prio")


@register("q_s1_header_search", f"""
WITH m AS ({_MONTHLY}), y AS (SELECT DISTINCT prio, year(date) AS y FROM m), mm AS (SELECT unnest(generate_series(1, 12)) AS k)
SELECT y.prio, make_date(y.y, mm.k, 1) AS date, CAST(m.n AS DOUBLE) AS anomaly
FROM y CROSS JOIN mm LEFT JOIN m ON m.prio = y.prio AND m.date = make_date(y.y, mm.k, 1)""")
def q_s1_header_search(spark, sf_dir):
    m = order_counts(spark, sf_dir, True)
    cells = [F.coalesce(F.max(F.when(F.month("date") == k, F.col("n").cast("string"))), F.lit("***")) for k in range(1, 13)]
    wide = m.groupBy("prio", F.year("date").alias("y")).agg(F.concat_ws(",", *cells).alias("cells"))
    body = joined_lines(wide, "concat(y, ',', cells)", "y")
    head = "Orders by month\n\n" + ",".join(["Year", *cal.MONTHS]) + "\n"
    path = rendered(spark, body.select("prio", F.concat(F.lit(head), "body").alias("value")))
    return srcs.gistemp_monthly(srcs.read_after_header(spark, path)).select(file_prio(), "date", "anomaly")


@register("q_s2_semicolon_daily", f"SELECT prio, date, CAST(n AS DOUBLE) AS value FROM ({_DAILY})")
def q_s2_semicolon_daily(spark, sf_dir):
    body = joined_lines(order_counts(spark, sf_dir, False),
                        "concat_ws(';', date_format(date, 'yyyy;MM;dd'), '0.0', concat('  ', n), '-1', '1', '1')", "date")
    path = rendered(spark, body.select("prio", F.concat(F.lit("# daily counts\n"), "body").alias("value")))
    return srcs.read_semicolon_daily(spark, path).select(file_prio(), "date", "value")


@register("q_s3_json_table", f"SELECT prio, strftime(date, '%Y-%m-%d') || ' 20:00:00' AS time_tag, CAST(n AS VARCHAR) AS flux FROM ({_DAILY})")
def q_s3_json_table(spark, sf_dir):
    body = joined_lines(order_counts(spark, sf_dir, False),
                        "concat('[\"', date_format(date, 'yyyy-MM-dd'), ' 20:00:00\",\"', n, '\"]')", "date", sep=",")
    path = rendered(spark, body.select("prio", F.concat(F.lit('[["time_tag","flux"],'), "body", F.lit("]")).alias("value")))
    return srcs.read_json_table(spark, path).select(file_prio(), "time_tag", "flux")


@register("q_s4_adjusted_flux", f"SELECT prio AS page, date, CAST(n AS DOUBLE) AS flux FROM ({_DAILY})")
def q_s4_adjusted_flux(spark, sf_dir):
    row = "concat('<tr><td>', date_format(date, 'yyyy-MM-dd'), '</td><td>', {t}, '</td><td>', {a}, '</td><td>', {b}, '</td></tr>')"
    both = row.format(t="'18:00:00'", a="0", b="-1"), row.format(t="'20:00:00'", a="n + 0.5", b="n")
    body = joined_lines(order_counts(spark, sf_dir, False), f"concat({both[0]}, {both[1]})", "date")
    head = "<table><tr><th>other</th></tr></table><table><tr><th>Date</th><th>Time</th><th>Observed Flux</th><th>Adjusted Flux</th></tr>"
    pages = body.select(F.col("prio").alias("page_id"), F.concat(F.lit(head), "body", F.lit("</table>")).alias("html"))
    return srcs.flux_table(srcs.pick_html_table(srcs.html_tables(pages), "Observed Flux", pages))


@register("q_s6_cpu_monthly", f"SELECT prio, last_day(date) AS date, CAST(n AS DOUBLE) AS cpu FROM ({_MONTHLY})")
def q_s6_cpu_monthly(spark, sf_dir):
    body = joined_lines(order_counts(spark, sf_dir, True), "concat(date_format(date, 'MMM-yy'), ',', n)", "date")
    head = "Index of orders, é\n\nby priority\n\nDate,CPU_index\n"
    path = rendered(spark, body.select("prio", F.concat(F.lit(head), "body", F.lit("\nnote,1")).alias("value")), "windows-1252")
    return srcs.cpu_monthly(spark, path).select(file_prio(), "date", "cpu")


# ------------------------------------------------------------------ workbooks (S5) and the indices report over them
def workbooks(spark, sf_dir) -> DataFrame:
    """(file, content): a workbook for each order priority; odd priorities count days from 1904, even ones from 1900.
    Sheet ``daily`` has two lines of preamble, then date cells, counts and an empty column; sheet ``monthly`` has inline
    strings with days first and no preamble. Header texts are in the text table. In ``daily`` priority 2 has remarks,
    priority 3 goes back in time, and priority 4 has the days of every two on the first of them."""
    odd = "prio IN ('1', '3', '5')"
    serial = f"datediff(date, if({odd}, date'1904-01-01', date'1899-12-30'))"
    cells = "concat('<row r=\"', r, '\"><c r=\"A', r, '\"{a}</c><c r=\"B', r, '\"><v>', n, '</v></c>', {c}, '</row>')"

    def lines(monthly, first, a, c, by):
        number = Window.partitionBy("prio").orderBy(F.expr(by))
        d = order_counts(spark, sf_dir, monthly).withColumn("r", F.row_number().over(number) + first)
        return joined_lines(d, cells.format(a=a, c=c), "r", sep="")

    day = f"({serial} - if(prio = '4', datediff(date, date'1899-12-30') % 2, 0))"
    remark = "if(prio = '2', concat('<c r=\"C', r, '\"><v>', 2 * n, '</v></c>'), '')"
    back = "if(prio = '3', -1, 1) * datediff(date, date'1899-12-30')"
    daily = lines(False, 3, f" s=\"1\"><v>', {day}, '</v>", remark, back).withColumnRenamed("body", "daily")
    monthly = lines(True, 1, " t=\"inlineStr\"><is><t>', date_format(date, 'dd/MM/yyyy'), '</t></is>", "''", "date"
                    ).withColumnRenamed("body", "monthly")
    both = daily.join(monthly, "prio")
    head = '<row r="{r}"><c r="A{r}" t="s"><v>0</v></c><c r="B{r}" t="s"><v>1</v></c>{more}</row>'
    intro = '<row r="1"><c r="A1" t="s"><v>3</v></c></row>' + head.format(r=3, more='<c r="C3" t="s"><v>2</v></c>')
    return both.select(F.concat(F.lit("orders-"), "prio", F.lit(".xlsx")).alias("file"), _zipped(
        F.concat(F.lit(intro), "daily"), F.concat(F.lit(head.format(r=1, more="")), "monthly"), F.expr(odd)).alias("content"))


_MAIN_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@F.pandas_udf(T.BinaryType())
def _zipped(daily: pd.Series, monthly: pd.Series, odd: pd.Series) -> pd.Series:
    """The parts of a workbook with two sheets, zipped."""
    import io
    import zipfile

    def book(day_rows, month_rows, base_1904):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN_NS}" xmlns:r="{_REL_NS}"><workbookPr date1904="{int(base_1904)}"/>'
                       '<sheets><sheet name="daily" sheetId="1" r:id="a"/><sheet name="monthly" sheetId="2" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/>'
                       '<Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN_NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN_NS}"><si><t>Date</t></si><si><r><t>Or</t></r><r><t>ders</t></r></si>'
                       "<si><t>Remark</t></si><si><t>Orders by day</t></si></sst>")
            for k, rows in ((1, day_rows), (2, month_rows)):
                z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN_NS}"><sheetData>{rows}</sheetData></worksheet>')
        return out.getvalue()

    return pd.Series([book(*x) for x in zip(daily, monthly, odd)])


_BOOK = "'orders-' || prio || '.xlsx'"


_SHEETS = f"""d AS ({_DAILY}), m AS ({_MONTHLY}),
dd AS (SELECT {_BOOK} AS file, prio, 3 + row_number() OVER (PARTITION BY prio ORDER BY CASE WHEN prio = '3' THEN -1 ELSE 1 END * (date - DATE '1899-12-30')) AS r,
              CASE WHEN prio = '4' THEN date - CAST((date - DATE '1899-12-30') % 2 AS INTEGER) ELSE date END AS date, n FROM d)"""


@register("q_s5_workbooks", f"""
WITH {_SHEETS}, c AS (
SELECT 'daily' AS sheet, prio, r, strftime(date, '%Y-%m-%d') AS a, n FROM dd
UNION ALL SELECT 'monthly' AS sheet, prio, 1 + row_number() OVER (PARTITION BY prio ORDER BY date) AS r, strftime(date, '%d/%m/%Y') AS a, n FROM m),
p AS (SELECT DISTINCT prio FROM d)
SELECT {_BOOK} AS file, sheet, CAST(r AS INTEGER) AS row, 1 AS col, a AS value FROM c
UNION ALL SELECT {_BOOK}, sheet, CAST(r AS INTEGER), 2, CAST(n AS VARCHAR) FROM c
UNION ALL SELECT {_BOOK}, sheet, CAST(r AS INTEGER), 3, CAST(2 * n AS VARCHAR) FROM c WHERE prio = '2' AND sheet = 'daily'
UNION ALL SELECT {_BOOK}, v.s, v.r, v.c, v.t FROM p, (VALUES ('daily', 1, 1, 'Orders by day'), ('daily', 3, 1, 'Date'),
  ('daily', 3, 2, 'Orders'), ('daily', 3, 3, 'Remark'), ('monthly', 1, 1, 'Date'), ('monthly', 1, 2, 'Orders')) v(s, r, c, t)""")
def q_s5_workbooks(spark, sf_dir):
    return srcs.xlsx_cells(workbooks(spark, sf_dir))


def indices(spark, sf_dir) -> dict[str, DataFrame]:
    from riskpanel.plans.compositions import climate_indices
    return climate_indices(srcs.xlsx_cells(workbooks(spark, sf_dir), "daily"), header_row=3,
                           rename={"Orders": "orders", "Remark": "remark"})


def _smooth_sql(col):
    frame = "(PARTITION BY file ORDER BY date, r ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {frame} >= 30 THEN {qs(f'avg({col}) OVER {frame}')} END AS {col}_smooth"


_INDICES = f"""WITH {_SHEETS}, t AS (SELECT file, r, date, CAST(n AS DOUBLE) AS orders,
       CASE WHEN prio = '2' THEN CAST(2 * n AS DOUBLE) END AS remark FROM dd)"""


@register("q_x2_indices_table", _INDICES + f"""
SELECT file, CAST(r AS INTEGER) AS row, date, orders, remark, {_smooth_sql("orders")}, {_smooth_sql("remark")} FROM t""")
def q_x2_indices_table(spark, sf_dir):
    return rnd(indices(spark, sf_dir)["table"], ["orders_smooth", "remark_smooth"])


@register("q_x2_indices_report", _INDICES + f""",
per AS (SELECT file, date, count(*) AS k FROM t GROUP BY ALL),
du AS (SELECT file, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS dup_rows,
              CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS dup_dates, CAST(sum(k) - count(*) AS BIGINT) AS extra_copies
       FROM per GROUP BY 1),
mo AS (SELECT file, bool_and(coalesce(date >= before, TRUE)) AS monotonic
       FROM (SELECT *, lag(date) OVER (PARTITION BY file ORDER BY r) AS before FROM t) GROUP BY 1),
co AS (SELECT file, CASE WHEN count(remark) > 0 THEN 'Orders,Remark' ELSE 'Orders' END AS filled FROM t GROUP BY 1),
g AS (SELECT file, date, lag(date) OVER (PARTITION BY file ORDER BY date) AS before FROM per),
g2 AS (SELECT *, CAST(date - before AS INTEGER) AS gap FROM g),
g3 AS (SELECT *, coalesce(isodow(before) = 5 AND isodow(date) = 1 AND gap = 3, FALSE) AS wk FROM g2),
ga AS (SELECT file, CAST(sum(CAST(wk AS INT)) AS BIGINT) AS weekend_gaps,
              CAST(sum(CAST(coalesce(gap > 1 AND NOT wk, FALSE) AS INT)) AS BIGINT) AS unusual_gaps,
              count(gap) AS count, {qs("avg(gap)")} AS mean, {qs("stddev_samp(gap)")} AS std, CAST(max(gap) AS DOUBLE) AS max FROM g3 GROUP BY 1)
SELECT file, filled, monotonic, dup_rows, dup_dates, extra_copies, weekend_gaps, unusual_gaps, count, mean, std, max
FROM co JOIN mo USING (file) JOIN du USING (file) JOIN ga USING (file)""")
def q_x2_indices_report(spark, sf_dir):
    """The parts of the report beside the table: filled columns, order, duplicates and gaps of every workbook."""
    part = indices(spark, sf_dir)
    gaps = rnd(part["gaps"].select("file", "weekend_gaps", "unusual_gaps", "count", "mean", "std", "max"), ["mean", "std"])
    columns = part["columns"].select("file", F.array_join("filled", ",").alias("filled"))
    return columns.join(part["monotonic"], "file").join(part["duplicates"], "file").join(gaps, "file")


# ------------------------------------------------------------------ datasets and samples written and read back
def scratch(spark) -> str:
    import uuid
    from riskpanel.session import _WRITTEN, checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskpanel-files-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@register("q_s9_datasets", f"""SELECT 'daily' AS dataset, prio, date, n FROM ({_DAILY})
UNION ALL SELECT 'monthly' AS dataset, prio, date, n FROM ({_MONTHLY})""")
def q_s9_datasets(spark, sf_dir):
    """Both datasets are written sorted; the second call finds them there and must leave them as they are."""
    root = scratch(spark)
    daily, monthly = order_counts(spark, sf_dir, False), order_counts(spark, sf_dir, True)
    srcs.ensure_datasets(spark, {"daily": daily, "monthly": monthly}, root, order=["date", "prio"])
    srcs.ensure_datasets(spark, {"daily": monthly}, root, required=["daily", "monthly"])
    parts = [srcs.read_dataset(spark, root, name).withColumn("dataset", F.lit(name)) for name in ("daily", "monthly")]
    return fx.union_all(parts).select("dataset", "prio", "date", "n")


@register("q_s10_sample", f"SELECT prio, date, n FROM ({_DAILY}) ORDER BY date, prio LIMIT 20")
def q_s10_sample(spark, sf_dir):
    root = scratch(spark)
    srcs.write_sample(order_counts(spark, sf_dir, False), root, n=20, order=["date", "prio"])
    return spark.read.option("header", "true").schema("prio string, date date, n long").csv(root)


# ------------------------------------------------------------------ K2 / BDeu family scores, G-test p-values
def _bayes_sql(method: str, ess: float = 5.0) -> str:
    if method == "k2":
        fterm, pterm = "lgamma(g.nn + 1.0)", "lgamma(g.nn + b.r) - lgamma(b.r)"
    else:
        a, bb = f"({ess} / b.q)", f"({ess} / (b.q * b.r))"
        fterm, pterm = f"lgamma(g.nn + {bb}) - lgamma({bb})", f"lgamma(g.nn + {a}) - lgamma({a})"
    return JC + "," + sp.subset_stats("flag", NODES, max_size=len(NODES)) + "," + FAM + f""",
base AS (SELECT s.flag, fam.child, fam.parents, fam.family, CAST(c.r AS DOUBLE) AS r,
                CAST(coalesce(cfg.q, 1) AS DOUBLE) AS q
         FROM st s JOIN fam ON s.subset = fam.family JOIN card c ON c.flag = s.flag AND c.v = fam.child
         LEFT JOIN cfg ON cfg.flag = s.flag AND cfg.parents = fam.parents),
fsum AS (SELECT b.flag, b.child, b.parents, sum({fterm}) AS f FROM base b JOIN gsets g ON g.flag = b.flag AND g.subset = b.family GROUP BY ALL),
psum AS (SELECT b.flag, b.child, b.parents, sum({pterm}) AS p FROM base b JOIN gsets g ON g.flag = b.flag AND g.subset = b.parents GROUP BY ALL)
SELECT flag, child, parents, {qs("f - p")} AS {method} FROM fsum JOIN psum USING (flag, child, parents)"""


@register("q_d6_k2_scores", _bayes_sql("k2"))
def q_d6_k2_scores(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return rnd(stx.bayesian_scores(jc, NODES, keys=["flag"], method="k2"), ["k2"])


@register("q_d6_bdeu_scores", _bayes_sql("bdeu", 5.0))
def q_d6_bdeu_scores(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return rnd(stx.bayesian_scores(jc, NODES, keys=["flag"], method="bdeu", ess=5.0), ["bdeu"])


@register("q_d8_pvalues", JC + "," + sp.subset_stats("flag", NODES) + f""",
tests AS {sp.values_table(_test_rows([None, "regime"]), ["x", "y", "z", "sxy", "sx", "sy", "sz"])},
card AS (SELECT flag, subset AS v, cells AS r FROM st WHERE subset <> '' AND NOT contains(subset, ',')),
t AS (SELECT a.flag, t.x, t.y, t.z, 2.0 * (a.g - b.g - c.g + d.g) AS g2,
       CAST((rx.r - 1) * (ry.r - 1) * coalesce(rz.r, 1) AS BIGINT) AS dof
FROM st a JOIN tests t ON a.subset = t.sxy
JOIN st b ON b.flag = a.flag AND b.subset = t.sx JOIN st c ON c.flag = a.flag AND c.subset = t.sy
JOIN st d ON d.flag = a.flag AND d.subset = t.sz
LEFT JOIN card rx ON rx.flag = a.flag AND rx.v = t.x LEFT JOIN card ry ON ry.flag = a.flag AND ry.v = t.y
LEFT JOIN card rz ON rz.flag = a.flag AND rz.v = t.z)
SELECT flag, x, y, z, {qs("g2")} AS g2, dof, {qs(sp.chi2_tail("g2", "dof"))} AS p_value FROM t""")
def q_d8_pvalues(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return rnd(stx.chi2_pvalues(stx.independence_tests(jc, NODES, keys=["flag"], given=[None, "regime"])), ["g2", "p_value"])


@register("q_d8_skeleton", JC + "," + sp.skeleton("flag", NODES, alpha=0.01, max_given=3))
def q_d8_skeleton(spark, sf_dir):
    jc = stx.joint_counts(flag_disc(spark, sf_dir), NODES, keys=["flag"])
    return stx.skeleton(jc, NODES, keys=["flag"], alpha=0.01, max_given=3)


_LINKS = JC + "," + sp.skeleton("flag", NODES, alpha=0.01, max_given=3)
_TEMPORAL = ", ".join(f"('{u}', '{v}')" for u, v in stx.DEFAULT_TEMPORAL)


@register("q_d9_template_of_skeleton", f"""WITH sk AS ({_LINKS})
SELECT flag, x AS parent, y AS child, s AS slice_from, s AS slice_to FROM sk, (VALUES (0), (1)) v(s) WHERE linked
UNION ALL SELECT k.flag, t.u AS parent, t.v AS child, 0 AS slice_from, 1 AS slice_to
FROM (SELECT DISTINCT flag FROM sk WHERE linked) k, (VALUES {_TEMPORAL}) t(u, v)""")
def q_d9_template_of_skeleton(spark, sf_dir):
    """D9 over edges that SQL can find too: the pairs left in the skeleton, from the first name to the second."""
    left = q_d8_skeleton(spark, sf_dir).where("linked")
    intra = left.select("flag", F.col("x").alias("parent"), F.col("y").alias("child"))
    return stx.dbn_template(intra, stx.DEFAULT_TEMPORAL, keys=["flag"])


# the target's parents vix and ig_spread_chg; temp_anom and cpu are summed out, (cpu, vix) may be unseen in a window
INTRA = [("temp_anom", "cpu"), ("cpu", "vix"), ("cpu", "ig_spread_chg"), ("vix", "ig_spread_chg"),
         ("vix", "regime"), ("ig_spread_chg", "regime")]


def _intra_sql() -> str:
    """Brute force: every combination of the ancestors' states, the product of their table entries, summed."""
    anc = ["temp_anom", "cpu", "vix", "ig_spread_chg"]
    ctes, factors, joins = [], [], []
    for v in anc:
        ps = [u for u, w in INTRA if w == v]
        ctes.append(f"st_{v} AS (SELECT *, count(*) OVER (PARTITION BY flag, block) AS r_{v} FROM (SELECT DISTINCT flag, block, {v} FROM mem))")
        by = ", ".join(["flag", "block", *ps])
        ctes.append(f"cn_{v} AS (SELECT {by}, {v}, count(*) AS n_{v} FROM mem GROUP BY ALL)")
        ctes.append(f"ct_{v} AS (SELECT {by}, count(*) AS t_{v} FROM mem GROUP BY ALL)")
        joins.append(f"LEFT JOIN ct_{v} USING ({by}) LEFT JOIN cn_{v} USING ({by}, {v})")
        factors.append(f"CASE WHEN t_{v} IS NULL THEN 1.0 / r_{v} ELSE coalesce(n_{v}, 0) / t_{v} END")
    combos = f"st_{anc[0]} " + " ".join(f"JOIN st_{v} USING (flag, block)" for v in anc[1:])
    return ", ".join(ctes) + f""",
mg AS (SELECT flag, block, vix, ig_spread_chg, sum({" * ".join(factors)}) AS w
       FROM (SELECT * FROM {combos}) {" ".join(joins)} GROUP BY ALL),
th AS (SELECT flag, block, {", ".join(_EV)}, vix, ig_spread_chg, count(*) AS n_cfg, sum(CASE WHEN regime = 0 THEN 1 ELSE 0 END) AS n_state
       FROM mem GROUP BY ALL)
SELECT s.flag, s.date, s.block, {qs("sum(m.w * coalesce(t.n_state / t.n_cfg, 1.0 / 3))")} AS p_off
FROM steps s JOIN mg m ON m.flag = s.flag AND m.block = s.block
LEFT JOIN th t ON t.flag = s.flag AND t.block = s.block AND t.vix = m.vix AND t.ig_spread_chg = m.ig_spread_chg
      AND {" AND ".join(f"t.{e} = s.{e}" for e in _EV)}
GROUP BY ALL"""


@register("q_j10_parent_marginals", WFSQL + ", " + _intra_sql())
def q_j10_parent_marginals(spark, sf_dir):
    """J10 with fixed same-slice edges in every block."""
    rets = flag_labelled(spark, sf_dir).select("flag", "date", F.col("spx_ret").alias("equity_ret"), "bond_ret")
    bt = wf.walk_forward_learned(flag_disc(spark, sf_dir), rets, FEAT7, "regime", keys=["flag"], intra_edges=INTRA)
    return rnd(bt.select("flag", "date", "block", "p_off"), ["p_off"])


_START = "CASE WHEN n > 121 THEN 120 ELSE 1 END AS start"


@register("q_w15_recent_only", WFSQL.replace(_START, "greatest(n - 60, " + _START.replace(" AS start", ") AS start")) + f"""
SELECT flag, date, block, {qs("p_off")} AS p_off, decision FROM btn""")
def q_w15_recent_only(spark, sf_dir):
    """The backtest of the last 60 steps of every key."""
    rets = flag_labelled(spark, sf_dir).select("flag", "date", F.col("spx_ret").alias("equity_ret"), "bond_ret")
    bt = wf.walk_forward(flag_disc(spark, sf_dir), rets, FEAT7, "regime", keys=["flag"], recent_only=60)
    return rnd(bt.select("flag", "date", "block", "p_off", "decision"), ["p_off"])


@register("q_d12_learned_structure_backtest")
def q_d12_learned_structure_backtest(spark, sf_dir):
    """Backtest whose every block learns its intra-slice structure on its own
    window (hill climbing per block) and marginalises REGIME's same-slice
    parents (J10)."""
    disc = flag_disc(spark, sf_dir)
    rets = flag_labelled(spark, sf_dir).select("flag", "date", F.col("spx_ret").alias("equity_ret"), "bond_ret")
    return wf.walk_forward_learned(disc, rets, FEAT7, "regime", keys=["flag"])
