"""Regime labelling.

Codes: 0 = risk-off, 1 = neutral, 2 = risk-on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators._win import ordered, running

# The reference's default rule thresholds.
RISK_OFF_VIX = 25.0
RISK_OFF_SPREAD_CHG = 0.40
RISK_ON_VIX = 15.0
RISK_ON_SPREAD_CHG = -0.20


def rule_label(vix, spread_chg, *, off_vix: float = RISK_OFF_VIX, off_chg: float = RISK_OFF_SPREAD_CHG,
               on_vix: float = RISK_ON_VIX, on_chg: float = RISK_ON_SPREAD_CHG) -> Column:
    """P10: neutral by default; risk-off if vix > off_vix or chg > off_chg; risk-on
    (assigned last, so it wins) if vix < on_vix and chg < on_chg. NULL inputs
    never fire a rule (NULL in ``when`` is false, as NaN comparisons are)."""
    v = F.col(vix) if isinstance(vix, str) else vix
    s = F.col(spread_chg) if isinstance(spread_chg, str) else spread_chg
    risk_off = (v > off_vix) | (s > off_chg)
    risk_on = (v < on_vix) & (s < on_chg)
    return F.when(risk_on, F.lit(2)).when(risk_off, F.lit(0)).otherwise(F.lit(1))


def missing_span_mask(df: DataFrame, cols: list[str], *, keys: list[str], date_col: str = "date",
                      out: str = "__span", block: str | None = None) -> DataFrame:
    """W7 (B9): true on the 2nd and later rows of a run of rows where all
    ``cols`` are null (rolling(2).sum()==2 ⇔ this row and the previous)."""
    allnull = F.lit(True)
    for c in cols:
        allnull = allnull & F.col(c).isNull()
    m = "__allnull"
    df = df.withColumn(m, allnull)
    if block is not None:
        from riskpanel.operators import blocks
        df = blocks.neighbours(df, [m], keys=keys, order=[date_col], block=block, prev_prefix="__p",
                               next_prefix="__n")
        res = df.withColumn(out, F.col(m) & F.coalesce(F.col(f"__p{m}"), F.lit(False)))
        return res.drop(m, f"__p{m}", f"__n{m}", "__is_first", "__is_last")
    prev = F.lag(m, 1).over(ordered(keys, date_col))
    return df.withColumn(out, F.col(m) & F.coalesce(prev, F.lit(False))).drop(m)


def hysteresis(df: DataFrame, label_col: str, out: str, *, keys: list[str], date_col: str = "date",
               h: int = 1) -> DataFrame:
    """W12 in closed form (no row loop).

    A row is *confirmed* when it is the key's first row, its label is NULL, or
    the label holds for the next ``h`` rows as well (rows past the end never
    confirm, B8). The output is the label of the latest confirmed row at or
    before each row; NULL labels are confirmed, so they pass through and reset.
    """
    w = ordered(keys, date_col)
    lab = F.col(label_col)
    is_first = F.row_number().over(w) == 1
    holds = F.lit(True)
    for i in range(1, h + 1):
        holds = holds & F.coalesce(F.lead(label_col, i).over(w) == lab, F.lit(False))
    conf = is_first | lab.isNull() | holds
    carried = F.last(F.when(conf, F.struct(lab.alias("v"))), ignorenulls=True).over(running(keys, date_col))
    return df.withColumn(out, carried.getField("v").cast("int"))


def hybrid_regime(df: DataFrame, *, keys: list[str], date_col: str = "date", vix_col: str = "VIX",
                  spread_chg_col: str = "IGSpreadChg", h: int = 1, out: str = "REGIME",
                  override: str = "always", base_col: str | None = None, block: str | None = None,
                  **thresholds) -> DataFrame:
    """D5 = P10 + J5 + W7 + W12.

    ``block`` (a column non-decreasing in date, e.g. the year) runs W7 and
    W12 as blocked scans, for one very long series or a hot key.

    ``override='always'`` (reference behaviour, B1): the rule label always wins,
    so the mixture base label never reaches the output and is not computed.
    ``override='when_fired'``: rule label where a rule fired, else ``base_col``.
    """
    rule = rule_label(vix_col, spread_chg_col, **thresholds)
    if override == "always":
        hyb = rule
    elif override == "when_fired":
        if base_col is None:
            raise ValueError("override='when_fired' needs base_col (e.g. from gmm_states)")
        hyb = F.when(rule != 1, rule).otherwise(F.col(base_col))
    else:
        raise ValueError("override must be 'always' or 'when_fired'")
    df = df.withColumn("__hyb", hyb)
    df = missing_span_mask(df, [vix_col, spread_chg_col], keys=keys, date_col=date_col, out="__span", block=block)
    df = df.withColumn("__hyb", F.when(~F.col("__span"), F.col("__hyb")))
    if block is not None:
        from riskpanel.operators import blocks
        df = blocks.hysteresis(df, "__hyb", out, keys=keys, order=[date_col], block=block, h=h)
    else:
        df = hysteresis(df, "__hyb", out, keys=keys, date_col=date_col, h=h)
    return df.drop("__hyb", "__span")


def order_states_by_mean(df: DataFrame, state_col: str, ret_col: str, out: str, *,
                         keys: list[str] | None = None) -> DataFrame:
    """Relabel states 0..k-1 by ascending mean of ``ret_col`` (0 = worst).
    The state table is tiny (keys x k) and joined back."""
    keys = keys or []
    means = df.where(F.col(state_col).isNotNull()).groupBy(*keys, state_col).agg(F.avg(ret_col).alias("__m"))
    w = Window.partitionBy(*keys).orderBy("__m", state_col) if keys else Window.orderBy("__m", state_col)
    mapping = means.withColumn(out, (F.row_number().over(w) - 1).cast("int")).drop("__m")
    return df.join(mapping, [*keys, state_col], "left")


def gmm_states(df: DataFrame, features: list[str], *, keys: list[str], date_col: str = "date",
               ret_col: str = "SPX_ret", k: int = 3, n_init: int = 10, seed: int = 42, out: str = "gmm_state",
               max_iter: int = 100, tol: float = 1e-3, reg_covar: float = 1e-6) -> DataFrame:
    """Gaussian-mixture states per series (full covariance, ``n_init``
    seeded restarts, best final log-likelihood), fitted on the finite rows of
    ``features``, then A8 ordering by mean ``ret_col`` (0 = worst).

    One EM per key inside ``applyInPandas``: a key's rows are one series (one
    row per date, bounded by the calendar), and EM on a few thousand points
    is milliseconds of numpy, whereas a distributed EM would run one job per
    iteration. Initialisation: k-means (a few Lloyd rounds from k distinct
    random rows) per restart, as the reference library's default."""
    from riskpanel.functions.nulls import finite

    fin = df.select(*keys, date_col, *[finite(c).alias(c) for c in features],
                    *([F.col(ret_col)] if ret_col not in features else []))
    fin = fin.dropna(subset=features)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + \
        f", `{date_col}` {df.schema[date_col].dataType.simpleString()}, __raw int"

    def fit(pdf):
        import pandas as pd
        x = pdf[features].to_numpy(float)
        lab = _em_best(x, k, n_init, seed, max_iter, tol, reg_covar)
        res = pd.DataFrame({date_col: pdf[date_col].to_numpy(), "__raw": lab.astype("int32")})
        for c in keys:
            res[c] = pdf[c].iloc[0]
        return res[[*keys, date_col, "__raw"]]

    raw = fin.groupBy(*keys).applyInPandas(fit, schema=schema)
    raw = raw.join(fin.select(*keys, date_col, ret_col), [*keys, date_col])
    ordered_df = order_states_by_mean(raw, "__raw", ret_col, out, keys=keys)
    return df.join(ordered_df.select(*keys, date_col, out), [*keys, date_col], "left")


def _em_best(x, k, n_init, seed, max_iter, tol, reg_covar):
    import numpy as np
    n, d = x.shape
    if n < k:
        return np.zeros(n, dtype=int)
    best_lb, best_lab = -np.inf, None
    for r in range(n_init):
        rng = np.random.default_rng(seed + r)
        cent = x[rng.choice(n, size=k, replace=False)]
        for _ in range(10):                                   # k-means initialisation
            j = np.argmin(((x[:, None, :] - cent[None]) ** 2).sum(-1), axis=1)
            cent = np.array([x[j == c].mean(0) if (j == c).any() else cent[c] for c in range(k)])
        resp = np.eye(k)[j]
        lb_old = -np.inf
        for _ in range(max_iter):
            nk = resp.sum(0) + 10 * np.finfo(float).eps       # M step
            w = nk / n
            mu = resp.T @ x / nk[:, None]
            cov = np.empty((k, d, d))
            for c in range(k):
                diff = x - mu[c]
                cov[c] = (resp[:, c, None] * diff).T @ diff / nk[c] + reg_covar * np.eye(d)
            logp = np.empty((n, k))                           # E step
            for c in range(k):
                chol = np.linalg.cholesky(cov[c])
                z = np.linalg.solve(chol, (x - mu[c]).T)
                logp[:, c] = (np.log(w[c]) - 0.5 * (z ** 2).sum(0) - np.log(np.diag(chol)).sum()
                              - 0.5 * d * np.log(2 * np.pi))
            mx = logp.max(1, keepdims=True)
            lse = mx[:, 0] + np.log(np.exp(logp - mx).sum(1))
            resp = np.exp(logp - lse[:, None])
            lb = lse.mean()
            if abs(lb - lb_old) < tol:
                break
            lb_old = lb
        if lb > best_lb:
            best_lb, best_lab = lb, resp.argmax(1)
    return best_lab
