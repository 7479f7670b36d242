"""Portfolio and classification metrics.

All metrics are grouped aggregates per key; the only windows run over
per-key return series; the ranks of the AUC run over range partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.operators._win import running
from riskpanel.operators.ranks import summed_before

PERIODS_PER_YEAR = 12  # fixed value: monthly annualisation factor of the reference


def sharpe_sortino(df: DataFrame, ret_col: str, *, keys: list[str], rf: float = 0.0,
                   periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """A9 + A10: annualised Sharpe sqrt(p)*mean(ex)/sd(ex) (ddof 1) and Sortino
    with the sd of negative excess returns only (NULL if absent or 0)."""
    ex = F.col(ret_col) - F.lit(rf / periods)
    neg = F.when(ex < 0, ex)
    root = F.lit(math.sqrt(periods))
    return df.groupBy(*keys).agg(
        (root * F.try_divide(F.avg(ex), F.nullif(F.stddev_samp(ex), F.lit(0.0)))).alias("sharpe"),
        (root * F.try_divide(F.avg(ex), F.nullif(F.stddev_samp(neg), F.lit(0.0)))).alias("sortino"))


def wealth_drawdown(df: DataFrame, ret_col: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """W8 + W9 series: wealth = running product of (1 + r), peak = running max
    of wealth (the starting capital 1.0 is not a peak, B10), drawdown =
    wealth / peak - 1. NULL returns keep the running product but emit NULL."""
    w = running(keys, date_col)
    df = df.withColumn("wealth", F.when(F.col(ret_col).isNotNull(), F.product(F.lit(1.0) + F.col(ret_col)).over(w)))
    df = df.withColumn("peak", F.max("wealth").over(w))
    return df.withColumn("drawdown", F.col("wealth") / F.col("peak") - F.lit(1.0))


def max_drawdown(df: DataFrame, ret_col: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Min drawdown per key."""
    dd = wealth_drawdown(df, ret_col, keys=keys, date_col=date_col)
    return dd.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, *, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, *, keys: list[str]) -> DataFrame:
    """Dense matrix per key over the union of the labels that occur in
    either column (any values, null left out), zero-filled. The cells are
    generated from each key's label set, never by pairing data rows."""
    cc = confusion_counts(df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()), y_true, y_pred, keys=keys)
    seen = cc.groupBy(*keys).agg(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("__seen"))
    grid = seen.select(*keys, "__seen", F.explode("__seen").alias("y_true"))
    grid = grid.select(*keys, "y_true", F.explode("__seen").alias("y_pred"))
    out = grid.join(cc, [*keys, "y_true", "y_pred"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, p_off: str | None, *,
                           keys: list[str]) -> DataFrame:
    """A11, A12, A14, A15 per key (``keys`` non-empty; add a constant key
    column for a single series): accuracy, macro-F1 over the union of true and
    predicted labels, and - only when the true labels contain 0, 1 and 2 -
    the Brier score and ROC-AUC of ``p_off`` for class 0 (ties share ranks)."""
    base = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    acc = base.groupBy(*keys).agg(
        F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
        (F.size(F.array_intersect(F.collect_set(F.col(y_true).cast("int")), F.array(*[F.lit(i) for i in (0, 1, 2)])))
         == 3).alias("__all3"))
    cc = confusion_counts(base, y_true, y_pred, keys=keys)
    per = cc.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("l"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("y_pred").alias("l"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")).select(*keys, "s.*")
    f1 = (per.groupBy(*keys, "l").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
          .groupBy(*keys).agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("nt") + F.col("np")).cast("double")),
                                               F.lit(0.0))).alias("f1_macro")))
    out = acc.join(f1, keys, "left")
    if p_off is None:
        return out.drop("__all3")
    y0 = (F.col(y_true) == 0).cast("double")
    brier = base.groupBy(*keys).agg(F.avg(F.pow(F.col(p_off) - y0, 2)).alias("brier_off"))
    auc = _auc(base, y_true, p_off, keys)
    out = out.join(brier, keys, "left").join(auc, keys, "left")
    return out.withColumns({
        "brier_off": F.when(F.col("__all3"), F.col("brier_off")),
        "auc_off": F.when(F.col("__all3"), F.col("auc_off"))}).drop("__all3")


def _auc(df: DataFrame, y_true: str, score: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUC from the distinct-score table: average rank of a
    score = rows with lower scores + (ties + 1) / 2. The rows with lower scores
    are counted over range partitions, so a key may have any number of scores."""
    s = df.groupBy(*keys, F.col(score).alias("__score")).agg(
        F.sum((F.col(y_true) == 0).cast("long")).alias("__pos"), F.count(F.lit(1)).alias("__cnt"))
    s = summed_before(s, keys, ["__score"], "__cnt", "__below")
    s = s.withColumn("__rank", F.col("__below") + (F.col("__cnt") + F.lit(1)) / F.lit(2.0))
    agg = s.groupBy(*keys).agg(F.sum(F.col("__pos") * F.col("__rank")).alias("__sr"),
                               F.sum("__pos").alias("__n1"), F.sum("__cnt").alias("__n"))
    n1, n0 = F.col("__n1").cast("double"), (F.col("__n") - F.col("__n1")).cast("double")
    auc = F.when((F.col("__n1") > 0) & (F.col("__n") > F.col("__n1")),
                 (F.col("__sr") - n1 * (n1 + 1) / 2.0) / (n1 * n0))
    return agg.select(*keys, auc.alias("auc_off"))


def performance_report(bt: DataFrame, *, keys: list[str], date_col: str = "date", net_col: str = "net",
                       y_true: str = "regime", y_pred: str = "decision_code", p_off: str = "p_off") -> DataFrame:
    """Portfolio metrics of the net return plus regime-timing metrics."""
    perf = sharpe_sortino(bt, net_col, keys=keys).join(max_drawdown(bt, net_col, keys=keys, date_col=date_col), keys)
    clf = classification_metrics(bt, y_true, y_pred, p_off, keys=keys)
    return perf.join(clf, keys, "left")
