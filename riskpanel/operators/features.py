"""Series preparation: lags, differences, percent change, rolling means,
N-way alignment, reindexing and reshaping (W1-W6, J1-J4, T2-T5, P5-P8, P15).

All windows are ``partitionBy(keys).orderBy(date)`` so consecutive
operators share one hash exchange on ``keys``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators._win import ordered, running, whole


# ---------------------------------------------------------------- lags
def add_lags(df: DataFrame, cols: list[str], *, keys: list[str], date_col: str = "date",
             n: int = 1, suffix: str | None = None, inplace: bool = False) -> DataFrame:
    """``lag(c, n)`` per key. ``inplace`` overwrites the column (climate lag),
    otherwise writes ``c + suffix`` (default ``_{n}``)."""
    w = ordered(keys, date_col)
    sfx = suffix if suffix is not None else f"_{n}"
    return df.withColumns({(c if inplace else f"{c}{sfx}"): F.lag(c, n).over(w) for c in cols})


def ensure_lags(df: DataFrame, *, keys: list[str], date_col: str = "date",
                exclude: tuple[str, ...] = ("REGIME",), drop_col: str | None = None) -> DataFrame:
    """W4 + P15: keys, date, then every feature, then its lag ``_1`` (taken as it
    is where the input has one), then the excluded columns. If any lag had to be
    made, rows with a null are left out."""
    have = [c for c in df.columns if c != drop_col]
    aside = [c for c in have if c in exclude]
    features = [c for c in have if not c.endswith("_1") and c not in (*keys, date_col, *aside)]
    w = ordered(keys, date_col)
    lag_of = {c: F.col(f"{c}_1") if f"{c}_1" in have else F.lag(c).over(w).alias(f"{c}_1") for c in features}
    others = [c for c in have if c.endswith("_1") and c[:-2] not in features and c not in aside]
    out = df.select(*keys, date_col, *features, *lag_of.values(), *others, *aside)
    return out.dropna() if any(f"{c}_1" not in have for c in features) else out


def split_base_lag(columns: list[str]) -> tuple[list[str], list[str]]:
    """Base names vs ``_1`` lag names, base first."""
    base = [c for c in columns if not c.endswith("_1")]
    lags = [c for c in columns if c.endswith("_1")]
    return base, lags


# ------------------------------------------------------- diff / pct
def diff(df: DataFrame, col: str, out: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """First difference ``c - lag(c)``."""
    return df.withColumn(out, F.col(col) - F.lag(col, 1).over(ordered(keys, date_col)))


def pct_change(df: DataFrame, col: str, out: str, *, keys: list[str], date_col: str = "date",
               fill: str = "pad", block: str | None = None) -> DataFrame:
    """Percent change. ``fill='pad'`` forward-fills before the ratio (the
    default of the reference's dataframe library): an interior gap gives 0 on the
    null row and then the full jump. Division by zero -> NULL [decision].
    ``block`` (a column non-decreasing in date, e.g. the year) switches to the
    blocked scan for one very long series."""
    w = ordered(keys, date_col)
    if fill == "pad" and block is not None:
        from riskpanel.operators import blocks
        tmp = f"__ffill_{col}"
        df = blocks.running_last(df, [col], keys=keys, order=[date_col], block=block, prefix="__ffill_")
        df = blocks.neighbours(df, [tmp], keys=keys, order=[date_col], block=block, prev_prefix="__prev",
                               next_prefix="__next")
        df = df.withColumn(out, F.try_divide(F.col(tmp), F.col(f"__prev{tmp}")) - F.lit(1.0))
        return df.drop(tmp, f"__prev{tmp}", f"__next{tmp}", "__is_first", "__is_last")
    if fill == "pad":
        tmp = f"__ffill_{col}"
        df = df.withColumn(tmp, F.last(col, ignorenulls=True).over(running(keys, date_col)))
        df = df.withColumn(out, F.try_divide(F.col(tmp), F.lag(tmp, 1).over(w)) - F.lit(1.0))
        return df.drop(tmp)
    if fill == "none":
        return df.withColumn(out, F.try_divide(F.col(col), F.lag(col, 1).over(w)) - F.lit(1.0))
    raise ValueError("fill must be 'pad' or 'none'")


def ffill(df: DataFrame, cols: list[str], *, keys: list[str], date_col: str = "date") -> DataFrame:
    w = running(keys, date_col)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


# ------------------------------------------------------- rolling means
def rolling_mean(df: DataFrame, col: str, out: str, window: int, *, keys: list[str],
                 date_col: str = "date", center: bool = False, min_periods: int | None = None) -> DataFrame:
    """Row-count rolling mean; NULL unless ``min_periods`` (default =
    window) non-null values fall in the frame. Centered even windows use
    ``rowsBetween(-w//2, w - w//2 - 1)``, as the reference library does."""
    mp = window if min_periods is None else min_periods
    if center:
        lo, hi = -(window // 2), window - window // 2 - 1
    else:
        lo, hi = -(window - 1), 0
    w = ordered(keys, date_col).rowsBetween(lo, hi)
    return df.withColumn(out, F.when(F.count(col).over(w) >= mp, F.avg(col).over(w)))


# ------------------------------------------------------- alignment
def align_series(long_df: DataFrame, series: list[str], *, keys: list[str], date_col: str = "date",
                 series_col: str = "series_id", value_col: str = "value",
                 check_unique: bool = True) -> DataFrame:
    """N-way outer alignment of long-form series on (keys, date).

    One grouped aggregate replaces N-1 full outer joins. The long input is
    hash-partitioned by ``keys`` only (it holds one row per key, date and
    series, so there is nothing to combine map-side), which also satisfies
    the ``partitionBy(keys)`` windows that follow: one exchange instead of
    two. A (key, date, series) seen twice raises, as the reference's concat
    does on duplicate index labels."""
    if keys:
        long_df = long_df.repartition(*keys)
    aggs = []
    for s in series:
        hit = F.col(series_col) == F.lit(s)
        aggs.append(F.max(F.when(hit, F.col(value_col))).alias(s))
        if check_unique:
            aggs.append(F.count(F.when(hit, F.lit(1))).alias(f"__n_{s}"))
    out = long_df.groupBy(*keys, date_col).agg(*aggs)
    if check_unique:
        bad = reduce(lambda a, b: a | b, [F.col(f"__n_{s}") > 1 for s in series])
        guard = F.when(bad, F.raise_error(F.lit("duplicate (key, date, series) in align_series")))
        out = out.withColumn("__guard", guard).where(F.col("__guard").isNull())
        out = out.drop("__guard", *[f"__n_{s}" for s in series])
    return out


def to_long(df: DataFrame, cols: list[str], *, keys: list[str], date_col: str = "date",
            series_col: str = "series_id", value_col: str = "value") -> DataFrame:
    """T4: wide -> long with ``unpivot`` (no shuffle)."""
    return df.unpivot([*keys, date_col], cols, series_col, value_col)


def outer_align(a: DataFrame, b: DataFrame, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Two-frame full outer join on keys + date."""
    return a.join(b, [*keys, date_col], "full_outer")


def lookup_aligned(left: DataFrame, right: DataFrame, *, keys: list[str], date_col: str = "date",
                   how: str = "inner") -> DataFrame:
    """Label-aligned lookup (inner by date)."""
    return left.join(right, [*keys, date_col], how)


def lookup_required(labels: DataFrame, table: DataFrame, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """J3, strict: the row of ``table`` for every row of ``labels``; fails on the
    first label (keys, date) that the table lacks."""
    on = [*keys, date_col]
    hit = labels.join(table.withColumn("__hit", F.lit(True)), on, "left")
    said = F.concat_ws(" ", F.lit("no row for label"), *[F.col(c).cast("string") for c in on])
    known = F.when(F.col("__hit"), F.col(date_col)).otherwise(F.raise_error(said).cast(labels.schema[date_col].dataType))
    return hit.withColumn(date_col, known).drop("__hit")


def daily_spine(df: DataFrame, *, keys: list[str], date_col: str = "date", step: str = "1 day") -> DataFrame:
    """Per-key calendar from min to max date: one row per key, then ``explode``.
    Work and output are linear in the calendar length."""
    bounds = df.groupBy(*keys).agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    return bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {step}"))).alias(date_col))


def reindex(df: DataFrame, spine: DataFrame, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Left join onto a target spine; nulls where absent."""
    return spine.join(df, [*keys, date_col], "left")


# ------------------------------------------------------- filters
def drop_null_rows(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """P5/P7."""
    return df.dropna(how=how, subset=subset)


def drop_all_null_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One aggregate pass counts non-nulls per column, then prunes (the
    only action here is a one-row ``first()``)."""
    cols = cols or df.columns
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    keep = [c for c in df.columns if c not in counts or counts[c] > 0]
    return df.select(*keep)


def filled_columns(df: DataFrame, cols: list[str], *, keys: list[str]) -> DataFrame:
    """P6 per key: (keys, filled), the names of the columns in which the key has any value, in the order of ``cols``.
    One grouped aggregate with map-side partial sums; a column may be empty for one key and filled for another."""
    held = df.groupBy(*keys).agg(*[F.max(F.col(c).isNotNull()).alias(f"__{i}") for i, c in enumerate(cols)])
    names = F.array(*[F.when(F.col(f"__{i}"), F.lit(c)) for i, c in enumerate(cols)])
    return held.select(*keys, F.array_compact(names).alias("filled"))


def trailing_months(df: DataFrame, months: int, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Rows within ``months`` of each key's last date, the row exactly that far back included."""
    mx = F.max(date_col).over(whole(keys))
    return df.withColumn("__mx", mx).where(F.col(date_col) >= F.add_months("__mx", -months)).drop("__mx")


def head_tail(df: DataFrame, n: int, *, keys: list[str], date_col: str = "date", tail: bool = False) -> DataFrame:
    """first/last ``n`` rows per key (row_number, no global sort)."""
    o = F.col(date_col).desc() if tail else F.col(date_col).asc()
    rn = F.row_number().over(ordered(keys, o))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise listing missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    """P13."""
    return next((c for c in candidates if c in df.columns), None)


def row_position(df: DataFrame, *, keys: list[str], date_col: str = "date", out: str = "pos") -> DataFrame:
    """0-based row position per key."""
    return df.withColumn(out, F.row_number().over(ordered(keys, date_col)) - 1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """T3."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


__all__ = [n for n in dir() if not n.startswith("_")] + ["Window"]
