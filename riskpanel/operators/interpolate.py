"""Month -> day resampling, interpolation and smoothing.

Knot-interval form: knots are the non-null (date, value) rows of a key; each
interval between consecutive knots explodes only its own days, so the work is
linear in the output and no dense window over the daily grid is needed. The
daily axis of a key runs from its first to its last row (null rows included),
as in the reference; x is the day offset from the key's first knot.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators._win import ordered, whole

# Fixed value: relative threshold below which an Akima slope weight counts as zero.
AKIMA_EPS = 1e-9


def _knots(df: DataFrame, value: str, *, keys: list[str], date_col: str) -> DataFrame:
    """Knots with interval neighbours: (keys, d, y, d2, y2, lo, hi, x0, first, last, kn)."""
    axis = df.groupBy(*keys).agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    k = df.where(F.col(value).isNotNull()).select(*keys, F.col(date_col).alias("d"), F.col(value).cast("double").alias("y"))
    w = ordered(keys, "d")
    k = k.withColumns({"d2": F.lead("d").over(w), "y2": F.lead("y").over(w),
                       "x0": F.min("d").over(whole(keys)), "kn": F.count(F.lit(1)).over(whole(keys)),
                       "ki": F.row_number().over(w) - 1})
    return k.join(axis, keys)


def _days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end))


def _intervals(k: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """One row per day: the interval (knot i -> i+1) that owns it. Interval i owns
    [d_i, d_{i+1} - 1]; the first also owns the days before the first knot, the
    last owns its right knot and the days after it. A one-knot key owns its axis."""
    first, last_iv = F.col("ki") == 0, F.col("ki") == F.col("kn") - 2
    start = F.when(first, F.col("lo")).otherwise(F.col("d"))
    end = F.when(last_iv | (F.col("kn") == 1), F.col("hi")).otherwise(F.date_sub(F.col("d2"), 1))
    iv = k.where(F.col("d2").isNotNull() | (F.col("kn") == 1))
    return iv.withColumn(date_col, _days(start, end))


def daily_grid(df: DataFrame, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Every day from each key's first to last row, left-joined to the data."""
    from riskpanel.operators.features import daily_spine, reindex
    return reindex(df, daily_spine(df, keys=keys, date_col=date_col), keys=keys, date_col=date_col)


def interpolate_time(df: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Time-linear interpolation on the daily grid; days before the first
    knot stay NULL, days after the last knot carry its value, knots are exact."""
    iv = _intervals(_knots(df, value, keys=keys, date_col=date_col), keys, date_col)
    t = F.col(date_col)
    lin = F.col("y") + (F.col("y2") - F.col("y")) * F.datediff(t, F.col("d")).cast("double") \
        / F.datediff(F.col("d2"), F.col("d")).cast("double")
    v = (F.when(t < F.col("d"), F.lit(None).cast("double"))
         .when(F.col("d2").isNull() | (t >= F.col("d2")), F.coalesce(F.col("y2"), F.col("y")))
         .when(t == F.col("d"), F.col("y"))
         .otherwise(lin))
    return iv.select(*keys, date_col, v.alias(out))


def interpolate_index(df: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Index-linear fill of NULLs on the rows as given (x = row position):
    leading NULLs stay, trailing NULLs carry the last value."""
    w = ordered(keys, date_col)
    df = df.withColumn("__i", F.row_number().over(w))
    kv = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).cast("double").alias("v")))
    prev = F.last(kv, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(kv, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__p": prev, "__n": nxt})
    p, n = F.col("__p"), F.col("__n")
    lin = p.v + (n.v - p.v) * (F.col("__i") - p.i).cast("double") / (n.i - p.i).cast("double")
    v = (F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
         .when(p.isNull(), F.lit(None).cast("double"))
         .when(n.isNull(), p.v)
         .otherwise(lin))
    return df.withColumn(out, v).drop("__i", "__p", "__n")


def _hermite(iv: DataFrame, keys: list[str], date_col: str, out: str, extrapolate: bool) -> DataFrame:
    """Evaluate the cubic of the owning interval: with s = x - x_i, h = x_{i+1} - x_i,
    c2 = (3m - 2d_i - d_{i+1}) / h, c3 = (d_i + d_{i+1} - 2m) / h^2,
    p(s) = y_i + d_i s + c2 s^2 + c3 s^3 (power sum, as a piecewise polynomial
    is evaluated)."""
    h = F.datediff(F.col("d2"), F.col("d")).cast("double")
    m = (F.col("y2") - F.col("y")) / h
    c2 = (F.lit(3.0) * m - F.lit(2.0) * F.col("sd") - F.col("sd2")) / h
    c3 = (F.col("sd") + F.col("sd2") - F.lit(2.0) * m) / (h * h)
    s = F.datediff(F.col(date_col), F.col("d")).cast("double")
    val = F.col("y") + F.col("sd") * s + c2 * (s * s) + c3 * (s * s * s)
    inside = (F.col(date_col) >= F.col("x0")) & (F.col(date_col) <= F.col("xl"))
    if not extrapolate:
        val = F.when(inside, val)
    val = F.when(F.col("kn") == 1, F.when(F.col(date_col) == F.col("d"), F.col("y"))).otherwise(val)
    return iv.select(*keys, date_col, val.alias(out))


def _slopes_frame(df, value, keys, date_col):
    k = _knots(df, value, keys=keys, date_col=date_col)
    w = ordered(keys, "d")
    k = k.withColumn("xl", F.max("d").over(whole(keys)))
    k = k.withColumn("h", F.datediff(F.col("d2"), F.col("d")).cast("double"))
    k = k.withColumn("m", (F.col("y2") - F.col("y")) / F.col("h"))      # secant of interval i (NULL on last knot)
    return k, w


def pchip(df: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """I4: shape-preserving piecewise cubic Hermite (Fritsch-Butland slopes,
    weighted harmonic mean inside, one-sided three-point ends); extrapolates
    with the end pieces. Two knots -> straight line."""
    k, w = _slopes_frame(df, value, keys, date_col)
    mp, hp = F.lag("m").over(w), F.lag("h").over(w)                   # m_{i-1}, h_{i-1}
    k = k.withColumns({"mp": mp, "hp": hp, "mn": F.lead("m").over(w), "hn": F.lead("h").over(w),
                       "mpp": F.lag("m", 2).over(w), "hpp": F.lag("h", 2).over(w)})
    m0, m1, h0, h1 = F.col("mp"), F.col("m"), F.col("hp"), F.col("h")
    w1 = F.lit(2.0) * h1 + h0
    w2 = h1 + F.lit(2.0) * h0
    interior = F.when((F.signum(m0) != F.signum(m1)) | (m1 == 0) | (m0 == 0), F.lit(0.0)) \
        .otherwise(F.lit(1.0) / ((w1 / m0 + w2 / m1) / (w1 + w2)))
    first = _pchip_edge(F.col("h"), F.col("hn"), F.col("m"), F.col("mn"))
    last = _pchip_edge(F.col("hp"), F.col("hpp"), F.col("mp"), F.col("mpp"))
    two = F.coalesce(F.col("m"), F.col("mp"))
    sd = (F.when(F.col("kn") == 2, two)
          .when(F.col("ki") == 0, first)
          .when(F.col("ki") == F.col("kn") - 1, last)
          .otherwise(interior))
    k = k.withColumn("sd", sd).withColumn("sd2", F.lead("sd").over(w))
    return _hermite(_intervals(k, keys, date_col), keys, date_col, out, extrapolate=True)


def _pchip_edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    d = ((F.lit(2.0) * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (F.when(F.signum(d) != F.signum(m0), F.lit(0.0))
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.lit(3.0) * F.abs(m0)), F.lit(3.0) * m0)
            .otherwise(d))


def akima(df: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date") -> DataFrame:
    """Akima (1970) local cubic. Secants m_i with two extrapolated secants on
    each side (2m_0 - m_1, ...); slope t_i = (|m_{i+1}-m_i| m_{i-1} + |m_{i-1}-m_{i-2}| m_i)
    / (sum of weights), or (m_{i+1} + m_{i-2}) / 2 when the weights vanish
    (relative to the key's largest weight sum). NULL outside the knots."""
    k, w = _slopes_frame(df, value, keys, date_col)
    at = lambda pos: F.max(F.when(F.col("ki") == pos, F.col("m"))).over(whole(keys))
    k = k.withColumns({"m_m2": F.lag("m", 2).over(w), "m_m1": F.lag("m", 1).over(w), "m_0": F.col("m"),
                       "m_p1": F.lead("m", 1).over(w), "s0": at(F.lit(0)), "s1": at(F.lit(1)),
                       "sl": at(F.col("kn") - 2), "sl2": at(F.col("kn") - 3)})
    n = F.col("kn")
    left1 = F.lit(2.0) * F.col("s0") - F.col("s1")            # m_{-1}
    left2 = F.lit(2.0) * left1 - F.col("s0")                  # m_{-2}
    right1 = F.lit(2.0) * F.col("sl") - F.col("sl2")          # m_{n-1}
    right2 = F.lit(2.0) * right1 - F.col("sl")                # m_n
    i = F.col("ki")

    def sec_at(offset: int, base: Column) -> Column:
        j = i + offset                                        # index of the secant wanted
        return (F.when(j == -2, left2).when(j == -1, left1)
                .when(j == n - 1, right1).when(j == n, right2).otherwise(base))

    mm2, mm1 = sec_at(-2, F.col("m_m2")), sec_at(-1, F.col("m_m1"))
    m0, mp1 = sec_at(0, F.col("m_0")), sec_at(1, F.col("m_p1"))
    f1 = F.abs(mp1 - m0)
    f2 = F.abs(mm1 - mm2)
    k = k.withColumns({"__f1": f1, "__f2": f2, "__mm1": mm1, "__m0": m0, "__fill": F.lit(0.5) * (mp1 + mm2)})
    k = k.withColumn("__f12", F.col("__f1") + F.col("__f2"))
    k = k.withColumn("__fmax", F.max("__f12").over(whole(keys)))
    t = F.when(F.col("__f12") > F.lit(AKIMA_EPS) * F.col("__fmax"),
               (F.col("__f1") * F.col("__mm1") + F.col("__f2") * F.col("__m0")) / F.col("__f12")) \
        .otherwise(F.col("__fill"))
    k = k.withColumn("sd", F.when(n >= 3, t).otherwise(F.coalesce(F.col("m"), F.lag("m").over(w))))
    k = k.withColumn("sd2", F.lead("sd").over(w))
    return _hermite(_intervals(k, keys, date_col), keys, date_col, out, extrapolate=False)


def savgol_coefficients(window: int, polyorder: int) -> list[float]:
    """Smoothing weights of a centred Savitzky-Golay filter: first row of the
    pseudo-inverse of the Vandermonde matrix of offsets -w..w (numpy, driver)."""
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float)
    a = np.vander(x, polyorder + 1, increasing=True)
    return [float(v) for v in np.linalg.pinv(a)[0]]


def savgol(daily: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date",
           window: int = 91, polyorder: int = 2, months: float | None = None) -> DataFrame:
    """Savitzky-Golay smoothing of a daily series with 'nearest' edge
    padding: out_i = sum_j c_j * y[clamp(i + j)].

    ``window`` rows for every key, or with ``months`` a window for each key: the
    odd number of days nearest to so many months, no longer than the key's
    series (F11). One window pass: a row gathers its neighbours as an array of
    at most the window's size, whatever the data volume. Coefficients are fitted
    on the driver for each distinct window length."""
    w = ordered(keys, date_col)
    d = daily.withColumns({"__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole(keys))})
    if months is None:
        widths = {None: window}
        d = d.withColumn("__c", F.array(*[F.lit(c) for c in savgol_coefficients(window, polyorder)]))
    else:
        sizes = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("n").distinct()  # lengths of series
        widths = {r.n: savgol_window(months, polyorder, r.n) for r in sizes.collect()}
        coef = {v: savgol_coefficients(v, polyorder) for v in set(widths.values())}
        by_width = F.create_map(*[x for v, c in coef.items() for x in (F.lit(v), F.array(*[F.lit(y) for y in c]))])
        width = F.create_map(*[x for n, v in widths.items() for x in (F.lit(n), F.lit(v))])[F.col("__n")]
        d = d.withColumn("__c", by_width[width])
    reach = max(widths.values(), default=1) // 2
    near = F.collect_list(F.struct(F.col(value).cast("double").alias("y"))).over(w.rowsBetween(-reach, reach))
    d = d.withColumns({"__y": near, "__at": F.least(F.col("__i"), F.lit(reach + 1))})
    half = F.floor(F.size("__c") / 2).cast("int")
    place = lambda k: F.least(F.greatest(F.col("__at") - half + k, F.lit(1)), F.size("__y")).cast("int")
    terms = F.transform("__c", lambda c, k: c * F.element_at("__y", place(k))["y"])
    smooth = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return d.withColumn(out, smooth).drop("__i", "__n", "__c", "__y", "__at")


def savgol_window(months: float, polyorder: int, n: int) -> int:
    from riskpanel.functions.calendar import months_to_odd_days
    return months_to_odd_days(months, polyorder, n)


def lowess(daily: DataFrame, value: str, out: str, *, keys: list[str], date_col: str = "date",
           frac: float = 0.15, it: int = 1, block_rows: int = 4096) -> DataFrame:
    """LOWESS (Cleveland 1979) of a daily series: a tricube-weighted local line
    over the k = max(2, floor(frac * n)) rows around each row (the window is moved
    inwards at the ends), ``it`` bisquare robustness rounds. n counts the rows with
    a value; a day without one takes no part and gets NULL.

    On either side of a row the tricube weight is a polynomial of degree 9 in the
    distance, so the sums of the local line follow from moments of the window's rows. A
    series is cut into blocks of min(k / 2, ``block_rows``) rows. Whole blocks inside a window
    stand for their rows by 23 moments about their own centre; only the block of a row and those
    that its window's ends cut come as rows. A group has at most seven blocks of rows, whatever
    ``k``. The robustness scale (median |residual| of the key) is an exact
    per-key percentile; each round's residuals are a table."""
    from riskpanel.session import materialize
    if not keys:
        one = lowess(daily.withColumn("__one", F.lit(0)), value, out, keys=["__one"], date_col=date_col, frac=frac, it=it, block_rows=block_rows)
        return one.drop("__one")
    used = daily.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    d = used.select(*keys, F.col(date_col).alias("__d"), F.col(value).cast("double").alias("__y"))
    d = d.withColumns({"__i": F.row_number().over(ordered(keys, "__d")) - 1, "__n": F.count(F.lit(1)).over(whole(keys)),
                       "__x": F.datediff("__d", F.min("__d").over(whole(keys))).cast("double"), "__rw": F.lit(1.0)})
    k = F.least(F.col("__n"), F.greatest(F.lit(2), F.floor(F.col("__n") * F.lit(frac)))).cast("int")
    d = d.withColumn("__k", k).withColumn("__b", F.least(F.greatest(F.floor(F.col("__k") / 2), F.lit(1)), F.lit(block_rows)).cast("int"))
    d = d.withColumn("__blk", F.floor(F.col("__i") / F.col("__b")).cast("int"))
    lo, hi = (fn("__x").over(whole([*keys, "__blk"])) for fn in (F.min, F.max))
    d = d.withColumns({"__c": (lo + hi) / 2, "__s": F.greatest((hi - lo) / 2, F.lit(1.0))})  # a block's centre and scale
    for r in range(it + 1):
        rows = materialize(d)
        d = rows.join(_lowess_pass(rows, keys), [*keys, "__i"])
        if r < it:
            res = materialize(d.withColumn("__res", F.abs(F.col("__y") - F.col("__fit"))))
            med = res.groupBy(*keys).agg(F.percentile("__res", 0.5).alias("__med"))
            u = F.col("__res") / (F.lit(6.0) * F.col("__med"))
            rw = F.when(F.col("__med") <= 0, F.lit(1.0)).otherwise(
                F.when(F.abs(u) < 1, F.pow(F.lit(1.0) - u * u, 2)).otherwise(F.lit(0.0)))
            d = res.join(med, keys).withColumn("__rw", rw).drop("__res", "__med", "__fit")
    fits = d.select(*keys, F.col("__d").alias(date_col), F.col("__fit").alias(out))
    return daily.join(fits, [*keys, date_col], "left")


_TOP = 11  # highest power of the distance: 9 of the tricube weight and 2 of the line's normal equations
_CHOOSE = np.array([[comb(q, r) for r in range(_TOP + 1)] for q in range(_TOP + 1)], float)


def _moment_terms(x: np.ndarray, y: np.ndarray, rw: np.ndarray, centre: float, scale: float) -> np.ndarray:
    """Each row's terms of its block's moments: rw * s^q for q to 11, rw * y * s^q for q to 10, s its scaled offset."""
    powers = ((x - centre) / scale)[:, None] ** np.arange(_TOP + 1) * rw[:, None]
    return np.concatenate([powers, powers[:, :_TOP] * y[:, None]], axis=1)


def _line_sums(v: np.ndarray, centre: float, scale: float, xi: np.ndarray, h: np.ndarray, side: int) -> np.ndarray:
    """Tricube-weighted sums of 1, t, t^2, y, t y of rows left (-1) or right (1) of ``xi``, from their moments ``v``
    about ``centre``; t = (x - xi) / h. The weight is (1 - side t^3)^3 with side t in 0..1."""
    top = _TOP + 1
    q, r = np.tril_indices(top)
    shifted = np.zeros((len(xi), top, top))  # row q: moment q about xi from the moments r <= q about the centre
    shifted[:, q, r] = _CHOOSE[q, r] * ((scale / h)[:, None] ** r) * (((centre - xi) / h)[:, None] ** (q - r))
    plain = np.einsum("mqr,mr->mq", shifted, v[:, :top])
    with_y = np.einsum("mqr,mr->mq", shifted[:, :_TOP, :_TOP], v[:, top:])
    cube = np.array([1, -3 * side, 3, -side])  # of t^0, t^3, t^6 and t^9
    return np.stack([*(plain[:, p::3][:, :4] @ cube for p in (0, 1, 2)), *(with_y[:, p::3][:, :4] @ cube for p in (0, 1))])


def _lowess_pass(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __i, __fit) of one round over rows (keys, __i, __n, __k, __b, __blk, __c, __s, __x, __y, __rw)."""
    kd = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys)

    offset = (F.col("__x") - F.col("__c")) / F.col("__s")
    terms = [F.sum(F.col("__rw") * F.pow(offset, F.lit(float(q)))) for q in range(_TOP + 1)]
    terms += [F.sum(F.col("__rw") * F.col("__y") * F.pow(offset, F.lit(float(q)))) for q in range(_TOP)]
    moments = d.groupBy(*keys, "__blk").agg(F.min("__i").alias("__first"), F.first("__c").alias("__c"), F.first("__s").alias("__s"),
                                            F.array(*terms).alias("__v"))
    # the blocks that the windows of a block's rows start in, end in and run over
    left = lambda i: F.greatest(F.lit(0), F.least(i - F.floor(F.col("__k") / 2), F.col("__n") - F.col("__k")))
    block = lambda i: F.floor(i / F.col("__b")).cast("int")
    own = d.groupBy(*keys, F.col("__blk").alias("__to")).agg(
        *[F.first(c).alias(c) for c in ("__n", "__k", "__b")], F.min("__i").alias("__lo"), F.max("__i").alias("__hi"))
    a0, a1 = left(F.col("__lo")), left(F.col("__hi"))
    b0, b1 = a0 + F.col("__k") - 1, a1 + F.col("__k") - 1
    cut = F.array_union(F.array("__to"), F.array_union(F.sequence(block(a0), block(a1)), F.sequence(block(b0), block(b1))))
    over = F.sequence(block(a0), block(b1))
    cut_by = own.select(*keys, "__to", F.explode(cut).alias("__blk"))
    inner = own.select(*keys, "__to", F.explode(F.array_except(over, cut)).alias("__blk"))
    rows = d.join(cut_by, [*keys, "__blk"]).select(*keys, "__to", "__blk", "__i", "__n", "__k", "__x", "__y", "__rw", "__c", "__s")
    whole_blocks = moments.join(inner, [*keys, "__blk"])
    whole_blocks = whole_blocks.select(*[F.col(c).alias(c) for c in whole_blocks.columns])  # columns of its own for the cogroup

    def fit(pdf, blocks):
        import pandas as pd
        pdf = pdf.sort_values("__i")
        i, x = pdf["__i"].to_numpy(np.int64), pdf["__x"].to_numpy(float)
        y, rw = pdf["__y"].to_numpy(float), pdf["__rw"].to_numpy(float)
        centres, scales = pdf["__c"].to_numpy(float), pdf["__s"].to_numpy(float)
        blk, to = pdf["__blk"].to_numpy(), int(pdf["__to"].iloc[0])
        n, k = int(pdf["__n"].iloc[0]), int(pdf["__k"].iloc[0])
        at, xi = i[blk == to], x[blk == to]
        a = np.clip(at - k // 2, 0, n - k)
        h = np.maximum(xi - x[np.searchsorted(i, a)], x[np.searchsorted(i, a + k - 1)] - xi)
        h = np.where(h > 0, h, 1.0)
        total = np.zeros((5, len(at)))
        for c in np.unique(blk):
            here = blk == c
            centre, scale = centres[here][0], scales[here][0]
            terms = _moment_terms(x[here], y[here], rw[here], centre, scale)
            upto = np.concatenate([np.zeros((1, terms.shape[1])), np.cumsum(terms, axis=0)])
            first, m = i[here][0], len(terms)
            from_, mid, end = (np.clip(e - first, 0, m) for e in (a, at + 1, a + k))
            total += _line_sums(upto[np.maximum(mid, from_)] - upto[from_], centre, scale, xi, h, -1)
            total += _line_sums(upto[end] - upto[np.minimum(mid, end)], centre, scale, xi, h, 1)
        for b in blocks.itertuples(index=False):
            row = dict(zip(blocks.columns, b))
            side = -1 if row["__first"] < at[0] else 1
            v = np.broadcast_to(np.asarray(row["__v"], float), (len(at), 2 * _TOP + 1))
            total += _line_sums(v, row["__c"], row["__s"], xi, h, side)
        s0, s1, s2, u0, u1 = total
        some = s0 > 1e-12
        safe = np.where(some, s0, 1.0)
        mx, my = s1 / safe, u0 / safe
        vx = s2 - mx * s1
        slope = np.divide(u1 - mx * u0, vx, out=np.zeros_like(vx), where=vx > 1e-12 * safe)
        fitted = np.where(some, my - slope * mx, y[blk == to])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(at) for c in keys}, "__i": at.astype("int32"), "__fit": fitted})

    # the rows are few and the work on them is much: keep them in as many tasks as a shuffle has
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, whole_blocks = (t.repartition(parts, *keys, "__to") for t in (rows, whole_blocks))
    return rows.groupBy(*keys, "__to").cogroup(whole_blocks.groupBy(*keys, "__to")).applyInPandas(fit, f"{kd}, __i int, __fit double")


def _spline_knots(x: np.ndarray, k: int) -> np.ndarray:
    """Default knot vector of a degree-k interpolating B-spline: not-a-knot for
    odd k, midpoints without the 2nd and 2nd-to-last for k = 2 (the
    conventions of the common scientific-Python spline builders)."""
    if k == 1:
        return np.r_[x[0], x, x[-1]]
    if k == 2:
        mid = (x[1:] + x[:-1]) / 2.0
        return np.r_[(x[0],) * 3, mid[1:-1], (x[-1],) * 3]
    if k % 2 != 1:
        raise ValueError("spline order must be odd, or 1, or 2")
    m = (k - 1) // 2
    return np.r_[(x[0],) * (k + 1), x[m + 1:len(x) - m - 1], (x[-1],) * (k + 1)]


def _bspline_basis(t: np.ndarray, k: int, xs: np.ndarray) -> np.ndarray:
    """Cox-de Boor: matrix B[i, j] = B_j,k(xs[i]) for knot vector t."""
    n = len(t) - k - 1
    xs = np.asarray(xs, float)
    # degree 0, right end included in the last non-empty interval
    b = np.zeros((len(xs), len(t) - 1))
    for j in range(len(t) - 1):
        if t[j] < t[j + 1]:
            b[:, j] = (xs >= t[j]) & (xs < t[j + 1])
    last = np.max(np.nonzero(t[:-1] < t[1:])[0])
    b[xs == t[-1], last] = 1.0
    for d in range(1, k + 1):
        nb = np.zeros((len(xs), len(t) - 1 - d))
        for j in range(len(t) - 1 - d):
            den1, den2 = t[j + d] - t[j], t[j + d + 1] - t[j + 1]
            a = (xs - t[j]) / den1 * b[:, j] if den1 > 0 else 0.0
            c = (t[j + d + 1] - xs) / den2 * b[:, j + 1] if den2 > 0 else 0.0
            nb[:, j] = a + c
        b = nb
    return b[:, :n]


def spline(df: DataFrame, value: str, out: str, order: int = 3, *, keys: list[str], date_col: str = "date",
           block_knots: int = 120, halo_knots: int = 30) -> DataFrame:
    """I8: degree-``order`` interpolating spline through the knots, evaluated
    on the daily axis between the first and last knot (NULL outside).

    Halo blocks of knots: block b owns knots [b*B, (b+1)*B) and is fitted on
    those plus ``halo_knots`` on each side (the influence of far knots on an
    interpolating spline decays geometrically), evaluated only on the days it
    owns; a key with <= B knots is one exact fit. Groups are bounded by
    B + 2H knots and their days."""
    k = _knots(df, value, keys=keys, date_col=date_col)
    k = k.withColumn("__x", F.datediff(F.col("d"), F.col("x0")).cast("double"))
    blk = F.floor(F.col("ki") / F.lit(block_knots)).cast("int")
    lo = F.floor(F.greatest(F.lit(0), F.col("ki") - halo_knots) / F.lit(block_knots)).cast("int")
    hi = F.floor(F.least(F.col("ki") + halo_knots, F.col("kn") - 1) / F.lit(block_knots)).cast("int")
    halo = k.withColumn("__own", blk).withColumn("__blk", F.explode(F.sequence(lo, hi)))
    halo = halo.select(*keys, "__blk", "__own", "ki", "kn", "__x", "y", "x0")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + \
        f", __dx int, {out} double"

    def fit(pdf):
        import pandas as pd
        pdf = pdf.sort_values("ki")
        xs, ys = pdf["__x"].to_numpy(float), pdf["y"].to_numpy(float)
        own = pdf["__own"].to_numpy() == pdf["__blk"].to_numpy()
        if not own.any():
            return pd.DataFrame({**{c: pdf[c].iloc[0:0] for c in keys},
                                 "__dx": pd.Series([], dtype="int32"), out: pd.Series([], dtype=float)})
        deg = min(order, len(xs) - 1)
        if deg >= 3 and deg % 2 == 0:
            deg -= 1
        if deg < 1:
            days, vals = xs[own], ys[own]
        else:
            t = _spline_knots(xs, deg)
            coef = np.linalg.solve(_bspline_basis(t, deg, xs), ys)
            ox = xs[own]
            last_owned = int(pdf["ki"].to_numpy()[own].max())
            end = ox.max() if last_owned == int(pdf["kn"].iloc[0]) - 1 else \
                xs[np.nonzero(pdf["ki"].to_numpy() == last_owned + 1)[0][0]] - 1
            days = np.arange(ox.min(), end + 1)
            vals = _bspline_basis(t, deg, days) @ coef
        res = pd.DataFrame({"__dx": days.astype("int32"), out: vals})
        for c in keys:
            res[c] = pdf[c].iloc[0]
        return res

    fits = halo.groupBy(*keys, "__blk").applyInPandas(fit, schema=schema)
    x0 = k.select(*keys, "x0").distinct()
    return fits.join(x0, keys).select(*keys, F.date_add(F.col("x0"), F.col("__dx")).alias(date_col), out)
