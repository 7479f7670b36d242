"""Brute-force checks of interpolants, structure scores and the walk-forward
backtest against small step-by-step Python loops written here."""

import datetime as dt
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import interpolate as ip
from riskpanel.operators import structure as stx
from riskpanel.operators import walkforward as wf


def _knots(spark, xs, ys, key="k", base=dt.date(2020, 1, 31)):
    rows = [(key, base + dt.timedelta(days=int(x)), float(y)) for x, y in zip(xs, ys)]
    return spark.createDataFrame(rows, "key string, date date, v double")


def _pchip_np(x, y, t):
    h = np.diff(x)
    m = np.diff(y) / h
    n = len(x)
    d = np.zeros(n)
    for i in range(1, n - 1):
        if np.sign(m[i - 1]) != np.sign(m[i]) or m[i] == 0 or m[i - 1] == 0:
            d[i] = 0.0
        else:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d[i] = (w1 + w2) / (w1 / m[i - 1] + w2 / m[i])

    def edge(h0, h1, m0, m1):
        e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if np.sign(e) != np.sign(m0):
            return 0.0
        if np.sign(m0) != np.sign(m1) and abs(e) > 3 * abs(m0):
            return 3 * m0
        return e
    d[0] = edge(h[0], h[1], m[0], m[1])
    d[-1] = edge(h[-1], h[-2], m[-1], m[-2])
    return _hermite_np(x, y, d, t)


def _akima_np(x, y, t):
    m = list(np.diff(y) / np.diff(x))
    n = len(x)
    l1 = 2 * m[0] - m[1]
    l2 = 2 * l1 - m[0]
    r1 = 2 * m[-1] - m[-2]
    r2 = 2 * r1 - m[-1]
    ext = [l2, l1] + m + [r1, r2]          # ext[j + 2] = m_j
    f12 = []
    for i in range(n):
        f1 = abs(ext[i + 3] - ext[i + 2])
        f2 = abs(ext[i + 1] - ext[i])
        f12.append((f1, f2))
    fmax = max(a + b for a, b in f12)
    d = np.zeros(n)
    for i, (f1, f2) in enumerate(f12):
        if f1 + f2 > 1e-9 * fmax:
            d[i] = (f1 * ext[i + 1] + f2 * ext[i + 2]) / (f1 + f2)
        else:
            d[i] = 0.5 * (ext[i + 3] + ext[i])
    out = _hermite_np(x, y, d, t)
    return np.where((t >= x[0]) & (t <= x[-1]), out, np.nan)


def _hermite_np(x, y, d, t):
    i = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    s = (t - x[i]) / h
    return ((1 + 2 * s) * (1 - s) ** 2 * y[i] + s * (1 - s) ** 2 * h * d[i]
            + s ** 2 * (3 - 2 * s) * y[i + 1] + s ** 2 * (s - 1) * h * d[i + 1])


def test_pchip_and_akima_match_independent_numpy(spark):
    rnd = random.Random(11)
    xs = np.cumsum([0] + [rnd.choice([28, 30, 31]) for _ in range(25)]).astype(float)
    ys = np.array([rnd.gauss(0, 1) for _ in xs]).cumsum()
    ys[7] = ys[8]                      # flat segment
    df = _knots(spark, xs, ys)
    t = np.arange(xs[0], xs[-1] + 1)
    for fn, ref in ((ip.pchip, _pchip_np), (ip.akima, _akima_np)):
        got = [r.o for r in fn(df, "v", "o", keys=["key"]).orderBy("date").collect()]
        want = ref(xs, ys, t)
        assert len(got) == len(t)
        assert np.allclose(np.array(got, dtype=float), want, atol=1e-9, equal_nan=True), fn.__name__
        # the curve passes through every knot
        assert np.allclose(np.array(got, dtype=float)[xs.astype(int)], ys, atol=1e-9)


def test_savgol_preserves_quadratics(spark):
    xs = np.arange(200, dtype=float)
    ys = 0.01 * xs ** 2 - xs + 3
    df = _knots(spark, xs, ys)
    out = np.array([r.o for r in ip.savgol(df, "v", "o", keys=["key"], window=21, polyorder=2)
                   .orderBy("date").collect()])
    assert np.allclose(out[10:-10], ys[10:-10], atol=1e-8)   # exact away from the padded edges


def test_lowess_reproduces_a_line(spark):
    xs = np.arange(400, dtype=float)
    df = _knots(spark, xs, 2.5 * xs - 7)
    out = np.array([r.o for r in ip.lowess(df, "v", "o", keys=["key"], frac=0.2, it=1, block_rows=13)
                   .orderBy("date").collect()])
    assert np.allclose(out, 2.5 * xs - 7, atol=1e-6)


def _loop_lowess(x, y, frac, rounds):
    n = len(x)
    k = min(n, max(2, math.floor(frac * n)))
    rw, out = np.ones(n), np.array(y)
    for r in range(rounds + 1):
        for i in range(n):
            a = min(max(i - k // 2, 0), n - k)
            near = slice(a, a + k)
            t = x[near] - x[i]
            h = max(np.abs(t).max(), 1.0)
            w = (1 - (np.abs(t) / h) ** 3) ** 3 * rw[near]
            design = np.stack([np.ones(k), t], axis=1) * np.sqrt(w)[:, None]
            out[i] = np.linalg.lstsq(design, y[near] * np.sqrt(w), rcond=1e-9)[0][0]
        u = np.abs(y - out) / (6 * max(np.median(np.abs(y - out)), 1e-300))
        rw = np.where(u < 1, (1 - u ** 2) ** 2, 0.0)
    return out


@pytest.mark.parametrize("n, frac, block", [(300, 0.15, 4096), (300, 0.31, 7), (211, 1.0, 10), (40, 0.1, 4096), (1, 0.5, 3)])
def test_lowess_matches_a_loop(spark, n, frac, block):
    """Moments of whole blocks and rows of cut ones give the sums of every window; days without a value stay out."""
    rnd = np.random.default_rng(n)
    y = np.sin(np.arange(n) / 20) * 5 + rnd.normal(size=n) + np.where(rnd.random(n) < 0.05, 30, 0)
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n + 3)]
    rows = [("a", d, None) for d in day[:3]] + [(s, d, float(v)) for s in "ab" for d, v in zip(day[3:], y)]
    df = spark.createDataFrame(rows, "key string, date date, v double")
    got = ip.lowess(df, "v", "o", keys=["key"], frac=frac, it=2 if n > 1 else 0, block_rows=block).orderBy("key", "date").collect()
    assert len(got) == len(rows) and [r.o for r in got[:3]] == [None] * 3
    want = _loop_lowess(np.arange(n, dtype=float), y, frac, 2 if n > 1 else 0)
    assert np.allclose([r.o for r in got[3:]], np.concatenate([want, want]), atol=1e-6)


def test_bic_matches_brute_force(spark):
    rnd = random.Random(2)
    nodes = ["a", "b", "c"]
    rows = [("k", rnd.randint(0, 2), rnd.randint(0, 1), rnd.randint(0, 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "key string, a int, b int, c int")
    jc = stx.joint_counts(df, nodes, keys=["key"])
    got = {(r.child, r.parents): r.bic for r in stx.bic_scores(jc, nodes, keys=["key"]).collect()}
    data = [dict(zip(nodes, r[1:])) for r in rows]
    card = {v: len({d[v] for d in data}) for v in nodes}
    n = len(data)
    for c in nodes:
        others = [v for v in nodes if v != c]
        for m in range(0, 3):
            for ps in combinations(others, m):
                njk = Counter((tuple(d[p] for p in ps), d[c]) for d in data)
                nj = Counter(tuple(d[p] for p in ps) for d in data)
                ll = sum(v * math.log(v / nj[j]) for (j, _), v in njk.items())
                q = math.prod(card[p] for p in ps)
                bic = ll - 0.5 * math.log(n) * q * (card[c] - 1)
                assert abs(got[(c, ",".join(sorted(ps)))] - bic) < 1e-9


def test_hill_climb_is_acyclic_and_cpt_normalised(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(500):
        a = rnd.randint(0, 2)
        b = a if rnd.random() < 0.8 else rnd.randint(0, 2)
        c = b if rnd.random() < 0.7 else rnd.randint(0, 2)
        rows.append(("k", a, b, c, rnd.randint(0, 2)))
    nodes = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "key string, a int, b int, c int, d int")
    jc = stx.joint_counts(df, nodes, keys=["key"])
    edges = [(r.parent, r.child) for r in stx.hill_climb(stx.bic_scores(jc, nodes, keys=["key"]), nodes,
                                                         keys=["key"]).collect()]
    assert edges and all(e[0] != "d" and e[1] != "d" for e in edges)
    parents = {v: {u for u, w in edges if w == v} for v in nodes}
    seen, order = set(), []
    while len(order) < len(nodes):
        free = [v for v in nodes if v not in seen and parents[v] <= seen]
        assert free, "cycle"
        seen.add(free[0])
        order.append(free[0])
    cpt = stx.fit_cpt(df, "c", ["b"], keys=["key"])
    sums = cpt.groupBy("key", "b").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    bdeu = stx.fit_cpt(df, "c", ["b"], keys=["key"], ess=5.0, k=3)
    assert all(abs(r.s - 1) < 1e-12 for r in bdeu.groupBy("key", "b").agg(F.sum("p").alias("s")).collect())


def _backtest_loop(rows, feats, warm, window, every, k=3):
    """Step-by-step replica of the reference's rolling backtest with the
    count-fitted REGIME table (no intra-slice parents)."""
    dbn = []
    for i in range(1, len(rows)):
        dbn.append({**rows[i], **{f + "_1": rows[i - 1][f] for f in feats}})
    n = len(dbn)
    start = warm if n > warm + 1 else 1
    out = {}
    table = None
    for t_i, pos in enumerate(range(start, n), start=1):
        prev = pos - 1
        if t_i == 1 or (t_i - 1) % every == 0:
            lo = max(0, prev - (window - 1))
            win = dbn[lo:prev + 1]
            table = Counter()
            tot = Counter()
            for a, b in zip(win, win[1:]):
                cfg = tuple(a[f] for f in feats)
                tot[cfg] += 1
                table[cfg] += b["regime"] == 0
        cfg = tuple(dbn[prev][f] for f in feats)
        p = table[cfg] / tot[cfg] if tot[cfg] else 1.0 / k
        dec = "risk_off" if p >= 0.5 else ("risk_on" if p <= 0.33 else "risk_neut")
        r = dbn[pos]
        net = r["bond"] if dec == "risk_off" else (r["eq"] if dec == "risk_on" else 0.5 * (r["eq"] + r["bond"]))
        out[r["date"]] = (p, dec, net)
    return out


def test_walk_forward_matches_loop(spark):
    rnd = random.Random(9)
    feats = ["f1", "f2"]
    series = []
    for i in range(180):
        series.append({"date": dt.date(2010, 1, 1) + dt.timedelta(days=i), "f1": rnd.randint(0, 2),
                       "f2": rnd.randint(0, 1), "regime": rnd.randint(0, 2),
                       "eq": round(rnd.gauss(0, 0.01), 6), "bond": round(rnd.gauss(0, 0.005), 6)})
    want = _backtest_loop(series, feats, warm=40, window=40, every=5)
    disc = spark.createDataFrame([("k", r["date"], r["f1"], r["f2"], r["regime"]) for r in series],
                                 "key string, date date, f1 int, f2 int, regime int")
    rets = spark.createDataFrame([("k", r["date"], r["eq"], r["bond"]) for r in series],
                                 "key string, date date, equity_ret double, bond_ret double")
    bt = wf.walk_forward(disc, rets, feats, "regime", keys=["key"], warmup=40, window=40, retrain_every=5)
    got = {r.date: (r.p_off, r.decision, r.net) for r in bt.collect()}
    assert set(got) == set(want)
    for d, (p, dec, net) in want.items():
        gp, gdec, gnet = got[d]
        assert abs(gp - p) < 1e-12 and gdec == dec and abs(gnet - net) < 1e-12, d


def test_spline_interpolates_and_reproduces_cubics(spark):
    xs = np.cumsum([0] + [30, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31]).astype(float)
    ys = 1e-6 * xs ** 3 - 2e-3 * xs ** 2 + xs
    df = _knots(spark, xs, ys)
    out = ip.spline(df, "v", "o", order=3, keys=["key"]).orderBy("date").collect()
    got = np.array([r.o for r in out])
    t = np.arange(xs[0], xs[-1] + 1)
    assert len(got) == len(t)
    assert np.allclose(got, 1e-6 * t ** 3 - 2e-3 * t ** 2 + t, atol=1e-7)   # not-a-knot cubic is exact on cubics
    for order in (2, 7):
        o = np.array([r.o for r in ip.spline(df, "v", "o", order=order, keys=["key"]).orderBy("date").collect()])
        assert np.allclose(o[xs.astype(int)], ys, atol=1e-7)                  # passes through the knots


def test_spline_blocks_match_single_fit(spark):
    rnd = random.Random(1)
    xs = np.cumsum([0] + [rnd.choice([28, 30, 31]) for _ in range(150)]).astype(float)
    ys = np.sin(xs / 200.0) * 10
    df = _knots(spark, xs, ys)
    one = np.array([r.o for r in ip.spline(df, "v", "o", keys=["key"], block_knots=1000).orderBy("date").collect()])
    blk = np.array([r.o for r in ip.spline(df, "v", "o", keys=["key"], block_knots=40, halo_knots=30)
                   .orderBy("date").collect()])
    assert len(one) == len(blk) and np.allclose(one, blk, atol=1e-6)


def test_k2_bdeu_match_brute_force(spark):
    rnd = random.Random(12)
    nodes = ["a", "b", "c"]
    rows = [("k", rnd.randint(0, 2), rnd.randint(0, 1), rnd.randint(0, 2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "key string, a int, b int, c int")
    jc = stx.joint_counts(df, nodes, keys=["key"])
    k2 = {(r.child, r.parents): r.k2 for r in stx.bayesian_scores(jc, nodes, keys=["key"], method="k2").collect()}
    bd = {(r.child, r.parents): r.bdeu for r in
          stx.bayesian_scores(jc, nodes, keys=["key"], method="bdeu", ess=5.0).collect()}
    data = [dict(zip(nodes, r[1:])) for r in rows]
    card = {v: len({d[v] for d in data}) for v in nodes}
    lg = math.lgamma
    for c in nodes:
        for m in range(0, 3):
            for ps in combinations([v for v in nodes if v != c], m):
                njk = Counter((tuple(d[p] for p in ps), d[c]) for d in data)
                nj = Counter(tuple(d[p] for p in ps) for d in data)
                r, q = card[c], math.prod(card[p] for p in ps)
                want_k2 = sum(lg(r) - lg(n + r) for n in nj.values()) + sum(lg(n + 1) for n in njk.values())
                a, b = 5.0 / q, 5.0 / (q * r)
                want_bd = sum(lg(a) - lg(n + a) for n in nj.values()) + sum(lg(n + b) - lg(b) for n in njk.values())
                key = (c, ",".join(sorted(ps)))
                assert abs(k2[key] - want_k2) < 1e-8 and abs(bd[key] - want_bd) < 1e-8


def test_chi2_pvalues(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (0.0, 4), (18.307038053275146, 10)],
                               "g2 double, dof long")
    p = [r.p_value for r in stx.chi2_pvalues(df).collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(p, [0.05, 0.05, 1.0, 0.05]))


def _learned_loop(rows, feats, target, edges, warm, window, every, k=3, recent=None):
    """Brute force: per block, fit slice-1 CPTs of the target's ancestral set and
    the target CPT given (x_t, pa_{t+1}); P = sum_pa P(pa) theta(0 | x, pa)."""
    import itertools
    dbn = [{**rows[i], **{f + "_1": rows[i - 1][f] for f in feats}} for i in range(1, len(rows))]
    n = len(dbn)
    start = warm if n > warm + 1 else 1
    if recent:
        start = max(start, n - recent)
    par = {}
    for u, v in edges:
        par.setdefault(v, []).append(u)
    pa = sorted(par.get(target, []))
    anc, stack = set(), list(pa)
    while stack:
        x = stack.pop()
        if x not in anc:
            anc.add(x)
            stack.extend(par.get(x, []))
    out = {}
    for t_i, pos in enumerate(range(start, n), start=1):
        prev = pos - 1
        if t_i == 1 or (t_i - 1) % every == 0:
            lo = max(0, prev - (window - 1))
            win = dbn[lo:prev + 1]
            pairs = list(zip(win, win[1:]))
            s1 = [b for _, b in pairs]
            dom = {v: sorted({r[v] for r in s1}) for v in anc}
            marg = Counter()
            order = sorted(anc)
            for combo in itertools.product(*[dom[v] for v in order]):
                val = dict(zip(order, combo))
                pr = 1.0
                for v in order:
                    ps = sorted(par.get(v, []))
                    match = [r for r in s1 if all(r[u] == val[u] for u in ps)]
                    pr *= (sum(r[v] == val[v] for r in match) / len(match)) if match else 1.0 / len(dom[v])
                marg[tuple(val[p] for p in pa)] += pr
            if not pa:
                marg = Counter({(): 1.0})
            theta = Counter()
            tot = Counter()
            for a, b in pairs:
                cfg = (tuple(a[f] for f in feats), tuple(b[p] for p in pa))
                tot[cfg] += 1
                theta[cfg] += b[target] == 0
        x = tuple(dbn[prev][f] for f in feats)
        p = sum(w * (theta[(x, c)] / tot[(x, c)] if tot[(x, c)] else 1.0 / k) for c, w in marg.items())
        out[dbn[pos]["date"]] = p
    return out


def test_walk_forward_learned_matches_loop(spark):
    rnd = random.Random(21)
    feats = ["f1", "f2", "f3"]
    series = []
    for i in range(150):
        f1 = rnd.randint(0, 2)
        f2 = f1 if rnd.random() < 0.6 else rnd.randint(0, 2)
        f3 = rnd.randint(0, 1)
        reg = f2 if rnd.random() < 0.5 else rnd.randint(0, 2)
        series.append({"date": dt.date(2010, 1, 1) + dt.timedelta(days=i), "f1": f1, "f2": f2, "f3": f3,
                       "regime": reg, "eq": 0.01, "bond": 0.0})
    edges = [("f1", "f2"), ("f2", "regime"), ("f3", "regime")]
    want = _learned_loop(series, feats, "regime", edges, warm=30, window=30, every=5)
    disc = spark.createDataFrame([("k", r["date"], r["f1"], r["f2"], r["f3"], r["regime"]) for r in series],
                                 "key string, date date, f1 int, f2 int, f3 int, regime int")
    rets = spark.createDataFrame([("k", r["date"], r["eq"], r["bond"]) for r in series],
                                 "key string, date date, equity_ret double, bond_ret double")
    bt = wf.walk_forward_learned(disc, rets, feats, "regime", keys=["key"], warmup=30, window=30, retrain_every=5,
                                 intra_edges=edges)
    got = {r.date: r.p_off for r in bt.collect()}
    assert set(got) == set(want)
    for d, p in want.items():
        assert abs(got[d] - p) < 1e-9, d
    learned = wf.walk_forward_learned(disc, rets, feats, "regime", keys=["key"], warmup=30, window=30,
                                      retrain_every=5)
    assert learned.count() == len(want)
    # parents summed out, a node with two parents, the last steps only
    for edges in ([("f3", "f1"), ("f1", "f2"), ("f3", "f2"), ("f2", "regime")], [("f1", "f2")]):
        want = _learned_loop(series, feats, "regime", edges, warm=30, window=30, every=5, recent=40)
        bt = wf.walk_forward_learned(disc, rets, feats, "regime", keys=["key"], warmup=30, window=30, retrain_every=5,
                                     intra_edges=edges, recent_only=40)
        got = {r.date: r.p_off for r in bt.collect()}
        assert set(got) == set(want) and len(got) == 40
        assert all(abs(got[d] - p) < 1e-9 for d, p in want.items())
    with pytest.raises(Exception, match="cycle"):
        wf.walk_forward_learned(disc, rets, feats, "regime", keys=["key"], warmup=30, window=30, retrain_every=5,
                                intra_edges=[("f1", "f2"), ("f2", "f1"), ("f2", "regime")]).count()


def _skeleton_of(spark, rows, names, **more):
    from riskpanel.operators import structure as stx
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, " + ", ".join(f"{n} int" for n in names))
    got = stx.skeleton(stx.joint_counts(df, names, keys=["k"]), names, keys=["k"], **more).collect()
    assert len(got) == len(names) * (len(names) - 1) // 2
    return {r.x + r.y for r in got if r.linked}, {r.x + r.y: (r.level, r.sepset) for r in got if not r.linked}


def test_skeleton_of_known_structures(spark):
    import random
    r = random.Random(5)

    def noisy(v):
        return v if r.random() < 0.8 else 1 - v

    chain, fork, collider = [], [], []
    for _ in range(4000):
        a = r.randint(0, 1)
        b = noisy(a)
        chain.append((a, b, noisy(b)))
        fork.append((noisy(a), a, noisy(a)))
        c = r.randint(0, 1)
        collider.append((a, noisy(a ^ c) if r.random() < 0.5 else noisy(a | c), c))
    for rows in (chain, fork):
        assert _skeleton_of(spark, rows, ["a", "b", "c"]) == ({"ab", "bc"}, {"ac": (1, "b")})
    assert _skeleton_of(spark, collider, ["a", "b", "c"]) == ({"ab", "bc"}, {"ac": (0, "")})
    # two neighbours must be given at once: a -> {b, c} -> d
    diamond = []
    for _ in range(20_000):
        a = r.randint(0, 1)
        b, c = noisy(a), noisy(a)
        diamond.append((a, b, c, noisy(b & c)))
    linked, gone = _skeleton_of(spark, diamond, ["a", "b", "c", "d"])
    assert linked == {"ab", "ac", "bd", "cd"} and gone["ad"] == (2, "b,c") and gone["bc"] == (1, "a")
    assert "ad" in _skeleton_of(spark, diamond, ["a", "b", "c", "d"], max_given=1)[0]
    # a constant node has no neighbours
    assert _skeleton_of(spark, [(a, b, 0) for a, b, _ in chain], ["a", "b", "c"])[0] == {"ab"}
