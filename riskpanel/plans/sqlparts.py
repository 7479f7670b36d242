"""DuckDB-dialect SQL fragments for the oracle side of each registered query.

They restate, in plain ANSI SQL over the driver's views, the same panels the
Spark builders in ``panels.py`` derive, so each operator's output can be
checked value for value.
"""

NATION_MONTH = """
li AS (SELECT s_nationkey AS nation, last_day(CAST(l_shipdate AS DATE)) AS date,
              sum(l_extendedprice * (1 - l_discount)) AS spx_px, avg(l_discount) AS temp_anom,
              avg(l_tax) AS carbon, avg(l_quantity) AS term_spread
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
od AS (SELECT c_nationkey AS nation, last_day(CAST(o_orderdate AS DATE)) AS date,
              CAST(count(*) AS DOUBLE) AS cpu, avg(o_totalprice) / 10000.0 AS vix,
              avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS ig_spread,
              sum(o_totalprice) AS bond_px
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
wide AS (SELECT * FROM li FULL OUTER JOIN od USING (nation, date))
"""

FLAG_DAY = """
wide AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS date,
                avg(l_discount) AS temp_anom, avg(l_tax) AS carbon, CAST(count(*) AS DOUBLE) AS cpu,
                avg(l_quantity) AS vix, avg(l_extendedprice) / 1000.0 AS term_spread,
                avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS ig_spread,
                sum(l_extendedprice * (1 - l_discount)) AS spx_px, sum(l_quantity) AS bond_px
         FROM lineitem GROUP BY 1, 2)
"""


def features(key: str, src: str = "wide") -> str:
    """X1 after alignment: diff, pct-change with pad, climate lag, dropna."""
    run = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w = f"(PARTITION BY {key} ORDER BY date)"
    return f"""
ff AS (SELECT *, last_value(spx_px IGNORE NULLS) OVER {run} AS spx_f,
                 last_value(bond_px IGNORE NULLS) OVER {run} AS bond_f FROM {src}),
fx AS (SELECT {key}, date,
              lag(temp_anom) OVER {w} AS temp_anom, lag(carbon) OVER {w} AS carbon,
              lag(cpu) OVER {w} AS cpu, vix, term_spread,
              ig_spread - lag(ig_spread) OVER {w} AS ig_spread_chg,
              spx_f / NULLIF(lag(spx_f) OVER {w}, 0) - 1 AS spx_ret,
              bond_f / NULLIF(lag(bond_f) OVER {w}, 0) - 1 AS bond_ret
       FROM ff),
feat AS (SELECT * FROM fx WHERE temp_anom IS NOT NULL AND carbon IS NOT NULL AND cpu IS NOT NULL
          AND vix IS NOT NULL AND term_spread IS NOT NULL AND ig_spread_chg IS NOT NULL
          AND spx_ret IS NOT NULL AND bond_ret IS NOT NULL)
"""


def regime(key: str, src: str = "feat", h: int = 1, vix: str = "vix", chg: str = "ig_spread_chg",
           off_vix: float = 25.0, off_chg: float = 0.40, on_vix: float = 15.0, on_chg: float = -0.20,
           base: str | None = None) -> str:
    """Rule label (override='always'; with ``base`` 'when_fired'), missing-span mask, hysteresis."""
    label = "rule" if base is None else f"CASE WHEN rule <> 1 THEN rule ELSE {base} END"
    w = f"(PARTITION BY {key} ORDER BY date)"
    run = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    holds = " AND ".join(f"COALESCE(lead(hyb, {i}) OVER {w} = hyb, FALSE)" for i in range(1, h + 1)) or "TRUE"
    return f"""
r0 AS (SELECT *, CASE WHEN {vix} < {on_vix} AND {chg} < {on_chg} THEN 2
                      WHEN {vix} > {off_vix} OR {chg} > {off_chg} THEN 0 ELSE 1 END AS rule,
              ({vix} IS NULL AND {chg} IS NULL) AS allnull FROM {src}),
r1 AS (SELECT *, CASE WHEN allnull AND COALESCE(lag(allnull) OVER {w}, FALSE) THEN NULL ELSE {label} END AS hyb FROM r0),
r2 AS (SELECT *, (row_number() OVER {w} = 1 OR hyb IS NULL OR ({holds})) AS conf FROM r1),
reg AS (SELECT * EXCLUDE (rule, allnull, hyb, conf),
               CAST((last_value(CASE WHEN conf THEN struct_pack(v := hyb) END IGNORE NULLS) OVER {run}).v AS INTEGER) AS regime
        FROM r2)
"""


def dbl(x: float) -> str:
    """A double literal DuckDB parses to the identical IEEE value."""
    return f"CAST('{x!r}' AS DOUBLE)"


def equal_freq_label(rank: str, n: str, k: int) -> str:
    from riskpanel.operators.discretize import quantile_levels
    terms = []
    for qv in quantile_levels(k):
        v = f"(CAST({n} - 1 AS DOUBLE) * {dbl(qv)})"
        e = f"(floor({v}) + 1.0 + ({v} - floor({v})))"
        terms.append(f"CASE WHEN CAST({rank} AS DOUBLE) > {e} THEN 1 ELSE 0 END")
    return f"CASE WHEN {rank} IS NOT NULL AND {n} > 1 THEN CAST({' + '.join(terms)} AS INTEGER) END"


def equal_freq_long(key: str, src: str = "lg", out: str = "ef") -> str:
    """D2 over long (key, date, col_name, value)."""
    return f"""
{out}_r AS (SELECT *, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY {key}, col_name ORDER BY value ASC NULLS LAST, date) END AS rk,
                 count(value) OVER (PARTITION BY {key}, col_name) AS nn FROM {src}),
{out} AS (SELECT * EXCLUDE (rk, nn), {equal_freq_label("rk", "nn", 3)} AS state FROM {out}_r)
"""


def _nearest(k: int, pre: str = "") -> str:
    expr = "0"
    best = f"abs(x - {pre}c0)"
    for j in range(1, k):
        d = f"abs(x - {pre}c{j})"
        expr = f"CASE WHEN {d} < {best} THEN {j} ELSE {expr} END"
        best = f"least({best}, {d})"
    return expr


def kmeans_long(key: str, src: str = "lg", k: int = 3) -> str:
    """D1 over long (key, date, col_name, value): seeds, Lloyd rounds to the
    fixed point by recursion, labels (CTE ``km`` with column ``state``; CTE
    ``cent`` holds the centroids). Sums may come in another order each round, so
    centroids that differ in their last digits only count as settled."""
    ps = [(j + 0.5) / k for j in range(k)]
    cs = ", ".join(f"c{j}" for j in range(k))
    old = ", ".join(f"any_value(c{j}) AS c{j}" for j in range(k))
    new = ", ".join(
        f"coalesce(sum(CASE WHEN j = {j} THEN x * c END) / CAST(sum(CASE WHEN j = {j} THEN c END) AS DOUBLE), any_value(c{j})) AS n{j}"
        for j in range(k))
    moved = " OR ".join(f"abs(n{j} - c{j}) > 1e-11 * (1 + abs(c{j}))" for j in range(k))
    return f"""
fin AS (SELECT *, CASE WHEN abs(value) < CAST('inf' AS DOUBLE) THEN value END AS x FROM {src}),
vals AS (SELECT {key}, col_name, x, count(*) AS c FROM fin WHERE x IS NOT NULL GROUP BY ALL),
seeds AS (SELECT {key}, col_name, {", ".join(f"quantile_cont(x, {dbl(p)}) AS c{j}" for j, p in enumerate(ps))},
                 count(DISTINCT x) AS nd FROM fin WHERE x IS NOT NULL GROUP BY ALL),
lloyd AS (
  SELECT {key}, col_name, {cs}, 0 AS step, true AS moving FROM seeds
  UNION ALL
  SELECT {key}, col_name, {", ".join(f"n{j}" for j in range(k))}, step + 1, {moved} FROM (
    SELECT {key}, col_name, step, {old}, {new}
    FROM (SELECT v.*, {cs}, step, {_nearest(k)} AS j FROM vals v JOIN lloyd USING ({key}, col_name) WHERE moving)
    GROUP BY {key}, col_name, step)),
cent AS (SELECT {key}, col_name, {", ".join(f"arg_max(c{j}, step) AS c{j}" for j in range(k))} FROM lloyd GROUP BY ALL),{equal_freq_long(key, "fin", "efk")},
km AS (SELECT e.* EXCLUDE (state, x),
              CASE WHEN coalesce(s.nd, 0) <= {k} THEN e.state
                   WHEN e.x IS NOT NULL THEN {_nearest(k, "c.")} END AS state
       FROM efk e LEFT JOIN seeds s USING ({key}, col_name) LEFT JOIN cent c USING ({key}, col_name))"""


def subset_stats(key: str, nodes: list[str], src: str = "jc", max_size: int = 3) -> str:
    """CTE ``st``: (key, subset, g, cells, total) via GROUPING SETS."""
    from itertools import combinations
    sets = [c for s in range(0, max_size + 1) for c in combinations(nodes, s)]
    gs = ", ".join("(" + ", ".join([key, *s]) + ")" for s in sets)
    name = "concat_ws(',', " + ", ".join(f"CASE WHEN GROUPING({c}) = 0 THEN '{c}' END" for c in sorted(nodes)) + ")"
    return f"""
gsets AS (SELECT {key}, {name} AS subset, CAST(sum(n) AS DOUBLE) AS nn FROM {src} GROUP BY GROUPING SETS ({gs})),
st AS (SELECT {key}, subset, sum(nn * ln(nn)) AS g, count(*) AS cells, sum(nn) AS total FROM gsets GROUP BY ALL)
"""


def chi2_tail(x: str, dof: str) -> str:
    """P(chi-square > x) for even ``dof``, a finite sum (NULL for odd dof, which the oracle queries don't have)."""
    return (f"CASE WHEN {dof} % 2 = 1 OR {dof} <= 0 THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE list_sum(list_transform("
            f"generate_series(0, {dof} // 2 - 1), lambda i: exp(i * ln({x} / 2) - {x} / 2 - lgamma(i + 1.0)))) END")


def skeleton(key: str, nodes: list[str], alpha: float, max_given: int) -> str:
    """The skeleton, one row for each key that goes from level to level: maps of the subsets' statistics, the list of edges
    'x|y' that are left, and the list of those that went."""
    from riskpanel.operators.structure import _conditional_tests
    pairs = ", ".join(f"'{x}|{y}'" for x, y, *_ in _conditional_tests(nodes, 0))
    out = subset_stats(key, nodes, max_size=2 + max_given) + f""",
s0 AS (SELECT {key}, map_from_entries(list((subset, g))) AS g, map_from_entries(list((subset, cells))) AS r, [{pairs}] AS edges,
  CAST([] AS STRUCT(pair VARCHAR, level INTEGER, sepset VARCHAR)[]) AS gone FROM st GROUP BY {key})"""
    for k in range(max_given + 1):
        tests = ", ".join("{" + f"'pair': '{x}|{y}', 'x': '{x}', 'y': '{y}', 'z': '{','.join(z)}', 'a': '{a}', 'b': '{b}', 'c': '{c}', 'd': '{d}'" + "}"
                          for x, y, z, a, b, c, d in _conditional_tests(nodes, k))
        near = "true" if k == 0 else " OR ".join(
            f"len(list_filter(string_split(t.z, ','), lambda v: NOT list_contains(edges, least(t.{s}, v) || '|' || greatest(t.{s}, v)))) = 0" for s in "xy")
        strata = "1" if k == 0 else "CAST(list_product(list_transform(string_split(t.z, ','), lambda v: r[v])) AS BIGINT)"
        out += f""",
c{k} AS (SELECT *, list_transform(list_filter([{tests}], lambda t: list_contains(edges, t.pair) AND ({near})), lambda t: {{'pair': t.pair, 'z': t.z,
  'g2': 2.0 * (g[t.a] - g[t.b] - g[t.c] + g[t.d]), 'dof': (r[t.x] - 1) * (r[t.y] - 1) * {strata}}}) AS tested FROM s{k}),
u{k} AS (SELECT {key}, unnest(tested) AS t FROM c{k}),
i{k} AS (SELECT {key}, list({{'pair': t.pair, 'level': {k}, 'sepset': t.z}}) AS free FROM u{k}
  WHERE t.dof = 0 OR {chi2_tail("t.g2", "t.dof")} > {alpha} GROUP BY {key}),
s{k + 1} AS (SELECT c.{key}, g, r, list_filter(edges, lambda e: NOT list_contains(coalesce(list_transform(free, lambda f: f.pair), []), e)) AS edges,
  list_concat(gone, coalesce(free, [])) AS gone FROM c{k} c LEFT JOIN i{k} ON i{k}.{key} = c.{key})"""
    return out + f""",
went AS (SELECT {key}, unnest(gone) AS f FROM s{max_given + 1}),
went1 AS (SELECT {key}, f.pair AS pair, min(f.level) AS level, min(f.sepset) AS sepset FROM went GROUP BY ALL),
every AS (SELECT DISTINCT {key}, unnest([{pairs}]) AS pair FROM st)
SELECT e.{key}, split_part(e.pair, '|', 1) AS x, split_part(e.pair, '|', 2) AS y, w.level IS NULL AS linked, w.level, w.sepset
FROM every e LEFT JOIN went1 w ON w.{key} = e.{key} AND w.pair = e.pair"""


def values_table(rows: list[tuple], cols: list[str]) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + str(v) + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def knots(key: str, src: str, col: str) -> str:
    """CTEs ax, kn for the interpolators: knots with interval neighbours."""
    w = f"(PARTITION BY {key} ORDER BY d)"
    return f"""
ax AS (SELECT {key}, min(date) AS lo, max(date) AS hi FROM {src} GROUP BY 1),
kn0 AS (SELECT {key}, date AS d, CAST({col} AS DOUBLE) AS y FROM {src} WHERE {col} IS NOT NULL),
kn1 AS (SELECT k.*, ax.lo, ax.hi, lead(d) OVER {w} AS d2, lead(y) OVER {w} AS y2,
               min(d) OVER (PARTITION BY {key}) AS x0, max(d) OVER (PARTITION BY {key}) AS xl,
               count(*) OVER (PARTITION BY {key}) AS kn, row_number() OVER {w} - 1 AS ki
        FROM kn0 k JOIN ax USING ({key})),
kn AS (SELECT *, CAST(d2 - d AS DOUBLE) AS h, (y2 - y) / CAST(d2 - d AS DOUBLE) AS m FROM kn1)
"""


def intervals(key: str, src: str) -> str:
    return f"""(SELECT *, CAST(unnest(generate_series(
        CASE WHEN ki = 0 THEN lo ELSE d END,
        CASE WHEN ki = kn - 2 OR kn = 1 THEN hi ELSE d2 - 1 END, INTERVAL 1 DAY)) AS DATE) AS date
     FROM {src} WHERE d2 IS NOT NULL OR kn = 1)"""


def hermite(key: str, src: str, out: str, extrapolate: bool) -> str:
    h = "CAST(d2 - d AS DOUBLE)"
    m = f"((y2 - y) / {h})"
    c2 = f"((3.0 * {m} - 2.0 * sd - sd2) / {h})"
    c3 = f"((sd + sd2 - 2.0 * {m}) / ({h} * {h}))"
    s = "CAST(date - d AS DOUBLE)"
    val = f"(y + sd * {s} + {c2} * ({s} * {s}) + {c3} * ({s} * {s} * {s}))"
    if not extrapolate:
        val = f"CASE WHEN date >= x0 AND date <= xl THEN {val} END"
    return f"""SELECT {key}, date, CASE WHEN kn = 1 THEN (CASE WHEN date = d THEN y END) ELSE {val} END AS {out}
FROM {intervals(key, src)}"""


def pchip_slopes(key: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY d)"

    def edge(h0, h1, m0, m1):
        d = f"(((2.0 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
        return (f"CASE WHEN sign({d}) <> sign({m0}) THEN 0.0 "
                f"WHEN sign({m0}) <> sign({m1}) AND abs({d}) > 3.0 * abs({m0}) THEN 3.0 * {m0} ELSE {d} END")
    interior = ("CASE WHEN sign(mp) <> sign(m) OR m = 0 OR mp = 0 THEN 0.0 ELSE "
                "1.0 / (((2.0 * h + hp) / mp + (h + 2.0 * hp) / m) / ((2.0 * h + hp) + (h + 2.0 * hp))) END")
    return f"""
pk AS (SELECT *, lag(m) OVER {w} AS mp, lag(h) OVER {w} AS hp, lead(m) OVER {w} AS mn, lead(h) OVER {w} AS hn,
              lag(m, 2) OVER {w} AS mpp, lag(h, 2) OVER {w} AS hpp FROM kn),
pk2 AS (SELECT *, CASE WHEN kn = 2 THEN coalesce(m, mp) WHEN ki = 0 THEN {edge("h", "hn", "m", "mn")}
                  WHEN ki = kn - 1 THEN {edge("hp", "hpp", "mp", "mpp")} ELSE {interior} END AS sd FROM pk),
pk3 AS (SELECT *, lead(sd) OVER {w} AS sd2 FROM pk2)"""


def akima_slopes(key: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY d)"
    at = lambda pos: f"max(CASE WHEN ki = {pos} THEN m END) OVER (PARTITION BY {key})"

    def sec(off, base):
        j = f"(ki + {off})"
        return (f"(CASE WHEN {j} = -2 THEN l2 WHEN {j} = -1 THEN l1 WHEN {j} = kn - 1 THEN r1 "
                f"WHEN {j} = kn THEN r2 ELSE {base} END)")
    return f"""
ak0 AS (SELECT *, lag(m, 2) OVER {w} AS m_m2, lag(m) OVER {w} AS m_m1, lead(m) OVER {w} AS m_p1,
               {at(0)} AS s0, {at(1)} AS s1, {at("kn - 2")} AS sl, {at("kn - 3")} AS sl2 FROM kn),
ak1 AS (SELECT *, 2.0 * s0 - s1 AS l1, 2.0 * sl - sl2 AS r1 FROM ak0),
ak2 AS (SELECT *, 2.0 * l1 - s0 AS l2, 2.0 * r1 - sl AS r2 FROM ak1),
ak3 AS (SELECT *, {sec(-2, "m_m2")} AS a_m2, {sec(-1, "m_m1")} AS a_m1, {sec(0, "m")} AS a_0, {sec(1, "m_p1")} AS a_p1 FROM ak2),
ak4 AS (SELECT *, abs(a_p1 - a_0) AS f1, abs(a_m1 - a_m2) AS f2 FROM ak3),
ak5 AS (SELECT *, f1 + f2 AS f12, max(f1 + f2) OVER (PARTITION BY {key}) AS fmax FROM ak4),
ak6 AS (SELECT *, CASE WHEN kn >= 3 THEN (CASE WHEN f12 > 1e-9 * fmax THEN (f1 * a_m1 + f2 * a_0) / f12
                        ELSE 0.5 * (a_p1 + a_m2) END) ELSE coalesce(m, lag(m) OVER {w}) END AS sd FROM ak5),
ak7 AS (SELECT *, lead(sd) OVER {w} AS sd2 FROM ak6)"""


def time_linear(key: str, out: str) -> str:
    lin = "y + (y2 - y) * CAST(date - d AS DOUBLE) / CAST(d2 - d AS DOUBLE)"
    return f"""SELECT {key}, date, CASE WHEN date < d THEN NULL WHEN d2 IS NULL OR date >= d2 THEN coalesce(y2, y)
    WHEN date = d THEN y ELSE {lin} END AS {out} FROM {intervals(key, "kn")}"""
