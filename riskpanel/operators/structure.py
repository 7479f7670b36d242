"""Network structure and parameter tables over discretised nodes
(A16-A19, A22, A23, D6-D10).

Sufficient statistics are computed once: the joint contingency table of all
nodes per key (A23, at most k^nodes rows per key whatever the data volume).
Every marginal needed later comes from ONE ``GROUPING SETS`` aggregate over
it, reduced to G(T) = sum over the cells of marginal T of N ln N. From G:

* family log-likelihood  LL(c | P) = G(P + c) - G(P)
* BIC(c | P)             = LL - 1/2 ln N * q(P) * (r_c - 1)
* mutual information     MI(x, y) = (G(xy) - G(x) - G(y) + G()) / N
* G-test statistic       G2(x, y | Z) = 2 (G(xyZ) - G(xZ) - G(yZ) + G(Z))
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reference's default temporal edges (every feature at t -> regime at t+1).
DEFAULT_TEMPORAL = [("temp_anom", "regime"), ("carbon", "regime"), ("cpu", "regime"), ("vix", "regime"),
                    ("term_spread", "regime"), ("ig_spread_chg", "regime"), ("spx_ret", "regime")]


def joint_counts(df: DataFrame, nodes: list[str], *, keys: list[str]) -> DataFrame:
    """Joint contingency of all nodes per key (rows with a null node dropped)."""
    return df.dropna(subset=nodes).groupBy(*keys, *nodes).agg(F.count(F.lit(1)).alias("n"))


def subset_key(cols) -> str:
    return ",".join(sorted(cols))


def subset_cells(joint: DataFrame, nodes: list[str], *, keys: list[str], max_size: int = 3,
                 count_col: str = "n") -> DataFrame:
    """(keys, subset, __N): the observed cell counts of every marginal over a
    node subset with |T| <= max_size, from ONE GROUPING SETS aggregate."""
    subsets = [c for s in range(0, max_size + 1) for c in combinations(nodes, s)]
    sets = [[*keys, *s] for s in subsets]
    agg = joint.groupingSets(sets, *keys, *nodes).agg(
        F.sum(count_col).alias("__N"), *[F.grouping(c).alias(f"__g_{c}") for c in nodes])
    names = [F.when(F.col(f"__g_{c}") == 0, F.lit(c)) for c in sorted(nodes)]
    return agg.select(*keys, F.concat_ws(",", *names).alias("subset"), F.col("__N").cast("double").alias("__N"))


def subset_stats(joint: DataFrame, nodes: list[str], *, keys: list[str], max_size: int = 3,
                 count_col: str = "n") -> DataFrame:
    """(keys, subset, g, cells, total): G(T) and the number of observed cells
    of every node subset T with |T| <= max_size."""
    agg = subset_cells(joint, nodes, keys=keys, max_size=max_size, count_col=count_col)
    return agg.groupBy(*keys, "subset").agg(
        F.sum(F.col("__N") * F.log(F.col("__N"))).alias("g"), F.count(F.lit(1)).alias("cells"),
        F.sum("__N").alias("total"))


def families(nodes: list[str], max_parents: int | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """Every (child, parent set); all parent sets unless ``max_parents`` restricts them."""
    most = len(nodes) - 1 if max_parents is None else max_parents
    return [(c, ps) for c in nodes for m in range(0, most + 1)
            for ps in combinations([x for x in nodes if x != c], m)]


def _families_df(spark: SparkSession, nodes: list[str], max_parents: int | None) -> DataFrame:
    rows = [(c, subset_key(ps), subset_key((*ps, c))) for c, ps in families(nodes, max_parents)]
    return spark.createDataFrame(rows, "child string, parents string, family string")


def _cardinalities(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __card): a map from node to its number of observed states, one row per key."""
    single = cells.where(~F.col("subset").contains(",") & (F.col("subset") != ""))
    return single.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("subset", "cells"))).alias("__card"))


def _configurations(parents: str = "parents") -> Column:
    """Product of the parents' cardinalities (1 without parents)."""
    names = F.filter(F.split(parents, ","), lambda p: p != "")
    return F.aggregate(names, F.lit(1.0), lambda a, p: a * F.element_at(F.col("__card"), p).cast("double"))


def bic_scores(joint: DataFrame, nodes: list[str], *, keys: list[str], max_parents: int | None = None) -> DataFrame:
    """BIC of every family (child, parent set); all parent sets unless
    ``max_parents`` restricts them. Cardinalities are the observed distinct
    states of each node per key. The statistics table (#keys x #subsets rows)
    feeds several joins, so it is materialised once."""
    from riskpanel.session import materialize
    size = len(nodes) if max_parents is None else max_parents + 1
    st = materialize(subset_stats(joint, nodes, keys=keys, max_size=size))
    fam = _families_df(joint.sparkSession, nodes, max_parents)
    gf = st.select(*keys, F.col("subset").alias("family"), F.col("g").alias("g_f"), F.col("total").alias("N"))
    gp = st.select(*keys, F.col("subset").alias("parents"), F.col("g").alias("g_p"))
    # the family list is equi-joined onto each key's observed subsets (a family
    # whose node subset was never observed cannot occur)
    s = gf.join(fam, "family").join(gp, [*keys, "parents"]).join(_cardinalities(st, keys), keys)
    ll = F.col("g_f") - F.col("g_p")
    r = F.element_at("__card", F.col("child")).cast("double")
    bic = ll - F.lit(0.5) * F.log(F.col("N")) * _configurations() * (r - 1)
    return s.select(*keys, "child", "parents", ll.alias("loglik"), bic.alias("bic"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers (NaN otherwise): the argument is raised by
    ten through the recurrence, then Stirling's series is exact to rounding."""
    x = np.asarray(x, float)
    ok = x > 0
    v = np.where(ok, x, 1.0)
    low = np.zeros_like(v)
    for i in range(10):
        low += np.log(v + i)
    z = v + 10
    tail = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188) / z**2) / z**2) / z**2) / z**2) / z
    return np.where(ok, (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - low, np.nan)


def _lgamma():
    """Log-gamma as a vectorised pandas UDF (Spark SQL has no built-in); used
    only on the small tables of cell counts."""

    @F.pandas_udf("double")
    def lgamma(x: pd.Series) -> pd.Series:
        return pd.Series(log_gamma(x.to_numpy()))

    return lgamma


def bayesian_scores(joint: DataFrame, nodes: list[str], *, keys: list[str], max_parents: int | None = None,
                    method: str = "k2", ess: float = 5.0) -> DataFrame:
    """D6, K2 and BDeu local scores for every family, from observed cells only
    (unobserved parent configurations contribute zero):

    K2   = sum_F lnG(N_jk + 1) - sum_P lnG(N_j + r) + |P cells| lnG(r)
    BDeu = sum_F [lnG(N_jk + b) - lnG(b)] - sum_P [lnG(N_j + a) - lnG(a)],  a = ess/q, b = ess/(q r)
    (F = cells of parents + child, P = cells of the parents)."""
    from riskpanel.session import materialize
    size = len(nodes) if max_parents is None else max_parents + 1
    cells = materialize(subset_cells(joint, nodes, keys=keys, max_size=size))
    st = cells.groupBy(*keys, "subset").agg(F.count(F.lit(1)).alias("cells"))
    fam = _families_df(joint.sparkSession, nodes, max_parents)
    # r and q per (key, family)
    base = (st.select(*keys, F.col("subset").alias("family")).join(fam, "family").join(_cardinalities(st, keys), keys)
            .select(*keys, "child", "parents", "family", F.element_at("__card", F.col("child")).cast("double").alias("r"),
                    _configurations().alias("q")))
    lg = _lgamma()
    if method == "k2":
        f_term = lg(F.col("__N") + 1.0)
        p_term = lg(F.col("__N") + F.col("r")) - lg(F.col("r"))
    elif method == "bdeu":
        a = F.lit(float(ess)) / F.col("q")
        b = F.lit(float(ess)) / (F.col("q") * F.col("r"))
        f_term = lg(F.col("__N") + b) - lg(b)
        p_term = lg(F.col("__N") + a) - lg(a)
    else:
        raise ValueError("method must be 'k2' or 'bdeu'")
    fsum = base.join(cells.withColumnRenamed("subset", "family"), [*keys, "family"]) \
        .groupBy(*keys, "child", "parents").agg(F.sum(f_term).alias("__f"))
    psum = base.join(cells.withColumnRenamed("subset", "parents"), [*keys, "parents"]) \
        .groupBy(*keys, "child", "parents").agg(F.sum(p_term).alias("__p"))
    return fsum.join(psum, [*keys, "child", "parents"]).select(
        *keys, "child", "parents", (F.col("__f") - F.col("__p")).alias(method))


def chi2_survival(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(chi-square with ``dof`` degrees of freedom > x), by the finite sums for
    even and odd dof; NaN without a positive dof."""
    x, dof = np.asarray(x, float), np.asarray(dof, float)
    out = np.full(len(x), np.nan)
    half = np.maximum(x, 0.0) / 2
    log_half = np.log(np.where(half > 0, half, 1.0))
    erfc = np.frompyfunc(math.erfc, 1, 1)
    for k in np.unique(dof[dof > 0]).astype(int):
        at = (dof == k) & ~np.isnan(x)
        a = 0.0 if k % 2 == 0 else 0.5
        total = np.zeros(at.sum()) if k % 2 == 0 else erfc(np.sqrt(half[at])).astype(float)
        for j in range(k // 2):
            power = np.where(half[at] > 0, (j + a) * log_half[at], 0.0 if j + a == 0 else -np.inf)
            total = total + np.exp(power - half[at] - math.lgamma(j + a + 1))
        out[at] = np.minimum(total, 1.0)
    return out


def chi2_pvalues(tests: DataFrame, stat: str = "g2", dof: str = "dof", out: str = "p_value") -> DataFrame:
    """D8 p-values: the chi-square survival function, vectorised over the small
    table of tests."""

    @F.pandas_udf("double")
    def sf(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(chi2_survival(x.to_numpy(float), k.to_numpy(float)))

    return tests.withColumn(out, sf(F.col(stat), F.col(dof).cast("double")))


def independence_tests(joint: DataFrame, nodes: list[str], *, keys: list[str],
                       given: list[str | None] = (None,)) -> DataFrame:
    """G-test statistic and degrees of freedom for every node pair, marginal
    (z = NULL) and conditional on each node in ``given`` (the small statistics
    table is materialised once; it feeds seven joins)."""
    from riskpanel.session import materialize
    st = materialize(subset_stats(joint, nodes, keys=keys, max_size=3))
    card = st.where(~F.col("subset").contains(",") & (F.col("subset") != "")).select(
        *keys, F.col("subset").alias("__v"), F.col("cells").alias("__r"))
    rows = []
    for z in given:
        for x, y in combinations(sorted(nodes), 2):
            if z in (x, y):
                continue
            zs = () if z is None else (z,)
            rows.append((x, y, z, subset_key((x, y, *zs)), subset_key((x, *zs)), subset_key((y, *zs)), subset_key(zs)))
    schema = "x string, y string, z string, sxy string, sx string, sy string, sz string"
    tests = joint.sparkSession.createDataFrame(rows, schema)
    g = st.select(*keys, "subset", "g")
    base = g.select(*keys, F.col("subset").alias("sxy"), F.col("g").alias("g_sxy")).join(F.broadcast(tests), "sxy")
    for name in ("sx", "sy", "sz"):
        base = base.join(g.select(*keys, F.col("subset").alias(name), F.col("g").alias(f"g_{name}")), [*keys, name])
    for v in ("x", "y", "z"):
        base = base.join(card.select(*keys, F.col("__v").alias(v), F.col("__r").alias(f"r_{v}")), [*keys, v], "left")
    stat = F.lit(2.0) * (F.col("g_sxy") - F.col("g_sx") - F.col("g_sy") + F.col("g_sz"))
    dof = (F.col("r_x") - 1) * (F.col("r_y") - 1) * F.coalesce(F.col("r_z"), F.lit(1))
    return base.select(*keys, "x", "y", "z", stat.alias("g2"), dof.cast("long").alias("dof"))


def _conditional_tests(nodes: list[str], size: int) -> list[tuple]:
    """(x, y, z ARRAY, and the four subsets of the G-test) of every pair and conditioning set of ``size`` nodes."""
    rows = []
    for x, y in combinations(sorted(nodes), 2):
        for z in combinations([v for v in sorted(nodes) if v not in (x, y)], size):
            rows.append((x, y, list(z), subset_key((x, y, *z)), subset_key((x, *z)), subset_key((y, *z)), subset_key(z)))
    return rows


def skeleton(joint: DataFrame, nodes: list[str], *, keys: list[str], alpha: float = 0.01, max_given: int = 3) -> DataFrame:
    """The undirected skeleton by level-wise removal of edges (order-independent).

    All pairs start as edges. At level k an edge (x, y) is tested given every k nodes that are all neighbours of x, or all
    neighbours of y, at the level's start; it goes if some test has a p-value above ``alpha``. Returns one row for each key
    and pair: (keys, x, y, linked, level, sepset), level and sepset (the first such set by name, comma-joined) of the edges
    that went. Levels run to ``max_given`` or until no edge has enough neighbours. A pair with a constant node is
    independent. The tests of a level are one join of the subset statistics with the edges that are left; what is joined
    is bounded by keys and nodes, not by rows.
    """
    from riskpanel.session import materialize
    spark = joint.sparkSession
    st = materialize(subset_stats(joint, nodes, keys=keys, max_size=2 + max_given))
    r = {v: F.max(F.when(F.col("subset") == v, F.col("cells"))).alias(f"r_{v}") for v in nodes}
    card = materialize(st.groupBy(*keys).agg(*r.values()))
    states = F.create_map(*[x for v in nodes for x in (F.lit(v), F.col(f"r_{v}"))]).alias("states")
    card = card.select(*keys, states)
    g = st.select(*keys, "subset", "g")
    listed = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in combinations(sorted(nodes), 2)])
    pairs = card.select(*keys, F.explode(listed).alias("pair")).select(*keys, "pair.x", "pair.y")
    left = pairs
    gone = None
    for size in range(max_given + 1):
        both = left.select(*keys, "x", "y").union(left.select(*keys, "y", "x"))
        near = both.groupBy(*keys, "x").agg(F.collect_set("y").alias("near"))  # at most one entry for each node
        if near.where(F.size("near") > size).head() is None:
            break
        rows = spark.createDataFrame(_conditional_tests(nodes, size), "x string, y string, z array<string>, sxy string, sx string, sy string, sz string")
        todo = (left.join(rows, ["x", "y"]).join(near, [*keys, "x"])
                .join(near.select(*keys, F.col("x").alias("y"), F.col("near").alias("near_y")), [*keys, "y"])
                .where((F.size(F.array_except("z", "near")) == 0) | (F.size(F.array_except("z", "near_y")) == 0)))
        for name in ("sxy", "sx", "sy", "sz"):
            todo = todo.join(g.select(*keys, F.col("subset").alias(name), F.col("g").alias(f"g_{name}")), [*keys, name])
        todo = todo.join(card, keys) if keys else todo.join(card)
        strata = F.aggregate("z", F.lit(1).cast("long"), lambda acc, v: acc * F.col("states")[v])
        todo = todo.select(*keys, "x", "y", "z", (2.0 * (F.col("g_sxy") - F.col("g_sx") - F.col("g_sy") + F.col("g_sz"))).alias("g2"),
                           ((F.col("states")[F.col("x")] - 1) * (F.col("states")[F.col("y")] - 1) * strata).alias("dof"))
        free = chi2_pvalues(todo).where((F.col("dof") == 0) | (F.col("p_value") > alpha))
        level = materialize(free.groupBy(*keys, "x", "y").agg(F.min(F.array_join("z", ",")).alias("sepset"))
                            .withColumn("level", F.lit(size)))
        gone = level if gone is None else gone.union(level)
        left = materialize(left.join(level, [*keys, "x", "y"], "left_anti"))
    out = pairs.select(*keys, "x", "y").join(gone, [*keys, "x", "y"], "left") if gone is not None else pairs.select(
        *keys, "x", "y", F.lit(None).cast("string").alias("sepset"), F.lit(None).cast("int").alias("level"))
    return out.select(*keys, "x", "y", F.col("level").isNull().alias("linked"), "level", "sepset")


def column_modes(df: DataFrame, cols: list[str], *, keys: list[str]) -> DataFrame:
    """Most frequent value per key and column; ties -> smallest value."""
    lg = df.select(*keys, *cols).unpivot(keys, cols, "col_name", "v").where(F.col("v").isNotNull())
    cnt = lg.groupBy(*keys, "col_name", "v").agg(F.count(F.lit(1)).alias("__c"))
    best = cnt.groupBy(*keys, "col_name").agg(
        F.max_by("v", F.struct(F.col("__c"), -F.col("v"))).alias("mode"))
    return best


def fill_with_modes(df: DataFrame, cols: list[str], *, keys: list[str]) -> DataFrame:
    """Null -> the column's mode (per key; ``keys`` must be non-empty,
    add a constant key column for a single series)."""
    modes = column_modes(df, cols, keys=keys)
    wide = modes.groupBy(*keys).agg(*[F.max(F.when(F.col("col_name") == c, F.col("mode"))).alias(f"__m_{c}")
                                      for c in cols])
    out = df.join(wide, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols}).drop(
        *[f"__m_{c}" for c in cols])


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]], *, keys: list[str]) -> DataFrame:
    """MI in nats of each (x, y) pair: one unpivot to (pair, x, y),
    one grouped count, marginals by window sums over the small count table."""
    sel = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
                    F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")) for a, b in pairs]
    lg = df.select(*keys, F.explode(F.array(*sel)).alias("__p")).select(*keys, "__p.*")
    cnt = lg.groupBy(*keys, "x_name", "y_name", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    g = [*keys, "x_name", "y_name"]
    cnt = cnt.withColumns({
        "nx": F.sum("nxy").over(Window.partitionBy(*g, "x")),
        "ny": F.sum("nxy").over(Window.partitionBy(*g, "y")),
        "nn": F.sum("nxy").over(Window.partitionBy(*g))})
    term = F.col("nxy") / F.col("nn") * F.log(F.col("nn") * F.col("nxy") / (F.col("nx") * F.col("ny")))
    return cnt.groupBy(*g).agg(F.sum(term).alias("mi"))


def node_importance(df: DataFrame, nodes: list[str], target: str, edges: list[tuple[str, str]], *,
                    keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node size 300 + 5000 * MI(node, target) / max MI (mode-filled
    data) and edge width 1 + 6 * MI(u, v) (nulls -> 0); an edge naming a column
    that is absent gets MI 0.05."""
    feats = [c for c in nodes if c != target]
    filled = fill_with_modes(df, [*feats, target], keys=keys)
    mi = mutual_information(filled, [(c, target) for c in feats], keys=keys)
    mx = F.max("mi").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    size = F.lit(300.0) + F.lit(5000.0) * F.when(mx > 0, F.col("mi") / mx).otherwise(F.col("mi"))
    node_tab = mi.select(*keys, F.col("x_name").alias("node"), "mi", size.alias("size"))
    present = [(u, v) for u, v in edges if u in df.columns and v in df.columns]
    zero = df.fillna(0, subset=list({c for e in present for c in e}))
    emi = mutual_information(zero, present, keys=keys).select(
        *keys, F.col("x_name").alias("parent"), F.col("y_name").alias("child"), "mi")
    absent = [(u, v) for u, v in edges if (u, v) not in present]
    if absent:
        lit_edges = F.array(*[F.struct(F.lit(u).alias("parent"), F.lit(v).alias("child"), F.lit(0.05).alias("mi"))
                              for u, v in absent])
        extra = df.select(*keys).distinct().select(*keys, F.explode(lit_edges).alias("__e")).select(*keys, "__e.*")
        emi = emi.unionByName(extra)
    edge_tab = emi.withColumn("width", F.lit(1.0) + F.lit(6.0) * F.col("mi"))
    return node_tab, edge_tab


def fit_cpt(df: DataFrame, child: str, parents: list[str], *, keys: list[str], ess: float = 0.0,
            k: int | None = None) -> DataFrame:
    """Conditional probability table by counts, (keys, parents..., child, n, p).
    ``ess = 0``: maximum likelihood over observed cells; ``ess > 0``: BDeu
    pseudo-counts (N_jk + ess/(q r)) / (N_j + ess/q) over all ``k`` child states
    of every observed parent configuration (q = product of parent
    cardinalities, r = k)."""
    d = df.dropna(subset=[child, *parents])
    cnt = d.groupBy(*keys, *parents, child).agg(F.count(F.lit(1)).alias("n"))
    grp = [*keys, *parents]
    if ess <= 0:
        tot = F.sum("n").over(Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0)))
        return cnt.withColumn("p", F.col("n") / tot)
    if k is None:
        raise ValueError("ess > 0 needs the number of child states k")
    cards = d.groupBy(*keys).agg(*[F.count_distinct(p).alias(f"__r_{p}") for p in parents])
    q = F.lit(1)
    for p in parents:
        q = q * F.col(f"__r_{p}")
    cfg = cnt.groupBy(*grp).agg(F.sum("n").alias("__nj"))
    grid = cfg.withColumn(child, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = grid.join(cnt, [*grp, child], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.join(cards, keys, "left")
    a = F.lit(float(ess))
    p = (F.col("n") + a / (q * k)) / (F.col("__nj") + a / q)
    return full.withColumn("p", p).drop("__nj", *[f"__r_{x}" for x in parents])


def hill_climb(scores: DataFrame, nodes: list[str], *, keys: list[str], max_parents: int | None = None,
               epsilon: float = 1e-4, tabu_length: int = 100) -> DataFrame:
    """Greedy add / remove / reverse search maximising total BIC, from the
    empty graph, acyclic, any number of parents unless ``max_parents`` is set,
    with a tabu list of undone moves; every step gains at least ``epsilon``, so it ends by itself; ties -> first in (kind, parent, child) order [decision].
    Runs per key with ``applyInPandas`` over that key's family-score table
    (|nodes| * 2^(|nodes|-1) rows), never over the data."""
    schema = ", ".join(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in keys) + \
        ", parent string, child string"

    def run(pdf):
        import pandas as pd
        score = dict(zip(zip(pdf["child"], pdf["parents"]), pdf["bic"]))
        edges = _climb(score, nodes, len(nodes) - 1 if max_parents is None else max_parents, epsilon, tabu_length)
        out = pd.DataFrame({"parent": pd.Series([u for u, _ in edges], dtype=object),
                            "child": pd.Series([v for _, v in edges], dtype=object)})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "parent", "child"]]

    return scores.groupBy(*keys).applyInPandas(run, schema=schema)


def _climb(score, nodes, max_parents, epsilon, tabu_length):
    from collections import deque
    parents = {n: set() for n in nodes}

    def fam(c, ps):
        return score.get((c, subset_key(ps)))

    def reaches(a, b):   # is there a directed path a -> ... -> b
        stack, seen = [a], set()
        while stack:
            x = stack.pop()
            if x == b:
                return True
            if x in seen:
                continue
            seen.add(x)
            stack.extend(c for c in nodes if x in parents[c])
        return False

    tabu = deque(maxlen=tabu_length)
    while True:
        best = None
        for u in sorted(nodes):
            for v in sorted(nodes):
                if u == v:
                    continue
                if u in parents[v]:
                    cand = [("remove", u, v)]
                    if len(parents[u]) < max_parents:
                        cand.append(("reverse", u, v))
                elif v not in parents[u] and len(parents[v]) < max_parents:
                    cand = [("add", u, v)]
                else:
                    cand = []
                for op in cand:
                    if op in tabu:
                        continue
                    kind = op[0]
                    if kind == "add":
                        if reaches(v, u):
                            continue
                        new, old = fam(v, parents[v] | {u}), fam(v, parents[v])
                        delta = None if new is None or old is None else new - old
                    elif kind == "remove":
                        new, old = fam(v, parents[v] - {u}), fam(v, parents[v])
                        delta = None if new is None or old is None else new - old
                    else:
                        parents[v].discard(u)
                        cyc = reaches(u, v)
                        parents[v].add(u)
                        if cyc:
                            continue
                        a1, a0 = fam(v, parents[v] - {u}), fam(v, parents[v])
                        b1, b0 = fam(u, parents[u] | {v}), fam(u, parents[u])
                        delta = None if None in (a1, a0, b1, b0) else (a1 - a0) + (b1 - b0)
                    if delta is not None and (best is None or delta > best[0]):
                        best = (delta, op)
        if best is None or best[0] < epsilon:
            break
        kind, u, v = best[1]
        if kind == "add":
            parents[v].add(u)
            tabu.append(("remove", u, v))
        elif kind == "remove":
            parents[v].discard(u)
            tabu.append(("add", u, v))
        else:
            parents[v].discard(u)
            parents[u].add(v)
            tabu.append(("reverse", v, u))
    return sorted((p, c) for c in nodes for p in parents[c])


def dbn_template(intra: DataFrame, temporal: list[tuple[str, str]], *,
                 keys: list[str]) -> DataFrame:
    """Two-slice template: intra-slice edges copied into slices 0 and 1,
    temporal edges from slice 0 to slice 1.
    Output (keys, parent, child, slice_from, slice_to)."""
    both = intra.select(*keys, "parent", "child", F.explode(F.array(F.lit(0), F.lit(1))).alias("slice_from"))
    both = both.withColumn("slice_to", F.col("slice_from"))
    lit_edges = F.array(*[F.struct(F.lit(u).alias("parent"), F.lit(v).alias("child")) for u, v in temporal])
    tmp = intra.select(*keys).distinct().select(*keys, F.explode(lit_edges).alias("__e")).select(*keys, "__e.*")
    tmp = tmp.withColumns({"slice_from": F.lit(0), "slice_to": F.lit(1)})
    return both.unionByName(tmp)
