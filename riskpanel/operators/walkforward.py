"""Walk-forward backtest as one declarative job.

Reference semantics (one series; here every key at once):

* rows are the discretised table with ``X_1`` lags, first row dropped;
  positions 0..n-1 per key (W11);
* warm-up S = ``warmup`` if n > warmup + 1 else 1 (W15); test steps are
  positions S..n-1 (optionally only the last ``recent_only``);
* step i (1-based) belongs to model block b = (i-1) div R; block b is trained
  on positions [max(0, e_b - L + 1), e_b], e_b = S + R*b - 1 (W14, J8);
* a model's training pairs are consecutive rows (t, t+1) inside its window
  (J6); the pair stamped at position p has slice-0 evidence = the ``X_1``
  columns of row p and slice-1 target = target at p;
* the target's CPT given the slice-0 features is a count fit (D11, A22);
  P(target_t = 0 | X_{t-1}) is a lookup of the step's evidence row in its
  block's table, unseen configurations -> 1/k (J9, D12, B17);
* decision: p >= 0.5 risk-off (bond), p <= 0.33 risk-on (equity), else half
  and half (D13).

Instead of a loop over steps and windows, each pair row is exploded to the
(at most ceil(L/R) + 1) blocks whose window contains it -- an equi-key on
(key, block), no range join -- and all CPTs of all blocks and keys come from
one grouped count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.operators import features as fx
from riskpanel.operators._win import ordered, whole

# The reference's decision thresholds and backtest cadence.
P_OFF_HIGH = 0.5
P_OFF_LOW = 0.33
WARMUP = 120
WINDOW = 120
RETRAIN_EVERY = 12


def decision(p_off: Column) -> Column:
    """Decision label from P(risk-off)."""
    return F.when(p_off >= P_OFF_HIGH, F.lit("risk_off")).when(p_off <= P_OFF_LOW, F.lit("risk_on")) \
        .otherwise(F.lit("risk_neut"))


def net_return(dec: Column, equity: Column, bond: Column) -> Column:
    return F.when(dec == "risk_off", bond).when(dec == "risk_on", equity).otherwise(F.lit(0.5) * (equity + bond))


def two_slice(df: DataFrame, nodes: list[str], *, keys: list[str], date_col: str = "date") -> DataFrame:
    """(t, t+1) pairs for every node, stamped with t+1's date:
    ``v_t0`` = value at t, ``v_t1`` = value at t+1. One window, no self join."""
    w = ordered(keys, date_col)
    out = df.select(*keys, date_col, *[F.lag(v).over(w).alias(f"{v}_t0") for v in nodes],
                    *[F.col(v).alias(f"{v}_t1") for v in nodes], F.row_number().over(w).alias("__row"))
    return out.where(F.col("__row") > 1).drop("__row")


def lagged_evidence(disc: DataFrame, features: list[str], target: str, *, keys: list[str],
                    date_col: str = "date") -> DataFrame:
    """W4 on the discretised table: X_1 for every feature, null rows dropped,
    then positions (W11) and per-key sizes."""
    dbn = fx.add_lags(disc.select(*keys, date_col, *features, target), features, keys=keys, date_col=date_col, n=1)
    dbn = dbn.dropna(how="any")
    dbn = fx.row_position(dbn, keys=keys, date_col=date_col, out="pos")
    return dbn.withColumn("n", F.count(F.lit(1)).over(whole(keys)))


def schedule(dbn: DataFrame, *, warmup: int = WARMUP, retrain_every: int = RETRAIN_EVERY,
             recent_only: int | None = None) -> DataFrame:
    """W14 + W15: first test position S per key (``start``)."""
    s = F.when(F.col("n") > warmup + 1, F.lit(warmup)).otherwise(F.lit(1))
    if recent_only:
        s = F.greatest(s, F.col("n") - F.lit(recent_only))
    return dbn.withColumn("start", s)


def model_membership(dbn: DataFrame, *, window: int = WINDOW, retrain_every: int = RETRAIN_EVERY) -> DataFrame:
    """Explode each pair row (pos >= 1) to every block whose training window
    contains it: b_min = max(0, ceil((p - S + 1)/R)), b_max = min(floor((p - S + L - 1)/R), M - 1),
    M = ceil((n - S)/R) blocks."""
    R, L = retrain_every, window
    p, s, n = F.col("pos"), F.col("start"), F.col("n")
    b_min = F.greatest(F.lit(0), F.ceil((p - s + 1) / F.lit(float(R)))).cast("int")
    n_blocks = F.ceil((n - s) / F.lit(float(R))).cast("int")
    b_max = F.least(F.floor((p - s + L - 1) / F.lit(float(R))), n_blocks - 1).cast("int")
    pairs = dbn.where((p >= 1) & (b_min <= b_max))
    return pairs.withColumn("block", F.explode(F.sequence(b_min, b_max)))


def fit_block_cpts(members: DataFrame, features: list[str], target: str, *, keys: list[str],
                   state: int = 0) -> DataFrame:
    """For every (key, block, evidence configuration) the count of pairs and
    of pairs whose target equals ``state`` -> P(target = state | X_{t-1})."""
    ev = [f"{f}_1" for f in features]
    return members.groupBy(*keys, "block", *ev).agg(
        F.count(F.lit(1)).alias("n_cfg"),
        F.sum((F.col(target) == state).cast("long")).alias("n_state"),
    ).withColumn("p_state", F.col("n_state") / F.col("n_cfg"))


def walk_forward(disc: DataFrame, returns: DataFrame, features: list[str], target: str, *, keys: list[str],
                 date_col: str = "date", equity_col: str = "equity_ret", bond_col: str = "bond_ret",
                 k: int = 3, warmup: int = WARMUP, window: int = WINDOW, retrain_every: int = RETRAIN_EVERY,
                 recent_only: int | None = None) -> DataFrame:
    """Backtest log (keys, date, block, p_off, decision, equity_ret, bond_ret, net)."""
    dbn = schedule(lagged_evidence(disc, features, target, keys=keys, date_col=date_col),
                   warmup=warmup, retrain_every=retrain_every, recent_only=recent_only)
    cpt = fit_block_cpts(model_membership(dbn, window=window, retrain_every=retrain_every), features, target,
                         keys=keys)
    ev = [f"{f}_1" for f in features]
    steps = dbn.where(F.col("pos") >= F.col("start")).withColumn(
        "block", F.floor((F.col("pos") - F.col("start")) / F.lit(retrain_every)).cast("int"))
    steps = steps.select(*keys, date_col, "block", *ev)
    post = steps.join(cpt, [*keys, "block", *ev], "left")
    post = post.withColumn("p_off", F.coalesce(F.col("p_state"), F.lit(1.0 / k)))
    post = post.select(*keys, date_col, "block", "p_off")
    rets = returns.select(*keys, date_col, F.col(equity_col).alias("equity_ret"), F.col(bond_col).alias("bond_ret"))
    bt = fx.lookup_required(post, rets, keys=keys, date_col=date_col)
    dec = decision(F.col("p_off"))
    return bt.withColumn("decision", dec).withColumn(
        "net", net_return(F.col("decision"), F.col("equity_ret"), F.col("bond_ret")))


# ---------------------------------------------------------------------------------------------
# Learned intra-slice structure per block (REGIME may have same-slice parents)
def window_row_membership(dbn: DataFrame, *, window: int = WINDOW, retrain_every: int = RETRAIN_EVERY) -> DataFrame:
    """Rows (not pairs) of each block's training window [max(0, e_b - L + 1), e_b]:
    b_min = max(0, ceil((p - S + 1)/R)), b_max = min(floor((p - S + L)/R), M - 1)."""
    R, L = retrain_every, window
    p, s, n = F.col("pos"), F.col("start"), F.col("n")
    b_min = F.greatest(F.lit(0), F.ceil((p - s + 1) / F.lit(float(R)))).cast("int")
    n_blocks = F.ceil((n - s) / F.lit(float(R))).cast("int")
    b_max = F.least(F.floor((p - s + L) / F.lit(float(R))), n_blocks - 1).cast("int")
    return dbn.where(b_min <= b_max).withColumn("block", F.explode(F.sequence(b_min, b_max)))


def block_structures(dbn: DataFrame, nodes: list[str], *, keys: list[str], window: int = WINDOW,
                     retrain_every: int = RETRAIN_EVERY, max_parents: int | None = None) -> DataFrame:
    """D7 per training window: (keys, block, parent, child) edges learned by hill
    climbing on each block's window rows; all blocks of all keys in one job
    (joint counts -> grouping-set scores -> per-block search)."""
    from riskpanel.operators import structure as stx
    rows = window_row_membership(dbn, window=window, retrain_every=retrain_every)
    kb = [*keys, "block"]
    jc = stx.joint_counts(rows, nodes, keys=kb)
    return stx.hill_climb(stx.bic_scores(jc, nodes, keys=kb, max_parents=max_parents), nodes, keys=kb,
                          max_parents=max_parents)


def elimination_plan(edges: DataFrame, nodes: list[str], target: str, *, keys: list[str]) -> DataFrame:
    """One row per (keys, block) with the target's same-slice parents ``pa`` and the ``steps`` that eliminate its
    ancestral set, both as positions in ``nodes``. Step t brings in ancestor ``v`` with its ``parents`` (each of an
    earlier step: ancestors go by falling longest path to the target) and sums out ``drop``, those that no later step
    and no parent of the target needs. A block's edges are at most nodes x nodes, so one row holds them."""
    kb = [*keys, "block"]
    at = F.create_map(*[x for i, c in enumerate(nodes) for x in (F.lit(c), F.lit(i))])
    e = edges.where(F.col("parent").isNotNull() & F.col("child").isNotNull())
    e = e.groupBy(*kb).agg(F.array_sort(F.collect_set(F.struct(at[F.col("parent")].alias("u"), at[F.col("child")].alias("v")))).alias("e"))
    n, t = len(nodes), nodes.index(target)
    e = e.withColumn("far", F.expr(f"""aggregate(sequence(1, {n}), transform(sequence(0, {n - 1}), i -> if(i = {t}, 0, -1)),
        (far, round) -> transform(far, (d, i) -> greatest(d, coalesce(array_max(transform(
            filter(e, x -> x.u = i AND far[x.v] >= 0), x -> far[x.v] + 1)), -1))))"""))
    cyclic = F.raise_error(F.lit("the same-slice edges hold a cycle")).cast("array<int>")
    e = e.withColumn("far", F.when(F.array_max("far") >= n, cyclic).otherwise(F.col("far")))
    e = e.withColumn("pa", F.expr(f"transform(filter(e, x -> x.v = {t}), x -> x.u)"))
    e = e.withColumn("seq", F.expr(f"""transform(array_sort(transform(filter(sequence(0, {n - 1}), i -> far[i] > 0),
        i -> struct(-far[i] AS d, i AS i))), x -> x.i)"""))
    e = e.withColumn("last", F.expr(f"""transform(sequence(0, {n - 1}), i -> array_max(transform(
        filter(e, x -> x.u = i AND array_contains(seq, x.v)), x -> int(array_position(seq, x.v)) - 1)))"""))
    return e.select(*kb, "pa", F.expr("""transform(seq, (v, t) -> struct(v AS v,
        transform(filter(e, x -> x.v = v), x -> x.u) AS parents,
        filter(seq, u -> NOT array_contains(pa, u) AND last[u] = t) AS drop))""").alias("steps"))


def walk_forward_learned(disc: DataFrame, returns: DataFrame, features: list[str], target: str, *,
                         keys: list[str], date_col: str = "date", equity_col: str = "equity_ret",
                         bond_col: str = "bond_ret", k: int = 3, warmup: int = WARMUP, window: int = WINDOW,
                         retrain_every: int = RETRAIN_EVERY, max_parents: int | None = None,
                         intra_edges: list[tuple[str, str]] | None = None,
                         recent_only: int | None = None) -> DataFrame:
    """D12 with J10: each block learns its intra-slice structure on its window
    (or uses the fixed ``intra_edges`` for every block);
    the target at t+1 has the slice-0 features as temporal parents plus its
    learned slice-1 parents pa. With evidence on slice 0 only,

        P(target_{t+1} = 0 | x_t) = sum_pa P(pa) * theta(0 | x_t, pa),

    P(pa) = marginal of pa in the slice-1 network (product of the count-fitted
    CPTs of pa's ancestral set, summed over the other ancestors; a parent
    configuration unseen in the window gives the uniform 1/r over the node's
    observed states), theta unseen -> 1/k. Blocks whose target has no intra
    parents reduce to the temporal-only lookup."""
    from riskpanel.session import materialize
    nodes = [*features, target]
    kb = [*keys, "block"]
    dbn = materialize(schedule(lagged_evidence(disc, features, target, keys=keys, date_col=date_col),
                               warmup=warmup, retrain_every=retrain_every, recent_only=recent_only))
    if intra_edges is None:
        edges = block_structures(dbn, nodes, keys=keys, window=window, retrain_every=retrain_every,
                                 max_parents=max_parents)
    else:
        blocks_df = model_membership(dbn, window=window, retrain_every=retrain_every).select(*kb).distinct()
        lit_edges = F.array(*[F.struct(F.lit(u).alias("parent"), F.lit(v).alias("child")) for u, v in intra_edges])
        edges = blocks_df.select(*kb, F.explode(lit_edges).alias("__e")).select(*kb, "__e.*")
    plan = materialize(elimination_plan(edges, nodes, target, keys=keys))
    members = model_membership(dbn, window=window, retrain_every=retrain_every).withColumn(
        "__x", F.array(*[F.col(c).cast("int") for c in nodes]))
    marg = parent_marginals(members, plan, keys=keys, n_nodes=len(nodes))

    def config(x):  # the states of the target's parents; empty where it has none
        return F.coalesce(F.transform("pa", lambda p: F.get(x, p)), F.array().cast("array<int>")).alias("xa")

    marg = marg.select(*kb, config("x"), "__w")
    # theta(target | x_t, pa) counts
    ev = [f"{f}_1" for f in features]
    theta = members.join(plan, kb, "left").select(*kb, *ev, F.col(target).alias("__y"), config("__x"))
    theta = theta.groupBy(*kb, *ev, "xa").agg(
        F.count(F.lit(1)).alias("n_cfg"), F.sum((F.col("__y") == 0).cast("long")).alias("n_state"))
    steps = dbn.where(F.col("pos") >= F.col("start")).withColumn(
        "block", F.floor((F.col("pos") - F.col("start")) / F.lit(retrain_every)).cast("int"))
    steps = steps.select(*keys, date_col, "block", *ev)
    st = steps.join(marg, kb, "left").withColumns({"__w": F.coalesce("__w", F.lit(1.0)),
                                                   "xa": F.coalesce("xa", F.array().cast("array<int>"))})
    j = st.join(theta, [*kb, *ev, "xa"], "left").select(
        *keys, date_col, "block", "__w", F.coalesce(F.col("n_state") / F.col("n_cfg"), F.lit(1.0 / k)).alias("__t"))
    post = j.groupBy(*keys, date_col, "block").agg(F.sum(F.col("__w") * F.col("__t")).alias("p_off"))
    rets = returns.select(*keys, date_col, F.col(equity_col).alias("equity_ret"), F.col(bond_col).alias("bond_ret"))
    bt = fx.lookup_required(post, rets, keys=keys, date_col=date_col)
    dec = decision(F.col("p_off"))
    return bt.withColumn("decision", dec).withColumn(
        "net", net_return(F.col("decision"), F.col("equity_ret"), F.col("bond_ret")))


def parent_marginals(members: DataFrame, plan: DataFrame, *, keys: list[str], n_nodes: int) -> DataFrame:
    """P(pa) of every (keys, block), by elimination over relations. ``members`` holds each window's slice-1 rows
    as an array ``__x`` of node states. A row of the running factor is an assignment ``x`` (NULL outside its scope) and
    its weight; a step joins the next ancestor's count-fitted CPT on the parents' states, multiplies, and sums the
    variables of ``drop`` out in a grouped sum. A parent configuration unseen in the window gives 1/r over the node's
    observed states. Assignments of weight 0 are left out. Returns (keys, block, pa, x, __w); a block without
    same-slice parents has one row of weight 1."""
    kb = [*keys, "block"]
    seen = members.join(plan, kb).select(*kb, "__x", F.posexplode("steps").alias("t", "s"))
    seen = seen.select(*kb, "t", F.transform("s.parents", lambda p: F.get("__x", p)).alias("cfg"),
                       F.get("__x", F.col("s.v")).alias("xv"))
    seen = seen.groupBy(*kb, "t", "cfg", "xv").agg(F.count(F.lit(1)).alias("n"))
    states = seen.groupBy(*kb, "t").agg(F.array_sort(F.collect_set("xv")).alias("r"))
    states = states.groupBy(*kb).agg(F.map_from_entries(F.collect_list(F.struct("t", "r"))).alias("r"))
    cpt = seen.groupBy(*kb, "t", "cfg").agg(
        F.map_from_entries(F.collect_list(F.struct("xv", "n"))).alias("n"), F.sum("n").alias("total"))
    from riskpanel.session import materialize
    cpt = materialize(cpt)
    rounds = plan.select(F.max(F.size("steps"))).head()[0] or 0
    joint = plan.join(states, kb, "left").select(
        *kb, "pa", F.transform("steps", lambda s, t: s.withField("r", F.col("r")[t])).alias("steps"),
        F.array_repeat(F.lit(None).cast("int"), n_nodes).alias("x"), F.lit(1.0).alias("__w"))
    for t in range(rounds):
        step = F.get("steps", F.lit(t))
        left = joint.withColumns({"s": step, "cfg": F.transform(step["parents"], lambda p: F.get("x", p))})
        j = left.join(cpt.where(F.col("t") == t).drop("t"), [*kb, "cfg"], "left")
        j = j.withColumn("xv", F.explode(F.coalesce(F.col("s.r"), F.array(F.lit(None).cast("int")))))
        p = (F.when(F.col("s").isNull(), 1.0).when(F.col("total").isNull(), 1.0 / F.size("s.r"))
             .otherwise(F.coalesce(F.col("n")[F.col("xv")], F.lit(0)) / F.col("total")))
        x = F.when(F.col("s").isNull(), F.col("x")).otherwise(F.transform("x", lambda e, i: F.when(
            i == F.col("s.v"), F.col("xv")).when(~F.array_contains("s.drop", i), e)))
        j = j.select(*kb, "pa", "steps", x.alias("x"), (F.col("__w") * p).alias("__w")).where(F.col("__w") > 0)
        joint = j.groupBy(*kb, "pa", "steps", "x").agg(F.sum("__w").alias("__w"))
    return joint.select(*kb, "pa", "x", "__w")
