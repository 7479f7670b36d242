"""Blocked scans for long or skewed series.

A plain ``Window.partitionBy(keys)`` puts every row of a key in one task. When
one key may hold a large share of all rows, we split its sequence into
ordered *blocks* (e.g. the calendar day of a raw event), work inside
``partitionBy(keys, block)``, and stitch block edges with a tiny per-block
summary table (#keys x #blocks rows) that is windowed over ``keys`` and joined
back. The block column must be non-decreasing along the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, cols: list[str], *, keys: list[str], order: list[str], block: str,
               prev_prefix: str = "prev_", next_prefix: str = "next_") -> DataFrame:
    """Exact ``lag(c, 1)`` / ``lead(c, 1)`` over the key's whole order, computed
    per block plus edge carry-ins. Adds ``prev_*``, ``next_*`` and boolean
    ``__is_first`` / ``__is_last`` (first / last row of the key)."""
    wb = Window.partitionBy(*keys, block).orderBy(*order)
    ordkey = F.struct(*[F.col(o) for o in order])
    vals = F.struct(*[F.col(c) for c in cols])
    summ = (df.groupBy(*keys, block)
            .agg(F.min_by(vals, ordkey).alias("__bf"), F.max_by(vals, ordkey).alias("__bl")))
    wk = Window.partitionBy(*keys).orderBy(block)
    summ = summ.select(*keys, block, F.lag("__bl").over(wk).alias("__pl"), F.lead("__bf").over(wk).alias("__nf"))
    out = df.withColumns({"__rb": F.row_number().over(wb), "__nx": F.lead(F.lit(1)).over(wb)})
    out = out.withColumns({f"__lag_{c}": F.lag(c).over(wb) for c in cols})
    out = out.withColumns({f"__lead_{c}": F.lead(c).over(wb) for c in cols})
    out = out.join(summ, [*keys, block], "left")
    first_in_block = F.col("__rb") == 1
    last_in_block = F.col("__nx").isNull()
    new = {}
    for c in cols:
        new[f"{prev_prefix}{c}"] = F.when(first_in_block, F.col("__pl").getField(c)).otherwise(F.col(f"__lag_{c}"))
        new[f"{next_prefix}{c}"] = F.when(last_in_block, F.col("__nf").getField(c)).otherwise(F.col(f"__lead_{c}"))
    new["__is_first"] = first_in_block & F.col("__pl").isNull()
    new["__is_last"] = last_in_block & F.col("__nf").isNull()
    out = out.withColumns(new)
    drop = ["__rb", "__nx", "__pl", "__nf"] + [f"__lag_{c}" for c in cols] + [f"__lead_{c}" for c in cols]
    return out.drop(*drop)


def positions(df: DataFrame, *, keys: list[str], order: list[str], block: str, out: str = "pos") -> DataFrame:
    """W11 at scale: 0-based row position per key = position inside the block
    + rows in earlier blocks (running sum over the small block-count table)."""
    wb = Window.partitionBy(*keys, block).orderBy(*order)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    wk = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, block, F.coalesce(F.sum("__n").over(wk), F.lit(0)).alias("__off"))
    res = df.withColumn("__rb", F.row_number().over(wb)).join(counts, [*keys, block], "left")
    return res.withColumn(out, (F.col("__off") + F.col("__rb") - 1).cast("long")).drop("__rb", "__off")


def running_last(df: DataFrame, cols: list[str], *, keys: list[str], order: list[str], block: str,
                 prefix: str = "ffill_") -> DataFrame:
    """Forward fill (last non-null at or before each row, over the key's whole
    order): running ``last(ignorenulls)`` inside each block, plus a carry-in =
    the last non-null of all earlier blocks from the per-block summary."""
    wb = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ordkey = F.struct(*[F.col(o) for o in order])
    summ = df.groupBy(*keys, block).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(f"__bl_{c}") for c in cols])
    wk = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, block, *[F.last(f"__bl_{c}", ignorenulls=True).over(wk).alias(f"__ci_{c}")
                                       for c in cols])
    out = df.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(wb) for c in cols})
    out = out.join(summ, [*keys, block], "left")
    out = out.withColumns({f"{prefix}{c}": F.coalesce(F.col(f"__in_{c}"), F.col(f"__ci_{c}")) for c in cols})
    return out.drop(*[f"__in_{c}" for c in cols], *[f"__ci_{c}" for c in cols])


def hysteresis(df: DataFrame, label_col: str, out: str, *, keys: list[str], order: list[str], block: str,
               h: int = 1) -> DataFrame:
    """W12 for one very long series (or a hot key), blocked.

    Look-ahead: each block is extended with a halo of the h rows that follow
    it in the key's order (found through global row positions and the small
    block table), so ``lead(1..h)`` is exact inside the block. Carry: the
    latest confirmed label of earlier blocks comes from the per-block summary.
    Same result as the plain window form. The input is read by several
    branches (positions, halo, carry), so it is checkpointed once first and
    every branch sees the same rows."""
    from riskpanel.session import materialize
    df = materialize(df)
    pos = positions(df, keys=keys, order=order, block=block, out="__pos")
    ends = pos.groupBy(*keys, block).agg(F.max("__pos").alias("__end"), F.min("__pos").alias("__begin"))
    ends = ends.withColumn("__ord", F.row_number().over(Window.partitionBy(*keys).orderBy(block)))
    # a row is halo for block b when end(b) < pos <= end(b) + h; every block has a row,
    # so b is among the h blocks (by ordinal) before the row's own block
    pos = pos.join(ends.select(*keys, block, "__ord", "__begin"), [*keys, block])
    # only the first h rows of a block can follow an earlier block that closely
    near = pos.where(F.col("__pos") - F.col("__begin") < F.lit(h)).drop("__begin")
    pos = pos.drop("__begin")
    cand = near.withColumn("__hord", F.explode(F.sequence(F.col("__ord") - F.lit(h), F.col("__ord") - F.lit(1))))
    cand = cand.join(ends.select(*keys, F.col(block).alias("__hb"), F.col("__ord").alias("__hord"), "__end"),
                     [*keys, "__hord"])
    halo = cand.where((F.col("__end") < F.col("__pos")) & (F.col("__pos") <= F.col("__end") + F.lit(h)))
    halo = halo.drop(block, "__end", "__hord").withColumnRenamed("__hb", block).withColumn("__halo", F.lit(True))
    ext = pos.withColumn("__halo", F.lit(False)).unionByName(halo)
    wb = Window.partitionBy(*keys, block).orderBy("__pos")
    lab = F.col(label_col)
    holds = F.lit(True)
    for i in range(1, h + 1):
        holds = holds & F.coalesce(F.lead(label_col, i).over(wb) == lab, F.lit(False))
    conf = (F.col("__pos") == 0) | lab.isNull() | holds
    # halo rows stay in the frame until the very end and are excluded by
    # expression (they sort after the block's own rows), so the result does
    # not depend on where a filter would be placed relative to the windows
    ext = ext.withColumn("__conf", F.when(conf & ~F.col("__halo"), F.struct(lab.alias("v"))))
    run = Window.partitionBy(*keys, block).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    ext = ext.withColumn("__in", F.last("__conf", ignorenulls=True).over(run))
    ext = ext.withColumn("__blast", F.last("__conf", ignorenulls=True).over(
        Window.partitionBy(*keys, block).orderBy("__pos").rowsBetween(Window.unboundedPreceding,
                                                                      Window.unboundedFollowing)))
    summ = ext.where(~F.col("__halo")).select(*keys, block, "__blast").dropDuplicates([*keys, block])
    wk = Window.partitionBy(*keys).orderBy(block)
    summ = summ.withColumn("__run", F.last("__blast", ignorenulls=True).over(
        wk.rowsBetween(Window.unboundedPreceding, 0)))
    summ = summ.select(*keys, block, F.lag("__run", 1).over(wk).alias("__ci"))
    res = ext.join(summ, [*keys, block], "left").where(~F.col("__halo"))
    res = res.withColumn(out, F.coalesce(F.col("__in"), F.col("__ci")).getField("v").cast("int"))
    return res.drop("__pos", "__halo", "__conf", "__in", "__ci", "__ord", "__blast")
