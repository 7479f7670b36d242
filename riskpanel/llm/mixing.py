"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target is a water level: sources share all words by weight, none above ``max_epochs`` times its own size.
Whole epochs of a source are taken as they are; the rest of its target is drawn without replacement. For the draw,
documents fall into blocks by a hash of their id, blocks stand in a permuted order, and the first blocks up to the
target are drawn, the last one document by document. Output shards get their exact numbers of each source's drawn blocks
from a tree: a node's block counts are split between its two halves by a multivariate hypergeometric draw, down to the
shards, which take consecutive, disjoint stretches of the permuted blocks and order their rows by a local hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SHARDS = 64
BLOCK_ROWS = 64
MAX_BLOCKS = 1 << 16  # of a source; beyond, blocks grow instead
_TREE_BLOCKS = 900_000_000  # in a draw of the tree; with many sources blocks grow, too
SEED = "mix-1"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, source_size, n_rows).

    Weights repeat over the sources in code point order, a null source last. Targets sum to the size of all sources; one
    stops at ``max_epochs`` times its source's size, and what it leaves is shared out again by weight until none is
    above: the level L with sum(min(L * weight, cap)) = total. Sources with equal cap per weight are alike in it.
    One row a source, so the windows run over the list of sources only.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    k = len(weights)
    s = sizes.withColumn("rank", F.row_number().over(in_order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % k + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("cost", F.col("cap") / F.col("weight"))
    by_cost = everything.orderBy("cost", "rank")
    s = (s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("filled", F.coalesce(F.sum("cap").over(by_cost.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(by_cost.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("filled")) / F.col("left")))
    # the first source that the level does not fill up sets it
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cost"), F.struct("cost", "rank", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "n_rows",
                    F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))



def _source_key(c: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))


def _name() -> Column:
    """What stands for a row in the permutation: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def _measured(docs: DataFrame, seed: str, size: Column | None = None) -> DataFrame:
    """``docs`` with the working columns: words, source key, and the permutation key of the id."""
    return (docs.withColumn("__size", words_of(F.col("text")) if size is None else size)
            .withColumn("__skey", _source_key())
            .withColumn("__order", F.md5(F.concat(F.lit(seed + ":"), _name()).cast("binary"))))


def _block(n_blocks: str = "__n_blocks") -> Column:
    """32 bits of the permutation key cut a source into blocks; their numbers follow the key, so block order is the
    permuted order."""
    return F.expr(f"(cast(conv(substring(__order, 1, 8), 16, 10) as bigint) * {n_blocks}) div 4294967296")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the last block of a source, in permuted order, whatever still fits into the rest of the target; then one more
    if that brings the source nearer to its target."""
    pdf = pdf.sort_values("__order", kind="stable")
    room, taken, unit = float(pdf["__room"].iloc[0]), [], pdf["__unit"].tolist()
    for size in unit:
        taken.append(0 < size <= room)
        room -= size if taken[-1] else 0
    off, k = min(((abs(size - room), k) for k, size in enumerate(unit) if not taken[k]), default=(room, 0))
    if off < room:
        taken[k] = True
    return pdf.loc[taken, ["__skey", "__order"]]


def _split(shards: int, seed: str, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A node's block counts by source, split between its halves; a node of one shard stays as it is."""
        pdf = pdf.sort_values("__skey", kind="stable").reset_index(drop=True)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        if hi - lo < 2:
            return pdf
        mid = (lo + hi) // 2
        m = pdf["m"].to_numpy(np.int64)
        rng = np.random.default_rng([level, lo, hi, *seed.encode()])
        left = rng.multivariate_hypergeometric(m, int(m.sum()) * (mid - lo) // (hi - lo), method="marginals")
        return pd.concat([pdf.assign(hi=mid, m=left), pdf.assign(lo=mid, m=m - left)])

    return run


def shard_bounds(counts: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(__skey, bounds) from (__skey, m), the number of blocks that a source has in the mix: bounds has, for each shard,
    where its stretch of the source's blocks ends. Every shard gets the same number of blocks in all, to one."""
    schema = "__skey string, m bigint, lo bigint, hi bigint"
    tree = counts.select("__skey", "m", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"))
    for level in range(max(0, (shards - 1).bit_length())):
        tree = tree.groupBy("lo", "hi").applyInPandas(_split(shards, seed, level), schema)
    runs = F.transform(F.array_sort(F.collect_list(F.struct("lo", "m"))), lambda x: x["m"])
    return (tree.groupBy("__skey").agg(runs.alias("runs"))
            .select("__skey", F.transform("runs", lambda _, i: F.aggregate(
                F.slice("runs", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("bounds")))


def _drawn(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, shards: int, block_rows: int, seed: str, keep_text: bool) -> DataFrame:
    """``docs`` with __size, __source_size, __target, __taken and __copies."""
    small = materialize(_measured(docs.select("doc_id", "source", "text"), seed).drop("text"))
    sizes = small.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_rows"))
    src = materialize(targets(sizes, weights, max_epochs))
    most = max(1, min(MAX_BLOCKS, _TREE_BLOCKS // ((max_epochs + 1) * max(1, src.count()))))  # what the tree can draw from
    size = F.greatest("source_size", F.lit(1))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    src = materialize(src.select(
        _source_key().alias("__skey"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / block_rows))).cast("long").alias("__n_blocks"),
        epochs.alias("__epochs"), (F.col("target") - epochs * F.col("source_size")).alias("__rest")))
    placed = small.join(src.select("__skey", "__n_blocks"), "__skey").withColumn("__block", _block())
    up_to = Window.partitionBy("__skey").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (placed.groupBy("__skey", "__block").agg(F.sum("__size").alias("__words"))  # at most MAX_BLOCKS a source
           .withColumn("__until", F.sum("__words").over(up_to))
           .join(src.select("__skey", "__rest"), "__skey").where(F.col("__until") > F.col("__rest"))
           .groupBy("__skey").agg(F.min(F.struct("__block", (F.col("__rest") - F.col("__until") + F.col("__words")).alias("__room"))).alias("__c"))
           .select("__skey", F.col("__c.__block").alias("__cut"), F.col("__c.__room").alias("__room")))
    src = materialize(src.join(cut, "__skey", "left").withColumn("__cut", F.coalesce("__cut", "__n_blocks")))
    last = (placed.join(src.select("__skey", "__cut", "__room"), "__skey").where("__block = __cut and __room > 0")
            .groupBy("__skey", "__order").agg(F.sum("__size").alias("__unit"), F.first("__room").alias("__room")))
    picks = materialize(last.groupBy("__skey").applyInPandas(_fill, "__skey string, __order string")
                        .withColumn("__picked", F.lit(True)))
    counts = src.select("__skey", (F.col("__epochs") * F.col("__n_blocks") + F.least(F.col("__cut") + 1, F.col("__n_blocks"))).alias("m"))
    src = materialize(src.join(shard_bounds(counts, shards, seed).withColumnRenamed("bounds", "__bounds"), "__skey"))
    rows = _measured(docs, seed) if keep_text else small
    out = (rows.join(src, "__skey").join(picks, ["__skey", "__order"], "left").withColumn("__block", _block())
           .withColumn("__drawn", F.when((F.col("__block") < F.col("__cut")) & (F.col("__rest") > 0), True)
                       .otherwise(F.coalesce("__picked", F.lit(False))))
           .withColumn("__times", F.col("__epochs") + F.col("__drawn").cast("long")))
    spot = F.when(F.col("__times") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("__times") - 1), lambda t: F.size(F.filter(
            F.col("__bounds"), lambda b: b <= t * F.col("__n_blocks") + F.col("__block"))))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("__taken", F.col("__size") * F.col("__times")).withColumn("__copies", spot)


def draw(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS,
         block_rows: int = BLOCK_ROWS, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its columns (without text if not ``keep_text``) and size, source_size, target,
    taken (words), copies (an array of the shards that its copies go to, one for each time it is taken).

    A null text has size 0; a null source is a source of its own, last in order; repeated rows are drawn together, and so
    are rows of a null doc_id that have the same text. An empty table gives an empty result. The same input gives the same
    mix on every run. Columns of the input that have one of the five new names are replaced.
    """
    new = ("size", "source_size", "target", "taken", "copies")
    base = docs.drop(*new) if keep_text else docs.select("doc_id", "source", "text")
    out = _drawn(base, weights, max_epochs, shards, block_rows, seed, keep_text)
    return out.select(*[c for c in base.columns if keep_text or c != "text"], *[F.col(f"__{c}").alias(c) for c in new])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS,
        seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each copy that is taken, with taken (words of this copy),
    shard and copy (columns of ``docs`` of these three names are replaced, all others kept). A shard's rows are in an order
    drawn by hash; a shard is cut along it into as many files as there are shuffle partitions for it. Documents without
    words are not taken."""
    names = [c for c in docs.columns if c not in ("taken", "shard", "copy")]
    d = _drawn(docs.select(*names), weights, max_epochs, shards, BLOCK_ROWS, seed, True)
    rows = (d.where("__taken > 0").select(*names, F.col("__size").alias("taken"), F.posexplode("__copies").alias("copy", "shard"))
            .withColumn("__at", F.xxhash64(F.lit(seed), "shard", "copy", "doc_id")))
    n = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = (n // shards - 1).bit_length()
    # the upper bits of the order, from the least long on: a cut's rows stand before those of the next
    cut = F.shiftrightunsigned(F.col("__at").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0)
    return rows.repartition(n, "shard", cut).sortWithinPartitions("shard", "__at").drop("__at")
