"""Exact row numbers over orders of any length: no key's rows meet in one task.

A window over a whole key puts all of its rows into one task. Here the rows are range-partitioned by key and order, so
that a frequent key runs over many partitions; each partition numbers its own rows, and the numbers of rows that stand in
the partitions before it (one count for each partition and key) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """``df`` with the row number ``name`` (from 1) of each row within its ``keys`` by ``order``.

    Rows that are equal in ``order`` get their numbers in any order, so ``order`` should be unique within the keys. Null
    keys are a key of their own. An empty table gives an empty result; a column of the new name is replaced.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = materialize(df.drop(name).repartitionByRange(n, *keys, *by).withColumn("__part", F.spark_partition_id()))
    at = Window.partitionBy("__part", *keys)
    local = dealt.withColumn("__no", F.row_number().over(at.orderBy(*by)))
    # one row for each partition and key that meet
    sizes = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sizes = materialize(sizes.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = local.join(sizes, same).withColumn(name, F.col("__no") + F.col("__before"))
    return out.select(*[c for c in df.columns if c != name], name)


def summed_before(df: DataFrame, keys: list[str], order: list[str | Column], amount: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` (whole numbers, null counts as 0) over the rows of the same ``keys`` that
    stand before a row by ``order``, which must be unique within the keys; 0 for the first. As ``numbered``, no key's rows
    meet in one task."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = materialize(df.drop(name).repartitionByRange(n, *keys, *by).withColumn("__sb_part", F.spark_partition_id()))
    earlier = Window.partitionBy("__sb_part", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__sb_sum", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
    totals = dealt.groupBy("__sb_part", *keys).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("__sb_total"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__sb_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__sb_before", F.coalesce(F.sum("__sb_total").over(before), F.lit(0)))
    totals = materialize(totals.select(F.col("__sb_part").alias("__sb_p"), *[F.col(k).alias(f"__sb_k{i}") for i, k in enumerate(keys)], "__sb_before"))
    same = F.col("__sb_part") == F.col("__sb_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__sb_k{i}"))
    out = local.join(totals, same).withColumn(name, F.col("__sb_sum") + F.col("__sb_before"))
    return out.select(*[c for c in df.columns if c != name], name)
