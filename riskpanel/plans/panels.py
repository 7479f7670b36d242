"""Panels derived from the driver tables (TPC-H-ish + events).

* ``nation_month_long``: 8 monthly series per nation (lineitem via supplier,
  orders via customer), long form -> input of the feature table (X1).
* ``flag_day_long``: 8 daily series per ``l_returnflag`` from lineitem alone
  (~2,500 rows per key: long enough for the 120-row walk-forward warm-up).
* ``user_events``: raw events keyed by user and day, with deterministic
  injected nulls for the quality operators.

Each builder aggregates the fact table once (partial aggregation before the
shuffle) and unpivots; series names follow the reference's feature names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.calendar import month_end

SERIES = ["temp_anom", "carbon", "cpu", "vix", "term_spread", "ig_spread", "spx_px", "bond_px"]
CLIMATE = ["temp_anom", "carbon", "cpu"]
FEATURES = ["temp_anom", "carbon", "cpu", "vix", "term_spread", "ig_spread_chg", "spx_ret", "bond_ret"]
NODES = ["temp_anom", "carbon", "cpu", "vix", "term_spread", "ig_spread_chg", "spx_ret", "regime"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_month_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice",
                                                "l_discount", "l_tax", "l_quantity")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    a = (li.join(su, li.l_suppkey == su.s_suppkey)
         .groupBy(F.col("s_nationkey").alias("nation"), month_end("l_shipdate").alias("date"))
         .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("spx_px"),
              F.avg("l_discount").alias("temp_anom"),
              F.avg("l_tax").alias("carbon"),
              F.avg("l_quantity").alias("term_spread")))
    od = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    b = (od.join(cu, od.o_custkey == cu.c_custkey)
         .groupBy(F.col("c_nationkey").alias("nation"), month_end("o_orderdate").alias("date"))
         .agg(F.count(F.lit(1)).cast("double").alias("cpu"),
              (F.avg("o_totalprice") / 10000.0).alias("vix"),
              F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("ig_spread"),
              F.sum("o_totalprice").alias("bond_px")))
    la = a.unpivot(["nation", "date"], ["spx_px", "temp_anom", "carbon", "term_spread"], "series_id", "value")
    lb = b.unpivot(["nation", "date"], ["cpu", "vix", "ig_spread", "bond_px"], "series_id", "value")
    return la.unionByName(lb)


def flag_day_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("date"))
            .agg(F.avg("l_discount").alias("temp_anom"),
                 F.avg("l_tax").alias("carbon"),
                 F.count(F.lit(1)).cast("double").alias("cpu"),
                 F.avg("l_quantity").alias("vix"),
                 (F.avg("l_extendedprice") / 1000.0).alias("term_spread"),
                 F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("ig_spread"),
                 F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("spx_px"),
                 F.sum("l_quantity").alias("bond_px")))


def flag_day_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_day_wide(spark, sf_dir).unpivot(["flag", "date"], SERIES, "series_id", "value")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with day key and deterministic injected nulls:
    value NULL when event_id % 7 = 0, event_type NULL when event_id % 5 = 0."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("date"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
    )
