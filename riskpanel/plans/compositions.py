"""Notebook compositions (X2, X3) expressed with the library operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.calendar import parse_date
from riskpanel.functions.nulls import to_double
from riskpanel.operators import features as fx
from riskpanel.operators import quality as qa
from riskpanel import sources as src
from riskpanel.session import materialize


def climate_indices(cells: DataFrame, *, header_row: int, date_header: str = "Date",
                    date_fmt: str = "dd/MM/yyyy", rename: dict[str, str] | None = None,
                    window: int = 30, key: str = "file") -> dict[str, DataFrame]:
    """Spreadsheet cells -> table -> drop all-null columns (P6) -> date key
    (ISO text of date cells, else F3, day-first) -> numeric coerce and rename (P2, F4) -> drop rows with no
    date or no values (P7, P5 'all') -> order check (A21) -> trailing
    ``window``-row means (W5) -> duplicate count (A7) -> gap report (A5, U5).
    Returns the frames of each report part, all keyed by source file. A column
    stays in the table if any file fills it; ``columns`` names those that a file
    fills itself. Rows of one date are smoothed in the order of the sheet."""
    t = materialize(src.cells_to_table(cells, header_row))
    t = fx.drop_all_null_columns(t)
    rename = rename or {}
    vals = [c for c in t.columns if c not in ("file", "sheet", "row", date_header)]
    # date cells come as ISO text, text cells as they were typed
    date = F.coalesce(parse_date(F.col(date_header), date_fmt), F.to_date(F.try_to_timestamp(F.substring(date_header, 1, 10), F.lit("yyyy-MM-dd"))))
    typed = F.trim(date_header)
    date = F.when(date.isNull() & (typed != ""), F.raise_error(F.concat(F.lit("no date: "), typed)).cast("date")).otherwise(date)
    out = t.select(F.col("file").alias(key), "row", date.alias("date"),
                   *[to_double(c).alias(rename.get(c, c)) for c in vals])
    names = [rename.get(c, c) for c in vals]
    out = out.where(F.col("date").isNotNull()).dropna(how="all", subset=names)
    monotonic = qa.is_monotonic(out, "date", keys=[key], arrival="row")
    smooth = out.withColumn("__at", F.struct("date", "row"))
    for c in names:
        smooth = fx.rolling_mean(smooth, c, f"{c}_smooth", window, keys=[key], date_col="__at")
    columns = fx.filled_columns(t.withColumnRenamed("file", key), vals, keys=[key])
    dups = qa.duplicate_summary(out, keys=[key])
    gaps = qa.gap_report(out.select(key, "date").distinct(), keys=[key])
    return {"table": smooth.drop("__at"), "columns": columns, "monotonic": monotonic, "duplicates": dups, "gaps": gaps}


def solar_daily(spark: SparkSession, sunspot_path: str, flux_json_path: str, on: str = "timestamp") -> DataFrame:
    """Daily sunspot numbers (S2) outer-joined (J1) with a JSON
    array-of-arrays flux table (S3, F3, F4). ``on='timestamp'`` joins on the
    full time stamp as the reference does (readings at 20:00 stay separate
    from midnight sunspot dates); ``on='date'`` aligns both on the day."""
    ssn = src.read_semicolon_daily(spark, sunspot_path).select(
        F.col("date").cast("timestamp_ntz").alias("ts"), F.col("value").alias("sunspot_number"))
    fl = src.read_json_table(spark, flux_json_path).select(
        F.try_to_timestamp("time_tag", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        to_double("flux").alias("f107_flux"))
    if on == "date":
        ssn = ssn.withColumn("ts", F.to_date("ts"))
        fl = fl.groupBy(F.to_date("ts").alias("ts")).agg(F.avg("f107_flux").alias("f107_flux"))
    elif on != "timestamp":
        raise ValueError("on must be 'timestamp' or 'date'")
    return fx.outer_align(ssn, fl, keys=[], date_col="ts")
