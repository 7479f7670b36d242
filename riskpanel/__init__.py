"""riskpanel: keyed time-series panel analytics on Spark DataFrames.

Every operator takes a DataFrame plus the panel ``keys`` and an explicit
``date_col`` and returns a lazy DataFrame built from Spark SQL expressions,
windows and grouped aggregates.
"""

from riskpanel.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
