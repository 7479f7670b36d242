"""The monthly (or any-period) feature table.

long series -> N-way align (one grouped aggregate) -> diff / pct-change /
climate lag (one window exchange on ``keys``) -> keep -> drop incomplete rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskpanel.operators import features as fx
from riskpanel.plans.panels import CLIMATE, FEATURES, SERIES


def build_feature_table(long_df: DataFrame, *, keys: list[str], date_col: str = "date",
                        series: list[str] = SERIES, climate: list[str] = CLIMATE,
                        spread_col: str = "ig_spread", equity_px: str = "spx_px", bond_px: str = "bond_px",
                        keep: list[str] = FEATURES, pct_fill: str = "pad") -> DataFrame:
    wide = fx.align_series(long_df, series, keys=keys, date_col=date_col)
    wide = fx.diff(wide, spread_col, "ig_spread_chg", keys=keys, date_col=date_col)
    wide = fx.pct_change(wide, equity_px, "spx_ret", keys=keys, date_col=date_col, fill=pct_fill)
    wide = fx.pct_change(wide, bond_px, "bond_ret", keys=keys, date_col=date_col, fill=pct_fill)
    wide = fx.add_lags(wide, climate, keys=keys, date_col=date_col, n=1, inplace=True)
    return wide.select(*keys, date_col, *keep).dropna(how="any")
