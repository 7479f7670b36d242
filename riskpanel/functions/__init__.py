"""Column-level helpers (pure Spark SQL expressions, whole-stage codegen friendly)."""

from riskpanel.functions.calendar import (  # noqa: F401
    month_end, period_start, make_month_date, parse_date, fix_two_digit_year,
    days_since_first, month_lookup, months_to_odd_days,
)
from riskpanel.functions.nulls import nan_to_null, finite, normalise_nans, to_double, to_int  # noqa: F401
from riskpanel.functions.text import normalise_header, normalise_columns, decision_code  # noqa: F401
