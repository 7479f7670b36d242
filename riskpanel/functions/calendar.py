"""Calendar scalars (F1-F8, F11): month ends, periods, coerced parsing."""

from __future__ import annotations


from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# English month abbreviations in calendar order (Jan = 1).
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_end(c) -> Column:
    """any timestamp/date -> last calendar day of its month (DATE)."""
    return F.last_day(F.to_date(_c(c)))


def period_start(c, period: str) -> Column:
    """Truncate to the start of a 'day' | 'week' (ISO, Monday) | 'month' period, as DATE.

    'month_end' maps to the month's last day (the reference's month index)."""
    if period == "day":
        return F.to_date(_c(c))
    if period == "month_end":
        return month_end(c)
    if period in ("week", "month", "quarter", "year"):
        return F.to_date(F.date_trunc(period, F.to_timestamp(_c(c))))
    raise ValueError(f"unknown period {period!r}")


def make_month_date(year, month) -> Column:
    """first day of (year, month) from int columns; nulls stay null."""
    return F.make_date(_c(year).cast("int"), _c(month).cast("int"), F.lit(1))


def month_lookup(name) -> Column:
    """'Jan'..'Dec' -> 1..12 (case-insensitive, unknown -> NULL)."""
    arr = F.array(*[F.lit(m.lower()) for m in MONTHS])
    pos = F.array_position(arr, F.lower(F.trim(_c(name))))
    return F.when(pos > 0, pos.cast("int"))


def fix_two_digit_year(d, pivot_year: int = 2069) -> Column:
    """Map a date parsed from a 2-digit year onto the 1969..2068 window (POSIX %y pivot)."""
    d = _c(d)
    return F.when(F.year(d) >= pivot_year, F.add_months(d, -1200)).otherwise(d)


def parse_date(c, fmt: str, two_digit_year: bool = False) -> Column:
    """coerced parse; bad text -> NULL (never raises under ANSI).

    Returns a DATE. ``two_digit_year`` applies the %y pivot rule."""
    d = F.to_date(F.try_to_timestamp(_c(c), F.lit(fmt)))
    return fix_two_digit_year(d) if two_digit_year else d


def days_since_first(date_col: str, keys: list[str]) -> Column:
    """F8: day offset from each key's first date (x axis of interpolants)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return F.datediff(F.col(date_col), F.min(date_col).over(w))


def months_to_odd_days(months: float, polyorder: int, n: int) -> int:
    """months -> odd day window, clamped to [polyorder+2 (odd), n (odd)].

    Python's round() is half-to-even, which is what the published recipe uses."""
    w = int(round(months * 30.44))
    if w % 2 == 0:
        w += 1
    lo = polyorder + 2
    if lo % 2 == 0:
        lo += 1
    hi = n if n % 2 == 1 else n - 1
    return max(lo, min(w, hi))


