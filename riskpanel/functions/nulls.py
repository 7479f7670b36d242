"""Missing-value normalisation (NaN and None are one concept -> NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL so three-valued logic matches pandas comparisons."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    """Keep finite doubles only; NaN, +inf, -inf -> NULL."""
    c = _c(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_double(c) -> Column:
    """numeric coerce ('***' -> NULL) under ANSI mode."""
    return nan_to_null(_c(c).try_cast("double"))


def to_int(c) -> Column:
    """best-effort integer cast."""
    return _c(c).try_cast("int")


def normalise_nans(df: DataFrame) -> DataFrame:
    """Apply nan_to_null to every float/double column (ingest boundary)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
