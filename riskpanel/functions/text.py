"""Header and label text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision label synonyms -> regime code (0 risk-off, 1 neutral, 2 risk-on).
DECISION_CODES = {"risk_off": 0, "risk_neut": 1, "risk_on": 2, "off": 0, "neutral": 1, "on": 2}


def normalise_header(name: str, lower: bool = True, underscore: bool = True) -> str:
    s = str(name).strip()
    if lower:
        s = s.lower()
    if underscore:
        s = re.sub(r"\s", "_", s)  # each blank, so that names with one and two blanks stay apart
    return s


def normalise_columns(df: DataFrame, lower: bool = True, underscore: bool = True) -> DataFrame:
    """Strip / lower / space->'_' on every column name (metadata only)."""
    return df.toDF(*[normalise_header(c, lower, underscore) for c in df.columns])


def decision_code(c) -> Column:
    """Case-insensitive decision label -> code; unknown -> NULL."""
    m = F.create_map(*[x for k, v in DECISION_CODES.items() for x in (F.lit(k), F.lit(v))])
    col = F.col(c) if isinstance(c, str) else c
    return m[F.lower(F.trim(col.cast("string")))]
