"""Rounding that gives the same digits in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, places: int) -> Column:
    """``floor(x * 10^places + 0.5) / 10^places``; ``round`` itself differs between engines at ties."""
    scale = float(10**places)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_up_sql(expr: str, places: int) -> str:
    scale = f"{10**places}.0::double"
    return f"(floor(({expr}) * {scale} + 0.5::double) / {scale})"
