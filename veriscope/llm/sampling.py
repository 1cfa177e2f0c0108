"""Bounded training samples: what reaches the driver follows the size asked for, not the table or its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 31


def share_of(df: DataFrame, unit: Column, size: int) -> float:
    """Share of the values of ``unit`` that a sample of ``size`` of them needs, with a margin; one aggregate row."""
    n = df.agg(F.approx_count_distinct(unit, 0.02)).first()[0]
    return min(1.0, 1.2 * size / max(1, n))


def within(unit: Column, share: float) -> Column:
    """Whether a value of ``unit`` falls into that share, by its hash: all rows of a value fall alike."""
    return F.pmod(F.xxhash64(F.lit("sample"), unit), F.lit(_SPACE)) < F.lit(int(share * _SPACE))
