"""Places, running sums and quantiles within keys of any size: no key is ever one task.

Rows are dealt into ranges of key and order, and each range is sorted and summed by itself. What lies before a range comes
from one row for each key and range, so a key with all rows costs no more than many small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace


def _same(keys: list[str], a: str, b: str) -> Column:
    """Equality of the keys and of the range, nulls being equal."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.col(f"{a}._range") == F.col(f"{b}._range"))


def ranked(df: DataFrame, keys: list[str], order: list[str], sums: tuple[str, ...] = (), ahead: str | None = None) -> DataFrame:
    """Adds ``_place`` (from 1) and ``_rows`` of each row's key, and what else is asked for.

    ``_sum_x`` and ``_all_x`` are the running sum up to the row and the total of ``x``, and ``_next`` the value of
    ``ahead`` in the row after it (null in the last). ``order`` should tell all rows of a key apart; equal ones come in any
    order. Null keys are a key, and nulls come first. An empty table gives no rows.
    """
    parts = Workspace(df.sparkSession, "ranks").save(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    first = [F.min(F.struct(*order, F.col(ahead).alias("_ahead")))["_ahead"].alias("_first")] if ahead else []
    totals = parts.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), *(F.sum(x).alias(f"_s_{x}") for x in sums), *first)
    by = Window.partitionBy(*keys).orderBy("_range")  # a row for each range of a key
    earlier, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    lay = [F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_rows")]
    for x in sums:
        lay += [F.coalesce(F.sum(f"_s_{x}").over(earlier), F.lit(0)).alias(f"_b_{x}"), F.sum(f"_s_{x}").over(whole).alias(f"_all_{x}")]
    lay += [F.lead("_first").over(by).alias("_after")] if ahead else []
    before = totals.select(*keys, "_range", *lay)
    joined = parts.alias("x").join(before.alias("y"), _same(keys, "x", "y")).select("x.*", *(f"y.{c}" for c in before.columns if c not in keys and c != "_range"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    out = joined.withColumn("_place", F.col("_before") + F.row_number().over(w))
    for x in sums:
        out = out.withColumn(f"_sum_{x}", F.col(f"_b_{x}") + F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(f"_b_{x}")
    if ahead:
        last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*keys, "_range"))
        out = out.withColumn("_next", F.when(last, F.col("_after")).otherwise(F.lead(ahead).over(w))).drop("_after")
    return out.drop("_before", "_range")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``keys, q, value``: exact quantiles with linear interpolation; null values count for nothing."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], ahead=value)
    asked = F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_rows") - 1)).alias("p")) for q in at])
    hit = rows.withColumn("_a", F.explode(F.filter(asked, lambda a: F.floor(a["p"]) == F.col("_place") - 1)))
    part = F.col("_a.p") - F.floor("_a.p")
    v = F.when(part > 0, F.col(value) + part * (F.col("_next") - F.col(value))).otherwise(F.col(value))
    return hit.select(*keys, F.col("_a.q").alias("q"), v.alias("value"))
