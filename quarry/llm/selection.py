"""Cut points of a ranking without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that one histogram tells apart.
LEVEL_BITS = 13


def top_k_cut(rows: DataFrame, key: str, k: int, low: float, high: float, levels: int = 5) -> float:
    """The greatest value such that at least ``k`` rows have a ``key`` of it or more; -inf if there are fewer rows.

    Each level counts rows in equal slices of the open interval and opens only
    the slice in which the count reaches k: one narrow aggregation a level.
    """
    slices = 1 << LEVEL_BITS
    left = k
    for _ in range(levels):
        width = (high - low) / slices
        if width <= 0:
            break
        slot = F.least(F.floor((F.col(key) - low) / width), F.lit(slices - 1)).cast("int")
        inside = rows.filter((F.col(key) >= low) & (F.col(key) <= high))
        counts = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        row = counts.withColumn("above", above).filter(F.col("above") + F.col("n") >= left).orderBy(F.desc("slot")).first()
        if row is None:
            return float("-inf")
        left -= row["above"]
        low, high = row["lo"], row["hi"]
        if low == high or row["n"] == left:
            break
    return low
