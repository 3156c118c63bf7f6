"""Totals over a whole ordered table without one task that sees it all.

Rows are put in ranges of the order, each range is summed, and the sums before a range are added to the
running totals inside it. Only one row per range (as many as shuffle partitions) is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """df with, per name in ``sums``, the total of its column over all rows up to and including this one.

    Rows that are equal in ``order`` are in one range, in an order of their own. Nulls count as 0 and
    stand where the order puts them. An empty table stays empty.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    each = ranged.groupBy("_range").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_range", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    w = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    out = inside.join(F.broadcast(offsets), "_range")  # a row per partition
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums}).drop("_range", *(f"_{a}_{n}" for n in sums for a in "io"))


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """df with each row's number in the order, from 1."""
    return running(df, order, {out: F.lit(1)})
