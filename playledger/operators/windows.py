"""Sequence operators: islands, fills, prior-only sums, look-ahead counts, decayed sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIOR = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)
ONWARD = (Window.currentRow, Window.unboundedFollowing)


def ordered(by: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def closed_islands(flag: Column, w) -> Column:
    """Number of the island a row is in, if a flagged row is the last of its island."""
    return F.coalesce(F.sum(flag.cast("int")).over(w.rowsBetween(*PRIOR)), F.lit(0))


def change_islands(value: Column, w) -> Column:
    """Number of the run of equal values a row is in, from 1; null equals null."""
    change = F.when(F.row_number().over(w) == 1, 1).otherwise((~value.eqNullSafe(F.lag(value).over(w))).cast("int"))
    return change


def prior_sum(value: Column, w) -> Column:
    """Sum over the rows strictly before."""
    return F.coalesce(F.sum(value).over(w.rowsBetween(*PRIOR)), F.lit(0))


def fill_forward(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(*UPTO))


def fill_backward(value: Column, w) -> Column:
    return F.first(value, ignorenulls=True).over(w.rowsBetween(*ONWARD))


def ahead_count(flag: Column, w, rows: int) -> Column:
    """Flagged rows among this and the next rows-1; 0 in the last rows-1 rows of a sequence."""
    n = F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(0, rows - 1))
    return F.when(F.lead(F.lit(1), rows - 1).over(w).isNull(), 0).otherwise(n)


def decayed_sum(value: Column, age: Column, half_life: float, w) -> Column:
    """Sum of value * 2^-((age of this row - age of that row) / half_life) up to this row.

    age grows with the order of w; it is taken relative to the sequence's first to stay in range.
    """
    rel = age - F.first(age).over(w.rowsBetween(*UPTO))
    return F.sum(value * F.pow(F.lit(2.0), rel / half_life)).over(w.rowsBetween(*UPTO)) * F.pow(F.lit(2.0), -rel / half_life)


def average_rank(w_rank, w_all) -> Column:
    """Rank with ties at their mean place; w_rank orders, w_all has the tied group."""
    return F.rank().over(w_rank) + (F.count("*").over(w_all) - 1) / 2


def leave_one_out(value: str, by: Sequence[str], prior: Column, weight: float) -> Column:
    """Mean of the group's other rows, shrunk to ``prior`` as if by ``weight`` further rows.

    The number of other rows is never below 0; an empty group gives the prior.
    """
    w = Window.partitionBy(*by)
    n = F.greatest(F.count(value).over(w) - F.when(F.col(value).isNotNull(), 1).otherwise(0), F.lit(0))
    total = F.coalesce(F.sum(value).over(w), F.lit(0.0)) - F.coalesce(F.col(value), F.lit(0.0))
    return (total + weight * prior) / (n + weight)


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_ambiguous(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key with its payload, or with null payload where rows of the key disagree.

    status is unique, duplicate or ambiguous; n_rows and n_versions tell how many.
    """
    body = F.struct(*payload)
    agg = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(body).alias("n_versions"), F.max(body).alias("_p"))
    one = F.col("n_versions") == 1
    status = F.when(~one, "ambiguous").when(F.col("n_rows") > 1, "duplicate").otherwise("unique")
    return agg.select(*keys, "n_rows", "n_versions", status.alias("status"), *(F.when(one, F.col(f"_p.{c}")).alias(c) for c in payload))
