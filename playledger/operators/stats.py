"""Aggregates: weighted moments, calibration, rank statistics, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def weighted_mse(x: Column, y: Column, w: Column) -> Column:
    e = x - y
    return F.sum(w * e * e) / F.sum(F.when(e.isNotNull(), w))


def right_closed_bin(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge, next edge] that x is in; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((x > lo) & (x <= hi), label).otherwise(out)
    return out


def moments_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation from sums of products."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / sw - sx * sy / sw / sw
    vx = F.sum(w * x * x) / sw - sx * sx / sw / sw
    vy = F.sum(w * y * y) / sw - sy * sy / sw / sw
    return cov / F.sqrt(vx * vy)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by average ranks; ranks come from counts per distinct score.

    Only one row per distinct score enters the order, and that is by ranges.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    ranks = running(per, [score], {"_upto": "_n"}).select(F.col("_n").alias("n"), F.col("_p").alias("p"), (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias("r"))
    sums = ranks.agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select(((F.col("rp") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))
