"""Estimators and allocations that go beyond one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .estimate import conjugate, pair_products, quadratic
from .ranks import numbered, running
from .sequences import along


def ks_statistic(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Largest distance of two groups' distribution functions, from counts per distinct value."""
    x = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    per = x.groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    run = running(per, [value], {"ra": "na", "rb": "nb"})
    sums = per.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    ta, tb = sums.select("ta").scalar(), sums.select("tb").scalar()
    return run.agg(F.max(F.abs(F.col("ra") / ta - F.col("rb") / tb)).alias("ks"))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """df with the false-discovery rate at which each row's test passes; null where p is.

    The rate of a value of p is the least of p n / rank over it and all greater ones. The ranks come
    from running counts over the distinct values; the least from the values' ranges, last to first.
    """
    per = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_k"))
    ranked = running(per, [p], {"_r": "_k"})
    raw = cut(ranked.withColumn("_raw", F.col(p) * per.agg(F.sum("_k")).scalar() / F.col("_r")).repartitionByRange(p).withColumn("_range", F.spark_partition_id()))
    each = raw.groupBy("_range").agg(F.min("_raw").alias("_m"))
    after = each.select("_range", F.min("_m").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))  # a row per range
    w = Window.partitionBy("_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    rates = raw.withColumn("_q", F.min("_raw").over(w)).join(F.broadcast(after), "_range").select(p, F.least("_q", "_after", F.lit(1.0)).alias(out))
    return df.join(rates, p, "left").select(*df.columns, out)


def quantile_bins(df: DataFrame, value: str, tie: Sequence[str], bins: int, out: str = "bin") -> DataFrame:
    """Bins 1..bins of equal numbers by rank, ties told apart by ``tie``; right-closed cuts on the ranks.

    Row n of N in order is in bin k if n lies in (1 + (N-1)(k-1)/bins, 1 + (N-1)k/bins].
    """
    ranked = numbered(df, [value, *tie], "_r").withColumn("_n", df.agg(F.count("*")).scalar())
    place = (F.col("_r") - 1) * bins / F.nullif(F.col("_n") - 1, F.lit(0))
    return ranked.withColumn(out, F.greatest(F.ceil(F.round(F.coalesce(place, F.lit(0.0)), 9)), F.lit(1)).cast("int")).drop("_r", "_n")


def shrunk_curve(df: DataFrame, x: str, y: str, weight: float) -> DataFrame:
    """x, mean, n: means shrunk to the overall one, gaps filled by straight lines, smoothed 1-2-1.

    x is an integer axis of bounded extent (ages, months); ends are smoothed with what is there.
    """
    overall = df.agg(F.avg(y)).scalar()
    g = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("int").alias("x")).agg(F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"))
    g = g.withColumn("m", (F.col("s") + weight * overall) / (F.col("n") + weight))
    axis = g.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.explode(F.sequence("a", "b")).alias("x"))
    j = axis.join(g, "x", "left")
    w = Window.orderBy("x")
    point = F.when(F.col("m").isNotNull(), F.struct("x", "m"))
    before, after = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    j = j.select("x", F.coalesce("n", F.lit(0)).alias("n"), before.alias("p"), after.alias("q"))
    line = F.when(F.col("p.x") == F.col("q.x"), F.col("p.m")).otherwise(F.col("p.m") + (F.col("q.m") - F.col("p.m")) * (F.col("x") - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    j = j.withColumn("v", line)
    lo, hi = F.lag("v").over(w), F.lead("v").over(w)
    smooth = (2 * F.col("v") + F.coalesce(lo, F.lit(0.0)) + F.coalesce(hi, F.lit(0.0))) / (2 + lo.isNotNull().cast("int") + hi.isNotNull().cast("int"))
    return j.select("x", "n", smooth.alias("mean"))


def best_candidate(df: DataFrame, key: Sequence[str], cost: str, payload: Sequence[str], margin: float) -> DataFrame:
    """The candidate of least cost per key, where it is alone or better than the next by ``margin``."""
    lists = df.where(F.col(cost).isNotNull()).groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(cost, *payload)).alias("_p"), F.min(cost).alias("_best"), F.count("*").alias("n"))
    second = df.join(lists.select(*key, "_best", "_p"), list(key)).where(~F.struct(cost, *payload).eqNullSafe(F.struct("_best", *(F.col(f"_p.{c}") for c in payload)))).groupBy(*key).agg(F.min(cost).alias("_next"))
    j = lists.join(second, list(key), "left")
    ok = F.col("_next").isNull() | (F.col("_next") - F.col("_best") >= margin)
    return j.select(*key, "n", ok.alias("clear"), *(F.when(ok, F.col(f"_p.{c}")).alias(c) for c in payload))


def first_ahead(value: Column, hit: Column, w, most: int) -> Column:
    """``value`` of the first of the next ``most`` rows where ``hit`` holds; null if there is none."""
    seen = F.array(*(F.struct(F.lead(hit, k).over(w).alias("h"), F.lead(value, k).over(w).alias("v")) for k in range(1, most + 1)))
    return F.get(F.filter(seen, lambda x: x["h"]), F.lit(0))["v"]


def series_win_probability(p_home: float, p_away: float, home: Sequence[bool] = (True, True, False, False, True, False, True)) -> float:
    """Chance of the first to win most of the games, with its chance at home and away."""
    need = len(home) // 2 + 1
    states = {(0, 0): 1.0}
    won = 0.0
    for at_home in home:
        p = p_home if at_home else p_away
        after: dict[tuple[int, int], float] = {}
        for (a, b), q in states.items():
            for x, y, r in ((a + 1, b, p), (a, b + 1, 1 - p)):
                if x == need:
                    won += q * r
                elif y < need:
                    after[x, y] = after.get((x, y), 0.0) + q * r
        states = after
    return won


def series_chances(home: Column, away: Column, places: Sequence[bool] = (True, True, False, False, True, False, True)) -> Column:
    """``series_win_probability`` as an expression: the states of wins are advanced game by game."""
    need = len(places) // 2 + 1
    states: dict[tuple[int, int], Column] = {(0, 0): F.lit(1.0)}
    won = F.lit(0.0)
    for at_home in places:
        p = home if at_home else away
        after: dict[tuple[int, int], Column] = {}
        for (a, b), q in states.items():
            won = won + q * p if a + 1 == need else won
            for key, r in ((((a + 1), b), p), ((a, b + 1), 1 - p)):
                if max(key) < need:
                    after[key] = after[key] + q * r if key in after else q * r
        states = after
    return won


def capped_shares(df: DataFrame, group: str, key: str, weight: str, cap: str, total: float) -> DataFrame:
    """group, key, share: ``total`` divided in proportion to weight, none above its cap.

    What a cap cuts off goes to the others in proportion, until all fit; a group whose caps sum to
    less than the total gets its caps. Groups are rosters, small by design.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, c = pdf[weight].fillna(0).clip(lower=0).to_numpy(float), pdf[cap].fillna(0).clip(lower=0).to_numpy(float)
        share, free, left = np.zeros(len(pdf)), np.ones(len(pdf), bool), min(total, c.sum())
        while left > 1e-12 and free.any():
            base = w * free
            if base.sum() <= 0:
                base = free.astype(float)
            add = left * base / base.sum()
            over = free & (share + add >= c - 1e-12)
            if not over.any():
                share += add
                break
            left -= (c - share)[over].sum()
            share[over] = c[over]
            free &= ~over
        return pd.DataFrame({group: pdf[group], key: pdf[key], "share": share})

    kinds = dict(df.dtypes)
    return df.select(group, key, weight, cap).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}, share double")


def ou_filter(panel: DataFrame, *, key: str, order: Sequence[str], value: str, exposure: str, gap_days: str, level_var: float, level_q: float, swing_var: float, half_life: float, r: float) -> DataFrame:
    """Two-part filter per key: a level that drifts and a swing that decays to 0 between rows."""

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        m, p, first = state
        out = np.empty((len(pdf), 2))
        y, e, gap = pdf[value].to_numpy(float), pdf[exposure].to_numpy(float), pdf[gap_days].fillna(0).to_numpy(float)
        for k in range(len(pdf)):
            if not first:
                f = 0.5 ** (gap[k] / half_life)
                a = np.diag([1.0, f])
                m, p = a @ m, a @ p @ a + np.diag([level_q * gap[k], swing_var * (1 - f * f)])
            first = False
            if not np.isnan(y[k]) and e[k] > 0:
                h = p.sum(axis=1)
                gain = h / (h.sum() + r / e[k])
                m, p = m + gain * (y[k] - m.sum()), p - np.outer(gain, h)
            out[k] = m
        return (m, p, first), {"level": out[:, 0], "swing": out[:, 1]}

    rows = panel.select(key, *order, value, exposure, gap_days)
    return along(rows, [key], list(order), lambda: (np.zeros(2), np.diag([level_var, swing_var]), True), step, "level double, swing double").select(key, *order, "level", "swing")


def ridge_by_folds(rows: DataFrame, *, features: str, weight: str, target: str, fold: str, alphas: Sequence[float], dense: int = 6_000) -> DataFrame:
    """alpha, mse: weighted error of each alpha over folds, from per-fold sums alone.

    One pass over the rows gives the sums of all folds. The training sums of a fold are the whole sums
    less the fold's own; errors follow from the fold's products, right side and sum of squares. Folds
    are taken one after the other, whatever their number; beyond ``dense`` features the equations are
    solved by conjugate gradients and no matrix comes to the driver. Rows without a fold are one fold.
    """
    spark = rows.sparkSession
    gram, right = pair_products(rows, features, weight, target, by=fold)
    gram = cut(gram)
    sums = rows.groupBy(F.col(fold).alias("_by")).agg(F.sum(F.col(weight) * F.col(target) * F.col(target)).alias("yy"), F.sum(weight).alias("w")).collect()
    sides = right.collect()  # a number per fold and feature
    names = sorted({r.i for r in sides})
    at = {n: k for k, n in enumerate(names)}
    vectors: dict = {}
    for r in sides:
        vectors.setdefault(r["_by"], np.zeros(len(names)))[at[r.i]] = r.b

    def matrix(part: DataFrame) -> np.ndarray:
        g = part.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
        m = np.zeros((len(names), len(names)))
        i, j = g["i"].map(at).to_numpy(), g["j"].map(at).to_numpy()
        m[i, j] = m[j, i] = g["g"].to_numpy()
        return m

    gb = sum(vectors.values(), np.zeros(len(names)))
    small = len(names) <= dense
    ga = matrix(gram) if small else None
    errors, n = np.zeros(len(alphas)), 0.0
    for s in sums:
        own = F.col("_by").eqNullSafe(F.lit(s["_by"]))
        v = vectors.get(s["_by"], np.zeros(len(names)))
        n += s.w
        if small:
            a = matrix(gram.where(own))
        else:
            rest = cut(gram.where(~own).groupBy("i", "j").agg(F.sum("g").alias("g")))
        for k, alpha in enumerate(alphas):
            if small:
                beta = np.linalg.solve(ga - a + alpha * np.eye(len(names)), gb - v)
                square = beta @ a @ beta
            else:
                beta = conjugate(rest, names, gb - v, np.full(len(names), float(alpha)), np.zeros(len(names)))
                square = quadratic(gram.where(own), names, beta)
            errors[k] += s.yy - 2 * beta @ v + square
    out = [(float(alpha), float(e / n)) for alpha, e in zip(alphas, errors, strict=True)] if n else []
    return spark.createDataFrame(out, "alpha double, mse double")
