"""Least squares from distributed sufficient statistics: Gram matrices, ridge, folds, Kalman filters.

Rows never leave the executors: designs are sparse (row, feature, value) triples or arrays, the
cluster sums their products, and only the Gram matrix, whose size is bounded by the number of
features, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sequences import along


def pair_products(rows: DataFrame, features: str, weight: str, target: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, j, g) with i <= j and (i, b): the weighted Gram matrix and right side; with ``by`` for each of its
    values, as a column _by.

    ``features`` is an array of struct<f, v>, short per row by design (a lineup's players). Pairs of
    one row's features are summed map-side; keys are feature pairs, so no feature is one group.
    """
    fs = F.array_sort(F.col(features))
    of = [F.col(by).alias("_by")] if by else []
    rows = rows.select(*of, fs.alias("_f"), F.col(weight).alias("_w"), F.col(target).alias("_y"))
    of = ["_by"] if by else []
    pairs = F.flatten(F.transform("_f", lambda x, i: F.transform(F.slice(F.col("_f"), i + 1, F.size("_f")), lambda y: F.struct(x["f"].alias("i"), y["f"].alias("j"), (x["v"] * y["v"] * F.col("_w")).alias("g")))))
    gram = rows.select(*of, F.explode(pairs).alias("p")).groupBy(*of, "p.i", "p.j").agg(F.sum("p.g").alias("g"))
    right = rows.select(*of, F.explode("_f").alias("x"), "_w", "_y").groupBy(*of, F.col("x.f").alias("i")).agg(F.sum(F.col("x.v") * F.col("_w") * F.col("_y")).alias("b"))
    return gram, right


def ridge(
    rows: DataFrame, *, features: str, weight: str, target: str, alpha: float, prior: dict | None = None, free: Sequence = (), penalties: dict | None = None, dense: int = 6_000, errors: bool = False, tolerance: float = 1e-10
) -> dict:
    """Coefficients by feature of min sum w (y - x b)^2 + sum alpha_f (b_f - prior_f)^2.

    ``penalties`` gives a feature's own alpha in place of the common one (per-side alphas, a player's
    multiplier), ``free`` has no penalty (nuisance columns). Up to ``dense`` features the normal
    equations are solved on the driver; beyond that by conjugate gradients, whose vectors of a number a
    feature are all that the driver holds: the matrix stays on the executors. With ``errors`` the
    values are (coefficient, standard error) from the residual variance, for the dense way only.
    """
    gram, right = pair_products(rows, features, weight, target)
    gram = cut(gram)
    sums = {r.i: r.b for r in right.collect()}  # a number a feature, as the result has
    names = sorted(sums)
    at = {f: k for k, f in enumerate(names)}
    b = np.array([sums[f] for f in names], dtype=float)
    loose, own = set(free), penalties or {}
    penalty = np.array([0.0 if f in loose else own.get(f, alpha) for f in names])
    centre = np.array([(prior or {}).get(f, 0.0) for f in names])
    if len(names) > dense:
        if errors:
            raise ValueError(f"standard errors for more than {dense} features")
        return dict(zip(names, conjugate(gram, names, b, penalty, centre, tolerance).tolist(), strict=True))
    g = gram.toPandas()
    a = np.zeros((len(names), len(names)))
    i, j = g["i"].map(at).to_numpy(), g["j"].map(at).to_numpy()
    a[i, j] = g["g"].to_numpy()
    a[j, i] = g["g"].to_numpy()
    whole = a + np.diag(penalty)
    solved = np.linalg.solve(whole, b + penalty * centre) if len(names) else np.zeros(0)
    if not errors:
        return dict(zip(names, solved.tolist(), strict=True))
    squares = rows.agg(F.sum(F.col(weight) * F.col(target) * F.col(target)).alias("s"), F.count(target).alias("n")).first()
    inverse = np.linalg.inv(whole)
    freedom = squares.n - np.trace(inverse @ a)
    variance = max(0.0, (squares.s or 0.0) - 2 * solved @ b + solved @ a @ solved) / freedom if freedom > 0 else float("nan")
    deviations = np.sqrt(variance * np.maximum(np.diag(inverse @ a @ inverse), 0.0))
    return {f: (float(x), float(d)) for f, x, d in zip(names, solved, deviations, strict=True)}


def _placed(gram: DataFrame, names: list) -> DataFrame:
    """(a, b, g): the pairs with their features' places among the names."""
    index = gram.sparkSession.createDataFrame(list(enumerate(names)), f"k int, f {dict(gram.dtypes)['i']}")
    return gram.join(index.select(F.col("f").alias("i"), F.col("k").alias("a")), "i").join(index.select(F.col("f").alias("j"), F.col("k").alias("b")), "j").select("a", "b", "g")


def quadratic(gram: DataFrame, names: list, beta: np.ndarray) -> float:
    """beta' G beta, summed on the executors."""
    held = gram.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            i, j = p["a"].to_numpy(), p["b"].to_numpy()
            yield pd.DataFrame({"x": [float((p["g"].to_numpy() * held.value[i] * held.value[j] * np.where(i == j, 1, 2)).sum())]})

    return _placed(gram, names).mapInPandas(run, "x double").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]


def conjugate(gram: DataFrame, names: list, b: np.ndarray, penalty: np.ndarray, centre: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Conjugate gradients with the diagonal as preconditioner; each step is one pass over the pairs."""
    spark = gram.sparkSession
    pairs = cut(_placed(gram, names))
    diagonal = penalty.copy()
    for r in pairs.where("a = b").collect():
        diagonal[r.a] += r.g

    def times(v: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(len(held.value))
            for p in batches:
                i, j, g = p["a"].to_numpy(), p["b"].to_numpy(), p["g"].to_numpy()
                out += np.bincount(i, g * held.value[j], len(out))
                off = i != j
                out += np.bincount(j[off], (g * held.value[i])[off], len(out))
            k = np.flatnonzero(out)
            yield pd.DataFrame({"k": k, "x": out[k]})

        out = penalty * v
        for r in pairs.mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[r.k] += r.x
        held.unpersist()
        return out

    x = centre.copy()
    rest = b + penalty * centre - times(x)
    z = rest / np.maximum(diagonal, 1e-300)
    along_, rz, first = z.copy(), rest @ z, max(np.linalg.norm(rest), 1e-300)
    for _ in range(10 * len(names)):
        if np.linalg.norm(rest) <= tolerance * first:
            break
        moved = times(along_)
        size = rz / (along_ @ moved)
        x, rest = x + size * along_, rest - size * moved
        z = rest / np.maximum(diagonal, 1e-300)
        rz, before = rest @ z, rz
        along_ = z + (rz / before) * along_
    return x


def recentred(df: DataFrame, value: str, weight: str) -> DataFrame:
    """df with ``value`` moved so that its weighted mean is 0."""
    mean = df.agg(F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).scalar()
    return df.withColumn(value, F.col(value) - mean)


def regression(df: DataFrame, x: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """term, estimate, std_error, t: least squares with an intercept from one row of moment sums.

    Rows with a null in y, x or the weight are left out. Standard errors need more rows than terms.
    """
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    terms = [F.lit(1.0), *(F.col(f"x{i}") for i in range(len(x)))]
    k = len(terms)
    pairs = {(i, j): F.sum(F.col("w") * terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)}
    sums = rows.agg(*pairs.values(), *(F.sum(F.col("w") * t * F.col("y")).alias(f"b{i}") for i, t in enumerate(terms)), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n")).first()
    schema = "term string, estimate double, std_error double, t double"
    if not sums.n:
        return df.sparkSession.createDataFrame([], schema)
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([sums[f"b{i}"] for i in range(k)])
    beta = np.linalg.solve(a, b)
    variance = max(0.0, sums.yy - beta @ b) / (sums.n - k) if sums.n > k else float("nan")
    errors = np.sqrt(variance * np.diag(np.linalg.inv(a)))
    out = [(name, float(e), float(s), float(e / s) if s else None) for name, e, s in zip(["intercept", *x], beta, errors, strict=True)]
    return df.sparkSession.createDataFrame(out, schema)


def one_standard_error(folds: DataFrame, penalty: str, error: str) -> DataFrame:
    """One row: the greatest penalty whose mean error over the folds is within one standard error of the least."""
    per = folds.groupBy(penalty).agg(F.avg(error).alias("m"), (F.stddev_samp(error) / F.sqrt(F.count("*"))).alias("se"))
    best = per.agg(F.min_by(F.col("m") + F.coalesce("se", F.lit(0.0)), "m")).scalar()
    return per.where(F.col("m") <= best).agg(F.max(penalty).alias(penalty))


def moment_sums(x: Sequence[Column], y: Column, w: Column) -> list[Column]:
    """Sums from which normal equations follow: w, w x_i, w x_i x_j (i <= j), w y, w x_i y, w y^2."""
    out = [F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy")]
    for i, a in enumerate(x, 1):
        out += [F.sum(w * a).alias(f"sx{i}"), F.sum(w * a * y).alias(f"sx{i}y")]
        out += [F.sum(w * a * b).alias(f"sx{i}x{j}") for j, b in enumerate(x, 1) if j >= i]
    return out


def kalman(panel: DataFrame, *, key: str, order: Sequence[str], value: str, exposure: str, gap_days: str, prior_var: float, q_game: float, q_day: float, r: float) -> DataFrame:
    """Filtered mean and variance before and after each row of a key, from mean 0 and prior_var.

    The variance grows by q_game and q_day per day of gap_days before a row; a row of exposure e
    has noise r / e; a null value or an exposure of 0 only lets time pass. Keys with a null gap
    (their first row) start at the prior.
    """

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        m, v, first = state
        pre_m, pre_v, post_m, post_v = (np.empty(len(pdf)) for _ in range(4))
        ys, es, gaps = pdf[value].to_numpy(float), pdf[exposure].to_numpy(float), pdf[gap_days].to_numpy(float)
        for k in range(len(pdf)):
            if not first:
                v += q_game + q_day * (0.0 if np.isnan(gaps[k]) else gaps[k])
            first = False
            pre_m[k], pre_v[k] = m, v
            if not np.isnan(ys[k]) and es[k] > 0:
                gain = v / (v + r / es[k])
                m, v = m + gain * (ys[k] - m), (1 - gain) * v
            post_m[k], post_v[k] = m, v
        return (m, v, first), {"pre_mean": pre_m, "pre_var": pre_v, "post_mean": post_m, "post_var": post_v}

    made = "pre_mean double, pre_var double, post_mean double, post_var double"
    rows = panel.select(key, *order, value, exposure, gap_days)
    return along(rows, [key], list(order), lambda: (0.0, prior_var, True), step, made).drop(value, exposure, gap_days)


def scalar_filter(rows: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, prior_var: float, q: float, r: float) -> DataFrame:
    """rows with mean and var after each: a scalar Kalman filter whose variance grows by q before each row."""

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        m, v = state
        means, variances = np.empty(len(pdf)), np.empty(len(pdf))
        for k, y in enumerate(pdf[value].to_numpy(float)):
            v += q
            if not np.isnan(y):
                gain = v / (v + r)
                m, v = m + gain * (y - m), (1 - gain) * v
            means[k], variances[k] = m, v
        return (m, v), {"mean": means, "var": variances}

    return along(rows, by, order, lambda: (0.0, prior_var), step, "mean double, var double")


def day_filter(rows: DataFrame, *, by: Sequence[str], day: str, tie: Sequence[str], value: str, exposure: str, query_only: str, season: str, prior_mean: float, prior_var: float, q_day: float, q_season: float, r: float, expire_days: int) -> DataFrame:
    """rows with pre_mean and pre_var: what was known before each row's day.

    All rows of a day see the same state; their observations are taken together after the day. Rows
    marked ``query_only`` ask for the state and never change it. From one observed or asked day to the
    next the variance grows by q_day a day and by q_season where the season changes; after more than
    ``expire_days`` the state is the prior again. A null value or an exposure of 0 tells nothing. Rows
    without a day come first and see the prior.
    """

    def step(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        at, year, m, v, info, weighted = state
        means, variances = np.empty(len(pdf)), np.empty(len(pdf))
        days = pd.to_datetime(pdf[day]).to_numpy("datetime64[D]")
        ys, es, asks, years = pdf[value].to_numpy(float), pdf[exposure].to_numpy(float), pdf[query_only].fillna(False).to_numpy(bool), pdf[season].to_numpy(float)
        for k in range(len(pdf)):
            if np.isnat(days[k]):
                means[k], variances[k] = prior_mean, prior_var
                continue
            if at is None or days[k] != at:
                if info > 0:
                    after = 1 / (1 / v + info)
                    m, v = after * (m / v + weighted), after
                if at is not None:
                    gap = int((days[k] - at) / np.timedelta64(1, "D"))
                    if gap > expire_days:
                        m, v = prior_mean, prior_var
                    else:
                        v += q_day * gap + (q_season if years[k] != year else 0.0)
                at, year, info, weighted = days[k], years[k], 0.0, 0.0
            means[k], variances[k] = m, v
            if not asks[k] and not np.isnan(ys[k]) and es[k] > 0:
                info, weighted = info + es[k] / r, weighted + es[k] / r * ys[k]
        return (at, year, m, v, info, weighted), {"pre_mean": means, "pre_var": variances}

    return along(rows, by, [day, *tie], lambda: (None, None, prior_mean, prior_var, 0.0, 0.0), step, "pre_mean double, pre_var double")


def blocks_topk(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int, block: int = 4096, most_queries: int = 100_000, distance: str = "cosine") -> DataFrame:
    """The k rows of ``vectors`` nearest to each query: query, rank, neighbour, similarity.

    Nearness is the cosine, or with ``distance`` "euclidean" the Euclidean distance, which then stands
    as similarity.

    A stated query set against all rows, in blocks: at most ``most_queries`` queries are held at a
    time, further ones in further passes; each partition keeps k per query of its own rows, and a
    small aggregation merges them. A row is not its own neighbour; ties go to the lower key. Rows
    with a null key or vector are no neighbours and no queries; vectors have equal lengths.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias(key), vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    asked = queries.select(F.col(key).cast("bigint").alias("q"), vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    passes = max(1, -(-asked.count() // most_queries))

    def unit(x: np.ndarray) -> np.ndarray:
        if distance == "euclidean":
            return x
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def one_pass(part: DataFrame) -> DataFrame:
        q = part.toPandas()
        held = spark.sparkContext.broadcast((q["q"].to_numpy(np.int64), unit(np.stack(q[vector].to_numpy()).astype(np.float64)) if len(q) else None))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = held.value
            for pdf in batches:
                for a in range(0, len(pdf) if m is not None else 0, block):
                    some = pdf.iloc[a : a + block]
                    x, keys = unit(np.stack(some[vector].to_numpy()).astype(np.float64)), some[key].to_numpy(np.int64)
                    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for start in range(0, len(ids), 1024):
                        s = m[start : start + 1024] @ x.T
                        if distance == "euclidean":
                            s = -np.sqrt(np.maximum((m[start : start + 1024] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * s, 0.0))
                        s = np.round(s, 9)
                        for row, qid in enumerate(ids[start : start + 1024]):
                            own = s[row]
                            # all that could be among the best, ties of the last included
                            cut = np.partition(own, len(own) - k - 1)[len(own) - k - 1] if len(own) > k + 1 else -np.inf
                            near = np.flatnonzero((own >= cut) & (keys != qid))
                            near = near[np.lexsort((keys[near], -own[near]))][:k]
                            found.append((np.full(len(near), qid), keys[near], own[near]))
                    if found:
                        yield pd.DataFrame(dict(zip(("query", "neighbour", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        return rows.mapInPandas(run, "query bigint, neighbour bigint, similarity double")

    found = one_pass(asked if passes == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == 0))
    for n in range(1, passes):
        found = found.unionByName(one_pass(asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == n)))
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n")))), 1, k).alias("_b"))
    return best.select("query", F.posexplode("_b").alias("rank", "_x")).select("query", (F.col("rank") + 1).alias("rank"), F.col("_x.n").alias("neighbour"), (F.abs("_x.s") if distance == "euclidean" else -F.col("_x.s")).alias("similarity"))
