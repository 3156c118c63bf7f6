"""Range-wise ranks, streaming recurrences, the solver's two ways, promotion, and small scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playledger import contracts
from playledger.operators import estimate, models, ranks, sequences, tables
from playledger.operators.models import quantile_bins, series_chances, series_win_probability
from playledger.sources import publish


def test_running_totals_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 5])) for _ in range(3000)]
    got = ranks.running(spark.createDataFrame(rows, "k int, v int").repartition(7), ["k"], {"t": "v", "n": F.lit(1)}).collect()
    last = {}
    for r in got:
        last[r.k] = max(last.get(r.k, (0, 0)), (r.t, r.n))
    total = n = 0
    for k in sorted(last, key=lambda x: (x is not None, x)):
        total += sum(v or 0 for a, v in rows if a == k)
        n += sum(a == k for a, _ in rows)
        assert last[k] == (total, n)
    assert ranks.numbered(spark.createDataFrame([], "k int"), ["k"]).count() == 0
    assert sorted(r["rank"] for r in ranks.numbered(spark.createDataFrame([(1,)] * 50, "k int"), ["k"]).collect()) == list(range(1, 51))
    bins = quantile_bins(spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, v int"), "v", ["k"], 3)
    assert sorted(bins.groupBy("bin").count().collect()) == [(1, 3), (2, 3), (3, 3)]


def test_along_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(k, i, float(i)) for k in ("a", None, "b") for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v double")

    def step(total, pdf):
        sums = total + pdf["v"].cumsum()
        return float(sums.iloc[-1]), {"s": sums}

    got = {(r.k, r.i): r.s for r in sequences.along(df, ["k"], ["i"], lambda: 0.0, step, "s double").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 150 and all(got[k, i] == i * (i + 1) / 2 for k, i in got)
    log = publish.chain(df.withColumn("n", F.col("i").cast("long")), ["k"], ["i"], F.col("v").cast("string"))
    assert publish.broken_links(log, ["k"], ["i"], F.col("v").cast("string")).count() == 0
    changed = log.withColumn("v", F.when(F.col("i") == 7, -1.0).otherwise(F.col("v")))
    assert {(r.k, r.i) for r in publish.broken_links(changed, ["k"], ["i"], F.col("v").cast("string")).collect()} == {("a", 7), (None, 7), ("b", 7)}


def design(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = [[(int(f), 1.0) for f in sorted(rng.choice(12, 3, replace=False))] + [(99, 1.0)] for _ in range(n)]
    y, w = rng.normal(size=n), rng.uniform(0.5, 2, size=n)
    rows = spark.createDataFrame([(a, float(b), float(c)) for a, b, c in zip(x, w, y, strict=True)], "x array<struct<f:int,v:double>>, w double, y double")
    names = sorted({f for a in x for f, _ in a})
    m = np.zeros((n, len(names)))
    for i, a in enumerate(x):
        for f, v in a:
            m[i, names.index(f)] = v
    return rows, names, m, w, y


def test_ridge_with_own_penalties_prior_and_free_columns(spark):
    rows, names, m, w, y = design(spark)
    own, prior = {f: (20.0 if f % 2 else 5.0) for f in names}, {3: 0.5}
    penalty = np.diag([0.0 if f == 99 else own[f] for f in names])
    centre = np.array([prior.get(f, 0.0) for f in names])
    want = np.linalg.solve(m.T @ (m * w[:, None]) + penalty, m.T @ (w * y) + penalty @ centre)
    for dense in (6000, 3):
        got = estimate.ridge(rows, features="x", weight="w", target="y", alpha=1.0, penalties=own, prior=prior, free=[99], dense=dense)
        assert np.allclose([got[f] for f in names], want, atol=1e-7)
    with pytest.raises(ValueError):
        estimate.ridge(rows, features="x", weight="w", target="y", alpha=1.0, dense=3, errors=True)


def test_alphas_over_folds_both_ways(spark):
    rows, names, m, w, y = design(spark, seed=4)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("y"), F.lit(3)))
    fold = np.array([r.fold for r in rows.select("fold").collect()])
    got = {dense: {r.alpha: r.mse for r in models.ridge_by_folds(rows, features="x", weight="w", target="y", fold="fold", alphas=[2.0, 50.0], dense=dense).collect()} for dense in (6000, 2)}
    for alpha in (2.0, 50.0):
        e = 0.0
        for k in range(3):
            t = fold != k
            beta = np.linalg.solve(m[t].T @ (m[t] * w[t, None]) + alpha * np.eye(len(names)), m[t].T @ (w[t] * y[t]))
            e += (w[~t] * (y[~t] - m[~t] @ beta) ** 2).sum()
        assert all(abs(g[alpha] - e / w.sum()) < 1e-8 for g in got.values())


def test_standard_errors(spark):
    rows, names, m, w, y = design(spark, seed=2)
    got = estimate.ridge(rows, features="x", weight="w", target="y", alpha=1.0, errors=True)
    gram = m.T @ (m * w[:, None]) + np.eye(len(names))
    beta = np.linalg.solve(gram, m.T @ (w * y))
    assert np.allclose([got[f][0] for f in names], beta, atol=1e-8) and all(d > 0 for _, d in got.values())
    flat = spark.createDataFrame([(float(a), float(2 * a + 1)) for a in range(9)], "x double, y double")
    terms = {r.term: (round(r.estimate, 9), round(r.std_error, 6)) for r in estimate.regression(flat, ["x"], "y").collect()}
    assert terms == {"intercept": (1.0, 0.0), "x": (2.0, 0.0)}
    assert estimate.regression(flat.limit(0), ["x"], "y").count() == 0


def test_day_filter_query_rows_and_expiry(spark):
    rows = [("a", "2024-01-01", 0, 1.0, False, 1), ("a", "2024-01-01", 1, 3.0, False, 1), ("a", "2024-01-05", 2, 9.0, True, 1), ("a", "2024-01-05", 3, None, False, 1), ("a", "2025-06-01", 4, 1.0, False, 2), ("a", None, 5, 1.0, False, 1)]
    df = spark.createDataFrame(rows, "k string, d string, n int, y double, ask boolean, season int").withColumn("d", F.to_date("d")).withColumn("e", F.lit(1.0))
    got = {r.n: (round(r.pre_mean, 6), round(r.pre_var, 6)) for r in estimate.day_filter(df, by=["k"], day="d", tie=["n"], value="y", exposure="e", query_only="ask", season="season", prior_mean=0.0, prior_var=4.0, q_day=0.1, q_season=1.0, r=2.0, expire_days=365).collect()}
    v = 1 / (1 / 4 + 2 / 2)
    assert got[0] == got[1] == got[5] == (0.0, 4.0)
    assert got[2] == got[3] == (round(v * (4 / 2), 6), round(v + 0.4, 6))
    assert got[4] == (0.0, 4.0)


def test_promotion_and_grants(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    for d in (a, b, a):
        publish.promote(spark, str(tmp_path), "t", *publish.publish(d, ["k"]))
    assert publish.promoted(spark, str(tmp_path), "t").count() == 1 and len(publish.history(spark, str(tmp_path), "t")) == 3
    with pytest.raises(contracts.ContractError):
        publish.promoted(spark, str(tmp_path), "none")
    grants = spark.createDataFrame([("r", 2), ("r", 2)], "role string, k int")
    assert [r.v for r in publish.visible(b, grants, role="r", on=["k"]).collect()] == ["z"] and publish.visible(b, grants, role="q", on=["k"]).count() == 0


def test_guards_and_forms(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(contracts.ContractError):
        tables.guarded_join(left, right, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(left, right, ["k"])
    assert tables.joined_with_suffix(right, right, ["k"], "_b").columns == ["k", "v", "v_b"]
    text = spark.createDataFrame([("['a', 'b']",), ('["c"]',), ("[",), (None,), ("",), ("[]",)], "t string")
    assert [r[0] for r in text.select(tables.literal_list(F.col("t"))).collect()] == [["a", "b"], ["c"], None, None, None, []]
    z = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "z double")
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / 2**0.5))) < 2e-7 for r in z.select("z", tables.normal_cdf(F.col("z")).alias("p")).collect())
    p = spark.createDataFrame([(0.6, 0.4)], "h double, a double").select(series_chances(F.col("h"), F.col("a")).alias("p")).first().p
    assert abs(p - series_win_probability(0.6, 0.4)) < 1e-12
