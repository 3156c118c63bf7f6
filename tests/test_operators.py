"""Relational operators, contracts, estimation and sources on small input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playledger import contracts
from playledger.functions import text as tx
from playledger.operators import estimate, joins, stats, windows
from playledger.sources import files, publish


def test_asof_null_state_is_kept_and_keys_with_nulls_match_nothing(spark):
    left = spark.createDataFrame([(1, 10, 0), (1, 5, 1), (None, 10, 2), (2, None, 3)], "k int, t int, id int")
    right = spark.createDataFrame([(1, 5, 7.0), (1, 8, None), (None, 1, 1.0)], "k int, t int, v double")
    got = {r.id: (r.v, r._at) for r in joins.asof_join(left, right, left_on="t", right_on="t", by=["k"], values=["v"]).collect()}
    assert got == {0: (None, 8), 1: (7.0, 5), 2: (None, None), 3: (None, None)}
    strict = {r.id: r._at for r in joins.asof_join(left, right, left_on="t", right_on="t", by=["k"], values=["v"], strict=True).collect()}
    assert strict == {0: 8, 1: None, 2: None, 3: None}


def test_interval_join_is_half_open(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 25.0)], "k int, t double")
    s = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 10.0, 30.0, "b"), (1, 5.0, 5.0, "empty")], "k int, s double, e double, n string")
    got = sorted((r.t, r.n) for r in joins.interval_join(p, s, at="t", start="s", end="e", by=["k"], width=4.0).collect())
    assert got == [(0.0, "a"), (10.0, "b"), (25.0, "b")]


def test_ahead_count_gives_zero_in_the_last_rows(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(7)], "g int, i int, f boolean")
    w = windows.ordered(["g"], ["i"])
    got = [r.n for r in df.select("i", windows.ahead_count(F.col("f"), w, 5).alias("n")).orderBy("i").collect()]
    assert got == [3, 2, 3, 0, 0, 0, 0]


def test_ambiguous_payloads_become_null(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    got = {r.k: (r.status, r.v) for r in windows.dedupe_ambiguous(df, ["k"], ["v"]).collect()}
    assert got == {1: ("duplicate", "a"), 2: ("ambiguous", None), 3: ("unique", None)}


def test_unordered_pairs(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (1, 2), (2, 9)], "g int, m int")
    assert sorted((r.a, r.b) for r in joins.unordered_pairs(df, ["g"], "m").collect()) == [(1, 2), (1, 3), (2, 3)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (None, 1)], "p double, y int")
    assert stats.auc(df, "p", "y").first().auc == pytest.approx(0.875)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (1, 5.0, 2.0, 3.0)], "k int, w double, a double, b double")
    contracts.expect_closure(df, "w", ["a", "b"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_unique(df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_columns(df, ["missing"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_closure(df, "w", ["a"])
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(df, df.select("k"), ["k"])


def test_ridge_equals_dense_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (60, 5)).astype(float)
    y, w = rng.normal(size=60), rng.uniform(0.5, 2, 60)
    rows = [([(j, float(x[i, j])) for j in range(5) if x[i, j]], float(w[i]), float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<struct<f:int,v:double>>, w double, y double")
    prior = {0: 0.3, 2: -0.1}
    got = estimate.ridge(df, features="x", weight="w", target="y", alpha=3.0, prior=prior, free=[4])
    pen = np.diag([3.0, 3.0, 3.0, 3.0, 0.0])
    m = np.array([prior.get(j, 0.0) for j in range(5)])
    want = np.linalg.solve(x.T @ (w[:, None] * x) + pen, x.T @ (w * y) + pen @ m)
    assert np.allclose([got[j] for j in range(5)], want)


def test_kalman_does_not_look_ahead(spark):
    rows = [("a", i, float(i % 3), 1.0, None if i == 0 else 2.0) for i in range(9)]
    schema = "k string, i int, y double, e double, gap double"

    def run(part):
        df = spark.createDataFrame(part, schema)
        got = estimate.kalman(df, key="k", order=["i"], value="y", exposure="e", gap_days="gap", prior_var=1.0, q_game=0.1, q_day=0.01, r=2.0)
        return {r.i: (r.pre_mean, r.post_mean, r.post_var) for r in got.collect()}

    whole, part = run(rows), run(rows[:5])
    assert all(whole[i] == part[i] for i in part)


def test_publication_is_content_addressed(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2.0)], "k int, v string, n double")
    b = spark.createDataFrame([(2, "y", 2.0), (1, "x", None)], "k int, v string, n double")
    c = spark.createDataFrame([(2, "y", 2.0), (1, "x", 0.0)], "k int, v string, n double")
    ids = [publish.publish(d, ["k"])[1].first().version_id for d in (a, b, c)]
    assert ids[0] == ids[1] != ids[2]
    with pytest.raises(contracts.ContractError):
        publish.publish(a, ["k"], least=3)


def test_chain_and_broken_links(spark):
    log = spark.createDataFrame([("g", i, f"r{i}") for i in range(5)], "k string, i int, body string")
    good = publish.chain(log, ["k"], ["i"], F.col("body"))
    assert publish.broken_links(good, ["k"], ["i"], F.col("body")).count() == 0
    bad = good.withColumn("body", F.when(F.col("i") == 2, "changed").otherwise(F.col("body")))
    assert [r.i for r in publish.broken_links(bad, ["k"], ["i"], F.col("body")).collect()] == [2]


def test_append_and_upsert_with_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "m")], "k int, v string")
    assert {(r.k, r.v) for r in files.append_new(old, new, ["k"], order=["v"]).collect()} == {(2, "d")}
    assert {(r.k, r.v) for r in files.upsert(old, new.where("v != 'c'"), ["k"]).collect()} == {(1, "b"), (2, "d"), (None, "m")}


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "k int, v string")
    files.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", "k int, v string").collect())) == [(1, 'a "q", b'), (2, None)]
    files.write_json(df, f"{tmp_path}/j")
    assert files.read_json_lines(spark, f"{tmp_path}/j", "k int, v string").count() == 2
    files.write_parquet(df, f"{tmp_path}/p")
    files.write_parquet(df.withColumn("extra", F.lit(1)), f"{tmp_path}/q")
    both = files.read_parquet(spark, [f"{tmp_path}/p", f"{tmp_path}/q"])
    assert set(both.columns) == {"k", "v", "extra"} and both.count() == 4 and files.columns_of(spark, f"{tmp_path}/p") == ["k", "v"]


def test_text_builders(spark):
    rows = [("11:05", "22500001.0", "Élan D'Åre-Žić"), ("PT01M02.50S", " 0022500001 ", ""), ("x", "12345678901", None), (None, None, "A")]
    df = spark.createDataFrame(rows, "c string, g string, n string")
    got = df.select(tx.clock_seconds(F.col("c")).alias("c"), tx.game_id(F.col("g")).alias("g"), tx.fold_name(F.col("n")).alias("n"), tx.says(F.col("n"), "élan").alias("s")).collect()
    assert [r.c for r in got] == [665.0, 62.5, None, None]
    assert [r.g for r in got] == ["0022500001", "0022500001", "12345678901", None]
    assert [r.n for r in got] == ["elan d are zic", "", None, "a"] and [r.s for r in got] == [True, False, False, False]
    assert df.select(tx.season_label(F.lit(2026)).alias("s"), tx.four_digit_year(F.lit(97)).alias("y")).first() == ("2025-26", 1997)


@pytest.mark.parametrize("most", [100, 3])
def test_nearest_in_blocks_equals_brute_force(spark, most):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[40:50] = x[0]  # ties and repeated rows
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(90)] + [(None, [1.0] * 4, "z"), (500, None, "z")]
    df = spark.createDataFrame(rows, "id long, v array<double>, query string").repartition(3)
    got = estimate.blocks_topk(df, df.where("id % 10 = 0"), key="id", vector="v", k=5, block=16, most_queries=most).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {}
    for q in range(0, 90, 10):
        s = np.round(u @ u[q], 9)
        want[q] = [j for j in np.lexsort((np.arange(90), -s)) if j != q][:5]
    have = {}
    for r in sorted(got, key=lambda r: (r.query, r.rank)):
        have.setdefault(r.query, []).append(r.neighbour)
    assert have == want


def test_model_operators(spark):
    from playledger.operators import models

    df = spark.createDataFrame([("t", "a", 30.0, 20.0), ("t", "b", 10.0, 42.0), ("t", "c", None, 42.0)], "t string, p string, w double, c double")
    got = {r.p: round(r.share, 6) for r in models.capped_shares(df, "t", "p", "w", "c", 50.0).collect()}
    assert got == {"a": 20.0, "b": 30.0, "c": 0.0}
    assert models.series_win_probability(0.5, 0.5) == pytest.approx(0.5) and models.series_win_probability(1.0, 1.0) == 1.0
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    q = {r.i: r.q and round(r.q, 6) for r in models.benjamini_hochberg(t, "p").collect()}
    assert q == {1: 0.03, 2: 0.04, 3: 0.04, 4: None}
    b = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    assert sorted(r.bin for r in models.quantile_bins(b, "v", ["i"], 4).collect()) == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4]
