"""Model-like operators over the driver's tables, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import models, possessions as pos, windows
from ..tables import DRIVER_TABLES, table
from .playbyplay import _BASE, _panel
from .training import games

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


@query("""with p as (select l_extendedprice as v, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'R') as b from lineitem where l_returnflag in ('A', 'R') group by 1)
select round(max(d), 7) as ks from (select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as d from p)""")
def ks_two_sample(spark, sf_dir):
    return models.ks_statistic(table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_returnflag"]), "l_extendedprice", "l_returnflag", "A", "R").select(F.round("ks", 7).alias("ks"))


@query("""with t as (select l_suppkey, abs(avg(l_discount) - 0.05) * 10 as p from lineitem group by 1), r as (select l_suppkey, p, p * count(*) over () / (rank() over (order by p) + count(*) over (partition by p) - 1) as raw from t)
select l_suppkey, round(least(1, min(raw) over (order by p desc)), 8) as q from r""")
def false_discovery_rate(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_discount"]).groupBy("l_suppkey").agg((F.abs(F.avg("l_discount") - 0.05) * 10).alias("p"))
    return models.benjamini_hochberg(t, "p").select("l_suppkey", F.round("q", 8).alias("q"))


@query("""with r as (select c_custkey, row_number() over (order by c_acctbal, c_custkey) as r, count(*) over () as n from customer) select c_custkey, greatest(1, ceil(round((r - 1) * 4 / (n - 1), 9)))::int as bin from r""")
def quantile_bins_by_rank(spark, sf_dir):
    return models.quantile_bins(table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]), "c_acctbal", ["c_custkey"], 4).select("c_custkey", "bin")


@query("""with o as (select avg(l_discount) as g from lineitem), a as (select p_size * 3 as x, l_discount as y from lineitem join part on l_partkey = p_partkey),
m as (select x, count(*) as n, (sum(y) + 50 * (select g from o)) / (count(*) + 50) as m from a group by 1), ax as (select unnest(range((select min(x) from m), (select max(x) from m) + 1))::int as x),
j as (select ax.x, coalesce(m.n, 0) as n, m.m, max(case when m.m is not null then ax.x end) over (order by ax.x) as px, min(case when m.m is not null then ax.x end) over (order by ax.x rows between current row and unbounded following) as qx from ax left join m on ax.x = m.x),
v as (select j.x, j.n, case when px = qx then a.m else a.m + (b.m - a.m) * (j.x - px) / (qx - px) end as v from j join m a on a.x = px join m b on b.x = qx)
select x, n, round((2 * v + coalesce(lag(v) over w, 0) + coalesce(lead(v) over w, 0)) / (2 + (lag(v) over w is not null)::int + (lead(v) over w is not null)::int), 8) as mean from v window w as (order by x)""")
def shrunk_age_curve(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem", ["l_partkey", "l_discount"]), table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    a = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("p_size") * 3).alias("x"), F.col("l_discount").alias("y"))
    return models.shrunk_curve(a, "x", "y", 50.0).select("x", "n", F.round("mean", 8).alias("mean"))


@query("""with k as (select l_orderkey, count(*) as n from lineitem group by 1), c as (select d.*, n, row_number() over (partition by d.l_orderkey order by cost, l_linenumber, l_suppkey) as rn from (select distinct l_orderkey, l_linenumber, l_suppkey, abs(l_quantity - 25) as cost from lineitem) d join k on d.l_orderkey = k.l_orderkey),
w as (select a.l_orderkey, a.n, a.l_linenumber, a.l_suppkey, b.cost is null or b.cost - a.cost >= 3 as clear from c a left join c b on a.l_orderkey = b.l_orderkey and b.rn = 2 where a.rn = 1)
select l_orderkey, n, clear, case when clear then l_linenumber end as l_linenumber, case when clear then l_suppkey end as l_suppkey from w""")
def best_candidate_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]).withColumn("cost", F.abs(F.col("l_quantity") - 25))
    return models.best_candidate(li, ["l_orderkey"], "cost", ["l_linenumber", "l_suppkey"], 3.0)


@query("""with p as (select event_id, event_type, """ + ", ".join(f"lead(event_type, {k}) over w as t{k}, lead(event_id, {k}) over w as e{k}" for k in range(1, 9)) + """ from events window w as (partition by user_id order by ts, event_id))
select event_id, case """ + " ".join(f"when t{k} = 'purchase' then e{k}" for k in range(1, 9)) + """ end as recovered from p where event_type = 'click'""")
def forward_scan_8(spark, sf_dir):
    w = windows.ordered(["user_id"], ["ts", "event_id"])
    e = table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    return e.withColumn("recovered", models.first_ahead(F.col("event_id"), F.col("event_type") == "purchase", w, 8)).where("event_type = 'click'").select("event_id", "recovered")


@query(f"""with {_BASE}, b as (select game_id, period, event_num, event_type, t_h, t_a, """ + ", ".join(f"lead(event_type, {k}) over w as t{k}, lead(event_num, {k}) over w as e{k}, lead(period, {k}) over w as p{k}" for k in range(1, 9)) + r""" from tl window w as (partition by game_id order by period, clock desc, event_num))
select lpad(game_id, 10, '0') as game_id, event_num, case """ + " ".join(f"when t{k} = 4 and p{k} = period then e{k}" for k in range(1, 9)) + r""" end as rebound from b where event_type = 2 and regexp_matches(concat_ws(' ', t_h, t_a), '(?i)\bBLOCK\b')""")
def pbp_block_recovery(spark, sf_dir):
    """The rebound that follows a blocked shot within eight events of the same period."""
    rows = pos.timeline(table(spark, sf_dir, "raw_event"))
    w = pos.in_game()
    seen = F.array(*(F.struct(F.lead("event_type", k).over(w).alias("t"), F.lead("event_num", k).over(w).alias("e"), F.lead("period", k).over(w).alias("p")) for k in range(1, 9)))
    hit = F.get(F.filter(seen, lambda x: (x["t"] == pos.REBOUND) & (x["p"] == F.col("period"))), F.lit(0))["e"]
    return rows.withColumn("rebound", hit).where((F.col("event_type") == pos.MISS) & tx.says(F.concat_ws(" ", "t_h", "t_a"), r"\bBLOCK\b")).select("game_id", "event_num", "rebound")


@query(f"""with {_BASE}, e as (select *, coalesce(lag(case event_type when 1 then 'make' when 4 then 'miss' when 5 then 'turnover' when 3 then 'free throw' else 'other' end) over (partition by game_id, period order by clock desc, event_num), 'start') as began,
  sum(points_h + points_a) over (partition by game_id order by period, clock desc, event_num) as total from pf),
d as (select *, total - lag(total, 1, 0) over (partition by game_id order by period, clock desc, event_num) as points from e where eop),
s as (select coalesce(lag(k) over (partition by game_id, period order by clock desc, event_num), 'start') as began, poss_offense, points from (select *, case event_type when 1 then 'make' when 4 then 'miss' when 5 then 'turnover' when 3 then 'free throw' else 'other' end as k from d))
select began, poss_offense, count(*) as possessions, sum(points)::bigint as points, grouping(poss_offense)::bigint as scope from s group by grouping sets ((began, poss_offense), (began), ())""")
def pbp_possession_start_report(spark, sf_dir):
    """Possessions and points by how the one before ended, per side and over all."""
    rows = pos.possessions(pos.terminals(pos.timeline(table(spark, sf_dir, "raw_event"))))
    e = rows.withColumn("total", F.sum(F.col("points_h") + F.col("points_a")).over(pos.so_far())).where("eop")
    kind = F.when(F.col("event_type") == 1, "make").when(F.col("event_type") == 4, "miss").when(F.col("event_type") == 5, "turnover").when(F.col("event_type") == 3, "free throw").otherwise("other")
    e = e.withColumns({"points": F.col("total") - F.lag("total", 1, 0).over(pos.in_game()), "kind": kind})
    w = Window.partitionBy("game_id", "period").orderBy(F.desc("clock"), "event_num")
    s = e.withColumn("began", F.coalesce(F.lag("kind").over(w), F.lit("start"))).select("began", "poss_offense", "points")
    g = s.groupingSets([[s.began, s.poss_offense], [s.began], []], s.began, s.poss_offense)
    return g.agg(F.count("*").alias("possessions"), F.sum("points").cast("bigint").alias("points"), F.grouping("poss_offense").cast("bigint").alias("scope"))


@query(f"""with {_BASE}, gd as (select lpad(regexp_replace(trim(game_id), '\\.0$', ''), 10, '0') as gid, arg_max(game_date, updated_ts) as day from game_metadata where game_id is not null group by 1),
s as (select player1_id, lpad(game_id, 10, '0') as gid, (event_type = 1)::int as made from tl where event_type in (1, 2) and player1_id > 0),
d as (select player1_id, s.gid, day, count(*) as n, sum(made) as m from s join gd on gd.gid = s.gid where day is not null group by 1, 2, 3),
l as (select day, sum(m) as m, sum(n) as n from d group by 1), lg as (select day, sum(m) over w / sum(n) over w as g from l window w as (order by day rows between unbounded preceding and 1 preceding))
select player1_id::bigint as player_id, d.gid as game_id, n, round((coalesce(sum(m) over w, 0) + 40 * coalesce(g, 0.45)) / (coalesce(sum(n) over w, 0) + 40), 7) as talent
from d join lg using (day) window w as (partition by player1_id order by d.day range between unbounded preceding and interval 1 day preceding)""")
def shot_talent_prior_only(spark, sf_dir):
    """Field-goal talent from days strictly before, shrunk to the league's rate of days strictly before as
    if by 40 shots (0.45 where there is none)."""
    dates = games(spark, sf_dir).where("game_date is not null").select("game_id", F.col("game_date").alias("day"))
    s = pos.timeline(table(spark, sf_dir, "raw_event")).where("event_type in (1, 2) and player1_id > 0").select("player1_id", "game_id", (F.col("event_type") == 1).cast("int").alias("made"))
    d = s.join(dates, "game_id").groupBy(F.col("player1_id").alias("player_id"), "game_id", "day").agg(F.count("*").alias("n"), F.sum("made").alias("m"))
    # a row per day, however many games
    league = d.groupBy("day").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    league = league.select("day", F.coalesce(F.sum("m").over(w) / F.sum("n").over(w), F.lit(0.45)).alias("g"))
    own = Window.partitionBy("player_id").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    est = (F.coalesce(F.sum("m").over(own), F.lit(0)) + 40 * F.col("g")) / (F.coalesce(F.sum("n").over(own), F.lit(0)) + 40)
    return d.join(league, "day").select("player_id", "game_id", "n", F.round(est, 7).alias("talent"))


@query("""select name, round(value, 4) as value from (unpivot (select avg(l_quantity) as l_quantity, avg(l_extendedprice) as l_extendedprice, avg(l_discount) as l_discount, avg(l_tax) as l_tax, avg(l_linenumber) as l_linenumber, avg(l_suppkey) as l_suppkey, avg(l_partkey) as l_partkey, avg(l_orderkey) as l_orderkey from lineitem)
on l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_suppkey, l_partkey, l_orderkey into name name value value)""")
def season_intercepts(spark, sf_dir):
    """The mean of every numeric column, whatever they are, one row each."""
    li = table(spark, sf_dir, "lineitem")
    numeric = [c for c, t in li.dtypes if t in ("int", "bigint", "double", "float")]
    return li.agg(*(F.avg(c).alias(c) for c in numeric)).unpivot([], numeric, "name", "value").select("name", F.round("value", 4).alias("value"))


@query("""with m as (select o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::int as m from orders group by 1, 2), g as (select o_custkey, m, lead(m) over (partition by o_custkey order by m) - m - 1 as gap from m)
select o_custkey, (m + k)::int as month_no, k::int as missed from g, lateral (select unnest(range(1, gap + 1)) as k)""")
def absent_streaks(spark, sf_dir):
    """Each month that a customer was away between two orders, with the length of the streak so far."""
    m = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).distinct()
    g = m.withColumn("gap", F.lead("m").over(windows.ordered(["o_custkey"], ["m"])) - F.col("m") - 1).where("gap > 0")
    return g.select("o_custkey", "m", F.explode(F.sequence(F.lit(1), "gap")).alias("missed")).select("o_custkey", (F.col("m") + F.col("missed")).alias("month_no"), "missed")


@query("""select l_orderkey, l_linenumber, round(greatest(l_quantity - 10, 0) / 40, 6) as h1, round(greatest(l_quantity - 30, 0) / 20, 6) as h2, round(greatest(l_quantity - 10, 0) / 40 * l_tax / 0.08, 6) as t1, round(greatest(l_quantity - 30, 0) / 20 * l_tax / 0.08, 6) as t2 from lineitem""")
def tensor_basis(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])
    h = [F.greatest(F.col("l_quantity") - k, F.lit(0.0)) / s for k, s in ((10, 40), (30, 20))]
    return li.select("l_orderkey", "l_linenumber", *(F.round(x, 6).alias(f"h{i}") for i, x in enumerate(h, 1)), *(F.round(x * F.col("l_tax") / 0.08, 6).alias(f"t{i}") for i, x in enumerate(h, 1)))


@query("""with v as (select game_id, home_player1 as p, player1_team_id as t, count(*) as n from raw_event where home_player1 > 0 and player1_id = home_player1 and player1_team_id is not null group by 1, 2, 3)
select game_id, p as player_id, t as team_id, n from v qualify row_number() over (partition by game_id, p order by n desc, t) = 1""")
def team_vote_winners(spark, sf_dir):
    e = table(spark, sf_dir, "raw_event", ["game_id", "home_player1", "player1_id", "player1_team_id"]).where("home_player1 > 0 and player1_id = home_player1 and player1_team_id is not null")
    v = e.groupBy("game_id", F.col("home_player1").alias("player_id"), F.col("player1_team_id").alias("team_id")).agg(F.count("*").alias("n"))
    best = v.groupBy("game_id", "player_id").agg(F.max(F.struct("n", (-F.col("team_id")).alias("t"))).alias("b"))
    return best.select("game_id", "player_id", (-F.col("b.t")).alias("team_id"), F.col("b.n").alias("n"))


@query("""with a as (select distinct player_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower(player_name)), 'ł', 'l'), 'ø', 'o'), 'đ', 'd'), 'ı', 'i'), 'ð', 'd'), 'ħ', 'h'), 'ŧ', 't'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '[^a-z0-9]+', ' ', 'g')) as k from player_rating_history where player_name is not null),
b as (select distinct player_id as epm_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower(player_name)), 'ł', 'l'), 'ø', 'o'), 'đ', 'd'), 'ı', 'i'), 'ð', 'd'), 'ħ', 'h'), 'ŧ', 't'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '[^a-z0-9]+', ' ', 'g')) as k from epm_snapshot where player_name is not null),
ua as (select k, min(player_id) as player_id from a group by 1 having count(*) = 1), ub as (select k, min(epm_id) as epm_id from b group by 1 having count(*) = 1) select k as name_key, player_id, epm_id from ua join ub using (k)""")
def fuzzy_identity_join(spark, sf_dir):
    """Players of two sources matched by folded name, where the name is one player's in both."""

    def unique(name: str, out: str) -> DataFrame:
        d = table(spark, sf_dir, name, ["player_id", "player_name"]).where("player_name is not null").select("player_id", tx.fold_name(F.col("player_name")).alias("name_key")).distinct()
        return d.groupBy("name_key").agg(F.count("*").alias("n"), F.min("player_id").alias(out)).where("n = 1").drop("n")

    return unique("player_rating_history", "player_id").join(unique("epm_snapshot", "epm_id"), "name_key").select("name_key", "player_id", "epm_id")


@query("select name, n from (" + " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in DRIVER_TABLES) + ")")
def registry_inventory(spark, sf_dir):
    """A table of the tables: how many rows each has."""
    counts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in DRIVER_TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("select customer_only, supplier_only from (select 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' as customer_only, 's_acctbal,s_name,s_nationkey,s_suppkey' as supplier_only)")
def column_set_difference(spark, sf_dir):
    a, b = set(table(spark, sf_dir, "customer").columns), set(table(spark, sf_dir, "supplier").columns)
    return spark.range(1).select(F.lit(",".join(sorted(a - b))).alias("customer_only"), F.lit(",".join(sorted(b - a))).alias("supplier_only"))


@query("""with p as (select game_id || ':' || team_id as side, player_id, max(minutes) as minutes from player_game where team_id is not null and player_id is not null and game_id is not null group by 1, 2),
w as (select side, player_id, greatest(coalesce(minutes, 0), 0)::double as w from p), r as (select *, count(*) over (partition by side) as n, row_number() over (partition by side order by w desc, player_id) as k, sum(w) over (partition by side) as total,
  sum(w) over (partition by side order by w desc, player_id rows between unbounded preceding and 1 preceding) as above from w),
-- with k - 1 at the cap, the others share the rest in proportion: the first k at which the greatest of them fits
s as (select *, case when total > 0 then (least(240, 42 * n) - 42 * (k - 1)) / nullif(total - coalesce(above, 0), 0) end as slope from r), f as (select side, min(k) filter (where slope * w <= 42 + 1e-9) as k0 from s group by 1)
select s.side, s.player_id, round(case when 42 * n <= 240 then 42 when total <= 0 then least(42, 240.0 / n) when s.k < k0 then 42 when k0 is not null then w * (select slope from s x where x.side = s.side and x.k = k0) else 42 end, 6) as share from s join f using (side)""")
def capped_minutes(spark, sf_dir):
    """240 minutes of a team's game shared by earlier minutes, nobody above 42."""
    p = table(spark, sf_dir, "player_game", ["game_id", "team_id", "player_id", "minutes"]).where("team_id is not null and player_id is not null and game_id is not null")
    p = p.groupBy(F.concat_ws(":", "game_id", "team_id").alias("side"), "player_id").agg(F.max("minutes").alias("minutes")).withColumn("cap", F.lit(42.0))
    return models.capped_shares(p, "side", "player_id", "minutes", "cap", 240.0).withColumn("share", F.round("share", 6))


@query()
def ridge_alpha_by_folds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber", "l_discount"])
    f = F.array(F.struct(F.concat(F.lit("s"), F.col("l_suppkey")).alias("f"), F.lit(1.0).alias("v")), F.struct(F.concat(F.lit("n"), F.col("l_linenumber")).alias("f"), F.lit(1.0).alias("v")))
    rows = li.select(f.alias("x"), F.lit(1.0).alias("w"), (F.col("l_discount") - 0.05).alias("y"), F.pmod(F.xxhash64("l_orderkey"), F.lit(5)).alias("fold"))
    return models.ridge_by_folds(rows, features="x", weight="w", target="y", fold="fold", alphas=[300.0, 1000.0, 3000.0])


@query()
def cluster_embeddings(spark, sf_dir):
    """k-means on scaled vectors, with each vector's cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).where("embedding is not null").withColumn("features", array_to_vector("embedding"))
    return KMeans(k=8, seed=7, maxIter=10).fit(e.select("features")).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def logistic_scores(spark, sf_dir):
    """Make or miss by shot kind and distance: calibrated probability of each shot."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = pos.shot_flags(pos.timeline(table(spark, sf_dir, "raw_event"))).where("event_type in (1, 2)")
    feet = F.coalesce(F.nullif(F.regexp_extract(F.concat_ws(" ", "t_h", "t_a"), r"(\d+)'", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    x = rows.select("game_id", "event_num", (F.col("event_type") == 1).cast("double").alias("label"), feet.alias("feet"), F.col("is_three").cast("double").alias("three"), F.col("is_rim").cast("double").alias("rim"))
    x = VectorAssembler(inputCols=["feet", "three", "rim"], outputCol="features").transform(x)
    m = LogisticRegression(maxIter=20, regParam=0.01).fit(x)
    from pyspark.ml.functions import vector_to_array

    return m.transform(x).select("game_id", "event_num", F.col("label").cast("int").alias("made"), F.round(vector_to_array("probability")[1], 6).alias("p"))
