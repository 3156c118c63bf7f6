"""Estimation, filters and streams over the domain tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimate, possessions as pos
from ..operators.sequences import along
from ..session import ensure_checkpoint_dir
from ..streaming import pipelines
from ..tables import table
from .playbyplay import _BASE, _SKILL, _panel, _rows
from .products import _folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


@query(f"""with {_BASE} select poss_offense, count(*) as events, sum(points_h + points_a)::bigint as points,
round(sum(case when event_type = 3 or regexp_matches(concat_ws(' ', t_h, t_a), '(?i)Free Throw') then 0.75 when event_type = 1 and regexp_matches(concat_ws(' ', t_h, t_a), '(?i)PTS') and not regexp_matches(concat_ws(' ', t_h, t_a), '(?i)3PT') then 2
 when regexp_matches(concat_ws(' ', t_h, t_a), '(?i)3PT') then points_h + points_a else 0 end), 4) as throws_adjusted,
round(sum(case when event_type = 3 or regexp_matches(concat_ws(' ', t_h, t_a), '(?i)Free Throw') then 0.75 when event_type = 1 and regexp_matches(concat_ws(' ', t_h, t_a), '(?i)PTS') and not regexp_matches(concat_ws(' ', t_h, t_a), '(?i)3PT') then 2
 when regexp_matches(concat_ws(' ', t_h, t_a), '(?i)3PT') then 0.5 * 1.05 + 0.5 * (points_h + points_a) else 0 end), 4) as half_adjusted from pf group by 1""")
def pbp_luck_adjusted(spark, sf_dir):
    """Points with free throws at their expected rate, and with threes half at theirs too."""
    rates = spark.createDataFrame([], "player_id bigint, ft_rate double, three_rate double")
    v = pos.luck_adjusted(pos.possessions(_rows(spark, sf_dir)), rates, share_off=0.5, share_def=0.5)
    return v.groupBy("poss_offense").agg(F.count("*").alias("events"), F.sum(F.col("points_h") + F.col("points_a")).cast("bigint").alias("points"), F.round(F.sum("value"), 4).alias("throws_adjusted"), F.round(F.sum("value_off"), 4).alias("half_adjusted"))


@query(f"""with recursive {_SKILL[len('with '):]},
s as (select player_id, gid as game_id, game_date, three_fga / nullif(off_poss, 0)::double as y, coalesce(off_poss, 0)::double as e, coalesce(datediff('day', lag(game_date) over w, game_date), 0) as gap, row_number() over w as rn from one window w as (partition by player_id order by game_date nulls first, gid)),
k as (select player_id, game_id, game_date, rn, 0.0::double as pm, 0.01::double as pv, y, e from s where rn = 1
 union all select s.player_id, s.game_id, s.game_date, s.rn, case when k.y is not null and k.e > 0 then k.pm + k.pv / (k.pv + 0.1 / k.e) * (k.y - k.pm) else k.pm end,
  (case when k.y is not null and k.e > 0 then (1 - k.pv / (k.pv + 0.1 / k.e)) * k.pv else k.pv end) + 1e-4 + 1e-6 * s.gap, s.y, s.e from k join s on s.player_id = k.player_id and s.rn = k.rn + 1)
select player_id, game_date, game_id, round(pm, 8) as pre_mean, round(pv, 8) as pre_var, round(case when y is not null and e > 0 then pm + pv / (pv + 0.1 / e) * (y - pm) else pm end, 8) as post_mean,
 round(case when y is not null and e > 0 then (1 - pv / (pv + 0.1 / e)) * pv else pv end, 8) as post_var from k""")
def skill_filter(spark, sf_dir):
    """Scalar Kalman filter of three-point attempts per possession, per player over games."""
    p = _panel(spark, sf_dir)
    w = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    p = p.withColumns({"rate": F.try_divide(F.col("three_fga").cast("double"), F.col("off_poss")), "exposure": F.coalesce(F.col("off_poss"), F.lit(0)).cast("double"), "gap": F.datediff("game_date", F.lag("game_date").over(w)).cast("double")})
    got = estimate.kalman(p, key="player_id", order=["game_date", "game_id"], value="rate", exposure="exposure", gap_days="gap", prior_var=0.01, q_game=1e-4, q_day=1e-6, r=0.1)
    return got.withColumns({c: F.round(c, 8) for c in ("pre_mean", "pre_var", "post_mean", "post_var")})


_SKILL_TWO = f"""with recursive {_SKILL[len('with '):]},
s as (select player_id, gid as game_id, game_date, pts / nullif(off_poss, 0)::double as y, coalesce(off_poss, 0)::double as e, coalesce(datediff('day', lag(game_date) over w, game_date), 0) as gap, row_number() over w as rn from one window w as (partition by player_id order by game_date nulls first, gid)),
p as (select player_id, game_id, game_date, rn, y, e, 0.0::double as m1, 0.0::double as m2, 0.02::double as a, 0.0::double as b, 0.01::double as c from s where rn = 1
 union all select player_id, game_id, game_date, rn, y, e, u1, f * u2, ua + 1e-5 * gap, f * ub, f * f * uc + 0.01 * (1 - f * f) from (
  select s.player_id, s.game_id, s.game_date, s.rn, s.y, s.e, s.gap, 0.5 ** (s.gap / 20.0) as f,
   case when ok then m1 + (a + b) / v * (p.y - m1 - m2) else m1 end as u1, case when ok then m2 + (b + c) / v * (p.y - m1 - m2) else m2 end as u2,
   case when ok then a - (a + b) * (a + b) / v else a end as ua, case when ok then b - (a + b) * (b + c) / v else b end as ub, case when ok then c - (b + c) * (b + c) / v else c end as uc
  from (select *, y is not null and e > 0 as ok, a + 2 * b + c + 0.5 / nullif(e, 0) as v from p) p join s on s.player_id = p.player_id and s.rn = p.rn + 1))
select player_id, game_date, game_id, round(case when y is not null and e > 0 then m1 + (a + b) / (a + 2 * b + c + 0.5 / e) * (y - m1 - m2) else m1 end, 8) as level,
 round(case when y is not null and e > 0 then m2 + (b + c) / (a + 2 * b + c + 0.5 / e) * (y - m1 - m2) else m2 end, 8) as swing from p"""


@query(_SKILL_TWO)
def skill_two_part_filter(spark, sf_dir):
    """A level that drifts and a swing that decays, per player over games."""
    from ..operators import models

    p = _panel(spark, sf_dir)
    w = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    p = p.withColumns({"rate": F.try_divide(F.col("pts").cast("double"), F.col("off_poss")), "exposure": F.coalesce(F.col("off_poss"), F.lit(0)).cast("double"), "gap": F.datediff("game_date", F.lag("game_date").over(w)).cast("double")})
    got = models.ou_filter(p, key="player_id", order=["game_date", "game_id"], value="rate", exposure="exposure", gap_days="gap", level_var=0.02, level_q=1e-5, swing_var=0.01, half_life=20.0, r=0.5)
    return got.withColumns({c: F.round(c, 8) for c in ("level", "swing")})


_GAME = """gm as (select * from (select lpad(regexp_replace(trim(game_id), '\\.0$', ''), 10, '0') as gid, * from game_metadata) where game_id is not null qualify row_number() over (partition by gid order by updated_ts desc nulls last, tipoff_utc desc nulls last, game_date desc nulls last, home_score desc, away_score desc) = 1),
tp as (select home_team_id as team_id, season_type, home_score as pts, away_score as opp from gm union all select away_team_id, season_type, away_score, home_score from gm)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, season_type, pts, opp: two rows per game of its latest metadata."""
    g = table(spark, sf_dir, "game_metadata", ["game_id", "game_date", "tipoff_utc", "season_type", "home_team_id", "away_team_id", "home_score", "away_score", "updated_ts"])
    one = g.where("game_id is not null").groupBy(pos.game_id(F.col("game_id")).alias("gid")).agg(F.max(F.struct("updated_ts", "tipoff_utc", "game_date", "home_score", "away_score", "season_type", "home_team_id", "away_team_id")).alias("g"))
    sides = F.array(F.struct(F.col("g.home_team_id").alias("team_id"), F.col("g.home_score").alias("pts"), F.col("g.away_score").alias("opp")), F.struct(F.col("g.away_team_id").alias("team_id"), F.col("g.away_score").alias("pts"), F.col("g.home_score").alias("opp")))
    return one.select(F.col("g.season_type").alias("season_type"), F.explode(sides).alias("s")).select("s.team_id", "season_type", "s.pts", "s.opp")


@query(f"""with {_GAME}, c as (select avg(pts) as m from tp where season_type = 'RS'), rs as (select team_id, sum(pts - m) / (count(*) + 4.0) as prior from tp, c where season_type = 'RS' group by 1),
ps as (select team_id, count(*) as n, sum(pts - m) as s from tp, c where season_type = 'PS' group by 1)
select team_id, round(rs.prior, 6) as regular, round((coalesce(s, 0) + 8 * rs.prior) / (coalesce(n, 0) + 8), 6) as playoffs from rs left join ps using (team_id)""")
def two_stage_prior(spark, sf_dir):
    """Teams' scoring by ridge in the regular season, then in the playoffs centred on it."""
    t = _scores(spark, sf_dir)
    mean = t.where("season_type = 'RS'").agg(F.avg("pts")).scalar()
    x = F.array(F.struct(F.col("team_id").alias("f"), F.lit(1.0).alias("v")))
    rows = {k: t.where(F.col("season_type") == k).select(x.alias("x"), F.lit(1.0).alias("w"), (F.col("pts") - mean).alias("y")) for k in ("RS", "PS")}
    regular = estimate.ridge(rows["RS"], features="x", weight="w", target="y", alpha=4.0)
    later = estimate.ridge(rows["PS"], features="x", weight="w", target="y", alpha=8.0, prior=regular)
    return spark.createDataFrame([(int(k), round(v, 6), round(later.get(k, v), 6)) for k, v in regular.items()], "team_id bigint, regular double, playoffs double")


@query(f"""{_SKILL}, o as (select season, avg(pts) as base from one group by 1), y as (select player_id, pts - base as y from one join o using (season)) select player_id, count(*) as n, round(sum(y) / (count(*) + 10.0), 6) as beyond from y group by 1""")
def fixed_offsets(spark, sf_dir):
    """Players' points beyond the mean of the season, shrunk as by ten games."""
    p = table(spark, sf_dir, "player_game", ["player_id", "game_id", "season", "pts", "loaded_ts"]).withColumn("gid", pos.game_id(F.col("game_id"))).where("player_id is not null and gid is not null")
    one = p.groupBy("player_id", "gid").agg(F.max_by(F.struct("season", "pts"), F.coalesce("loaded_ts", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r")).select("player_id", "r.*")
    base = one.groupBy("season").agg(F.avg("pts").alias("base"))
    return one.join(base, "season").groupBy("player_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("pts") - F.col("base")) / (F.count("*") + 10.0), 6).alias("beyond"))


@query(f"""with {_BASE}, r as (select player1_id as p, avg((event_type = 1)::int) as rate from tl where event_type in (1, 2) and player1_id > 0 group by 1),
t as (select game_id, event_num, unnest(list_distinct(list_filter([home_player1, home_player2, home_player3, home_player4, home_player5], lambda x: x > 0))) as p from pf where eop),
s as (select game_id, event_num, sum(coalesce(rate, 0)) as strength from t left join r using (p) group by 1, 2) select case when strength > 2.5 then 'high' when strength > 2.0 then 'middle' else 'low' end as bucket, count(*) as n, round(avg(strength), 6) as strength from s group by 1""")
def lineup_strength_buckets(spark, sf_dir):
    """Possessions by the summed rating of the home side's lineup."""
    rows = pos.possessions(_rows(spark, sf_dir))
    rate = rows.where("event_type in (1, 2) and player1_id > 0").groupBy(F.col("player1_id").alias("p")).agg(F.avg((F.col("event_type") == 1).cast("int")).alias("rate"))
    t = rows.where("eop").select("game_id", "event_num", F.explode(F.filter("l_h", lambda x: x > 0)).alias("p")).join(rate, "p", "left")
    s = t.groupBy("game_id", "event_num").agg(F.sum(F.coalesce("rate", F.lit(0.0))).alias("strength"))
    bucket = F.when(F.col("strength") > 2.5, "high").when(F.col("strength") > 2.0, "middle").otherwise("low")
    return s.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("strength"))


@query()
def team_ridge(spark, sf_dir):
    """Margins by team indicators, home 1 and away -1, with a free home column and standard errors."""
    g = table(spark, sf_dir, "game_metadata", ["game_id", "home_team_id", "away_team_id", "home_score", "away_score", "updated_ts"])
    one = g.where("game_id is not null").groupBy(pos.game_id(F.col("game_id")).alias("gid")).agg(F.max(F.struct("updated_ts", "home_team_id", "away_team_id", "home_score", "away_score")).alias("g")).select("g.*").where("home_score is not null and away_score is not null")
    x = F.array(F.struct(F.lit(0).cast("bigint").alias("f"), F.lit(1.0).alias("v")), F.struct(F.col("home_team_id").alias("f"), F.lit(1.0).alias("v")), F.struct(F.col("away_team_id").alias("f"), F.lit(-1.0).alias("v")))
    rows = one.select(x.alias("x"), F.lit(1.0).alias("w"), (F.col("home_score") - F.col("away_score")).cast("double").alias("y"))
    got = estimate.ridge(rows, features="x", weight="w", target="y", alpha=5.0, free=[0], errors=True)
    return spark.createDataFrame([(int(k), round(b, 6), round(e, 6)) for k, (b, e) in got.items()], "team_id bigint, rating double, std_error double")


_GRID = [(0.1, 50.0), (1.0, 50.0), (10.0, 50.0), (1.0, 400.0)]


@query(f"""with recursive gr as (select unnest([{', '.join(str(q) for q, _ in _GRID)}]::double[]) as q, unnest([{', '.join(str(r) for _, r in _GRID)}]::double[]) as r), e as (select user_id, value as y, row_number() over (partition by user_id order by ts, event_id) as rn from events where value is not null),
k as (select q, r, user_id, rn, 0.0::double as m, (100.0 + q)::double as v, y from gr, e where rn = 1 union all select k.q, k.r, e.user_id, e.rn, m + v / (v + k.r) * (k.y - m), (1 - v / (v + k.r)) * v + k.q, e.y from k join e on e.user_id = k.user_id and e.rn = k.rn + 1)
select q, r, round(avg((y - m) ** 2), 5) as mse, count(*) as n from k group by 1, 2""")
def filter_grid_search(spark, sf_dir):
    """One-step errors of a filter for several settings, all at once: the search's table."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id", "ts", "value"]).where("value is not null")
    grid = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in _GRID))
    rows = e.withColumn("_g", F.explode(grid)).select("user_id", "event_id", "ts", "value", "_g.q", "_g.r")

    def step(state, pdf):
        m, v = state
        out = []
        for y, q, r in zip(pdf["value"], pdf["q"], pdf["r"], strict=True):
            v += q
            out.append((y - m) ** 2)
            gain = v / (v + r)
            m, v = m + gain * (y - m), (1 - gain) * v
        return (m, v), {"error": out}

    got = along(rows, ["q", "r", "user_id"], ["ts", "event_id"], lambda: (0.0, 100.0), step, "error double")
    return got.groupBy("q", "r").agg(F.round(F.avg("error"), 5).alias("mse"), F.count("*").alias("n"))


@query("""with t as (select user_id, ts, value, coalesce(datediff('day', lag(ts) over w, ts) > 3 and ts - lag(ts) over w >= interval 4 day, false) as fresh from events window w as (partition by user_id order by ts, value)), s as (select *, sum(fresh::int) over (partition by user_id order by ts, value rows unbounded preceding) as part from t)
select user_id, ts as day, count(value) over w as n, round(avg(value) over w, 6) as mean from s window w as (partition by user_id, part order by ts, value rows between unbounded preceding and 1 preceding)""")
def stream_expiring_states(spark, sf_dir):
    """What was known of each user before each event, states of more than three whole days ago forgotten."""
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path)).select("user_id", F.col("ts").cast("timestamp").alias("day"), "value").withWatermark("day", "400 days")
    got = pipelines.run_to_end(pipelines.expiring_states(stream, "user_id", "day", "value", expire_days=3))
    return got.select("user_id", F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"))


@query("select event_type, count(*) as n from events where ts < timestamp '2024-01-10' + to_days((user_id % 5)::int) group by 1")
def stream_before_fence(spark, sf_dir):
    """Events sent before their user's fence, from a stream."""
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path))
    fence = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 5).cast("int")).cast("timestamp")
    kept = pipelines.before_fence(stream.withColumn("sent", F.col("ts").cast("timestamp")).withColumn("fence", fence), "sent", "fence").select("event_type", "event_id")
    return pipelines.run_to_end(kept).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select l_suppkey, count(*) as n, round(sum(l_quantity * l_discount), 6) as xy, round(sum(l_quantity * l_quantity), 6) as xx from lineitem group by 1")
def stream_incremental_sums(spark, sf_dir):
    """Sufficient statistics added batch by batch; the total is the sum over batches."""
    path = f"{sf_dir}/lineitem.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path))
    target = f"{ensure_checkpoint_dir(spark)}/sums-{spark.sparkContext.applicationId}-{id(stream)}"
    write = pipelines.add_sums(target)

    def batch(rows: DataFrame, number: int) -> None:
        write(rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("xy"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("xx")), number)

    stream.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", f"{target}-at").start().awaitTermination()
    got = spark.read.parquet(target).groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.round(F.sum("xy"), 6).alias("xy"), F.round(F.sum("xx"), 6).alias("xx"))
    return got


@query(f"""with {_GAME}, w as (select season_type, team_id, (pts > opp)::int as win, pts - opp as margin from tp where pts is not null and opp is not null), p as (select team_id, season_type, win, 1 / (1 + exp(-(avg(margin) over (partition by team_id)) / 10.0)) as p from w)
select season_type, count(*) as n, round(avg((p - win) ** 2), 6) as brier, round(avg(-(win * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - win) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))), 6) as log_loss from p group by 1""")
def forecast_scores(spark, sf_dir):
    """Brier score and log-loss of a forecast of wins by mean margins."""
    from ..operators.stats import log_loss

    t = _scores(spark, sf_dir).where("pts is not null and opp is not null").select("season_type", "team_id", (F.col("pts") > F.col("opp")).cast("int").alias("win"), (F.col("pts") - F.col("opp")).alias("margin"))
    p = t.withColumn("p", 1 / (1 + F.exp(-F.avg("margin").over(Window.partitionBy("team_id")) / 10.0)))
    return p.groupBy("season_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("win")) ** 2), 6).alias("brier"), F.round(log_loss(F.col("p"), F.col("win")), 6).alias("log_loss"))


@query(f"""{_SKILL}, gd as (select player_id, gid, season, game_date, pts from one where game_date is not null), d as (select player_id, gid, pts, count(*) over c as career_games, avg(pts) over c as career, count(*) over s as season_games, avg(pts) over s as season_mean from gd
 window c as (partition by player_id order by game_date, gid rows between unbounded preceding and 1 preceding), s as (partition by player_id, season order by game_date, gid rows between unbounded preceding and 1 preceding))
select player_id, gid as game_id, career_games, round(career, 6) as career, season_games, round(season_mean, 6) as season_mean from d""")
def prior_baselines(spark, sf_dir):
    """Season and career means of points before each game."""
    p = table(spark, sf_dir, "player_game", ["player_id", "game_id", "season", "game_date", "pts", "loaded_ts"]).withColumn("gid", pos.game_id(F.col("game_id"))).where("player_id is not null and gid is not null")
    one = p.groupBy("player_id", "gid").agg(F.max_by(F.struct("season", "game_date", "pts"), F.coalesce("loaded_ts", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r")).select("player_id", F.col("gid").alias("game_id"), "r.*").where("game_date is not null")
    c, s = (Window.partitionBy(*k).orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1) for k in (["player_id"], ["player_id", "season"]))
    return one.select("player_id", "game_id", F.count("*").over(c).alias("career_games"), F.round(F.avg("pts").over(c), 6).alias("career"), F.count("*").over(s).alias("season_games"), F.round(F.avg("pts").over(s), 6).alias("season_mean"))
