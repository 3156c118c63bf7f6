"""Target rows of the play-by-play chain, each with SQL over the same base of possessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as m, possessions as pos
from .playbyplay import _BASE, _RIM, _THREE, _rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pos.shot_flags(pos.possessions(_rows(spark, sf_dir)))


_PLAYERS = {s: "[" + ", ".join(f"coalesce({side}_player{i}, 0)" for i in range(1, 6)) + "]" for s, side in (("h", "home"), ("a", "away"))}
_W = "partition by game_id order by period, clock desc, event_num"
_M = f"""{_BASE},
e as (select *, lpad(game_id, 10, '0') as gid, case when t_h <> '' and t_a = '' then 'h' when t_a <> '' and t_h = '' then 'a' end as side, points_h + points_a as pts, event_type in (1, 2) as fga,
  case when event_type not in (1, 2) then null when {_THREE} then 'three' when {_RIM} then 'rim' else 'mid' end as zone, case when event_type = 1 and {_THREE} then 3 when event_type = 1 then 2 else 0 end as sp,
  list_distinct(list_filter({_PLAYERS['h']}, lambda x: x > 0)) as lh, list_distinct(list_filter({_PLAYERS['a']}, lambda x: x > 0)) as la from pf)"""
_ROLES = f"""{_M}, s as (select *, case when side = 'h' then lh else la end as own from e where fga and side is not null and player1_id > 0),
r as (select gid, event_num, player1_id, sp, unnest(own) as p from s where list_contains(own, player1_id))"""


@query(f"with {_ROLES} select gid as game_id, event_num, p as player_id, case when p = player1_id then 'shooter' else 'teammate' end as role, sp as points from r")
def pbp_shot_roles(spark, sf_dir):
    """One row of the shooter and one of each team-mate per field-goal attempt."""
    return m.shot_roles(_shots(spark, sf_dir))


@query(f"with {_ROLES} select p as player_id, sum(case when p = player1_id then sp else 0 end)::double as on_ball, sum(case when p <> player1_id then sp / 4.0 else 0 end)::double as off_ball from r where sp > 0 group by 1")
def pbp_scoring_roles(spark, sf_dir):
    return m.scoring_roles(_shots(spark, sf_dir))


@query(f"""with {_M}, n as (select *, lead(event_type) over w as nt, lead(side) over w as ns, lead(player1_id) over w as np from e window w as ({_W}))
select gid as game_id, event_num, player1_id as shooter_id, np as rebounder_id, case when ns <> side then 'defense' when np = player1_id and player1_id > 0 then 'shooter' else 'teammate' end as won
from n where event_type = 2 and nt = 4 and side is not null and ns is not null""")
def pbp_shooter_rebounds(spark, sf_dir):
    """Who has the rebound of a miss: its shooter, a team-mate or the defense."""
    return m.miss_rebounds(_shots(spark, sf_dir))


@query(f"""with {_M}, n as (select *, lead(event_type) over w as nt, lead(side) over w as ns from e window w as ({_W}))
select poss_offense, count(*) as chances, sum((ns = side)::int)::bigint as offensive from n where event_type = 2 and nt = 4 and side is not null and ns is not null group by 1""")
def pbp_rebound_chances(spark, sf_dir):
    """Offensive rebounds per chance, by the side that has the ball."""
    rows = _shots(spark, sf_dir).select("game_id", "event_num", "poss_offense").distinct()
    r = m.miss_rebounds(_shots(spark, sf_dir)).join(rows, ["game_id", "event_num"])
    return r.groupBy("poss_offense").agg(F.count("*").alias("chances"), F.count_if(F.col("won") != "defense").alias("offensive"))


@query(f"""with {_M}, t as (select *, case when side = 'h' then t_h else t_a end as txt, concat_ws(' ', t_h, t_a) as whole from e)
select gid as game_id, event_num, player1_id as receiver_id, trim(regexp_extract(txt, '\\(([^()]*?)\\s+\\d+ AST\\)', 1)) as passer, sp as points from t where event_type = 1 and side is not null and regexp_matches(whole, '(?i)\\(.*\\d+ AST\\)')""")
def pbp_assist_roles(spark, sf_dir):
    """Receiver and passer of each assisted make."""
    return m.assist_rows(_shots(spark, sf_dir))


_CHANCES = f"""{_M}, b as (select *, coalesce(max((event_type = 2)::int) over (partition by game_id, poss order by period, clock desc, event_num rows between unbounded preceding and 1 preceding), 0) = 1 as second_ from e),
c as (select gid as game_id, poss::bigint as poss, sum(pts)::bigint as points, {', '.join(f"sum(case when not second_ and zone = '{z}' then pts else 0 end)::bigint as first_{z}" for z in m.ZONES)},
  sum(case when not second_ and zone is null then pts else 0 end)::bigint as first_ft, sum(case when second_ then pts else 0 end)::bigint as second,
  min_by(zone, (period, -clock, event_num)) filter (where event_type = 2) as missed_zone from b group by 1, 2)"""


@query(f"with {_CHANCES} select * from c")
def pbp_chances(spark, sf_dir):
    """Points of each possession by first chance (zones, free throws) and second chance; they add up."""
    return m.chances(_shots(spark, sf_dir))


@query(f"with {_CHANCES} select missed_zone, count(*) as n, round(avg(second), 8) as later from c where missed_zone is not null group by 1")
def pbp_continuation(spark, sf_dir):
    return m.continuation(m.chances(_shots(spark, sf_dir))).select("missed_zone", "n", F.round("later", 8).alias("later"))


@query(f"""with {_CHANCES}, k as (select missed_zone, avg(second) as later from c where missed_zone is not null group by 1)
select game_id, poss, points, round(points - second + coalesce(later, 0), 8) as first_priced, round(second - coalesce(later, 0), 8) as second_priced from c left join k using (missed_zone)""")
def pbp_priced_chances(spark, sf_dir):
    """First misses priced by what their zone brings later; first and second still add up to the points."""
    return m.priced(m.chances(_shots(spark, sf_dir))).select("game_id", "poss", "points", F.round("first_priced", 8).alias("first_priced"), F.round("second_priced", 8).alias("second_priced"))


@query(f"""with {_M}, f as (select *, coalesce(regexp_extract(case when side = 'h' then t_h else t_a end, '(\\d+) of \\d+', 1) = '1', false) as first_ from e where event_type = 3 and side is not null),
s as (select *, first_ or player1_id is distinct from lag(player1_id) over w or row_number() over w = 1 and player1_id is not null as starts from f window w as (partition by game_id, poss order by period, clock desc, event_num)),
t as (select *, sum(starts::int) over (partition by game_id, poss order by period, clock desc, event_num rows unbounded preceding) as trip from s)
select gid as game_id, poss::bigint as poss, trip::bigint as trip, count(*) as throws, sum(pts)::bigint as made from t group by 1, 2, 3""")
def pbp_free_throw_trips(spark, sf_dir):
    """Free throws of each possession by trip: how many there are and what they give."""
    return m.free_throw_trips(_shots(spark, sf_dir))


@query(f"""with {_M}, x as (select *, concat_ws(' ', t_h, t_a) as whole, case when regexp_matches(t_h, '(?i)\\bmiss\\b') then 'h' when regexp_matches(t_a, '(?i)\\bmiss\\b') then 'a' end as shooter,
  [{', '.join(f"case when lead(event_type, {k}) over w = 4 then coalesce(lead(side, {k}) over w, '?') end" for k in range(1, 9))}] as ahead from e window w as ({_W})),
k as (select *, list_filter(ahead, lambda v: v is not null)[1] as board from x)
select gid as game_id, poss::bigint as poss, max((event_type = 5)::int) + max((event_type = 2 and regexp_matches(whole, '(?i)block') and coalesce(nullif(board, '?') <> shooter, false))::int) > 0 as stop from k group by 1, 2""")
def pbp_stops(spark, sf_dir):
    """Possessions that a turnover or a block kept by the defense stopped."""
    return m.stops(_shots(spark, sf_dir))


@query(f"with {_M}, v as (select zone, avg(sp) as ev from e where fga group by 1) select gid as game_id, event_num, zone, sp as shot_points, round(ev, 8) as ev, round(sp - ev, 8) as making from e join v using (zone) where fga")
def pbp_expected_values(spark, sf_dir):
    """Each attempt's value by zone and what its shooter made beyond it."""
    return m.expected_values(_shots(spark, sf_dir)).withColumns({"ev": F.round("ev", 8), "making": F.round("making", 8)})


@query(f"""with {_M}, v as (select zone, avg(sp) as ev from e where fga group by 1), q as (select poss_offense, count(*) filter (where eop) as possessions, sum(pts)::bigint as points, sum(case when event_type = 3 then pts else 0 end)::bigint as ft, sum(ev) filter (where fga) as quality, sum(sp - ev) filter (where fga) as making from e left join v using (zone) group by 1)
select poss_offense, possessions, points, round(quality, 4) as quality, round(making, 4) as making, ft from q""")
def pbp_quality_split(spark, sf_dir):
    """Points by shot quality, shot making and free throws, by the side that has the ball."""
    r = m.told(_shots(spark, sf_dir)).withColumn("zone", m.zone())
    mean = r.where("is_fga").groupBy("zone").agg(F.avg("shot_points").alias("ev"))  # three zones
    j = r.join(F.broadcast(mean), "zone", "left").withColumn("making", F.col("shot_points") - F.col("ev"))
    own = F.col("is_fga")
    return j.groupBy("poss_offense").agg(F.count_if("eop").alias("possessions"), F.sum("points").cast("bigint").alias("points"), F.round(F.sum(F.when(own, F.col("ev"))), 4).alias("quality"), F.round(F.sum(F.when(own, F.col("making"))), 4).alias("making"), F.sum(F.when(F.col("event_type") == 3, F.col("points")).otherwise(0)).cast("bigint").alias("ft"))


@query(f"with {_M} select coalesce(event_action_type, -1)::int as action, zone, count(*) as n, round(avg(sp), 8) as value from e where fga group by 1, 2")
def pbp_play_type_values(spark, sf_dir):
    """Mean value of each kind of attempt."""
    r = _shots(spark, sf_dir).where("is_fga")
    return r.groupBy(F.coalesce("event_action_type", F.lit(-1)).cast("int").alias("action"), m.zone().alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg("shot_points"), 8).alias("value"))


@query(f"""with {_CHANCES}, t as (select gid as game_id, poss::bigint as poss, max((event_type = 5)::int) = 1 as turned from e group by 1, 2), x as (select c.*, turned from c join t using (game_id, poss)), bl as (select avg(points) as base from x where not turned)
select game_id, poss, round(case when turned then base else points end, 8) as target from x, bl""")
def pbp_turnover_baseline(spark, sf_dir):
    """Points of each possession, the mean of the others in place of one that was turned over."""
    r = m.told(_shots(spark, sf_dir))
    p = r.groupBy("game_id", "poss").agg(F.sum("points").alias("points"), (F.max((F.col("event_type") == 5).cast("int")) == 1).alias("turned"))
    base = p.where("not turned").agg(F.avg("points")).scalar()
    return p.select("game_id", "poss", F.round(F.when(F.col("turned"), base).otherwise(F.col("points").cast("double")), 8).alias("target"))


@query(f"""with {_M}, p as (select gid as game_id, unnest(lh) as player_id, 'h' as side from e union all select gid, unnest(la), 'a' from e), n as (select game_id, player_id, side, count(*) as n from p group by 1, 2, 3)
select game_id, player_id, side, n from n qualify row_number() over (partition by game_id, player_id order by n desc, side desc) = 1""")
def pbp_player_sides(spark, sf_dir):
    """The side of each player of a game by vote of all its lineups."""
    return m.sides_of_players(pos.timeline(spark.read.parquet(f"{sf_dir}/raw_event.parquet")))


@query(f"""with {_M}, t as (select gid as game_id, event_num, poss_offense, lh, la from e where eop and poss_offense <> ''), u as (select game_id, event_num, unnest(lh) as player_id, case when poss_offense = 'Home' then 1 else -1 end as sign from t union all select game_id, event_num, unnest(la), case when poss_offense = 'Home' then -1 else 1 end from t)
select player_id, count(*) filter (where sign = 1) as off_rows, count(*) filter (where sign = -1) as def_rows, sum(sign)::bigint as balance from u group by 1""")
def pbp_design_columns(spark, sf_dir):
    """The design of offense (1) and defense (-1) indicators, summed by column."""
    t = _shots(spark, sf_dir).where("eop and poss_offense != ''")
    sign = F.when(m.home_offense(), 1).otherwise(-1)
    u = t.select(F.explode(F.concat(F.transform("l_h", lambda p: F.struct(p.alias("p"), sign.alias("s"))), F.transform("l_a", lambda p: F.struct(p.alias("p"), (-sign).alias("s"))))).alias("x")).where("x.p > 0")
    return u.groupBy(F.col("x.p").alias("player_id")).agg(F.count_if(F.col("x.s") == 1).alias("off_rows"), F.count_if(F.col("x.s") == -1).alias("def_rows"), F.sum("x.s").cast("bigint").alias("balance"))


@query(f"""with {_BASE}, s as (select *, case when row_number() over w = 1 then coalesce(home_score, 0) else home_score end as hs, case when row_number() over w = 1 then coalesce(away_score, 0) else away_score end as as_ from pf window w as ({_W})),
x as (select *, last_value(hs ignore nulls) over w - last_value(as_ ignore nulls) over w as margin from s window w as ({_W})),
z as (select *, case when period <= 4 then (4 - period) * 720 + clock else clock end / 2880.0 as rest from x where eop)
select period::bigint as period, count(*) as n, sum((margin > -8 and margin <= 0)::int)::bigint as close_behind, sum((margin > 15)::int)::bigint as far_ahead, round(sum(greatest(margin - 5, 0) * greatest(rest - 0.25, 0)), 5) as lead_5_1, round(sum(greatest(-margin - 10, 0) * greatest(rest - 0.0, 0)), 5) as trail_10_0 from z group by 1""")
def pbp_state_basis(spark, sf_dir):
    """Sums of some of the 64 columns of the game-state basis over possessions, by period."""
    r = _shots(spark, sf_dir).where("eop").withColumn("margin", F.col("home_score") - F.col("away_score"))
    basis = m.state_basis(F.col("margin"), F.col("period"), F.col("clock"))
    r = r.select("period", *(c.alias(n) for n, c in basis.items()))
    behind, ahead = (sum((F.col(f"bin_{i}_{p}") for p in range(1, 5)), F.lit(0)) for i in (2, 5))
    return r.groupBy(F.col("period").cast("bigint").alias("period")).agg(F.count("*").alias("n"), F.sum(behind).cast("bigint").alias("close_behind"), F.sum(ahead).cast("bigint").alias("far_ahead"), F.round(F.sum("lead_5_1"), 5).alias("lead_5_1"), F.round(F.sum("trail_10_0"), 5).alias("trail_10_0"))


@query(f"""with {_M}, t as (select gid as game_id, poss::bigint as poss, sum(pts)::bigint as points, max((event_type = 9)::int) = 1 as timeout, max(period) as period, max(clock) as clock, any_value(poss_offense) as o from e group by 1, 2),
n as (select *, lag(timeout) over (partition by game_id order by poss) as after from t) select coalesce(after, false) as after_timeout, period >= 4 and clock <= 120 as endgame, count(*) as n, sum(points)::bigint as points from n group by 1, 2""")
def pbp_after_timeout(spark, sf_dir):
    """Points of possessions after one with a timeout, in and out of the last two minutes."""
    r = m.told(_shots(spark, sf_dir))
    t = r.groupBy("game_id", "poss").agg(F.sum("points").alias("points"), (F.max((F.col("event_type") == 9).cast("int")) == 1).alias("timeout"), F.max("period").alias("period"), F.max("clock").alias("clock"))
    after = F.coalesce(F.lag("timeout").over(Window.partitionBy("game_id").orderBy("poss")), F.lit(False))
    t = t.select("points", after.alias("after_timeout"), ((F.col("period") >= 4) & (F.col("clock") <= 120)).alias("endgame"))
    return t.groupBy("after_timeout", "endgame").agg(F.count("*").alias("n"), F.sum("points").cast("bigint").alias("points"))


@query(f"""with {_M}, t as (select gid as game_id, lh, la, sum(points_h) over (partition by game_id order by period, clock desc, event_num) as ph, sum(points_a) over (partition by game_id order by period, clock desc, event_num) as pa, home_score, away_score, points_h, points_a, eop from e),
g as (select game_id, max(ph) as ph, max(pa) as pa, max(home_score) as hs, max(away_score) as as_ from t group by 1), ok as (select game_id from g where ph = hs and pa = as_),
r as (select array_to_string(list_sort(lh), '-') as lineup, points_h - points_a as net, eop from t semi join ok using (game_id) union all select array_to_string(list_sort(la), '-'), points_a - points_h, eop from t semi join ok using (game_id))
select lineup, count(*) filter (where eop) as possessions, sum(net)::bigint as net from r group by 1""")
def pbp_clean_lineups(spark, sf_dir):
    """Net points of lineups in the games whose events add up to the score."""
    r = _shots(spark, sf_dir)
    g = r.groupBy("game_id").agg(F.sum("points_h").alias("ph"), F.sum("points_a").alias("pa"), F.max("home_score").alias("hs"), F.max("away_score").alias("as_"))
    r = r.join(g.where("ph = hs and pa = as_").select("game_id"), "game_id", "left_semi")
    net = F.col("points_h") - F.col("points_a")
    key = [F.array_join(F.array_sort(F.filter(c, lambda x: x > 0)).cast("array<string>"), "-") for c in ("l_h", "l_a")]
    each = r.select("eop", F.explode(F.array(F.struct(key[0].alias("lineup"), net.alias("net")), F.struct(key[1].alias("lineup"), (-net).alias("net")))).alias("x"))
    return each.groupBy("x.lineup").agg(F.count_if("eop").alias("possessions"), F.sum("x.net").cast("bigint").alias("net"))
