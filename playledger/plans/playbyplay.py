"""The domain chain over the play-by-play tables, with SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimate, possessions as pos
from ..operators.joins import unordered_pairs
from ..session import cut
from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pos.terminals(pos.timeline(table(spark, sf_dir, "raw_event")))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = table(spark, sf_dir, "game_metadata", ["game_id", "home_team_id", "away_team_id", "updated_ts"]).groupBy("game_id").agg(F.max(F.struct("updated_ts", "home_team_id", "away_team_id")).alias("g"))
    games = games.select("game_id", "g.home_team_id", "g.away_team_id")
    rows = pos.neutral_offense(_rows(spark, sf_dir), games, table(spark, sf_dir, "team"))
    return pos.possession_table(pos.possessions(pos.fill_lineups(pos.foul_lineups(rows))))


_SLOTS = ", ".join(f"{s}_player{i}" for s in ("home", "away") for i in range(1, 6))


def _side(s: str, o: str) -> dict[str, str]:
    def m(t: str, p: str) -> str:
        return f"regexp_matches({t}, '(?i){p}')"

    not_last, last = r"\b(1 of [23]|2 of 3|Technical|Flagrant)\b", r"\b(1 of 1|2 of 2|3 of 3)\b"
    board = m(f"t_{s}", "REBOUND")
    own, other = f"(n_type = 4 and {m(f'n_{s}', 'REBOUND')})", f"(n_type = 4 and {m(f'n_{o}', 'REBOUND')})"
    live = f"(({own} and not {m(f'n_{s}', 'deadball')} and not {m(f'n_{s}', 'team defensive rebound')}) or ({other} and not {m(f'n_{o}', 'deadball')} and not {m(f'n_{o}', 'team offensive rebound')}))"
    return {
        "flagrant": m(f"t_{s}", "Flagrant (2 of 2|3 of 3)"),
        "board": f"{board} and {m(f'p_{o}', 'MISS')} and not {m(f'p_{o}', not_last)}",
        "board_any": f"{board} and {m(f'p_{o}', 'MISS')}",
        "turnover": m(f"t_{s}", "Turnover"),
        "make": f"{m(f't_{s}', 'PTS')} and event_type = 1 and not regexp_matches(n_{o}, 'S.FOUL')",
        "last_ft": f"{m(f't_{s}', last)} and {m(f't_{s}', 'PTS')} and not ({m(f'pp_{o}', 'Transition')} or {m(f'p_{o}', 'Transition')} or {m(f't_{s}', 'Flagrant')})",
        "foul": f"event_type = 6 and {m(f't_{s}', 'offensive|charge')} and coalesce(n_type, -1) <> 5",
        "missed_ft": f"event_type = 3 and {m(f't_{s}', last)} and {m(f't_{s}', chr(92) + 'bMISS' + chr(92) + 'b')} and not {m(f't_{s}', 'technical')} and not coalesce({live}, false)",
        "shot": f"event_type in (1, 2) and ({m(f't_{s}', 'PTS')} or {m(f't_{s}', 'MISS')})",
        "ft": f"event_type = 3 and {m(f't_{s}', 'Free Throw')}",
    }


def _points(s: str) -> str:
    t = f"t_{s}"
    missed = f"regexp_matches({t}, '(?i){chr(92)}bMISS{chr(92)}b')"
    return f"case when regexp_matches({t}, '(?i)Free Throw') and not {missed} then 1 when regexp_matches({t}, '(?i)PTS') and not regexp_matches({t}, '(?i)3PT') and event_type = 1 then 2 when regexp_matches({t}, '(?i)3PT') and not {missed} then 3 else 0 end"


_H, _A = _side("h", "a"), _side("a", "h")
_BASE = f"""
once as (select distinct on (game_id, period, clock, event_num) * from (select *, 60 * minute_remaining_quarter + seconds_remaining_quarter as clock from raw_event)
  where game_id is not null and period is not null and clock is not null and event_num is not null order by game_id, period, clock, event_num, received_ts),
tl as (select *, coalesce(home_description, '') as t_h, coalesce(visitor_description, '') as t_a, coalesce(neutral_description, '') as t_n from once
  where {' and '.join(f'{c.strip()} is not null' for c in _SLOTS.split(','))}),
nb as (select *, {_points('h')} as points_h, {_points('a')} as points_a,
  {', '.join(f"coalesce(lag(t_{s}) over w, '') as p_{s}, coalesce(lag(t_{s}, 2) over w, '') as pp_{s}, coalesce(lead(t_{s}) over w, '') as n_{s}" for s in 'ha')},
  lead(event_type) over w as n_type, lag(seconds_remaining_quarter) over w as p_seconds
  from tl window w as (partition by game_id order by period, clock desc, event_num)),
tm as (select *, coalesce(event_type = 13 and p_seconds > 0, false) or event_type = 5 or {' or '.join(f'({x[k]})' for k in ('flagrant', 'board', 'make', 'last_ft', 'foul', 'missed_ft') for x in (_H, _A))} as eop,
  case {' '.join(f"when {_H[k]} then '{'Away' if k == 'board_any' else 'Home'}' when {_A[k]} then '{'Home' if k == 'board_any' else 'Away'}'" for k in ('flagrant', 'board_any', 'turnover', 'make', 'last_ft', 'foul', 'missed_ft', 'shot', 'ft'))} else '' end as offense from nb),
po as (select *, coalesce(sum(eop::int) over (partition by game_id order by period, clock desc, event_num rows between unbounded preceding and 1 preceding), 0) as poss from tm),
of as (select *, coalesce(first_value(nullif(offense, '') ignore nulls) over (partition by game_id, poss order by period, clock desc, event_num rows between current row and unbounded following),
  last_value(nullif(offense, '') ignore nulls) over (partition by game_id, poss order by period, clock desc, event_num rows between unbounded preceding and current row)) as o from po),
pf as (select *, coalesce(o, case when eop then case last_value(case when eop then o end ignore nulls) over (partition by game_id, period order by clock desc, event_num rows between unbounded preceding and 1 preceding) when 'Home' then 'Away' when 'Away' then 'Home' end end, '') as poss_offense from of)
"""


@query(f"with {_BASE} select lpad(game_id, 10, '0') as game_id, event_num, eop, offense, points_h, points_a from tm")
def pbp_terminals(spark, sf_dir):
    return _rows(spark, sf_dir).select("game_id", "event_num", "eop", "offense", "points_h", "points_a")


@query(f"""with {_BASE}, r as (select *, sum(points_h + points_a) over (partition by game_id order by period, clock desc, event_num) as total from pf), e as (select * from r where eop)
select lpad(game_id, 10, '0') as game_id, poss::bigint as poss, event_num, poss_offense, (total - lag(total, 1, 0) over (partition by game_id order by period, clock desc, event_num))::bigint as points from e""")
def pbp_possessions(spark, sf_dir):
    """Possessions by the terminal rules alone (no change of terminals by foul lineups)."""
    rows = pos.possessions(_rows(spark, sf_dir))
    e = rows.withColumn("total", F.sum(F.col("points_h") + F.col("points_a")).over(pos.so_far())).where("eop")
    return e.select("game_id", "poss", "event_num", "poss_offense", (F.col("total") - F.lag("total", 1, 0).over(pos.in_game())).cast("bigint").alias("points"))


_TEXT = "concat_ws(' ', t_h, t_a)"
_RIM = f"(coalesce(event_action_type, -1) in {pos.RIM_ACTIONS} or regexp_matches({_TEXT}, '(?i)layup|dunk|{chr(92)}btip{chr(92)}b'))"
_THREE = f"regexp_matches({_TEXT}, '(?i)3PT')"


@query(f"""with {_BASE}, f as (select *, (event_type in (1, 2))::int as fga, (event_type = 5)::int as tov, (event_type in (1, 2) and {_RIM} and not {_THREE})::int as rim, (event_type in (1, 2) and {_THREE})::int as three,
(event_type in (1, 2) and not {_RIM} and not {_THREE})::int as mid from pf)
select period::bigint as period, poss_offense, count(*) filter (where eop) as possessions, sum(fga)::bigint as fga, sum(tov)::bigint as turnovers, sum(rim)::bigint as rim_attempts, sum(three)::bigint as three_attempts, sum(mid)::bigint as mid_attempts from f group by 1, 2""")
def pbp_shot_mix(spark, sf_dir):
    f = pos.shot_flags(pos.possessions(_rows(spark, sf_dir)))
    m = {k: F.sum(pos.METRICS[k]()).cast("bigint").alias(k) for k in ("fga", "turnovers", "rim_attempts", "three_attempts", "mid_attempts")}
    return f.groupBy(F.col("period").cast("bigint").alias("period"), "poss_offense").agg(F.count_if("eop").alias("possessions"), *m.values())


@query(f"""with {_BASE}, s as (select *, case when row_number() over w = 1 then coalesce(home_score, 0) else home_score end as hs, case when row_number() over w = 1 then coalesce(away_score, 0) else away_score end as as_ from tl window w as (partition by game_id order by period, clock desc, event_num)),
x as (select game_id, event_num, last_value(hs ignore nulls) over w as home, last_value(as_ ignore nulls) over w as away from s window w as (partition by game_id order by period, clock desc, event_num))
select lpad(game_id, 10, '0') as game_id, event_num, home as home_score, away as away_score, case when home = away then 'TIE' else (home - away)::int::varchar end as score_margin from x""")
def pbp_scores(spark, sf_dir):
    return pos.timeline(table(spark, sf_dir, "raw_event")).select("game_id", "event_num", "home_score", "away_score", "score_margin")


_NOT_LAST = r"\b(1 of [23]|2 of 3|Technical|Flagrant)\b"
_QUIET = r"T\.FOUL|FLAGRANT|Offens|Transition"
_IN = "partition by game_id order by period, clock desc, event_num"
_PART = "partition by game_id, part order by period, clock desc, event_num"


def _packed(side: str) -> str:
    slots = "[" + ", ".join(f"coalesce({side}_player{i}, 0)" for i in range(1, 6)) + "]"
    return f"list_concat(list_filter({slots}, lambda x, i: x > 0 and list_position({slots}, x) = i), [0, 0, 0, 0, 0])[1:5]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _whole_chain() -> str:
    """SQL of the possession table: labels of neutral turnovers, foul lineups, filled lineups, numerators."""
    t2, t3 = "concat_ws(' ', t_h, t_a)", "concat_ws(' ', t_h, t_a, t_n)"
    rim, three, make = _RIM, _THREE, "event_type = 1"
    dunk = f"(coalesce(event_action_type, -1) in {pos.DUNK_ACTIONS} or regexp_matches({t2}, '(?i)\\bdunk\\b'))"
    assisted = f"({make} and regexp_matches({t2}, '(?i)\\(.*[0-9]+ AST\\)'))"
    shot = f"case when {make} and {three} then 3 when {make} then 2 else 0 end"
    pts = "points_h + points_a"
    flags = {
        "points": pts, "fga": "(event_type in (1, 2))::int", "turnovers": "(event_type = 5)::int",
        "bad_passes": f"(event_type = 5 and regexp_matches({t3}, '(?i)bad pass'))::int", "other_turnovers": f"(event_type = 5 and not regexp_matches({t3}, '(?i)bad pass'))::int",
        "rim_attempts": f"(event_type in (1, 2) and {rim} and not {three})::int", "rim_makes": f"({make} and {rim} and not {three})::int",
        "three_attempts": f"(event_type in (1, 2) and {three})::int", "three_makes": f"({make} and {three})::int",
        "mid_attempts": f"(event_type in (1, 2) and not {three} and not {rim})::int", "mid_makes": f"({make} and not {three} and not {rim})::int",
        "dunks": f"({make} and {dunk})::int", "assist_points": f"case when {assisted} then {shot} else 0 end", "rim_assists": f"({assisted} and {rim} and not {three})::int", "dunk_assists": f"({assisted} and {dunk})::int",
        "free_throws": "(event_type = 3)::int", "free_throw_points": f"case when event_type = 3 then {pts} else 0 end",
        "offensive_rebounds": "(event_type = 4 and ((regexp_matches(t_h, '(?i)REBOUND') and regexp_matches(p_h, '(?i)MISS')) or (regexp_matches(t_a, '(?i)REBOUND') and regexp_matches(p_a, '(?i)MISS'))))::int",
        "transition": f"regexp_matches({t3}, '(?i)transition')::int", "second_chance_points": f"case when after_miss then {pts} else 0 end",
    }
    second = " or ".join(f"(regexp_matches(t_{x}, '(?i)REBOUND') and regexp_matches(p_{x}, '(?i)MISS') and regexp_matches(p_{x}, '(?i)Free Throw') and not regexp_matches(p_{x}, '(?i){_NOT_LAST}'))" for x in "ha")
    filled = {x: "[" + ", ".join(f"case when l_{x}[{i}] > 0 then l_{x}[{i}] else coalesce(last_value(nullif(l_{x}[{i}], 0) ignore nulls) over (w rows unbounded preceding), 0) end" for i in range(1, 6)) + "]" for x in "ha"}
    return f"""{_BASE},
lb as (select team_id, list_filter([{_clean('team_abbreviation')}, {_clean('team_city')}, {_clean('team_nickname')}], lambda x: x <> '') as labels from team),
gt as (select game_id as gid, arg_max({{'h': home_team_id, 'a': away_team_id}}, updated_ts) as t from game_metadata group by 1),
gl as (select gid, h.labels as lh, a.labels as la from gt left join lb h on h.team_id = t.h left join lb a on a.team_id = t.a),
t0 as (select * replace (lpad(game_id, 10, '0') as game_id), {_packed('home')} as l_h, {_packed('away')} as l_a, coalesce({second}, false) as off_ft_reb from tm),
t1 as (select *, ' ' || {_clean('t_n')} || ' ' as label from t0 left join gl on gl.gid = t0.game_id),
t2 as (select *, coalesce(len(list_filter(lh, lambda x: contains(label, ' ' || x || ' '))) > 0, false) as in_h, coalesce(len(list_filter(la, lambda x: contains(label, ' ' || x || ' '))) > 0, false) as in_a from t1),
t3 as (select * replace (case when event_type = 5 and offense = '' and regexp_matches(t_n, '(?i)Turnover') then case when in_h and not in_a then 'Home' when in_a and not in_h then 'Away' else '' end else offense end as offense) from t2),
f1 as (select *, event_type = 6 and lead(1, 4) over w is not null and coalesce(sum((event_type = 3)::int) over (w rows between current row and 4 following), 0) > 0 and coalesce(sum((event_type = 8)::int) over (w rows between current row and 4 following), 0) > 0
  and not regexp_matches(t_a, '{_QUIET}') and not regexp_matches(t_h, '{_QUIET}') as foul, eop or off_ft_reb as stop from t3 window w as ({_IN})),
f2 as (select *, coalesce(sum(stop::int) over ({_IN} rows between unbounded preceding and 1 preceding), 0) as part from f1),
f3 as (select *, case when foul and not stop then {{'h': l_h, 'a': l_a}} end as any_, case when foul and not stop and coalesce(sum((event_type = 3)::int) over ({_PART} rows between 1 following and unbounded following), 0) > 0 then {{'h': l_h, 'a': l_a}} end as from_ from f2),
f4 as (select *, first_value(from_ ignore nulls) over ({_PART} rows between unbounded preceding and 1 preceding) as held, first_value(any_ ignore nulls) over ({_PART} rows between unbounded preceding and 1 preceding) as at_foul from f3),
f5 as (select *, off_ft_reb and not eop and at_foul is not null and (at_foul.h <> l_h or at_foul.a <> l_a) as changed from f4),
f6 as (select * replace (case when (not off_ft_reb or eop) and held is not null then held.h else l_h end as l_h, case when (not off_ft_reb or eop) and held is not null then held.a else l_a end as l_a, eop or coalesce(lead(changed) over ({_IN}), false) as eop) from f5),
f7 as (select *, {filled['h']} as fh, {filled['a']} as fa, eop and (len(list_filter(l_h, lambda x: x > 0)) < 4 or len(list_filter(l_a, lambda x: x > 0)) < 4) as few from f6 window w as ({_IN})),
c1 as (select * replace (case when few then fh else l_h end as l_h, case when few then fa else l_a end as l_a), coalesce(sum(eop::int) over ({_IN} rows between unbounded preceding and 1 preceding), 0) as poss from f7),
c2 as (select *, coalesce(first_value(nullif(offense, '') ignore nulls) over (partition by game_id, poss order by period, clock desc, event_num rows between current row and unbounded following),
  last_value(nullif(offense, '') ignore nulls) over (partition by game_id, poss order by period, clock desc, event_num rows between unbounded preceding and current row)) as o from c1),
c3 as (select *, coalesce(o, case when eop then case last_value(case when eop then o end ignore nulls) over (partition by game_id, period order by clock desc, event_num rows between unbounded preceding and 1 preceding) when 'Home' then 'Away' when 'Away' then 'Home' end end, '') as poss_offense,
  coalesce(max((event_type = 2)::int) over (partition by game_id, poss order by period, clock desc, event_num rows between unbounded preceding and 1 preceding), 0) = 1 as after_miss,
  case when row_number() over w = 1 then coalesce(home_score, 0) else home_score end as hs0, case when row_number() over w = 1 then coalesce(away_score, 0) else away_score end as as0 from c2 window w as ({_IN})),
c4 as (select *, last_value(hs0 ignore nulls) over w as hs, last_value(as0 ignore nulls) over w as as_ from c3 window w as ({_IN})),
mt as (select game_id, poss, {', '.join(f'sum({x})::bigint as {k}' for k, x in flags.items())} from c4 group by 1, 2),
en as (select game_id, poss, period, clock, event_num, poss_offense, case when poss_offense = 'Home' then l_h else l_a end as O, case when poss_offense = 'Home' then l_a else l_h end as D, hs as home_score, as_ as away_score, case when hs = as_ then 'TIE' else (hs - as_)::int::varchar end as score_margin from c4 where eop),
pt as (select en.*, {', '.join(f'mt.{k}' for k in flags)} from en join mt using (game_id, poss)
  where len(list_distinct(list_filter(O, lambda x: x > 0))) >= 5 and len(list_distinct(list_filter(D, lambda x: x > 0))) >= 5 and not list_has_any(list_filter(O, lambda x: x > 0), list_filter(D, lambda x: x > 0)) and poss_offense <> '')"""


_TABLE = _whole_chain()


@query(f"with {_TABLE} select * replace (poss::bigint as poss) from pt")
def pbp_possession_table(spark, sf_dir):
    """The whole chain: foul lineups, filled lineups, offense and defense slots, all numerators."""
    return pos.complete(_chain(spark, sf_dir))


@query(f"""with {_TABLE}, o as (select array_to_string(list_sort(O), '-') as lineup_key, count(*) as off_poss, sum(points)::bigint as off_points, count(distinct game_id) as off_games from pt group by 1),
d as (select array_to_string(list_sort(D), '-') as lineup_key, count(*) as def_poss, sum(points)::bigint as def_points, count(distinct game_id) as def_games from pt group by 1)
select lineup_key, coalesce(off_poss, 0) as off_poss, coalesce(off_points, 0) as off_points, coalesce(off_games, 0) as off_games, coalesce(def_poss, 0) as def_poss, coalesce(def_points, 0) as def_points, coalesce(def_games, 0) as def_games,
 round(100.0 * off_points / off_poss, 3) as off_rating, round(100.0 * def_points / def_poss, 3) as def_rating from o full join d using (lineup_key)""")
def pbp_lineups(spark, sf_dir):
    """Lineup table: possessions and points for and against of each five."""
    t = pos.complete(_chain(spark, sf_dir))
    off = t.groupBy(F.concat_ws("-", F.array_sort("O").cast("array<string>")).alias("lineup_key")).agg(F.count("*").alias("off_poss"), F.sum("points").alias("off_points"), F.countDistinct("game_id").alias("off_games"))
    de = t.groupBy(F.concat_ws("-", F.array_sort("D").cast("array<string>")).alias("lineup_key")).agg(F.count("*").alias("def_poss"), F.sum("points").alias("def_points"), F.countDistinct("game_id").alias("def_games"))
    j = off.join(de, "lineup_key", "full").na.fill(0)
    rate = [F.when(F.col(f"{s}_poss") > 0, F.round(100 * F.col(f"{s}_points") / F.col(f"{s}_poss"), 3)).alias(f"{s}_rating") for s in ("off", "def")]
    return j.select("lineup_key", "off_poss", "off_points", "off_games", "def_poss", "def_points", "def_games", *rate)


@query(f"with {_TABLE}, e as (select game_id, poss, points, unnest(O) as p from pt) select a.p as a, b.p as b, count(*) as poss, sum(a.points)::bigint as points from e a join e b on a.game_id = b.game_id and a.poss = b.poss and a.p < b.p where a.p > 0 group by 1, 2")
def pbp_teammate_pairs(spark, sf_dir):
    """Possessions that two players shared on offense, with the points of these."""
    t = pos.complete(_chain(spark, sf_dir)).select("game_id", "poss", "points", F.explode("O").alias("player"))
    pairs = unordered_pairs(t.where("player > 0"), ["game_id", "poss", "points"], "player")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("poss"), F.sum("points").alias("points"))


@query()
def pbp_ridge(spark, sf_dir):
    """Offensive and defensive coefficients per 100 possessions by weighted ridge on lineups."""
    t = pos.complete(_chain(spark, sf_dir))
    # equal lineups first: as many rows as distinct pairs of lineups
    t = cut(t.groupBy(F.array_sort("O").alias("O"), F.array_sort("D").alias("D")).agg(F.count("*").cast("double").alias("w"), F.avg("points").alias("y")))
    mean = t.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first().m or 0.0
    feats = F.concat(F.transform("O", lambda p: F.struct((p * 2).alias("f"), F.lit(1.0).alias("v"))), F.transform("D", lambda p: F.struct((p * 2 + 1).alias("f"), F.lit(1.0).alias("v"))))
    rows = t.select(feats.alias("x"), "w", (F.col("y") - mean).alias("y"))
    beta = estimate.ridge(rows, features="x", weight="w", target="y", alpha=2000.0)
    side = {}
    for f, v in beta.items():
        side.setdefault(f // 2, [0.0, 0.0])[f % 2] = v
    data = [(int(p), round(100 * o, 3), round(100 * d, 3), round(100 * (o - d), 3)) for p, (o, d) in sorted(side.items())]
    return spark.createDataFrame(data, "player_id bigint, off double, def double, net double")


_SKILL = """with g as (select *, lpad(regexp_replace(trim(game_id), '\\.0$', ''), 10, '0') as gid from player_game),
one as (select * from g qualify row_number() over (partition by player_id, gid order by loaded_ts desc nulls last) = 1)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per player and game, the last loaded; three-point attempts per 100 possessions."""
    p = table(spark, sf_dir, "player_game", ["player_id", "game_id", "game_date", "three_fga", "three_fgm", "off_poss", "pts", "fga", "fta", "loaded_ts"])
    p = p.withColumn("gid", pos.game_id(F.col("game_id"))).where("player_id is not null and gid is not null")
    last = p.groupBy("player_id", "gid").agg(F.max_by(F.struct("game_date", "three_fga", "three_fgm", "off_poss", "pts", "fga", "fta"), F.coalesce("loaded_ts", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r"))
    return last.select("player_id", F.col("gid").alias("game_id"), "r.*")


@query(_SKILL + """ select player_id, gid as game_id, sum(three_fga) over w as before_fga, sum(three_fgm) over w as before_fgm, round((coalesce(sum(three_fgm) over w, 0) + 35) / (coalesce(sum(three_fga) over w, 0) + 100.0), 6) as shrunk
from one window w as (partition by player_id order by game_date, gid rows between unbounded preceding and 1 preceding)""")
def skill_prior_only(spark, sf_dir):
    """Running three-point rate from games strictly before, shrunk to 35 in 100."""
    w = Window.partitionBy("player_id").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    a, m = F.sum("three_fga").over(w), F.sum("three_fgm").over(w)
    return _panel(spark, sf_dir).select("player_id", "game_id", a.alias("before_fga"), m.alias("before_fgm"), F.round((F.coalesce(m, F.lit(0)) + 35) / (F.coalesce(a, F.lit(0)) + 100.0), 6).alias("shrunk"))


@query(_SKILL + """ select player_id, count(*) as games, sum(pts)::bigint as pts, round(sum(pts) / nullif(2 * (sum(fga) + 0.44 * sum(fta)), 0), 6) as ts from one group by 1""")
def true_shooting(spark, sf_dir):
    return _panel(spark, sf_dir).groupBy("player_id").agg(F.count("*").alias("games"), F.sum("pts").alias("pts"), F.round(F.try_divide(F.sum("pts"), 2 * (F.sum("fga") + 0.44 * F.sum("fta"))), 6).alias("ts"))
