"""Play-by-play events to possessions: order, scores, terminal events, offense, lineups, numerators.

Every step is a window over one game in the order of its clock, so the whole chain needs a single
exchange by game_id. Rules are written once for a side and its opponent and applied to both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import game_id, says

HOME, AWAY = "Home", "Away"
SIDES = (("h", "a", HOME, AWAY), ("a", "h", AWAY, HOME))
# fixed values: event types of the feed
MAKE, MISS, FREE_THROW, REBOUND, TURNOVER, FOUL, SUBSTITUTION, END_OF_PERIOD = 1, 2, 3, 4, 5, 6, 8, 13
# fixed values: action types of shots at the rim, and of dunks
RIM_ACTIONS = (5, 6, 41, 43, 75, 98, 99, 100, 7, 9, 50, 52, 87, 107, 108, 97)
DUNK_ACTIONS = (7, 9, 50, 52, 87, 107, 108)
# fixed values: texts of free throws that cannot end a possession, and of those that can
NOT_LAST = r"\b(1 of [23]|2 of 3|Technical|Flagrant)\b"
LAST = r"\b(1 of 1|2 of 2|3 of 3)\b"
LAST_FLAGRANT = "Flagrant (2 of 2|3 of 3)"
DEFAULT_FT, DEFAULT_THREE = 0.75, 0.35



def in_game():
    """A game in the order of its clock."""
    return Window.partitionBy("game_id").orderBy("period", F.desc("clock"), "event_num")


def so_far():
    return in_game().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return in_game().rowsBetween(Window.unboundedPreceding, -1)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _first(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first case that holds, else ''."""
    out = F.lit("")
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def timeline(events: DataFrame, *, allow_partial: bool = False) -> DataFrame:
    """One row per event in play order, with texts, lineup arrays and the points it scored.

    Copies (equal game, period, clock and event number) count once. Without ``allow_partial`` rows
    with a null lineup slot are left out; a slot of 0 is a known gap. Null texts become ''. Scores
    start at 0 and are carried forward. Rows without game, period, clock or number have no place.
    """
    home, away = ([f"{side}_player{i}" for i in range(1, 6)] for side in ("home", "away"))
    clock = F.col("minute_remaining_quarter") * 60 + F.col("seconds_remaining_quarter")
    rows = events.select(
        game_id(F.col("game_id")).alias("game_id"), "period", clock.alias("clock"), "event_num", "event_type", "event_action_type", "seconds_remaining_quarter",
        F.coalesce("home_description", F.lit("")).alias("t_h"), F.coalesce("visitor_description", F.lit("")).alias("t_a"), F.coalesce("neutral_description", F.lit("")).alias("t_n"),
        "player1_id", "player1_team_id", "player1_team_abbreviation", "home_score", "away_score", "received_ts",
        F.array(*(F.coalesce(c, F.lit(0)).cast("bigint") for c in home)).alias("l_h"), F.array(*(F.coalesce(c, F.lit(0)).cast("bigint") for c in away)).alias("l_a"),
        _any([F.col(c).isNull() for c in (*home, *away)]).alias("_gap"),
    ).where("game_id is not null and period is not null and clock is not null and event_num is not null")
    copies = Window.partitionBy("game_id").orderBy("period", F.desc("clock"), "event_num", F.col("received_ts").asc_nulls_last())
    same = (F.lag("event_num").over(copies) == F.col("event_num")) & (F.lag("clock").over(copies) == F.col("clock")) & (F.lag("period").over(copies) == F.col("period"))
    rows = rows.withColumn("_copy", F.coalesce(same, F.lit(False))).where("not _copy")
    if not allow_partial:
        rows = rows.where("not _gap")
    for side in ("h", "a"):
        packed = F.array_distinct(F.filter(f"l_{side}", lambda x: x > 0))
        rows = rows.withColumn(f"l_{side}", F.slice(F.concat(packed, F.array_repeat(F.lit(0).cast("bigint"), 5)), 1, 5))
    rows = rows.drop("_copy", "_gap", "received_ts")

    def points(s: str) -> Column:
        t, missed = F.col(f"t_{s}"), says(F.col(f"t_{s}"), r"\bMISS\b")
        three = says(t, "3PT")
        return F.when(says(t, "Free Throw") & ~missed, 1).when(says(t, "PTS") & ~three & (F.col("event_type") == MAKE), 2).when(three & ~missed, 3).otherwise(0)

    scores = {}
    for c in ("home_score", "away_score"):
        start = F.when((F.row_number().over(in_game()) == 1) & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
        scores[c] = start
    rows = rows.withColumns(scores | {"points_h": points("h"), "points_a": points("a")})
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in ("home_score", "away_score")})
    margin = F.col("home_score") - F.col("away_score")
    return rows.withColumn("score_margin", F.when(margin == 0, "TIE").otherwise(margin.cast("int").cast("string")))


def terminals(rows: DataFrame) -> DataFrame:
    """timeline with eop (the event ends its possession), offense ('Home', 'Away' or '') and off_ft_reb."""
    blank = F.lit("")
    near = {}
    for s in ("h", "a"):
        near |= {f"p_{s}": F.coalesce(F.lag(f"t_{s}").over(in_game()), blank), f"pp_{s}": F.coalesce(F.lag(f"t_{s}", 2).over(in_game()), blank), f"n_{s}": F.coalesce(F.lead(f"t_{s}").over(in_game()), blank)}
    near |= {"n_type": F.lead("event_type").over(in_game()), "p_seconds": F.lag("seconds_remaining_quarter").over(in_game())}
    rows = rows.withColumns(near)
    kind = F.col("event_type")
    next_is = F.coalesce(F.col("n_type"), F.lit(-1))

    rules: dict[str, list[tuple[Column, str]]] = {k: [] for k in ("flagrant", "board", "board_any", "turnover", "make", "last_ft", "foul", "missed_ft", "shot", "ft")}
    second = []
    for s, o, own, other in SIDES:
        t, po, ppo, no = (F.col(f"{k}_{x}") for k, x in (("t", s), ("p", o), ("pp", o), ("n", o)))
        ns, ps = F.col(f"n_{s}"), F.col(f"p_{s}")
        board = says(t, "REBOUND")
        rules["flagrant"].append((says(t, LAST_FLAGRANT), own))
        rules["board"].append((board & says(po, "MISS") & ~says(po, NOT_LAST), other))
        rules["board_any"].append((board & says(po, "MISS"), other))
        rules["turnover"].append((says(t, "Turnover"), own))
        rules["make"].append((says(t, "PTS") & (kind == MAKE) & ~no.rlike("S.FOUL"), own))
        rules["last_ft"].append((says(t, LAST) & says(t, "PTS") & ~(says(ppo, "Transition") | says(po, "Transition") | says(t, "Flagrant")), own))
        rules["foul"].append(((kind == FOUL) & says(t, "offensive|charge") & (next_is != TURNOVER), own))
        own_board = (next_is == REBOUND) & says(ns, "REBOUND")
        other_board = (next_is == REBOUND) & says(no, "REBOUND")
        live = (own_board & ~says(ns, "deadball") & ~says(ns, "team defensive rebound")) | (other_board & ~says(no, "deadball") & ~says(no, "team offensive rebound"))
        rules["missed_ft"].append(((kind == FREE_THROW) & says(t, LAST) & says(t, r"\bMISS\b") & ~says(t, "technical") & ~live, own))
        rules["shot"].append((kind.isin(MAKE, MISS) & (says(t, "PTS") | says(t, "MISS")), own))
        rules["ft"].append(((kind == FREE_THROW) & says(t, "Free Throw"), own))
        second.append(board & says(ps, "MISS") & says(ps, "Free Throw") & ~says(ps, NOT_LAST))
    ends = [(kind == END_OF_PERIOD) & (F.col("p_seconds") > 0), kind == TURNOVER]
    ends += [c for k in ("flagrant", "board", "make", "last_ft", "foul", "missed_ft") for c, _ in rules[k]]
    order = ("flagrant", "board_any", "turnover", "make", "last_ft", "foul", "missed_ft", "shot", "ft")
    return rows.withColumns({"eop": F.coalesce(_any(ends), F.lit(False)), "offense": _first([case for k in order for case in rules[k]]), "off_ft_reb": _any(second)})


def neutral_offense(rows: DataFrame, games: DataFrame, teams: DataFrame) -> DataFrame:
    """offense of turnovers told neutrally, by the only team of the game whose label the text has.

    games: game_id, home_team_id, away_team_id; teams: team_id and label columns.
    """
    labels = teams.select("team_id", F.array_distinct(F.filter(F.transform(F.array("team_abbreviation", "team_city", "team_nickname"), _label), lambda x: x != "")).alias("_labels"))
    g = games.join(labels.select(F.col("team_id").alias("home_team_id"), F.col("_labels").alias("_lh")), "home_team_id", "left")
    g = g.join(labels.select(F.col("team_id").alias("away_team_id"), F.col("_labels").alias("_la")), "away_team_id", "left").select("game_id", "_lh", "_la")
    text = F.concat(F.lit(" "), _label(F.col("t_n")), F.lit(" "))

    def named(c: str) -> Column:
        return F.coalesce(F.exists(c, lambda x: text.contains(F.concat(F.lit(" "), x, F.lit(" ")))), F.lit(False))

    asked = (F.col("event_type") == TURNOVER) & (F.col("offense") == "") & says(F.col("t_n"), "Turnover")
    told = F.when(named("_lh") & ~named("_la"), HOME).when(named("_la") & ~named("_lh"), AWAY).otherwise("")
    return rows.join(g, "game_id", "left").withColumn("offense", F.when(asked, told).otherwise(F.col("offense"))).drop("_lh", "_la")


def _label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def foul_lineups(rows: DataFrame) -> DataFrame:
    """Lineups at a foul carried over the free throws it gives, to the end of the possession.

    A foul with a free throw and a substitution among the next rows gives its lineups to the rows
    after it, up to the next terminal event, or up to before the next offensive rebound of a free
    throw, if a free throw lies between. The first such foul of a stretch counts. Where the lineups
    at that rebound differ from those at the foul, the row before it becomes terminal.
    """
    quiet = r"T\.FOUL|FLAGRANT|Offens|Transition"
    kind = F.col("event_type")

    def ahead(t: int) -> Column:
        n = F.sum((kind == t).cast("int")).over(in_game().rowsBetween(0, 4))
        return F.when(F.lead(F.lit(1), 4).over(in_game()).isNull(), 0).otherwise(n)

    foul = (kind == FOUL) & (ahead(FREE_THROW) > 0) & (ahead(SUBSTITUTION) > 0) & ~F.col("t_a").rlike(quiet) & ~F.col("t_h").rlike(quiet)
    rows = rows.withColumns({"_foul": foul, "_stop": F.col("eop") | F.col("off_ft_reb")})
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.col("_stop").cast("int")).over(before()), F.lit(0)))
    part = Window.partitionBy("game_id", "_part").orderBy("period", F.desc("clock"), "event_num")
    throws_after = F.sum((kind == FREE_THROW).cast("int")).over(part.rowsBetween(1, Window.unboundedFollowing))
    both = F.struct("l_h", "l_a")
    rows = rows.withColumns({"_from": F.when(F.col("_foul") & ~F.col("_stop") & (F.coalesce(throws_after, F.lit(0)) > 0), both), "_any": F.when(F.col("_foul") & ~F.col("_stop"), both)})
    upto = part.rowsBetween(Window.unboundedPreceding, -1)
    held, at_foul = F.first("_from", ignorenulls=True).over(upto), F.first("_any", ignorenulls=True).over(upto)
    rows = rows.withColumns({"_held": F.when(~F.col("off_ft_reb") | F.col("eop"), held), "_changed": F.col("off_ft_reb") & ~F.col("eop") & at_foul.isNotNull() & (at_foul != both)})
    rows = rows.withColumns({"l_h": F.coalesce("_held.l_h", "l_h"), "l_a": F.coalesce("_held.l_a", "l_a"), "eop": F.col("eop") | F.coalesce(F.lead("_changed").over(in_game()), F.lit(False))})
    return rows.drop("_foul", "_stop", "_part", "_from", "_any", "_held", "_changed")


def fill_lineups(rows: DataFrame) -> DataFrame:
    """Terminal rows with fewer than four known players of a side take its gaps from rows before."""
    out = {}
    few = _any([F.size(F.filter(f"l_{s}", lambda x: x > 0)) < 4 for s in ("h", "a")]) & F.col("eop")
    for s in ("h", "a"):
        slots = []
        for i in range(5):
            slot = F.get(f"l_{s}", F.lit(i))
            slots.append(F.when(slot > 0, slot).otherwise(F.coalesce(F.last(F.when(slot > 0, slot), ignorenulls=True).over(so_far()), F.lit(0))))
        out[f"l_{s}"] = F.when(few, F.array(*slots)).otherwise(F.col(f"l_{s}"))
    return rows.withColumns(out)


def possessions(rows: DataFrame) -> DataFrame:
    """terminals with poss (from 0 in each game) and poss_offense.

    A possession's offense is that of its next row that tells it, else of the last one before; a
    terminal row still without it takes the other side of the period's terminal before.
    """
    rows = rows.withColumn("poss", F.coalesce(F.sum(F.col("eop").cast("int")).over(before()), F.lit(0)))
    own = Window.partitionBy("game_id", "poss").orderBy("period", F.desc("clock"), "event_num")
    told = F.when(F.col("offense") != "", F.col("offense"))
    rows = rows.withColumn("_o", F.coalesce(F.first(told, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.last(told, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    period = Window.partitionBy("game_id", "period").orderBy(F.desc("clock"), "event_num").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("eop") & F.col("_o").isNotNull(), F.col("_o")), ignorenulls=True).over(period)
    turned = F.when(last == HOME, AWAY).when(last == AWAY, HOME)
    return rows.withColumn("poss_offense", F.coalesce("_o", F.when(F.col("eop"), turned), F.lit(""))).drop("_o")


def shot_flags(rows: DataFrame) -> DataFrame:
    """is_fga, is_three, is_rim, is_dunk, is_assisted and the shot's points of each event."""
    text = F.concat_ws(" ", "t_h", "t_a")
    kind, action = F.col("event_type"), F.coalesce(F.col("event_action_type"), F.lit(-1))
    make = kind == MAKE
    three = says(text, "3PT")
    return rows.withColumns(
        {
            "is_fga": kind.isin(MAKE, MISS), "is_three": three, "is_rim": action.isin(*RIM_ACTIONS) | says(text, r"layup|dunk|\btip\b"), "is_dunk": action.isin(*DUNK_ACTIONS) | says(text, r"\bdunk\b"),
            "is_assisted": make & says(text, r"\(.*\d+ AST\)"), "shot_points": F.when(make & three, 3).when(make, 2).otherwise(0),
        }
    )


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _text() -> Column:
    return F.concat_ws(" ", "t_h", "t_a", "t_n")


#: What each metric counts per event; a possession has the sum since the terminal before.
METRICS: dict[str, Callable[[], Column]] = {
    "points": lambda: F.col("points_h") + F.col("points_a"),
    "fga": lambda: _flag(F.col("is_fga")),
    "turnovers": lambda: _flag(F.col("event_type") == TURNOVER),
    "bad_passes": lambda: _flag((F.col("event_type") == TURNOVER) & says(_text(), "bad pass")),
    "other_turnovers": lambda: _flag((F.col("event_type") == TURNOVER) & ~says(_text(), "bad pass")),
    "rim_attempts": lambda: _flag(F.col("is_fga") & F.col("is_rim") & ~F.col("is_three")),
    "rim_makes": lambda: _flag((F.col("event_type") == MAKE) & F.col("is_rim") & ~F.col("is_three")),
    "three_attempts": lambda: _flag(F.col("is_fga") & F.col("is_three")),
    "three_makes": lambda: _flag((F.col("event_type") == MAKE) & F.col("is_three")),
    "mid_attempts": lambda: _flag(F.col("is_fga") & ~F.col("is_three") & ~F.col("is_rim")),
    "mid_makes": lambda: _flag((F.col("event_type") == MAKE) & ~F.col("is_three") & ~F.col("is_rim")),
    "dunks": lambda: _flag((F.col("event_type") == MAKE) & F.col("is_dunk")),
    "assist_points": lambda: F.when(F.col("is_assisted"), F.col("shot_points")).otherwise(0),
    "rim_assists": lambda: _flag(F.col("is_assisted") & F.col("is_rim") & ~F.col("is_three")),
    "dunk_assists": lambda: _flag(F.col("is_assisted") & F.col("is_dunk")),
    "free_throws": lambda: _flag(F.col("event_type") == FREE_THROW),
    "free_throw_points": lambda: F.when(F.col("event_type") == FREE_THROW, F.col("points_h") + F.col("points_a")).otherwise(0),
    "offensive_rebounds": lambda: _flag(F.col("_own_board")),
    "transition": lambda: _flag(says(_text(), "transition")),
}


def possession_table(rows: DataFrame, metrics: dict[str, Callable[[], Column]] = METRICS) -> DataFrame:
    """One row per possession: its terminal event, offense, lineups O and D, and its numerators.

    A numerator is the difference of running totals at successive terminals of a game, so what
    happens after the last terminal is in no possession. second_chance_points are the points after
    the possession's first missed field goal.
    """
    own_board = _any([says(F.col(f"t_{s}"), "REBOUND") & says(F.col(f"p_{s}"), "MISS") for s in ("h", "a")])
    rows = shot_flags(rows).withColumn("_own_board", (F.col("event_type") == REBOUND) & own_board)
    own = Window.partitionBy("game_id", "poss").orderBy("period", F.desc("clock"), "event_num").rowsBetween(Window.unboundedPreceding, -1)
    after_miss = F.coalesce(F.max((F.col("event_type") == MISS).cast("int")).over(own), F.lit(0))
    rows = rows.withColumns({f"_m_{k}": f() for k, f in metrics.items()} | {"_m_second_chance_points": F.when(after_miss == 1, F.col("points_h") + F.col("points_a")).otherwise(0)})
    names = [*metrics, "second_chance_points"]
    rows = rows.withColumns({f"_m_{k}": F.sum(f"_m_{k}").over(so_far()) for k in names}).where("eop")
    rows = rows.select("*", *((F.col(f"_m_{k}") - F.lag(f"_m_{k}", 1, 0).over(in_game())).cast("bigint").alias(k) for k in names))
    home = F.col("poss_offense") == HOME
    sides = {"O": F.when(home, F.col("l_h")).otherwise(F.col("l_a")), "D": F.when(home, F.col("l_a")).otherwise(F.col("l_h"))}
    return rows.withColumns(sides).select("game_id", "poss", "period", "clock", "event_num", "poss_offense", "O", "D", "home_score", "away_score", "score_margin", *names)


def complete(table: DataFrame, least: int = 5) -> DataFrame:
    """Possessions with at least ``least`` known players a side, none on both, and a known offense."""
    known = [F.size(F.array_distinct(F.filter(c, lambda x: x > 0))) >= least for c in ("O", "D")]
    both = F.arrays_overlap(F.filter("O", lambda x: x > 0), F.filter("D", lambda x: x > 0))
    return table.where(known[0] & known[1] & ~both & (F.col("poss_offense") != ""))


def luck_adjusted(rows: DataFrame, rates: DataFrame, share_off: float = 1.0, share_def: float = 1.0) -> DataFrame:
    """Expected points per event: free throws at the shooter's rate, threes blended with their result.

    rates: player_id, ft_rate, three_rate; missing rates take the defaults.
    """
    j = rows.join(rates.select(F.col("player_id").alias("player1_id"), "ft_rate", "three_rate"), "player1_id", "left")
    ft, three = F.coalesce("ft_rate", F.lit(DEFAULT_FT)), F.coalesce("three_rate", F.lit(DEFAULT_THREE)) * 3
    text = F.concat_ws(" ", "t_h", "t_a")
    actual = (F.col("points_h") + F.col("points_a")).cast("double")
    is_three = says(text, "3PT")

    def value(blend: float | None) -> Column:
        shot = actual if blend is None else blend * three + (1 - blend) * actual
        return F.when((F.col("event_type") == FREE_THROW) | says(text, "Free Throw"), ft).when((F.col("event_type") == MAKE) & says(text, "PTS") & ~is_three, F.lit(2.0)).when(is_three, shot).otherwise(F.lit(0.0))

    return j.withColumns({"value": value(None), "value_off": value(share_off), "value_def": value(share_def)})
