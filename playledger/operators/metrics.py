"""Rows of a target and its players per event or possession, from play-by-play with possessions.

All take the rows of ``possessions`` with ``shot_flags`` and work by windows over a game or a
possession; nothing is gathered. ``side`` is 'h' or 'a', the side whose text tells the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import says
from .possessions import FREE_THROW, HOME, MAKE, MISS, REBOUND, TURNOVER, in_game

#: zones of a shot, of which the parts of a possession's points are named
ZONES = ("rim", "mid", "three")


def told(rows: DataFrame) -> DataFrame:
    """rows with side ('h', 'a' or null) and points of the event."""
    side = F.when((F.col("t_h") != "") & (F.col("t_a") == ""), "h").when((F.col("t_a") != "") & (F.col("t_h") == ""), "a")
    return rows.withColumns({"side": side, "points": F.col("points_h") + F.col("points_a")})


def zone() -> Column:
    return F.when(F.col("is_fga") & F.col("is_three"), "three").when(F.col("is_fga") & F.col("is_rim"), "rim").when(F.col("is_fga"), "mid")


def own_lineup() -> Column:
    return F.when(F.col("side") == "h", F.col("l_h")).when(F.col("side") == "a", F.col("l_a"))


def shot_roles(rows: DataFrame) -> DataFrame:
    """game_id, event_num, player_id, role, points: per field-goal attempt one row of its shooter and one of
    each team-mate on the floor. Attempts whose shooter is not in the side's lineup give none."""
    shots = told(rows).where(F.col("is_fga") & F.col("side").isNotNull() & (F.col("player1_id") > 0)).withColumn("own", own_lineup())
    shots = shots.where(F.array_contains("own", F.col("player1_id")))
    each = shots.select("game_id", "event_num", "player1_id", "shot_points", F.explode(F.filter("own", lambda x: x > 0)).alias("player_id"))
    return each.select("game_id", "event_num", "player_id", F.when(F.col("player_id") == F.col("player1_id"), "shooter").otherwise("teammate").alias("role"), F.col("shot_points").alias("points"))


def scoring_roles(rows: DataFrame) -> DataFrame:
    """player_id, on_ball, off_ball: a shooter has a made shot's value, each team-mate a quarter of it."""
    r = shot_roles(rows).where("points > 0")
    return r.groupBy("player_id").agg(F.sum(F.when(F.col("role") == "shooter", F.col("points")).otherwise(0)).cast("double").alias("on_ball"), F.sum(F.when(F.col("role") == "teammate", F.col("points") / 4.0).otherwise(0.0)).alias("off_ball"))


def miss_rebounds(rows: DataFrame) -> DataFrame:
    """game_id, event_num, shooter_id, rebounder_id, won: per miss whose next event is a rebound, whether the
    shooter ('shooter'), a team-mate ('teammate') or the other side ('defense') has it."""
    r = told(rows)
    nxt = {k: F.lead(c).over(in_game()) for k, c in (("_n_type", "event_type"), ("_n_side", "side"), ("_n_player", "player1_id"))}
    m = r.withColumns(nxt).where((F.col("event_type") == MISS) & (F.col("_n_type") == REBOUND) & F.col("side").isNotNull() & F.col("_n_side").isNotNull())
    won = F.when(F.col("_n_side") != F.col("side"), "defense").when((F.col("_n_player") == F.col("player1_id")) & (F.col("player1_id") > 0), "shooter").otherwise("teammate")
    return m.select("game_id", "event_num", F.col("player1_id").alias("shooter_id"), F.col("_n_player").alias("rebounder_id"), won.alias("won"))


def assist_rows(rows: DataFrame) -> DataFrame:
    """game_id, event_num, receiver_id, passer, points: made shots with an assist; the passer as the text names it."""
    m = told(rows).where(F.col("is_assisted") & F.col("side").isNotNull())
    text = F.when(F.col("side") == "h", F.col("t_h")).otherwise(F.col("t_a"))
    return m.select("game_id", "event_num", F.col("player1_id").alias("receiver_id"), F.trim(F.regexp_extract(text, r"\(([^()]*?)\s+\d+ AST\)", 1)).alias("passer"), F.col("shot_points").alias("points"))


def chances(rows: DataFrame) -> DataFrame:
    """game_id, poss, points and their parts: of the first chance by zone, free throws of it, and all of the second.

    The first chance ends with the possession's first missed field goal. first_rim + first_mid +
    first_three + first_ft + second = points. missed_zone is the zone of that miss, or null.
    """
    r = told(rows).withColumns({"zone": zone(), "_miss": (F.col("event_type") == MISS).cast("int")})
    w = Window.partitionBy("game_id", "poss").orderBy("period", F.desc("clock"), "event_num")
    before = F.coalesce(F.max("_miss").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("_second", before == 1)
    # points of events that are no field goal stand with the free throws
    parts = [F.sum(F.when(~F.col("_second") & (F.col("zone") == z), F.col("points")).otherwise(0)).cast("bigint").alias(f"first_{z}") for z in ZONES]
    order = F.struct("period", (-F.col("clock")).alias("c"), "event_num")
    return r.groupBy("game_id", "poss").agg(
        F.sum("points").cast("bigint").alias("points"), *parts,
        F.sum(F.when(~F.col("_second") & F.col("zone").isNull(), F.col("points")).otherwise(0)).cast("bigint").alias("first_ft"),
        F.sum(F.when(F.col("_second"), F.col("points")).otherwise(0)).cast("bigint").alias("second"),
        F.min_by(F.when(F.col("_miss") == 1, F.col("zone")), F.when(F.col("_miss") == 1, order)).alias("missed_zone"),
    )


def continuation(parts: DataFrame) -> DataFrame:
    """missed_zone, n, later: mean points after a first miss, by its zone."""
    return parts.where("missed_zone is not null").groupBy("missed_zone").agg(F.count("*").alias("n"), F.avg("second").alias("later"))


def priced(parts: DataFrame) -> DataFrame:
    """parts with first_priced and second_priced: a first miss is worth what its zone's misses bring later,
    which the second chance then has less; their sum stays the points."""
    kappa = continuation(parts).select("missed_zone", "later")  # three zones
    j = parts.join(F.broadcast(kappa), "missed_zone", "left")
    later = F.coalesce("later", F.lit(0.0))
    return j.withColumns({"first_priced": F.col("points") - F.col("second") + later, "second_priced": F.col("second") - later}).drop("later")


def free_throw_trips(rows: DataFrame) -> DataFrame:
    """game_id, poss, trip, throws, made: a possession's free throws cut into trips by other shooters or by 'n of m'
    starting anew at 1."""
    r = told(rows).where((F.col("event_type") == FREE_THROW) & F.col("side").isNotNull())
    text = F.when(F.col("side") == "h", F.col("t_h")).otherwise(F.col("t_a"))
    r = r.withColumn("_first", F.coalesce(F.regexp_extract(text, r"(\d+) of \d+", 1) == "1", F.lit(False)))
    w = Window.partitionBy("game_id", "poss").orderBy("period", F.desc("clock"), "event_num")
    starts = F.col("_first") | (~F.col("player1_id").eqNullSafe(F.lag("player1_id").over(w)))
    r = r.withColumn("trip", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("game_id", "poss", "trip").agg(F.count("*").alias("throws"), F.sum("points").cast("bigint").alias("made"))


def stops(rows: DataFrame) -> DataFrame:
    """game_id, poss, stop: whether a possession ended in a turnover, or had a blocked shot whose next rebound of
    the next events is the defense's."""
    r = told(rows)
    blocked = (F.col("event_type") == MISS) & says(F.concat_ws(" ", "t_h", "t_a"), "block")
    r = r.withColumns({"_blocked": blocked, "_turned": F.col("event_type") == TURNOVER})
    shooter = F.when(says(F.col("t_h"), r"\bmiss\b"), "h").when(says(F.col("t_a"), r"\bmiss\b"), "a")
    ahead = F.array(*(F.struct(F.lead("event_type", k).over(in_game()).alias("t"), F.lead("side", k).over(in_game()).alias("s")) for k in range(1, 9)))
    next_board = F.get(F.filter(ahead, lambda x: x["t"] == REBOUND), F.lit(0))["s"]
    kept = F.col("_blocked") & F.coalesce(next_board != shooter, F.lit(False))
    return r.withColumn("_kept", kept).groupBy("game_id", "poss").agg((F.max(F.col("_turned").cast("int")) + F.max(F.col("_kept").cast("int")) > 0).alias("stop"))


def expected_values(rows: DataFrame) -> DataFrame:
    """game_id, event_num, zone, shot_points, ev, making: each attempt's value as its zone's mean, and what the shot
    gave beyond it."""
    r = rows.where("is_fga").withColumn("zone", zone())
    mean = r.groupBy("zone").agg(F.avg("shot_points").alias("ev"))  # three zones
    return r.join(F.broadcast(mean), "zone").select("game_id", "event_num", "zone", "shot_points", "ev", (F.col("shot_points") - F.col("ev")).alias("making"))


def sides_of_players(rows: DataFrame) -> DataFrame:
    """game_id, player_id, side, n: the side on whose lineups a player stands in most events (home in a tie)."""
    each = rows.select("game_id", F.explode(F.concat(F.transform("l_h", lambda p: F.struct(p.alias("p"), F.lit("h").alias("s"))), F.transform("l_a", lambda p: F.struct(p.alias("p"), F.lit("a").alias("s"))))).alias("x")).where("x.p > 0")
    n = each.groupBy("game_id", F.col("x.p").alias("player_id"), F.col("x.s").alias("side")).agg(F.count("*").alias("n"))
    return n.groupBy("game_id", "player_id").agg(F.max_by(F.struct("side", "n"), F.struct("n", "side")).alias("b")).select("game_id", "player_id", "b.side", "b.n")


def state_basis(margin: Column, period: Column, clock: Column) -> dict[str, Column]:
    """The state of a game as columns: six bins of margin by four periods, hinges of pressure, and the products
    of hinges of margin with hinges of the share left to play."""
    # fixed values: edges of margin and knots
    edges = (-15, -8, 0, 8, 15)
    out: dict[str, Column] = {}
    bound = [None, *edges, None]
    for i, (lo, hi) in enumerate(zip(bound, bound[1:], strict=False)):
        inside = (F.lit(True) if lo is None else margin > lo) & (F.lit(True) if hi is None else margin <= hi)
        for p in range(1, 5):
            out[f"bin_{i}_{p}"] = (inside & (F.least(period, F.lit(4)) == p)).cast("int")
    left = F.when(period <= 4, (4 - period) * 720 + clock).otherwise(clock) / 2880.0
    for k in (5, 10, 15, 20, 25):
        for sign, name in ((1, "lead"), (-1, "trail")):
            high = F.greatest(sign * margin - k, F.lit(0)).cast("double")
            for j, knot in enumerate((0.0, 0.25, 0.5, 0.75)):
                out[f"{name}_{k}_{j}"] = high * F.greatest(left - knot, F.lit(0.0))
    return out


def home_offense() -> Column:
    return F.col("poss_offense") == HOME


def made() -> Column:
    return F.col("event_type") == MAKE
