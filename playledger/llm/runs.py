"""Runs of repeated consecutive events, collapsed into one event with count and duration.

Only boundary rows are kept: a row that differs from the row before it starts a run. Leads over the
starts give the rest: the difference of positions is the number of reports, the row before the next
start is the run's end. Sequences are cut into buckets of time, each with the few rows before it
that its first row can still belong to, so that no sequence has to fit one task; pieces of a run
that crosses a bucket's edge are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 60
GAP_S = 2


def link_items(events: DataFrame) -> DataFrame:
    """What two reports of one occurrence must agree in, wherever both tell it.

    Columns: game_id, period, clock, event_num, event_type, received_ts, and of free throws (3) and
    fouls (6) player, kind, number, outcome, points, fouls; each is null where the row does not
    tell it. Kind and number are read from the text, and from the action type if there is no text.
    """
    kind_of = F.col("event_type")
    ours = kind_of.isin(3, 6)
    text = F.upper(F.regexp_replace(F.concat_ws(" ", "home_description", "neutral_description", "visitor_description"), r"[\s\p{Z}]+", " "))
    base = events.select(
        "game_id",
        "period",
        (F.col("minute_remaining_quarter") * 60 + F.col("seconds_remaining_quarter")).alias("clock"),
        "event_num",
        "event_type",
        "received_ts",
        F.when(ours & (F.col("player1_id") != 0), F.col("player1_id")).alias("player"),
        F.when(ours, text).alias("t"),
        F.when(ours, F.col("event_action_type")).alias("a"),
    ).where("game_id is not null and period is not null and clock is not null and event_num is not null")

    def found(pattern: str, group: int = 1) -> Column:
        x = F.regexp_extract("t", pattern, group)
        return F.when(x != "", x)

    blank = F.trim("t") == ""
    # fixed values: the feed's action types of free throws and their places
    place = F.when(F.col("a").isin(10, 11, 13), 1).when(F.col("a").isin(12, 14), 2).when(F.col("a") == 15, 3)
    throw_kind = (
        F.when(F.col("t").contains("TECHNICAL"), "TECHNICAL")
        .when(F.col("t").contains("FLAGRANT"), "FLAGRANT")
        .when(F.col("t").rlike(r"CLEAR\s*PATH"), "CLEAR PATH")
        .when(F.col("t").rlike(r"FREE\s*THROW"), "ORDINARY")
        .when(blank & F.col("a").between(10, 15), "ORDINARY")
    )
    foul_kind = F.coalesce(F.concat(found(r"(\S+)\.FOUL"), F.regexp_extract("t", r"FOUL\.TYPE\s*(\d+)", 1)), F.when(blank, F.get(F.array(F.lit(None), F.lit("P"), F.lit("S"), F.lit("L.B")), F.col("a"))))
    throw = F.col("event_type") == 3
    foul = F.col("event_type") == 6
    points = found(r"\(\s*(\d+)\s*PTS?\s*\)").cast("int")
    return base.select(
        "game_id", "period", "clock", "event_num", "event_type", "received_ts", "player",
        F.when(throw, throw_kind).when(foul, foul_kind).alias("kind"),
        F.when(throw, F.coalesce(found(r"(\d+)\s*OF\s*\d+").cast("int"), F.when(blank, place))).alias("number"),
        F.when(throw, F.when(F.col("t").rlike(r"(^|\W)MISS(ED)?\W"), 0).when(points.isNotNull(), 1)).alias("outcome"),
        F.when(throw, points).alias("points"),
        F.when(foul, found(r"\(\s*P(\d+)").cast("int")).alias("fouls"),
    )


ITEMS = ("player", "kind", "number", "outcome", "points", "fouls")


def collapse(items: DataFrame, *, bucket_s: int = BUCKET_S, gap_s: int = GAP_S) -> DataFrame:
    """One row per run or single event: game_id, period, event_type, first_event_num,
    last_event_num, n_reports, duration_s (clock of the first less that of the last report).

    items has the columns of ``link_items``. Order in a game is period, clock from high to low,
    event_num. Rows of equal game and event_num are copies and count once, by the one received first
    (of these the one of the lowest period, then clock). Rows follow each other in a run if they are neighbours in that
    order, of the same period, both free throws or both fouls, at most ``gap_s`` apart, and agree in
    each item that both tell. Rows without game, period, clock or event_num have no place in the
    order; they are in no run and part none. An empty table gives no rows.
    """
    bucket = F.floor(F.col("clock") / bucket_s)
    # a row also goes to the next bucket if that one's first row may follow it within the gap
    reach = (F.col("clock") - bucket * bucket_s) < gap_s
    # copies may tell another clock, so they are left out before rows are cut into buckets
    first = Window.partitionBy("game_id", "event_num").orderBy(F.col("received_ts").asc_nulls_last(), "period", "clock")
    items = items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    placed = items.withColumn("_b", F.explode(F.when(reach & (bucket > 0), F.array(bucket, bucket - 1)).otherwise(F.array(bucket)))).withColumn("_halo", F.col("_b") != bucket)
    part = ["game_id", "period", "_b"]
    clock_down = F.col("clock").desc()
    w = Window.partitionBy(*part).orderBy(clock_down, "event_num")
    agree = (F.lag("event_type").over(w) == F.col("event_type")) & F.col("event_type").isin(3, 6) & (F.lag("clock").over(w) - F.col("clock") <= gap_s)
    for c in ITEMS:
        agree = agree & F.coalesce(F.lag(c).over(w) == F.col(c), F.lit(True))
    linked = placed.select(*part, "clock", "event_num", "event_type", "_halo", F.coalesce(agree, F.lit(False)).alias("_linked"), F.lag("event_num").over(w).alias("_prev_event"), F.lag("clock").over(w).alias("_prev_clock"))
    own = linked.where(~F.col("_halo"))
    whole = Window.partitionBy(*part).orderBy(clock_down, "event_num").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = own.select("*", F.row_number().over(w).alias("_pos"), F.count("*").over(whole).alias("_n"), F.last("event_num").over(whole).alias("_end_event"), F.last("clock").over(whole).alias("_end_clock"))
    starts = counted.where(~F.col("_linked") | (F.col("_pos") == 1))
    pieces = starts.select(
        *part,
        "event_type",
        F.col("clock").alias("first_clock"),
        F.col("event_num").alias("first_event_num"),
        F.coalesce(F.lead("_pos").over(w) - F.col("_pos"), F.col("_n") + 1 - F.col("_pos")).cast("bigint").alias("n_reports"),
        F.coalesce(F.lead("_prev_event").over(w), F.col("_end_event")).alias("last_event_num"),
        F.coalesce(F.lead("_prev_clock").over(w), F.col("_end_clock")).alias("last_clock"),
        F.col("_linked").alias("_joins"),
        F.lead("_pos").over(w).isNull().alias("_is_last"),
    )
    # pieces that may touch another at a bucket's edge, within the gap; all others are whole
    edge = F.col("_joins") | (F.col("_is_last") & F.col("event_type").isin(3, 6) & (F.col("_b") > 0) & (F.col("last_clock") - F.col("_b") * bucket_s < gap_s))
    columns = ["game_id", "period", "event_type", "first_event_num", "last_event_num", "n_reports", (F.col("first_clock") - F.col("last_clock")).alias("duration_s")]
    order = Window.partitionBy("game_id", "period").orderBy(F.col("first_clock").desc(), "first_event_num")
    island = F.sum((~F.col("_joins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.struct((-F.col("first_clock")).alias("c"), "first_event_num")
    stitched = (
        pieces.where(edge)
        .withColumn("_run", island)
        .groupBy("game_id", "period", "_run")
        .agg(
            F.min_by("event_type", at).alias("event_type"), F.min_by("first_event_num", at).alias("first_event_num"), F.max_by("last_event_num", at).alias("last_event_num"),
            F.sum("n_reports").alias("n_reports"), F.max("first_clock").alias("first_clock"), F.min("last_clock").alias("last_clock"),
        )
    )
    return pieces.where(~edge).select(columns).unionByName(stitched.select(columns))


def runs(events: DataFrame) -> DataFrame:
    """The runs of two or more reports of one free throw or foul in a play-by-play table."""
    return collapse(link_items(events)).where("n_reports >= 2")
