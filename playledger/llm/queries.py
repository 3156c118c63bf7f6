"""Registered queries of the subpackage (problems 1, 6, 7 and 8) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from . import encoding, packing, runs, tokenizer

_EVENT = [
    "game_id", "event_num", "event_type", "event_action_type", "period", "minute_remaining_quarter", "seconds_remaining_quarter",
    "home_description", "neutral_description", "visitor_description", "player1_id", "received_ts",
]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(table(spark, sf_dir, "raw_event", _EVENT)).select("game_id", "first_event_num", "last_event_num")


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sequence with each run as one event, its number of reports and its duration."""
    return runs.collapse(runs.link_items(table(spark, sf_dir, "raw_event", _EVENT)))


def p1_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose first report ft_sequence lists, with the declared total of free throws."""
    found = runs.runs(table(spark, sf_dir, "raw_event", _EVENT))
    seq = table(spark, sf_dir, "ft_sequence", ["game_id", "foul_idx", "ft_indices"])
    listed = seq.select("game_id", F.explode(F.concat(F.coalesce("ft_indices", F.array().cast("array<bigint>")), F.array("foul_idx"))).alias("event_num")).distinct()
    totals = table(spark, sf_dir, "parsed_free_throw", ["game_id", "event_num", "declared_total"]).groupBy("game_id", "event_num").agg(F.max("declared_total").alias("declared_total"))
    joined = found.withColumn("event_num", F.col("first_event_num")).join(listed, ["game_id", "event_num"]).join(totals, ["game_id", "event_num"], "left")
    return joined.select("game_id", "event_type", "first_event_num", "last_event_num", "n_reports", F.col("duration_s").cast("bigint").alias("duration_s"), "declared_total")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, sf_dir, "documents", ["doc_id", "text"]), "text", "ids").select("doc_id", "ids")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their ids; an empty and a null text give an empty one."""
    return p6_ids(spark, sf_dir).select("doc_id", tokenizer.decode(F.col("ids")).alias("text"))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(tokenizer.token_counts(table(spark, sf_dir, "documents", ["doc_id", "text"]), "text", key="doc_id"))
    kinds = table(spark, sf_dir, "container_kind", ["kind_id", "capacity_tokens"])
    return packing.pack(sizes, kinds, key="doc_id", size="n_tokens", kind="kind_id", capacity="capacity_tokens"), kinds


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = _placed(spark, sf_dir)
    return placed.select("kind_id", F.col("container").alias("container_id"), "doc_id", "piece_no", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, kinds = _placed(spark, sf_dir)
    return packing.report(placed, kinds, kind="kind_id", capacity="capacity_tokens")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.found(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_events, p1_listed, p6_ids, p6_decoded, p7_containers, p7_fill, p8_found, p8_restored)}

_RUNS = r"""
once as (select distinct on (game_id, event_num) * from raw_event where game_id is not null and event_num is not null order by game_id, event_num, received_ts),
txt as (select game_id, period, 60 * minute_remaining_quarter + seconds_remaining_quarter as clock, event_num, event_type, nullif(player1_id, 0) as player,
  event_action_type as a, upper(regexp_replace(concat_ws(' ', home_description, neutral_description, visitor_description), '[\s\p{Z}]+', ' ', 'g')) as t from once),
itm as (select *, case when event_type = 3 then case when t like '%TECHNICAL%' then 'TECHNICAL' when t like '%FLAGRANT%' then 'FLAGRANT'
    when regexp_matches(t, 'CLEAR\s*PATH') then 'CLEAR PATH' when regexp_matches(t, 'FREE\s*THROW') or a between 10 and 15 then 'ORDINARY' end
  when event_type = 6 then coalesce(nullif(regexp_extract(t, '(\S+)\.FOUL', 1), '') || regexp_extract(t, 'FOUL\.TYPE\s*(\d+)', 1), case when trim(t) = '' then case a when 1 then 'P' when 2 then 'S' when 3 then 'L.B' end end) end as kind,
  case when event_type = 3 then coalesce(try_cast(nullif(regexp_extract(t, '(\d+)\s*OF\s*\d+', 1), '') as int),
    case when trim(t) = '' then case when a in (10, 11, 13) then 1 when a in (12, 14) then 2 when a = 15 then 3 end end) end as number,
  case when event_type = 3 then case when regexp_matches(t, '(^|\W)MISS(ED)?\W') then 0 when regexp_matches(t, '\(\s*\d+\s*PTS?\s*\)') then 1 end end as outcome,
  case when event_type = 3 then try_cast(nullif(regexp_extract(t, '\(\s*(\d+)\s*PTS?\s*\)', 1), '') as int) end as points,
  case when event_type = 6 then try_cast(nullif(regexp_extract(t, '\(\s*P(\d+)', 1), '') as int) end as fouls
  from txt where period is not null and clock is not null),
lk as (select *, coalesce(event_type in (3, 6) and lag(event_type) over w = event_type and lag(period) over w = period and lag(clock) over w - clock <= 2
  and coalesce(lag(player) over w = player, true) and coalesce(lag(kind) over w = kind, true) and coalesce(lag(number) over w = number, true)
  and coalesce(lag(outcome) over w = outcome, true) and coalesce(lag(points) over w = points, true) and coalesce(lag(fouls) over w = fouls, true), false) as linked
  from itm window w as (partition by game_id order by period, clock desc, event_num)),
isl as (select *, sum(case when linked then 0 else 1 end) over (partition by game_id order by period, clock desc, event_num rows unbounded preceding) as run from lk),
seq as (select game_id, period, event_type, first(event_num order by clock desc, event_num) as first_event_num, last(event_num order by clock desc, event_num) as last_event_num,
  count(*) as n_reports, max(clock) - min(clock) as duration_s from isl group by game_id, period, event_type, run)
"""

SQL = {
    "p1_found": f"with {_RUNS} select game_id, first_event_num, last_event_num from seq where n_reports >= 2",
    "p1_events": f"with {_RUNS} select game_id, period, event_type, first_event_num, last_event_num, n_reports, duration_s from seq",
    "p1_listed": f"""with {_RUNS},
      ls as (select game_id, unnest(ft_indices) as event_num from ft_sequence union select game_id, foul_idx from ft_sequence),
      tot as (select game_id, event_num, max(declared_total) as declared_total from parsed_free_throw group by 1, 2)
      select s.game_id, event_type, first_event_num, last_event_num, n_reports, duration_s::bigint as duration_s, declared_total
      from seq s join ls on ls.game_id = s.game_id and ls.event_num = s.first_event_num
      left join tot on tot.game_id = s.game_id and tot.event_num = s.first_event_num where n_reports >= 2""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
