"""The core's training-data queries over the driver's tables (problems 2, 3, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import Drift
from ..operators.known_at import known_at
from ..operators.records import FEEDS, classify, typed_rows
from ..operators.snapshots import snapshot_changes
from ..tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Drift(table(spark, sf_dir, "skill_file_row")).changes()


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Drift(table(spark, sf_dir, "skill_file_row")).unified()


def p2_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = Drift(table(spark, sf_dir, "skill_file_row"))
    return drift.lines.select("stream_id", "field", "canonical", "first_seq", "last_seq", "files")


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of p2_table, one row per value: what the table holds of each payload."""
    return Drift(table(spark, sf_dir, "skill_file_row")).cells()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "epm_snapshot", ["requested_date", "player_id", "delivery_no", "row_no", "oepm", "depm"])
    found = snapshot_changes(rows, snapshot="requested_date", key="player_id", delivery="delivery_no", order="row_no", compare=["oepm", "depm"])
    return found.select(F.date_format("requested_date", "yyyy-MM-dd").alias("requested_date"), "player_id", "change_kind")


def _ten_digits(c: str) -> Column:
    t = F.regexp_replace(F.trim(F.col(c)), r"\.0$", "")
    return F.when(F.length(t) < 10, F.lpad(t, 10, "0")).otherwise(t)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game: the metadata row with the latest updated_ts (then the greatest)."""
    g = table(spark, sf_dir, "game_metadata", ["game_id", "game_date", "tipoff_utc", "updated_ts"]).withColumn("game_id", _ten_digits("game_id"))
    latest = g.where("game_id is not null").groupBy("game_id").agg(F.max(F.struct("updated_ts", "tipoff_utc", "game_date")).alias("_g"))
    return latest.select("game_id", F.col("_g.game_date").alias("game_date"), F.col("_g.tipoff_utc").alias("tipoff_utc"))


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def ratings_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct player and game of player_game with the epm and dpm known at its tip-off."""
    lines = table(spark, sf_dir, "player_game", ["player_id", "game_id"]).select("player_id", _ten_digits("game_id").alias("game_id")).distinct()
    events = lines.join(games(spark, sf_dir), "game_id", "left").select(F.col("player_id").alias("_entity"), F.col("game_date").alias("_date"), F.col("tipoff_utc").alias("_time"), "game_id")
    epm = table(spark, sf_dir, "epm_snapshot", ["requested_date", "player_id", "oepm", "delivery_no", "row_no", "fetched_ts"])
    rows = epm.groupBy("player_id", "requested_date", "delivery_no").agg(F.max(F.struct("row_no", "oepm", "fetched_ts")).alias("_r"))
    epm = rows.where(_present("_r.oepm")).select(
        F.col("player_id").alias("_entity"), F.col("requested_date").alias("_day"), F.col("delivery_no").cast("int").alias("_rank"), F.col("_r.fetched_ts").alias("_known"), F.col("_r.oepm").alias("_value")
    )
    history = table(spark, sf_dir, "player_rating_history", ["player_id", "dates", "dpm", "known_at"])
    zipped = history.select("player_id", F.posexplode(F.arrays_zip("dates", "dpm", "known_at")).alias("_p", "_r"))
    dpm = zipped.where(_present("_r.dpm")).select(
        F.col("player_id").alias("_entity"), F.col("_r.dates").alias("_day"), (F.col("_p") + 1).alias("_rank"), F.col("_r.known_at").alias("_known"), F.col("_r.dpm").alias("_value")
    )
    return known_at(events, {"epm": epm, "dpm": dpm})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ratings_known(spark, sf_dir)
    long = known.select(
        F.col("_entity").alias("player_id"), "game_id",
        F.explode(F.array(*(F.struct(F.lit(s).alias("rating_source"), F.col(s).alias("r")) for s in ("epm", "dpm")))).alias("_s"),
    )
    return long.where("_s.r is not null").select("player_id", "game_id", F.col("_s.rating_source").alias("rating_source"), F.date_format("_s.r._day", "yyyy-MM-dd").alias("as_of_date"), F.col("_s.r._rank").alias("version_no"))


def p4_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ratings_known(spark, sf_dir)
    return known.select(
        F.col("_entity").alias("player_id"), "game_id", F.date_format("_date", "yyyy-MM-dd").alias("game_date"),
        F.col("epm._value").alias("oepm"), F.col("dpm._value").alias("dpm"),
    )


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "feed_line", ["line_id", "file_name", "feed", "line_no", "line_text"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = classify(table(spark, sf_dir, "feed_line", ["line_id", "feed", "line_text"]))
    return lines.where("reason is not null").select("line_id", "reason")


def p5_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("reason is not null").select("line_id", "file_name", "line_no", "reason", F.col("_error_offset").alias("error_offset"), F.col("_bad_field").alias("bad_field"), "line_text")


def p5_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_rows(_feed(spark, sf_dir), "substitution", ["line_id"])


def p5_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_rows(_feed(spark, sf_dir), "game_metadata", ["line_id"])


def p5_free_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_rows(_feed(spark, sf_dir), "free_throw", ["line_id"])


QUERIES = {f.__name__: f for f in (p2_found, p2_table, p2_catalogue, p2_cells, p3_found, p4_found, p4_ratings, p5_found, p5_rejected, p5_substitutions, p5_games, p5_free_throws)}

_GAMES = """
g as (select lpad(regexp_replace(trim(game_id), '\\.0$', ''), 10, '0') as game_id, game_date, tipoff_utc, updated_ts from game_metadata),
games as (select game_id, game_date, tipoff_utc from g where game_id is not null
          qualify row_number() over (partition by game_id order by updated_ts desc nulls last, tipoff_utc desc nulls last, game_date desc nulls last) = 1),
pairs as (select distinct player_id, lpad(regexp_replace(trim(game_id), '\\.0$', ''), 10, '0') as game_id from player_game),
ev as (select p.player_id, p.game_id, game_date, tipoff_utc from pairs p left join games using (game_id)),
epm as (select player_id, requested_date, delivery_no, oepm, fetched_ts from epm_snapshot
        qualify row_number() over (partition by player_id, requested_date, delivery_no order by row_no desc nulls last) = 1),
hist as (select player_id, unnest(range(1, len(dates) + 1)) as pos, unnest(dates) as d, unnest(dpm) as v, unnest(known_at) as k from player_rating_history),
known as (
  select ev.player_id, ev.game_id, 'epm' as rating_source, requested_date as d, delivery_no as n, oepm as v
  from ev join epm on epm.player_id = ev.player_id and requested_date <= game_date and fetched_ts <= tipoff_utc
  where oepm is not null and not isnan(oepm)
  qualify row_number() over (partition by ev.player_id, ev.game_id order by requested_date desc, delivery_no desc) = 1
  union all
  select ev.player_id, ev.game_id, 'dpm', d, pos, v
  from ev join hist on hist.player_id = ev.player_id and d <= game_date and k <= tipoff_utc
  where v is not null and not isnan(v)
  qualify row_number() over (partition by ev.player_id, ev.game_id order by d desc, pos desc) = 1)
"""

_FIELD = '("(?:[^"]|"")*"|[^",]*)'


def _value(name: str, k: int) -> str:
    """SQL of the k-th field of a line of the feed, unquoted."""
    line = "^" + ",".join([_FIELD] * len(FEEDS[name])) + "$"
    raw = f"regexp_extract(t, '{line}', {k}, 's')"
    return f"case when {raw} like '\"%' then replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') else {raw} end"


def _bare(name: str, k: int) -> str:
    return f"regexp_replace({_value(name, k)}, '^\\s+|\\s+$', '', 'g')"


def _p5_base() -> str:
    """Lines with reason, bad_field and error_offset."""
    counts, bad = [], []
    for name, columns in FEEDS.items():
        line = "^" + ",".join([_FIELD] * len(columns)) + "$"
        counts.append(f"when feed = '{name}' and not regexp_matches(t, '{line}', 's') then 'column_count'")
        tests = []
        for k, (column, (form, kind)) in enumerate(columns.items(), 1):
            if form is None:
                continue
            test = f"not regexp_full_match({_bare(name, k)}, '(?:{form})')"
            if kind == "date":
                test = f"({test} or try_cast({_bare(name, k)} as date) is null)"
            tests.append(f"when {test} then '{column}'")
        bad.append(f"when feed = '{name}' and regexp_matches(t, '{line}', 's') then case {' '.join(tests)} end")
    known = ", ".join(f"'{n}'" for n in FEEDS)
    return f"""l as (select line_id, file_name, line_no, feed, line_text, coalesce(line_text, '') as t from feed_line),
q as (select *, not regexp_matches(t, '^{_FIELD}(,{_FIELD})*$', 's') as broken, regexp_extract(t, '^(?:(?:"(?:[^"]|"")*"|[^",]*),)*', 0, 's') as pre from l),
h as (select *, substr(t, length(pre) + 1) as rest from q),
o as (select *, regexp_extract(rest, '^"(?:[^"]|"")*"', 0, 's') as quoted, regexp_extract(rest, '^[^",]+', 0, 's') as plain from h),
b as (select *, case when not broken then case {' '.join(bad)} end end as bad_field,
  case when broken then case when rest not like '"%' then strlen(pre) + strlen(plain) when quoted <> '' and substr(rest, length(quoted) + 1, 1) <> '"' then strlen(pre) + strlen(quoted) else strlen(t) end end as error_offset from o),
r as (select *, case when broken then 'quoting' {' '.join(counts)} when feed is null or feed not in ({known}) then 'column_count' when bad_field is not null then 'invalid_value' end as reason from b)"""


def _p5_typed(name: str) -> str:
    """SQL of the valid lines of a feed with typed columns."""
    out = []
    for k, (column, (form, kind)) in enumerate(FEEDS[name].items(), 1):
        t = _value(name, k) if form is None else _bare(name, k)
        if kind == "game_id":
            t = f"lpad(regexp_replace({t}, '[.]0$', ''), 10, '0')"
        elif kind == "boolean":
            t = f"lower({t}) in ('true', '1')"
        elif kind != "string":
            t = f"try_cast({t} as {kind})"
        out.append(f"{t} as {column}")
    return f"with {_p5_base()} select line_id, {', '.join(out)} from r where feed = '{name}' and reason is null"


_DRIFT = r"""
kv as (select stream_id, file_id, row_no, j.key as field, j.value as v, j.type as jt,
         json_extract_string(payload, '$.player_id') || chr(31) || coalesce(json_extract_string(payload, '$.game_id'), json_extract_string(payload, '$.requested_date')) as rk
       from skill_file_row, json_each(case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload else '{}' end) j),
typed as (select stream_id, file_id, row_no, field, rk, v::varchar as v,
         case when jt in ('UBIGINT', 'BIGINT', 'HUGEINT') then 'integer' when jt = 'DOUBLE' then 'decimal' when jt = 'VARCHAR' then 'string' when jt in ('OBJECT', 'ARRAY', 'BOOLEAN') then lower(jt) end as k,
         case when jt in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') then v::double::varchar when jt != 'NULL' then v::varchar end as t from kv),
files as (select stream_id, file_id, dense_rank() over (partition by stream_id order by min(delivered_ts) nulls first, file_id) as seq from skill_file_row group by stream_id, file_id),
last_seq as (select stream_id, max(seq) as files from files group by stream_id),
votes as (select stream_id, file_id, field, k, count(k) as n, list_position(['integer', 'decimal', 'string', 'object', 'array', 'boolean'], k) as o from typed group by all),
cat as (select v.stream_id, v.file_id, seq, field, k as kind from votes v join files f using (stream_id, file_id)
        qualify row_number() over (partition by v.stream_id, v.file_id, field order by n desc, o) = 1),
isl as (select stream_id, field, seq, seq - row_number() over (partition by stream_id, field order by seq) as g from cat),
spans as (select stream_id, field, min(seq) as first_seq, max(seq) as last_seq, any_value(files) as files from isl join last_seq using (stream_id) group by stream_id, field, g),
gone as (select stream_id, last_seq + 1 as seq, field as old_field from spans where last_seq < files),
come as (select stream_id, first_seq as seq, field as new_field from spans where first_seq > 1),
recs as (select distinct stream_id, file_id, row_no, rk from typed where rk is not null),
pairs as (select g.stream_id, g.seq, old_field, new_field, x.t as ot, y.t as nt, coalesce(x.k != a.kind, false) or coalesce(y.k != b.kind, false) as aside
  from gone g join come c on g.stream_id = c.stream_id and g.seq = c.seq
  join cat a on a.stream_id = g.stream_id and a.seq = g.seq - 1 and a.field = old_field
  join cat b on b.stream_id = g.stream_id and b.seq = g.seq and b.field = new_field
  join recs r on r.stream_id = g.stream_id and r.file_id = a.file_id
  join recs q on q.stream_id = g.stream_id and q.file_id = b.file_id and q.rk = r.rk
  left join typed x on x.stream_id = r.stream_id and x.file_id = r.file_id and x.row_no = r.row_no and x.field = old_field
  left join typed y on y.stream_id = q.stream_id and y.file_id = q.file_id and y.row_no = q.row_no and y.field = new_field),
fit as (select stream_id, seq, old_field, new_field, count(*) filter (where not aside and ot = nt) as alike from pairs
  group by all having alike > 0 and count(*) filter (where not aside and ot is distinct from nt) = 0),
ren as (select stream_id, seq, old_field, new_field from fit
  qualify row_number() over (partition by stream_id, seq, old_field order by alike desc, new_field) = 1 and row_number() over (partition by stream_id, seq, new_field order by alike desc, old_field) = 1),
links as (select r.stream_id, new_field as field, r.seq as first_seq, n.field as to_field, n.first_seq as to_seq from ren r join spans n on n.stream_id = r.stream_id and n.field = old_field and n.last_seq = r.seq - 1),
roots as (select stream_id, field, first_seq, last_seq, files, field as canonical, first_seq as origin_seq from spans s
    where not exists (select 1 from links l where l.stream_id = s.stream_id and l.field = s.field and l.first_seq = s.first_seq)
  union all select s.stream_id, s.field, s.first_seq, s.last_seq, s.files, r.canonical, r.origin_seq from spans s
    join links l on l.stream_id = s.stream_id and l.field = s.field and l.first_seq = s.first_seq
    join roots r on r.stream_id = l.stream_id and r.field = l.to_field and r.first_seq = l.to_seq),
lanes as (select stream_id, canonical, origin_seq, case when max(max(last_seq)) over (partition by stream_id, canonical order by origin_seq rows between unbounded preceding and 1 preceding) >= origin_seq
    then canonical || '#' || origin_seq else canonical end as lane from roots group by stream_id, canonical, origin_seq),
lines as (select r.stream_id, field, lane as canonical, r.origin_seq, first_seq, last_seq, files from roots r join lanes using (stream_id, canonical, origin_seq)),
named as (select c.*, l.canonical, last_value(kind ignore nulls) over (partition by c.stream_id, l.canonical, l.origin_seq order by c.seq) as carried,
    last_value(kind ignore nulls) over (partition by c.stream_id, l.canonical, l.origin_seq order by c.seq rows between unbounded preceding and 1 preceding) as earlier
  from cat c join lines l on l.stream_id = c.stream_id and l.field = c.field and c.seq between l.first_seq and l.last_seq)
"""
_P2 = {
    "p2_found": f"""with recursive {_DRIFT},
log as (select stream_id, seq, 'renamed' as change_kind, old_field, new_field from ren
  union all select stream_id, seq, 'added', '', new_field from come anti join ren using (stream_id, seq, new_field)
  union all select stream_id, seq, 'removed', old_field, '' from gone anti join ren using (stream_id, seq, old_field)
  union all select stream_id, seq, 'retyped', field, field from named where kind != earlier)
select file_id, change_kind, old_field, new_field from log join files using (stream_id, seq)""",
    "p2_catalogue": f"with recursive {_DRIFT} select stream_id, field, canonical, first_seq::int as first_seq, last_seq::int as last_seq, files::int as files from lines",
    "p2_cells": f"""with recursive {_DRIFT},
numeric as (select canonical, bool_or(coalesce(kind in ('integer', 'decimal'), false)) as is_number from named group by canonical),
vals as (select t.*, n.canonical, is_number, case when k in ('integer', 'decimal') then t.v when k = 'object' then json_extract_string(t.v, '$.value')
    when k = 'array' then regexp_extract(t.v, '^\\["?([^,"\\[\\]{{}}]*)"?\\]$', 1) when k = 'string' then json_extract_string(t.v, '$') end as inner_text
  from typed t join named n using (stream_id, file_id, field) join numeric using (canonical) where t.t is not null),
cells as (select *, case when is_number and regexp_full_match(inner_text, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?') then inner_text::double end as number from vals)
select stream_id, file_id, row_no, canonical as field, number, case when not is_number and k = 'string' then json_extract_string(v, '$') end as text,
  case when is_number and number is null or not is_number and k != 'string' then v
       when is_number and k = 'object' and len(json_keys(v)) > 1 then '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: '"' || x || '":' || json_extract(v, x)::varchar), ',') || '}}' end as raw
from cells""",
}


SQL = _P2 | {
    "p3_found": """
with d as (select requested_date, max(delivery_no) as delivery_no, row_number() over (order by requested_date) as seq from epm_snapshot where requested_date is not null group by 1),
s as (select seq, d.requested_date, player_id, case when isnan(oepm) then null else round(oepm, 3) end as o, case when isnan(depm) then null else round(depm, 3) end as e
      from epm_snapshot join d using (requested_date, delivery_no) where player_id is not null
      qualify row_number() over (partition by d.requested_date, player_id order by row_no desc nulls last) = 1),
b as (select s.*, d.requested_date as next_date from s join d on d.seq = s.seq + 1)
select strftime(coalesce(b.next_date, s.requested_date), '%Y-%m-%d') as requested_date, coalesce(s.player_id, b.player_id) as player_id,
       case when b.player_id is null then 'added' when s.player_id is null then 'removed' else 'changed' end as change_kind
from (select * from s where seq > 1) s full join b on s.seq = b.seq + 1 and s.player_id = b.player_id
where b.player_id is null or s.player_id is null or s.o is distinct from b.o or s.e is distinct from b.e
""",
    "p4_found": f"with {_GAMES} select player_id, game_id, rating_source, strftime(d, '%Y-%m-%d') as as_of_date, n::int as version_no from known",
    "p4_ratings": f"""with {_GAMES} select ev.player_id, ev.game_id, strftime(game_date, '%Y-%m-%d') as game_date,
       max(v) filter (where rating_source = 'epm') as oepm, max(v) filter (where rating_source = 'dpm') as dpm
       from ev left join known k on k.player_id = ev.player_id and k.game_id = ev.game_id group by ev.player_id, ev.game_id, game_date""",
    "p5_found": f"with {_p5_base()} select line_id, reason from r where reason is not null",
    "p5_rejected": f"with {_p5_base()} select line_id, file_name, line_no, reason, error_offset::bigint as error_offset, case when reason = 'invalid_value' then bad_field end as bad_field, line_text from r where reason is not null",
    "p5_substitutions": _p5_typed("substitution"),
    "p5_games": _p5_typed("game_metadata"),
    "p5_free_throws": _p5_typed("free_throw"),
}
