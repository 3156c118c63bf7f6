"""Relational, window and scalar operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import estimate, joins, stats, windows
from ..operators.ranks import running
from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query (a function of a reader of tables) with its SQL."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name, *columns: table(spark, sf_dir, name, columns or None))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


EVENT_ORDER = ("ts", "event_id")


def _events():
    return windows.ordered(["user_id"], EVENT_ORDER)


def _n(c: str, k: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), k)


# possessions in miniature: sequences closed by a terminal event


@query("""with i as (select *, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as island from events)
select user_id, island::bigint as island, count(*) as n_events, min(event_id) as first_event, max(event_id) as last_event from i group by user_id, island""")
def possession_islands(t):
    e = t("events", "user_id", "event_id", "ts", "event_type")
    i = e.withColumn("island", windows.closed_islands(F.col("event_type") == "purchase", _events()))
    return i.groupBy("user_id", "island").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""with r as (select *, sum(value) over (partition by user_id order by ts, event_id) as total from events),
x as (select user_id, event_id, ts, total from r where event_type = 'purchase')
select user_id, event_id, round(total - coalesce(lag(total) over (partition by user_id order by ts, event_id), 0), 4) as points from x""")
def possession_points(t):
    e = t("events", "user_id", "event_id", "ts", "event_type", "value").withColumn("total", F.sum("value").over(_events().rowsBetween(*windows.UPTO)))
    x = e.where("event_type = 'purchase'")
    return x.select("user_id", "event_id", F.round(F.col("total") - F.coalesce(F.lag("total").over(_events()), F.lit(0.0)), 4).alias("points"))


@query("""with i as (select *, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as island from events),
s as (select *, coalesce(max((event_type = 'click')::int) over (partition by user_id, island order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as seen from i)
select user_id, island::bigint as island, round(sum(case when seen = 0 then value else 0 end), 4) as first_chance, round(sum(case when seen = 1 then value else 0 end), 4) as second_chance from s group by user_id, island""")
def possession_first_second_chance(t):
    e = t("events", "user_id", "event_id", "ts", "event_type", "value")
    i = e.withColumn("island", windows.closed_islands(F.col("event_type") == "purchase", _events()))
    w = windows.ordered(["user_id", "island"], EVENT_ORDER).rowsBetween(*windows.PRIOR)
    seen = F.coalesce(F.max((F.col("event_type") == "click").cast("int")).over(w), F.lit(0))
    s = i.withColumn("seen", seen)
    return s.groupBy("user_id", "island").agg(F.round(F.sum(F.when(F.col("seen") == 0, F.col("value")).otherwise(0.0)), 4).alias("first_chance"), F.round(F.sum(F.when(F.col("seen") == 1, F.col("value")).otherwise(0.0)), 4).alias("second_chance"))


@query("""with i as (select *, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as island from events),
c as (select *, case when event_type = 'click' and coalesce(lag(event_type) over (partition by user_id, island order by ts, event_id), '') <> 'click' then 1 else 0 end as starts from i),
t as (select *, sum(starts) over (partition by user_id, island order by ts, event_id) as trip from c)
select user_id, island::bigint as island, trip::bigint as trip, count(*) as n_clicks, round(sum(value), 4) as value from t where event_type = 'click' group by user_id, island, trip""")
def possession_subtrips(t):
    e = t("events", "user_id", "event_id", "ts", "event_type", "value")
    i = e.withColumn("island", windows.closed_islands(F.col("event_type") == "purchase", _events()))
    w = windows.ordered(["user_id", "island"], EVENT_ORDER)
    start = (F.col("event_type") == "click") & (F.coalesce(F.lag("event_type").over(w), F.lit("")) != "click")
    trips = i.withColumn("starts", start.cast("int")).withColumn("trip", F.sum("starts").over(w.rowsBetween(*windows.UPTO)))
    return trips.where("event_type = 'click'").groupBy("user_id", "island", "trip").agg(F.count("*").alias("n_clicks"), F.round(F.sum("value"), 4).alias("value"))


# sequence functions


@query("""select event_id, coalesce(lag(event_type) over w, '') as prev1, coalesce(lag(event_type, 2) over w, '') as prev2, coalesce(lead(event_type) over w, '') as next1, round(value - lag(value, 1, 0.0) over w, 4) as step from events window w as (partition by user_id order by ts, event_id)""")
def event_lag_lead(t):
    w = _events()
    blank = F.lit("")
    return t("events", "user_id", "event_id", "ts", "event_type", "value").select(
        "event_id", F.coalesce(F.lag("event_type").over(w), blank).alias("prev1"), F.coalesce(F.lag("event_type", 2).over(w), blank).alias("prev2"),
        F.coalesce(F.lead("event_type").over(w), blank).alias("next1"), F.round(F.col("value") - F.lag("value", 1, 0.0).over(w), 4).alias("step"),
    )


@query("""select event_id, case when lead(1, 4) over w is null then 0 else sum((event_type = 'click')::int) over (partition by user_id order by ts, event_id rows between current row and 4 following) end::bigint as clicks_ahead
from events window w as (partition by user_id order by ts, event_id)""")
def lookahead5_count(t):
    return t("events", "user_id", "event_id", "ts", "event_type").select("event_id", windows.ahead_count(F.col("event_type") == "click", _events(), 5).cast("bigint").alias("clicks_ahead"))


@query("""with m as (select *, case when event_type = 'signup' then event_id end as mark from events)
select event_id, coalesce(first_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following),
 last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) as filled,
 last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as forward from m""")
def fill_backward_forward(t):
    m = t("events", "user_id", "event_id", "ts", "event_type").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    w = _events()
    return m.select("event_id", F.coalesce(windows.fill_backward(F.col("mark"), w), windows.fill_forward(F.col("mark"), w)).alias("filled"), windows.fill_forward(F.col("mark"), w).alias("forward"))


@query("""with c as (select *, case when row_number() over w = 1 then 1 when event_type is distinct from lag(event_type) over w then 1 else 0 end as ch from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(ch) over (partition by user_id order by ts, event_id) as run from c)
select user_id, run::bigint as run, min(event_type) as event_type, count(*) as n, min(event_id) as first_event from r group by user_id, run""")
def value_change_runs(t):
    w = _events()
    c = t("events", "user_id", "event_id", "ts", "event_type").withColumn("ch", windows.change_islands(F.col("event_type"), w))
    r = c.withColumn("run", F.sum("ch").over(w.rowsBetween(*windows.UPTO)))
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""with m as (select *, case when value < 1 then null else value end as seen from events)
select event_id, round(coalesce(last_value(seen ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0), 4) as repaired from m""")
def sparse_state_repair(t):
    m = t("events", "user_id", "event_id", "ts", "value").withColumn("seen", F.when(F.col("value") >= 1, F.col("value")))
    return m.select("event_id", F.round(F.coalesce(windows.fill_forward(F.col("seen"), _events()), F.lit(0.0)), 4).alias("repaired"))


@query("""with d as (select user_id, ts::date as day, sum(value) as v, count(*) as n from events group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as day, round(coalesce(sum(v) over w, 0), 4) as before_value, coalesce(sum(n) over w, 0)::bigint as before_n
from d window w as (partition by user_id order by day rows between unbounded preceding and 1 preceding)""")
def exclusive_cumsum_by_day(t):
    d = t("events", "user_id", "ts", "value").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    w = windows.ordered(["user_id"], ["day"])
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(windows.prior_sum(F.col("v"), w), 4).alias("before_value"), windows.prior_sum(F.col("n"), w).alias("before_n"))


@query("""select event_id, round(sum(value) over w / count(value) over w, 5) as ratio from events window w as (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding)""")
def trailing10_ratio(t):
    w = _events().rowsBetween(-10, -1)
    return t("events", "user_id", "event_id", "ts", "value").select("event_id", F.round(F.sum("value").over(w) / F.nullif(F.count("value").over(w), F.lit(0)), 5).alias("ratio"))


@query("""select event_id, round(avg(value) over w, 5) as mean5, case when count(value) over w = 5 then round(sum(value) over w, 4) end as full5 from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""")
def rolling_mean_min1(t):
    w = _events().rowsBetween(-4, 0)
    return t("events", "user_id", "event_id", "ts", "value").select("event_id", F.round(F.avg("value").over(w), 5).alias("mean5"), F.when(F.count("value").over(w) == 5, F.round(F.sum("value").over(w), 4)).alias("full5"))


@query("""select l_orderkey, l_linenumber, rank() over w as r_min, row_number() over (partition by l_orderkey order by l_quantity, l_linenumber) as r_first,
rank() over w + (count(*) over (partition by l_orderkey, l_quantity) - 1) / 2 as r_avg, dense_rank() over w as r_dense from lineitem window w as (partition by l_orderkey order by l_quantity)""")
def running_ranks(t):
    w = windows.ordered(["l_orderkey"], ["l_quantity"])
    first = windows.ordered(["l_orderkey"], ["l_quantity", "l_linenumber"])
    avg = windows.average_rank(w, Window.partitionBy("l_orderkey", "l_quantity"))
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.rank().over(w).cast("bigint").alias("r_min"), F.row_number().over(first).cast("bigint").alias("r_first"), avg.alias("r_avg"), F.dense_rank().over(w).cast("bigint").alias("r_dense"))


@query("""with o as (select o_custkey, o_orderkey, o_totalprice, datediff('day', date '1990-01-01', o_orderdate::date) as age from orders),
f as (select *, age - first_value(age) over (partition by o_custkey order by age, o_orderkey) as rel from o)
select o_orderkey, round(sum(o_totalprice * pow(2.0, rel / 90.0)) over (partition by o_custkey order by age, o_orderkey rows unbounded preceding) * pow(2.0, -rel / 90.0), 3) as decayed from f""")
def decayed_sum_halflife(t):
    o = t("orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("age", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")))
    w = windows.ordered(["o_custkey"], ["age", "o_orderkey"])
    return o.select("o_orderkey", F.round(windows.decayed_sum(F.col("o_totalprice"), F.col("age"), 90.0, w), 3).alias("decayed"))


@query("""with r as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) - 1 as age from orders)
select o_custkey, round(sum(o_totalprice * pow(0.5, age / 5.0)) / sum(pow(0.5, age / 5.0)), 4) as ewma from r group by o_custkey""")
def ewma_rank_age(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = t("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("weight", F.pow(F.lit(0.5), (F.row_number().over(w) - 1) / 5.0))
    return r.groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * F.col("weight")) / F.sum("weight"), 4).alias("ewma"))


@query("""with d as (select *, max(o_orderdate::date) over () as last from orders)
select o_custkey, round(sum(o_totalprice * pow(0.5, datediff('day', o_orderdate::date, last) / 700.0)) / sum(pow(0.5, datediff('day', o_orderdate::date, last) / 700.0)), 3) as decayed_mean from d group by o_custkey""")
def time_decay_weighted_mean(t):
    o = t("orders", "o_custkey", "o_totalprice", "o_orderdate").withColumn("d", F.to_date("o_orderdate"))
    last = o.agg(F.max("d")).scalar()
    weight = F.pow(F.lit(0.5), F.datediff(last, "d") / 700.0)
    return o.groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * weight) / F.sum(weight), 3).alias("decayed_mean"))


@query("""select user_id, count(*) as sessions, max(n)::bigint as longest from (
 select user_id, session, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (
  select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 6 hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id))) group by 1, 2) group by user_id""")
def gap_sessions(t):
    w = _events()
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = t("events", "user_id", "event_id", "ts").withColumn("new", F.when(gap.isNull() | (gap > 6 * 3_600_000_000), 1).otherwise(0))
    s = e.withColumn("session", F.sum("new").over(w.rowsBetween(*windows.UPTO))).groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


# joins


@query("""select o.o_orderkey, e.event_id as event_id from orders o asof left join (select * from events where event_type = 'purchase') e on o.o_custkey = e.user_id and o.o_orderdate > e.ts""")
def asof_strict_by_key(t):
    e = t("events", "event_id", "user_id", "ts", "event_type").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"), "event_id", "ts")
    o = t("orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return joins.asof_join(o, e, left_on="o_orderdate", right_on="ts", by=["o_custkey"], values=["event_id"], strict=True, ties=["event_id"]).select("o_orderkey", "event_id")


_DAILY = "(select user_id, ts::date as d, sum(value) as v from events group by 1, 2)"


@query(f"""with d as {_DAILY} select e.event_id, strftime(d.d, '%Y-%m-%d') as as_of, round(d.v, 4) as day_value from events e asof left join d on e.user_id = d.user_id and e.ts::date >= d.d""")
def asof_inclusive_by_key(t):
    e = t("events", "event_id", "user_id", "ts", "value").withColumn("d", F.to_date("ts"))
    d = e.groupBy("user_id", "d").agg(F.sum("value").alias("v"))
    got = joins.asof_join(e.select("event_id", "user_id", "d"), d, left_on="d", right_on="d", by=["user_id"], values=["v"])
    return got.select("event_id", F.date_format("_at", "yyyy-MM-dd").alias("as_of"), F.round("v", 4).alias("day_value"))


@query(f"""with d as {_DAILY} select e.event_id, case when datediff('day', d.d, e.ts::date) <= 2 then strftime(d.d, '%Y-%m-%d') end as as_of from events e asof left join d on e.user_id = d.user_id and e.ts::date > d.d""")
def asof_stale_window(t):
    e = t("events", "event_id", "user_id", "ts", "value").withColumn("d", F.to_date("ts"))
    d = e.groupBy("user_id", "d").agg(F.sum("value").alias("v"))
    got = joins.asof_join(e.select("event_id", "user_id", "d"), d, left_on="d", right_on="d", by=["user_id"], values=["v"], strict=True, stale=2)
    return got.select("event_id", F.date_format("_at", "yyyy-MM-dd").alias("as_of"))


@query("""with d as (select ts::date as d, sum(value) as v from events group by 1)
select e.event_id, strftime(d.d, '%Y-%m-%d') as as_of from events e asof left join d on e.ts::date > d.d""")
def asof_global(t):
    e = t("events", "event_id", "ts").withColumn("d", F.to_date("ts"))
    days = e.select("d").distinct()
    prev = days.select("d", F.lag("d").over(Window.orderBy("d")).alias("as_of"))  # one row per day
    return e.join(prev, "d").select("event_id", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


_STINTS = """st as (select user_id, event_id as stint, epoch(ts) as s, epoch(lead(ts) over (partition by user_id order by ts, event_id)) as e from events where event_type = 'signup')"""


@query(f"""with {_STINTS} select p.event_id, st.stint from events p join st on p.user_id = st.user_id and epoch(p.ts) >= st.s and epoch(p.ts) < st.e where p.event_type = 'purchase'""")
def interval_stab_join(t):
    ev = t("events", "event_id", "user_id", "ts", "event_type").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    st = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("stint"), F.col("sec").alias("s"), F.lead("sec").over(windows.ordered(["user_id"], ["ts", "event_id"])).alias("e"))
    return joins.interval_join(ev.where("event_type = 'purchase'"), st, at="sec", start="s", end="e", by=["user_id"], width=86400.0 * 3).select("event_id", "stint")


@query("""select a.event_id as out_event, b.event_id as in_event from events a join events b on a.user_id = b.user_id and abs(epoch(a.ts) - epoch(b.ts)) < 3600 where a.event_type = 'click' and b.event_type = 'view'""")
def tolerance_pairs(t):
    ev = t("events", "event_id", "user_id", "ts", "event_type").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("out_event"), F.col("sec").alias("a"))
    b = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("in_event"), F.col("sec").alias("b"))
    return joins.tolerance_join(a, b, left_on="a", right_on="b", by=["user_id"], tolerance=3600.0).select("out_event", "in_event")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_join(t):
    return t("customer", "c_custkey").join(t("orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def semi_join(t):
    return t("customer", "c_custkey").join(t("orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""select coalesce(a.k, b.k) as k, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'left_only' else 'right_only' end as side, coalesce(a.n, 0) as orders, coalesce(b.n, 0) as events
from (select o_custkey as k, count(*) as n from orders group by 1) a full join (select user_id as k, count(*) as n from events group by 1) b on a.k = b.k""")
def full_outer_provenance(t):
    a = t("orders", "o_custkey").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = t("events", "user_id").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("events"))
    return joins.full_with_provenance(a, b, ["k"]).select("k", F.col("_merge").alias("side"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("events", F.lit(0)).alias("events"))


@query("""select r_name, n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate >= timestamp '1995-01-01' group by r_name, n_name""")
def n_way_inner(t):
    o = t("orders", "o_orderkey", "o_custkey", "o_orderdate").where("o_orderdate >= timestamp '1995-01-01'")
    j = t("lineitem", "l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select l_orderkey, l_linenumber, coalesce(p_brand, 'unknown') as brand, coalesce(p_size, 0) as size from lineitem left join (select * from part where p_size <= 25) on l_partkey = p_partkey")
def left_dimension_fill(t):
    j = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(t("part", "p_partkey", "p_brand", "p_size").where("p_size <= 25"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce("p_brand", F.lit("unknown")).alias("brand"), F.coalesce("p_size", F.lit(0)).alias("size"))


@query("""select a, b, count(*) as together from (select distinct x.l_orderkey, x.l_suppkey as a, y.l_suppkey as b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey) group by a, b""")
def self_pairs(t):
    return joins.unordered_pairs(t("lineitem", "l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("together"))


@query("""with y as (select o_custkey, year(o_orderdate)::int as yr, sum(o_totalprice) as v from orders group by 1, 2)
select a.o_custkey, a.yr, round(a.v, 2) as this_year, round(b.v, 2) as next_year from y a join y b on a.o_custkey = b.o_custkey and b.yr = a.yr + 1""")
def consecutive_period_self_join(t):
    y = t("orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("v"))
    b = y.select("o_custkey", (F.col("yr") - 1).alias("yr"), F.col("v").alias("nv"))
    return y.join(b, ["o_custkey", "yr"]).select("o_custkey", "yr", F.round("v", 2).alias("this_year"), F.round("nv", 2).alias("next_year"))


@query("""select d.doc_id, t.team_id from documents d join team t on d.team_id = t.team_id where contains(lower(d.text), lower(t.team_nickname))""")
def theta_text_join(t):
    j = t("documents", "doc_id", "text", "team_id").join(t("team", "team_id", "team_nickname"), "team_id")
    return j.where(F.contains(F.lower("text"), F.lower("team_nickname"))).select("doc_id", "team_id")


# aggregates


@query("""with s as (select l_partkey, l_orderkey, l_linenumber, l_discount, sum(l_discount) over p as s, count(*) over p as n, avg(l_discount) over () as g from lineitem window p as (partition by l_partkey))
select l_orderkey, l_linenumber, round((s - l_discount + 20 * g) / (n - 1 + 20), 9) as estimate from s""")
def loo_eb_one_level(t):
    li = t("lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_discount")
    return li.withColumn("g", li.agg(F.avg("l_discount")).scalar()).select("l_orderkey", "l_linenumber", F.round(windows.leave_one_out("l_discount", ["l_partkey"], F.col("g"), 20.0), 9).alias("estimate"))


@query("""with a as (select *, avg(l_discount) over () as g from lineitem),
b as (select *, (sum(l_discount) over p - l_discount + 30 * g) / (count(*) over p - 1 + 30) as e1 from a window p as (partition by l_returnflag)),
c as (select *, (sum(l_discount) over p - l_discount + 20 * e1) / (count(*) over p - 1 + 20) as e2 from b window p as (partition by l_returnflag, l_suppkey)),
d as (select *, (sum(l_discount) over p - l_discount + 10 * e2) / (count(*) over p - 1 + 10) as e3 from c window p as (partition by l_returnflag, l_suppkey, l_linenumber))
select l_orderkey, l_linenumber, round(e3, 9) as estimate from d""")
def loo_eb_nested3(t):
    li = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_discount")
    x = li.withColumn("g", li.agg(F.avg("l_discount")).scalar())
    # the widest level has few keys: its sums come from an aggregate, not from a window
    flag = li.groupBy("l_returnflag").agg(F.sum("l_discount").alias("fs"), F.count("l_discount").alias("fn"))
    x = x.join(flag, "l_returnflag").withColumn("e1", (F.col("fs") - F.col("l_discount") + 30 * F.col("g")) / (F.col("fn") - 1 + 30))
    x = x.withColumn("e2", windows.leave_one_out("l_discount", ["l_returnflag", "l_suppkey"], F.col("e1"), 20.0))
    x = x.withColumn("e3", windows.leave_one_out("l_discount", ["l_returnflag", "l_suppkey", "l_linenumber"], F.col("e2"), 10.0))
    return x.select("l_orderkey", "l_linenumber", F.round("e3", 9).alias("estimate"))


@query("""select l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 7) as wmean, round(sum(l_quantity * (l_discount - l_tax) * (l_discount - l_tax)) / sum(l_quantity), 8) as wmse from lineitem group by 1""")
def weighted_mean_mse(t):
    d, x, w = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return t("lineitem", "l_suppkey", "l_discount", "l_tax", "l_quantity").groupBy("l_suppkey").agg(F.round(stats.weighted_mean(d, w), 7).alias("wmean"), F.round(stats.weighted_mse(d, x, w), 8).alias("wmse"))


@query("""with m as (select l_returnflag as f, sum(l_quantity) as w, sum(l_quantity * l_discount) as x, sum(l_quantity * l_tax) as y, sum(l_quantity * l_discount * l_tax) as xy, sum(l_quantity * l_discount * l_discount) as xx, sum(l_quantity * l_tax * l_tax) as yy from lineitem group by 1)
select f as l_returnflag, round((xy / w - x * y / w / w) / sqrt((xx / w - x * x / w / w) * (yy / w - y * y / w / w)), 6) as r from m""")
def weighted_moments_corr(t):
    r = stats.moments_corr(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return t("lineitem", "l_returnflag", "l_discount", "l_tax", "l_quantity").groupBy("l_returnflag").agg(F.round(r, 6).alias("r"))


@query("""with v as (select c_custkey, c_acctbal, coalesce(sum(o_totalprice), 0) as spent from customer left join orders on c_custkey = o_custkey group by 1, 2),
r as (select rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2 as a, rank() over (order by spent) + (count(*) over (partition by spent) - 1) / 2 as b from v)
select round(corr(a, b), 6) as spearman from r""")
def spearman(t):
    v = t("customer", "c_custkey", "c_acctbal").join(t("orders", "o_custkey", "o_totalprice"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spent"))

    def ranks(c: str, name: str) -> DataFrame:
        n = v.groupBy(c).agg(F.count("*").alias("n"))
        return running(n, [c], {"_upto": "n"}).select(c, (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name))

    return v.join(ranks("c_acctbal", "a"), "c_acctbal").join(ranks("spent", "b"), "spent").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 3) as q1, round(median(l_extendedprice), 3) as q2, round(quantile_cont(l_extendedprice, 0.75), 3) as q3, round(stddev_samp(l_tax), 7) as sd, round(stddev_pop(l_tax), 7) as sd0 from lineitem group by 1""")
def quantiles_linear(t):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = t("lineitem", "l_returnflag", "l_extendedprice", "l_tax").groupBy("l_returnflag").agg(p.alias("p"), F.round(F.stddev_samp("l_tax"), 7).alias("sd"), F.round(F.stddev_pop("l_tax"), 7).alias("sd0"))
    return g.select("l_returnflag", *(F.round(F.col("p")[k], 3).alias(f"q{k + 1}") for k in range(3)), "sd", "sd0")


@query("""with c as (select l_suppkey, l_shipmode_ as m, count(*) as n from (select l_suppkey, l_linenumber as l_shipmode_ from lineitem) group by 1, 2)
select l_suppkey, m::int as mode from c qualify row_number() over (partition by l_suppkey order by n desc, m) = 1""")
def mode_smallest(t):
    c = t("lineitem", "l_suppkey", "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.min_by("l_linenumber", F.struct(-F.col("n"), "l_linenumber")).alias("mode"))


@query("""select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as largest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as smallest, count(distinct o_orderstatus) as kinds from orders group by 1""")
def argmax_argmin(t):
    by = F.struct("o_totalprice", "o_orderkey")
    return t("orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("largest"), F.min_by("o_orderkey", by).alias("smallest"), F.countDistinct("o_orderstatus").alias("kinds"))


@query("""with v as (select o_custkey, o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2, 3),
b as (select * from v qualify row_number() over (partition by o_custkey, o_orderstatus order by n desc, o_orderpriority) = 1)
select o_custkey, max(o_orderpriority) filter (where o_orderstatus = 'F') as f, max(o_orderpriority) filter (where o_orderstatus = 'O') as o, max(o_orderpriority) filter (where o_orderstatus = 'P') as p from b group by 1""")
def majority_vote_pivot(t):
    v = t("orders", "o_custkey", "o_orderstatus", "o_orderpriority").groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    b = v.groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("w"))
    return b.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("w")).select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, grouping(l_returnflag)::bigint as g1, grouping(l_linestatus)::bigint as g2 from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_scope_report(t):
    return t("lineitem", "l_returnflag", "l_linestatus", "l_quantity").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping("l_returnflag").cast("bigint").alias("g1"), F.grouping("l_linestatus").cast("bigint").alias("g2"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 9) as d from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_phase(t):
    return t("lineitem", "l_returnflag", "l_linestatus", "l_discount").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("d"))


@query("""select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())""")
def grouping_sets_team(t):
    c = t("customer", "c_mktsegment", "c_nationkey")
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"))


@query("""select o_custkey, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) as f, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0), 2) as o from orders group by 1""")
def pivot_long_wide(t):
    p = t("orders", "o_custkey", "o_orderstatus", "o_totalprice").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return p.select("o_custkey", F.round(F.coalesce("F", F.lit(0.0)), 2).alias("f"), F.round(F.coalesce("O", F.lit(0.0)), 2).alias("o"))


@query("""select l_orderkey, l_linenumber, name, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name name value value)""")
def melt_wide_long(t):
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("""select vec_id, i::int as pos, v from (select vec_id, unnest(embedding[1:3]) as v, unnest([0, 1, 2]) as i from embeddings)""")
def explode_list(t):
    return t("embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("pos", "v"))


@query("""select case when l_quantity > 0 and l_quantity <= 10 then 'low' when l_quantity > 10 and l_quantity <= 25 then 'mid' when l_quantity > 25 and l_quantity <= 50 then 'high' end as bin, count(*) as n, round(avg(l_extendedprice), 3) as price from lineitem group by 1""")
def right_closed_bins(t):
    b = stats.right_closed_bin(F.col("l_quantity"), [0, 10, 25, 50], ["low", "mid", "high"])
    return t("lineitem", "l_quantity", "l_extendedprice").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 3).alias("price"))


@query("""with q as (select quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q from part)
select p_partkey, (1 + (p_retailprice > q[1])::int + (p_retailprice > q[2])::int + (p_retailprice > q[3])::int) as quartile from part, q""")
def quartile_bins(t):
    p = t("part", "p_partkey", "p_retailprice")
    q = p.agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).scalar()
    return p.withColumn("q", q).select("p_partkey", (1 + sum(((F.col("p_retailprice") > F.col("q")[k]).cast("int") for k in range(3)), F.lit(0))).alias("quartile"))


@query("""select o_orderpriority, round(sum(o_totalprice) filter (where o_orderstatus = 'F') / sum(o_totalprice), 7) as share_f, count(*) filter (where o_totalprice > 150000) as large from orders group by 1""")
def conditional_ratio(t):
    return t("orders", "o_orderpriority", "o_orderstatus", "o_totalprice").groupBy("o_orderpriority").agg(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / F.sum("o_totalprice"), 7).alias("share_f"), F.count_if(F.col("o_totalprice") > 150000).alias("large"))


_PROB = "with s as (select l_discount * 10 as p, (l_returnflag = 'R')::int as y from lineitem)"


@query(_PROB + " select round(avg((p - y) * (p - y)), 7) as brier, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) as log_loss from s")
def brier_logloss(t):
    s = t("lineitem", "l_discount", "l_returnflag").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    e = F.col("p") - F.col("y")
    return s.agg(F.round(F.avg(e * e), 7).alias("brier"), F.round(stats.log_loss(F.col("p"), F.col("y")), 6).alias("log_loss"))


@query(_PROB + ", r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as r from s) select round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) as auc from r")
def auc_rank(t):
    s = t("lineitem", "l_discount", "l_returnflag").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.auc(s, "p", "y").select(F.round("auc", 6).alias("auc"))


@query(_PROB + """, b as (select *, least(4, floor(p * 5))::int as bin from s), g as (select bin, count(*) as n, avg(p) as mp, avg(y) as my from b group by 1) select round(sum(n * abs(mp - my)) / sum(n), 6) as ece from g""")
def calibration_error(t):
    s = t("lineitem", "l_discount", "l_returnflag").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    g = s.groupBy(F.least(F.lit(4), F.floor(F.col("p") * 5).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n"), 6).alias("ece"))


# cleaning, sets, order


@query("select count(*) as n, count(distinct team_id) as teams from (select distinct text, lang, source, team_id from documents)")
def dedupe_exact(t):
    return t("documents", "text", "lang", "source", "team_id").dropDuplicates().agg(F.count("*").alias("n"), F.countDistinct("team_id").alias("teams"))


@query("select user_id, event_type, event_id, round(value, 4) as value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def dedupe_keep_last(t):
    e = t("events", "user_id", "event_type", "event_id", "ts", "value")
    return windows.dedupe_keep(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""with g as (select l_orderkey, l_suppkey, count(*) as n_rows, count(distinct (l_returnflag, l_linestatus)) as n_versions, max(l_returnflag) as f, max(l_linestatus) as s from lineitem group by 1, 2)
select l_orderkey, l_suppkey, n_rows, n_versions, case when n_versions > 1 then 'ambiguous' when n_rows > 1 then 'duplicate' else 'unique' end as status, case when n_versions = 1 then f end as l_returnflag, case when n_versions = 1 then s end as l_linestatus from g""")
def dedupe_ambiguous_null_payload(t):
    return windows.dedupe_ambiguous(t("lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("""with s as (select game_id, event_num, list_distinct([x for x in [home_player1, home_player2, home_player3, home_player4, home_player5] if x > 0]) as h from raw_event)
select game_id, event_num, len(h)::bigint as known, array_to_string(list_sort(h), '-') as lineup_key from s""")
def missing_slot_pack(t):
    slots = [f"home_player{i}" for i in range(1, 6)]
    h = F.array_distinct(F.filter(F.array(*slots), lambda x: x > 0))
    return t("raw_event", "game_id", "event_num", *slots).select("game_id", "event_num", F.size(h).cast("bigint").alias("known"), F.concat_ws("-", F.array_sort(h).cast("array<string>")).alias("lineup_key"))


@query("""select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey)), '-') as lineup, count(*) as n from lineitem group by 1""")
def array_canonical_key(t):
    return t("lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.concat_ws("-", F.array_sort(F.collect_set("l_suppkey")).cast("array<string>")).alias("lineup"), F.count("*").alias("n"))


@query("""select o_orderkey as k, o_totalprice as amount, null::varchar as kind from orders where o_orderstatus = 'P' union all by name select event_id as k, null::double as amount, event_type as kind from events where value > 90""")
def union_by_name_missing(t):
    a = t("orders", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    b = t("events", "event_id", "event_type", "value").where("value > 90").select(F.col("event_id").alias("k"), F.col("event_type").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select o_custkey as k from orders union select user_id from events")
def union_distinct(t):
    return t("orders", "o_custkey").select(F.col("o_custkey").alias("k")).union(t("events", "user_id")).distinct()


@query("select o_custkey as k from orders intersect select user_id from events")
def intersect_keys(t):
    return t("orders", "o_custkey").select(F.col("o_custkey").alias("k")).intersect(t("events", "user_id"))


@query("select l_suppkey as k, l_linenumber as n from lineitem where l_returnflag = 'A' except all select l_suppkey, l_linenumber from lineitem where l_returnflag = 'R'")
def except_all(t):
    li = t("lineitem", "l_suppkey", "l_linenumber", "l_returnflag")
    pick = [F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n")]
    return li.where("l_returnflag = 'A'").select(pick).exceptAll(li.where("l_returnflag = 'R'").select(pick))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk_global(t):
    return t("orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select l_suppkey, l_orderkey, l_linenumber, rn from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3")
def topk_per_group(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rn")


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc nulls last, o_orderkey) as place from orders order by o_orderpriority, o_totalprice desc nulls last, o_orderkey limit 200")
def sort_mixed_stable(t):
    top = t("orders", "o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(200)
    w = Window.orderBy("o_orderpriority", F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return top.select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))


# scalars


@query("""select doc_id, regexp_matches(coalesce(text, ''), '(?i)rebound') as rebounds, regexp_matches(coalesce(text, ''), '(?i)free throw|foul') as fouls, coalesce(length(regexp_extract(text, '([0-9]+) points', 1)), 0)::int as digits from documents""")
def text_flags_regex(t):
    x = F.col("text")
    return t("documents", "doc_id", "text").select("doc_id", tx.says(x, "rebound").alias("rebounds"), tx.says(x, "free throw|foul").alias("fouls"), F.coalesce(F.length(F.regexp_extract(x, "([0-9]+) points", 1)), F.lit(0)).alias("digits"))


@query("""select game_id, event_num, try_cast(nullif(regexp_extract(concat_ws(' ', home_description, visitor_description), '([0-9]+)''', 1), '') as int) as feet, regexp_matches(concat_ws(' ', home_description, visitor_description), '3PT') as three from raw_event where event_type in (1, 2)""")
def text_extract_distance(t):
    x = F.concat_ws(" ", "home_description", "visitor_description")
    e = t("raw_event", "game_id", "event_num", "event_type", "home_description", "visitor_description").where("event_type in (1, 2)")
    return e.select("game_id", "event_num", F.nullif(F.regexp_extract(x, "([0-9]+)'", 1), F.lit("")).try_cast("int").alias("feet"), x.rlike("3PT").alias("three"))


@query(r"""select lpad(regexp_replace(trim(game_id), '\.0$', ''), 10, '0') as game_id, count(*) as n from player_game where length(regexp_replace(trim(game_id), '\.0$', '')) <= 10 group by 1""")
def id_normalize_zfill(t):
    p = t("player_game", "game_id").select(tx.game_id(F.col("game_id")).alias("game_id"))
    return p.where("length(game_id) <= 10").groupBy("game_id").agg(F.count("*").alias("n"))


@query("""select player_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower(player_name)), 'ł', 'l'), 'ø', 'o'), 'đ', 'd'), 'ı', 'i'), 'ð', 'd'), 'ħ', 'h'), 'ŧ', 't'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '[^a-z0-9]+', ' ', 'g')) as folded from player_rating_history""")
def name_fold(t):
    return t("player_rating_history", "player_id", "player_name").select("player_id", tx.fold_name(F.col("player_name")).alias("folded"))


@query("""select game_id, event_num, split_part(time_quarter, ':', 1)::double * 60 + split_part(time_quarter, ':', 2)::double as clock, case when period <= 4 then (4 - period) * 720 else 0 end + split_part(time_quarter, ':', 1)::double * 60 + split_part(time_quarter, ':', 2)::double as seconds_left from raw_event where time_quarter is not null and period is not null""")
def clock_parse(t):
    e = t("raw_event", "game_id", "event_num", "period", "time_quarter").where("time_quarter is not null and period is not null")
    c = tx.clock_seconds(F.col("time_quarter"))
    return e.select("game_id", "event_num", c.alias("clock"), tx.seconds_left(F.col("period"), c).alias("seconds_left"))


@query("""select o_orderkey, (year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end)::int as season, (year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end - 1)::varchar || '-' || lpad(((year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end) % 100)::varchar, 2, '0') as label from orders""")
def season_label_rollover(t):
    s = tx.season_of(F.col("o_orderdate"))
    return t("orders", "o_orderkey", "o_orderdate").select("o_orderkey", s.alias("season"), tx.season_label(s).alias("label"))


@query("select event_id, (props->>'k')::bigint as k from events")
def json_extract_props(t):
    return t("events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""select c_custkey, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') as digest from customer""")
def canonical_json_sha256(t):
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return t("customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.sha2(body, 256).alias("digest"))


@query("""with k as (select [0.0, 10, 25, 50] as x, [1.0, 3, 2, 8] as y)
select l_orderkey, l_linenumber, round(case when l_quantity <= 0 then 1 when l_quantity <= 10 then 1 + 2 * l_quantity / 10 when l_quantity <= 25 then 3 - (l_quantity - 10) / 15 when l_quantity <= 50 then 2 + 6 * (l_quantity - 25) / 25 else 8 end, 6) as curve, round(greatest(l_quantity - 25, 0) / 25, 6) as hinge from lineitem""")
def interp_and_hinge(t):
    knots = [(0.0, 1.0), (10.0, 3.0), (25.0, 2.0), (50.0, 8.0)]
    x = F.col("l_quantity")
    curve = F.lit(knots[-1][1])
    for (a, ya), (b, yb) in reversed(list(zip(knots, knots[1:], strict=False))):
        curve = F.when(x <= b, F.lit(ya) + (x - a) * (yb - ya) / (b - a)).otherwise(curve)
    curve = F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(curve)
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.round(curve, 6).alias("curve"), F.round(F.greatest(x - 25, F.lit(0.0)) / 25, 6).alias("hinge"))


# estimation


_X = "l_quantity / 50 as x1, l_discount as x2, l_tax as x3, l_extendedprice / 1000 as y"


@query(f"""with d as (select l_returnflag, {_X} from lineitem) select l_returnflag, count(*) as n, round(sum(x1 * x1), 3) as g11, round(sum(x1 * x2), 4) as g12, round(sum(x1 * x3), 4) as g13, round(sum(x2 * x2), 5) as g22, round(sum(x2 * x3), 5) as g23, round(sum(x3 * x3), 5) as g33, round(sum(x1 * y), 2) as b1, round(sum(x2 * y), 3) as b2, round(sum(x3 * y), 3) as b3 from d group by 1""")
def gram_matrix(t):
    d = t("lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice").select("l_returnflag", (F.col("l_quantity") / 50).alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_extendedprice") / 1000).alias("y"))
    x = [F.col(f"x{i}") for i in (1, 2, 3)]
    m = d.groupBy("l_returnflag").agg(F.count("*").alias("n"), *estimate.moment_sums(x, F.col("y"), F.lit(1.0)))
    digits = {"sx1x1": ("g11", 3), "sx1x2": ("g12", 4), "sx1x3": ("g13", 4), "sx2x2": ("g22", 5), "sx2x3": ("g23", 5), "sx3x3": ("g33", 5), "sx1y": ("b1", 2), "sx2y": ("b2", 3), "sx3y": ("b3", 3)}
    return m.select("l_returnflag", "n", *(F.round(c, k).alias(name) for c, (name, k) in digits.items()))


@query("""select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1""")
def ols_normal_equations(t):
    return t("lineitem", "l_returnflag", "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2")
    )


@query(f"""with d as (select l_orderkey % 5 as fold, {_X} from lineitem), f as (select fold::bigint as fold, sum(x1 * x1) as g, sum(x1 * y) as b from d group by 1), a as (select sum(g) as g, sum(b) as b from f)
select fold, round((a.b - f.b) / (a.g - f.g + 10), 7) as ridge from f, a""")
def fold_gram_difference(t):
    d = t("lineitem", "l_orderkey", "l_quantity", "l_extendedprice").select((F.col("l_orderkey") % 5).alias("fold"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = d.groupBy("fold").agg(F.sum(F.col("x") * F.col("x")).alias("g"), F.sum(F.col("x") * F.col("y")).alias("b"))
    return f.withColumns({"ga": f.agg(F.sum("g")).scalar(), "ba": f.agg(F.sum("b")).scalar()}).select("fold", F.round((F.col("ba") - F.col("b")) / (F.col("ga") - F.col("g") + 10), 7).alias("ridge"))


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0),
s as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as similarity from q join embeddings e on q.vec_id <> e.vec_id)
select query, rank::int as rank, neighbour from (select *, row_number() over (partition by query order by similarity desc, neighbour) as rank from s) where rank <= 10""")
def knn_topk_cosine(t):
    e = t("embeddings", "vec_id", "embedding")
    return estimate.blocks_topk(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding", k=10).select("query", "rank", "neighbour")


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0),
s as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as similarity from q join embeddings e on q.vec_id <> e.vec_id),
k as (select * from s qualify row_number() over (partition by query order by similarity desc, neighbour) <= 5)
select distinct least(query, neighbour) as a, greatest(query, neighbour) as b from k""")
def knn_links_undirected(t):
    e = t("embeddings", "vec_id", "embedding")
    k = estimate.blocks_topk(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding", k=5)
    return k.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b")).distinct()


# lineups: an order is a lineup, its suppliers are the players


_WITH = "with o as (select l_orderkey, list(distinct l_suppkey) as players, sum(l_extendedprice * (1 - l_discount)) as pts, count(*) as poss from lineitem group by 1)"


@query(_WITH + """, p as (select distinct l_suppkey from lineitem), tot as (select sum(pts) as tp, sum(poss) as tn from o), s as (select l_suppkey, sum(pts) as onp, sum(poss) as onn from (select unnest(players) as l_suppkey, pts, poss from o) group by 1)
select l_suppkey as player, onn::bigint as on_poss, round(onp / onn, 3) as on_rate, round((tp - onp) / nullif(tn - onn, 0), 3) as off_rate from s, tot""")
def wowy_on_off(t):
    o = t("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("players"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pts"), F.count("*").alias("poss"))
    s = o.select(F.explode("players").alias("player"), "pts", "poss").groupBy("player").agg(F.sum("pts").alias("onp"), F.sum("poss").alias("onn"))
    return s.withColumns({"tp": o.agg(F.sum("pts")).scalar(), "tn": o.agg(F.sum("poss")).scalar()}).select("player", F.col("onn").alias("on_poss"), F.round(F.col("onp") / F.col("onn"), 3).alias("on_rate"), F.round((F.col("tp") - F.col("onp")) / F.nullif(F.col("tn") - F.col("onn"), F.lit(0)), 3).alias("off_rate"))


@query(_WITH + " select count(*) as lineups, sum(poss)::bigint as poss, round(sum(pts) / sum(poss), 3) as rate from o where list_contains(players, 3) and not list_contains(players, 5) and len(players) >= 3")
def lineup_include_exclude(t):
    o = t("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("players"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pts"), F.count("*").alias("poss"))
    hit = o.where(F.array_contains("players", 3) & ~F.array_contains("players", 5) & (F.size("players") >= 3))
    return hit.agg(F.count("*").alias("lineups"), F.sum("poss").alias("poss"), F.round(F.sum("pts") / F.sum("poss"), 3).alias("rate"))


@query("""select strftime(m, '%Y-%m-%d') as month, coalesce(n, 0) as orders from (select unnest(generate_series(date_trunc('month', (select min(o_orderdate) from orders))::date, date_trunc('month', (select max(o_orderdate) from orders))::date, interval 1 month)) as m) c
left join (select date_trunc('month', o_orderdate)::date as om, count(*) as n from orders group by 1) o on om = m::date""")
def calendar_reindex(t):
    o = t("orders", "o_orderdate").select(F.trunc(F.to_date("o_orderdate"), "month").alias("m"))
    n = o.groupBy("m").agg(F.count("*").alias("n"))
    months = n.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return months.join(n, "m", "left").select(F.date_format("m", "yyyy-MM-dd").alias("month"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("""with d as (select distinct o_orderdate::date as d from orders), r as (select d, row_number() over (order by d) as rn, count(*) over () as n from d)
select q::int as quarter, strftime(d, '%Y-%m-%d') as cut from r join (select unnest([1, 2, 3, 4]) as q) on rn = ceil(n * q / 4.0)""")
def quarter_cut_dates(t):
    d = t("orders", "o_orderdate").select(F.to_date("o_orderdate").alias("d")).distinct()
    r = d.select("d", F.row_number().over(Window.orderBy("d")).alias("rn"), F.count("*").over(Window.partitionBy()).alias("n"))  # one row per day
    return r.withColumn("quarter", F.explode(F.array(*(F.lit(q) for q in (1, 2, 3, 4))))).where(F.col("rn") == F.ceil(F.col("n") * F.col("quarter") / 4.0)).select("quarter", F.date_format("d", "yyyy-MM-dd").alias("cut"))
