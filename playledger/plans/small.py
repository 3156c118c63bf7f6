"""Small forms that pipelines meet often, each with SQL: scans and sinks, guards, text forms, scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts
from ..operators import estimate, joins, tables as ops
from ..operators.models import series_chances
from ..session import ensure_checkpoint_dir
from ..sources import files, publish
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


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal from customer")
def csv_sink_and_scan(spark, sf_dir):
    """Customers written as CSV and read again by a told schema."""
    at = _folder(spark)
    files.write_csv(table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"]), at)
    return files.read_csv(spark, at, "c_custkey bigint, c_name string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("select s_suppkey, s_name from supplier")
def json_sink_and_scan(spark, sf_dir):
    at = _folder(spark)
    files.write_json(table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]), at)
    return files.read_json_lines(spark, at, "s_suppkey bigint, s_name string")


@query("select p_partkey, case when p_partkey % 2 = 0 then p_size end as p_size, case when p_partkey % 2 = 1 then p_name end as p_name from part")
def multi_file_union(spark, sf_dir):
    """Two folders with different columns read as one table by name."""
    at = _folder(spark)
    p = table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_name"])
    files.write_parquet(p.where("p_partkey % 2 = 0").drop("p_name"), f"{at}/a")
    files.write_parquet(p.where("p_partkey % 2 = 1").drop("p_size"), f"{at}/b")
    return files.read_parquet(spark, [f"{at}/a", f"{at}/b"], columns=["p_partkey", "p_size", "p_name"])


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def partitioned_sink_pruned_scan(spark, sf_dir):
    """Orders written by status; a predicate on it reads one folder."""
    at = _folder(spark)
    files.write_parquet(table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]), at, by=["o_orderstatus"])
    return files.read_parquet(spark, [at], columns=["o_orderkey", "o_orderstatus"], where="o_orderstatus = 'F'")


@query("select n_nationkey, n_name, (n_nationkey % 3)::int as step from nation")
def append_log_read(spark, sf_dir):
    """A log of JSON lines appended in three steps, read as one."""
    at = _folder(spark)
    for k in range(3):
        files.write_json(table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).where(f"n_nationkey % 3 = {k}").withColumn("step", F.lit(k)), at, mode="append")
    return files.read_json_lines(spark, at, "n_nationkey bigint, n_name string, step int")


@query("select 'customers' as slug, (select count(*) from customer where c_acctbal >= 0) as row_count, 2 as flips")
def pointer_flip(spark, sf_dir):
    """Two versions promoted one after the other by an atomic change of the pointer; the last one shows."""
    at = _folder(spark)
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    for part in (c.where("c_acctbal < 0"), c.where("c_acctbal >= 0")):
        rows, version = publish.publish(part, ["c_custkey"], least=0)
        publish.promote(spark, at, "customers", rows, version)
    return publish.promoted(spark, at, "customers").agg(F.count("*").alias("row_count")).select(F.lit("customers").alias("slug"), "row_count", F.lit(len(publish.history(spark, at, "customers"))).alias("flips"))


@query("select c_custkey, c_nationkey from customer where c_nationkey in (3, 7)")
def row_level_view(spark, sf_dir):
    """The rows that a reader of two nations may see; nobody without a grant sees any."""
    grants = spark.createDataFrame([("reader", 3), ("reader", 7), ("other", 1)], "role string, c_nationkey bigint")
    return publish.visible(table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]), grants, role="reader", on=["c_nationkey"])


@query("select event_id, coalesce(home_description, visitor_description, neutral_description) as told from (select game_id || ':' || event_num as event_id, nullif(home_description, '') as home_description, nullif(visitor_description, '') as visitor_description, nullif(neutral_description, '') as neutral_description from raw_event)")
def first_non_null(spark, sf_dir):
    e = table(spark, sf_dir, "raw_event", ["game_id", "event_num", "home_description", "visitor_description", "neutral_description"])
    return e.select(F.concat_ws(":", "game_id", "event_num").alias("event_id"), F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("home_description", "visitor_description", "neutral_description"))).alias("told"))


@query("select player_id, game_id, loaded_ts, greatest(rim_fga, mid_fga, three_fga) as most, least(rim_fga, mid_fga, three_fga) as least, coalesce(rim_fga, 0) + coalesce(mid_fga, 0) + coalesce(three_fga, 0) as total from player_game")
def row_wise_reduce(spark, sf_dir):
    c = ["rim_fga", "mid_fga", "three_fga"]
    p = table(spark, sf_dir, "player_game", ["player_id", "game_id", "loaded_ts", *c])
    return p.select("player_id", "game_id", "loaded_ts", F.greatest(*c).alias("most"), F.least(*c).alias("least"), sum((F.coalesce(x, F.lit(0)) for x in c), F.lit(0)).alias("total"))


@query("select o_custkey, count(distinct coalesce(o_orderstatus, '?')) as n from orders group by 1 having n > 1")
def conflict_keys(spark, sf_dir):
    """Customers whose orders differ in status."""
    return ops.conflicts(table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus"]), ["o_custkey"], ["o_orderstatus"])


@query("select o_orderkey, (o_orderstatus = 'F')::int as status_F, (o_orderstatus = 'O')::int as status_O, (o_orderstatus = 'P')::int as status_P from orders")
def one_hot_status(spark, sf_dir):
    return ops.one_hot(table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]), "o_orderstatus", ["F", "O", "P"], "status_").drop("o_orderstatus")


@query("select n.n_nationkey, n.n_name, r.r_name from nation n left join region r on n.n_regionkey = r.r_regionkey")
def cardinality_checked_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return contracts.checked_join(n, r.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey")
def row_count_guarded_join(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"]), table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return ops.guarded_join(s, n.withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"]).select("s_suppkey", "s_name", "n_name")


@query("""with a as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders where year(o_orderdate) % 2 = 0 group by 1), b as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders where year(o_orderdate) % 2 = 1 group by 1)
select o_custkey, a.n as n, round(a.top, 2) as top, b.n as n_odd, round(b.top, 2) as top_odd from a join b using (o_custkey)""")
def aligned_with_suffix(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])

    def half(k: int) -> DataFrame:
        return o.where(F.year("o_orderdate") % 2 == k).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))

    return ops.joined_with_suffix(half(0), half(1), ["o_custkey"], "_odd")


@query("""with s as (select distinct game_id, event_num as sub_num from raw_event where event_type = 8 and game_id is not null and event_num is not null), e as (select distinct game_id, event_num from raw_event where event_type = 6 and game_id is not null and event_num is not null)
select e.game_id, e.event_num, s.sub_num from e asof left join s on e.game_id = s.game_id and e.event_num >= s.sub_num""")
def asof_event_number(spark, sf_dir):
    """The last substitution at or before each foul, by event number."""
    r = table(spark, sf_dir, "raw_event", ["game_id", "event_num", "event_type"]).where("game_id is not null and event_num is not null")
    s = r.where("event_type = 8").select("game_id", F.col("event_num").alias("sub_num"), F.col("event_num").alias("value")).distinct()
    got = joins.asof_join(r.where("event_type = 6").select("game_id", "event_num").distinct(), s, left_on="event_num", right_on="sub_num", by=["game_id"], values=["value"])
    return got.select("game_id", "event_num", F.col("value").alias("sub_num"))


@query("select r_name, n_name from region join nation on contains(n_name, r_regionkey::varchar)")
def substring_join(spark, sf_dir):
    """Nations whose name holds a region's number: the patterns, five by definition, are a literal list."""
    patterns = [(r.r_name, str(r.r_regionkey)) for r in table(spark, sf_dir, "region", ["r_name", "r_regionkey"]).where("r_regionkey is not null").collect()]
    n = table(spark, sf_dir, "nation", ["n_name"]).where("n_name is not null")
    hit = F.filter(F.array(*(F.struct(F.lit(a).alias("r_name"), F.lit(b).alias("p")) for a, b in patterns)), lambda x: F.contains("n_name", x["p"]))
    return n.select("n_name", F.explode(hit).alias("h")).select("h.r_name", "n_name")


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as keys from orders group by 1")
def group_keeping_order(spark, sf_dir):
    """Each customer's orders in the order of their dates."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_returnflag) as flags from lineitem group by 1")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey", "l_returnflag"]).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("flags"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def last_three(spark, sf_dir):
    return ops.last_n(table(spark, sf_dir, "events", ["user_id", "event_id", "ts"]), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


_NS = "6ba7b8109dad11d180b400c04fd430c8"


@query(f"""with h as (select c_custkey, sha1(unhex('{_NS}') || encode(c_name)) as h from customer)
select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::int + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h""")
def uuid_of_name(spark, sf_dir):
    return table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select("c_custkey", ops.uuid5(_NS, F.col("c_name")).alias("id"))


@query("select n_nationkey, case when n_nationkey % 5 <> 0 then [n_nationkey::varchar, n_name] end as items from nation")
def literal_lists(spark, sf_dir):
    """Lists written as text, some of them broken."""
    n = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    text = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("["), F.col("n_name"))).otherwise(F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(", '"), F.col("n_name"), F.lit("']")))
    return n.select("n_nationkey", ops.literal_list(text).alias("items"))


@query("select game_id, updated_ts, strftime(tipoff_utc at time zone 'UTC' at time zone 'America/New_York', '%Y-%m-%d %H:%M') as local_time from game_metadata where tipoff_utc is not null")
def local_tipoff(spark, sf_dir):
    """Tip-off in the league's eastern time, summer time kept."""
    g = table(spark, sf_dir, "game_metadata", ["game_id", "updated_ts", "tipoff_utc"]).where("tipoff_utc is not null")
    return g.select("game_id", "updated_ts", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "tipoff_utc"), "yyyy-MM-dd HH:mm").alias("local_time"))


@query("select l_orderkey, l_linenumber, round_even((l_quantity / 2)::decimal(18, 4), 0)::double as half from lineitem")
def rounded_half_even(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return l.select("l_orderkey", "l_linenumber", F.bround((F.col("l_quantity") / 2).cast("decimal(18,4)"), 0).cast("double").alias("half"))


@query("""with e as (select game_id, event_num, period, 60 * minute_remaining_quarter + seconds_remaining_quarter as clock from raw_event where period is not null and minute_remaining_quarter is not null and seconds_remaining_quarter is not null)
select game_id, event_num, period, clock, round(case when period <= 4 then ((period - 1) * 720 + 720 - clock) / 2880.0 else 1.0 end, 8) as regulation, round(case when period > 4 then period - 5 + (300 - clock) / 300.0 else 0.0 end, 8) as overtime from e""")
def game_progress(spark, sf_dir):
    """The share of regulation played, and overtime periods played."""
    e = table(spark, sf_dir, "raw_event", ["game_id", "event_num", "period", "minute_remaining_quarter", "seconds_remaining_quarter"])
    e = e.select("game_id", "event_num", "period", (60 * F.col("minute_remaining_quarter") + F.col("seconds_remaining_quarter")).alias("clock")).where("period is not null and clock is not null")
    regular = F.when(F.col("period") <= 4, ((F.col("period") - 1) * 720 + 720 - F.col("clock")) / 2880.0).otherwise(1.0)
    over = F.when(F.col("period") > 4, F.col("period") - 5 + (300 - F.col("clock")) / 300.0).otherwise(0.0)
    return e.select("*", F.round(regular, 8).alias("regulation"), F.round(over, 8).alias("overtime"))


@query("""with t as (select event_id, (value - 50) / 20 as z from events), u as (select event_id, z, abs(z) / sqrt(2.0) as x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as t from t)
select event_id, round(0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x))), 7) as p from u""")
def normal_probability(spark, sf_dir):
    return table(spark, sf_dir, "events", ["event_id", "value"]).select("event_id", F.round(ops.normal_cdf((F.col("value") - 50) / 20), 7).alias("p"))


@query("""with d as (select p_size, p_retailprice as y, avg(p_retailprice) over (partition by p_size) as m, stddev_pop(p_retailprice) over (partition by p_size) as s from part), z as (select *, (y - m) / s as z from d where s > 0),
u as (select *, abs(z) / sqrt(2.0) as x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as t from z),
c as (select p_size, s * (z * (2 * (0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)))) - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) as crps from u)
select p_size, round(avg(crps), 4) as crps from c group by 1""")
def forecast_crps(spark, sf_dir):
    """The score of each size's mean and deviation as a normal forecast of its prices."""
    w = Window.partitionBy("p_size")
    d = table(spark, sf_dir, "part", ["p_size", "p_retailprice"]).withColumns({"m": F.avg("p_retailprice").over(w), "s": F.stddev_pop("p_retailprice").over(w)}).where("s > 0")
    return d.groupBy("p_size").agg(F.round(F.avg(ops.normal_crps(F.col("m"), F.col("s"), F.col("p_retailprice"))), 4).alias("crps"))


@query("""with p as (select l_discount as s, count(*) as n, sum((l_returnflag = 'R')::int) as p from lineitem group by 1), r as (select p, sum(p) over w as hit, sum(n) over w as n from p window w as (order by s desc))
select round(sum(p * hit / n) / sum(p), 7) as average_precision from r""")
def precision_recall_area(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", ["l_discount", "l_returnflag"]).withColumn("y", F.col("l_returnflag") == "R")
    return ops.average_precision(l, "l_discount", "y").select(F.round("average_precision", 7).alias("average_precision"))


_FLIPS = 40


@query(f"""with d as (select o_custkey::varchar as k, avg(case when o_orderstatus = 'F' then o_totalprice end) - avg(case when o_orderstatus <> 'F' then o_totalprice end) as v from orders group by 1), b as (select * from d where v is not null),
r as (select r, sum(case when ('0x' || substr(md5(k || '-' || r), 1, 8))::bigint / 4294967296.0 < 0.5 then v else -v end) as s from b, (select unnest(range({_FLIPS})) as r) group by r)
select round((select avg(v) from b), 4) as mean, round(((select count(*) from r where abs(s) >= abs((select sum(v) from b)) - 1e-9) + 1) / {_FLIPS + 1}.0, 7) as p""")
def permutation_test(spark, sf_dir):
    """Paired difference of mean prices per customer against sign flips."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"])
    d = o.groupBy("o_custkey").agg((F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) - F.avg(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))).alias("v"))
    return ops.sign_flips(d, "o_custkey", "v", _FLIPS).select(F.round("mean", 4).alias("mean"), F.round("p", 7).alias("p"))


@query("""with v as (select vec_id, embedding from embeddings where embedding is not null), q as (select * from v where vec_id % 100 = 0),
d as (select q.vec_id as query, v.vec_id as neighbour, round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) ** 2))), 6) as distance from q, v where q.vec_id <> v.vec_id)
select query, neighbour, distance from d qualify row_number() over (partition by query order by distance, neighbour) <= 3""")
def knn_euclidean(spark, sf_dir):
    """The three nearest rows by Euclidean distance of every row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return estimate.blocks_topk(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding", k=3, distance="euclidean").select("query", "neighbour", F.round("similarity", 6).alias("distance"))


@query("""with t as (select unnest([0.45, 0.5, 0.6, 0.7]) as home, unnest([0.4, 0.5, 0.5, 0.55]) as away), s as (select home, away, unnest(range(128)) as b from t),
e as (select home, away, bit_count(b::int) as wins, (case when b & 1 > 0 then home else 1 - home end) * (case when b & 2 > 0 then home else 1 - home end) * (case when b & 4 > 0 then away else 1 - away end) * (case when b & 8 > 0 then away else 1 - away end)
  * (case when b & 16 > 0 then home else 1 - home end) * (case when b & 32 > 0 then away else 1 - away end) * (case when b & 64 > 0 then home else 1 - home end) as q from s)
select home, away, round(sum(q) filter (where wins >= 4), 8) as p from e group by 1, 2""")
def series_probability(spark, sf_dir):
    """The chance to win a series of seven, for some chances at home and away."""
    chances = spark.createDataFrame([(0.45, 0.4), (0.5, 0.5), (0.6, 0.5), (0.7, 0.55)], "home double, away double")
    return chances.select("home", "away", F.round(series_chances(F.col("home"), F.col("away")), 8).alias("p"))


@query("""with g as (select l_suppkey as f, count(*) as n, sum(l_discount) as s from lineitem group by 1), b as (select f, s / (n + 50.0) as beta, n from g), m as (select sum(n * beta) / sum(n) as m from b)
select f as l_suppkey, round(beta - m, 8) as centred from b, m""")
def weighted_recentering(spark, sf_dir):
    """Ridge coefficients of one-hot suppliers, moved so that their mean by rows is 0."""
    g = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_discount"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.sum("l_discount") / (F.count("*") + 50.0)).alias("beta"))
    return estimate.recentred(g, "beta", "n").select("l_suppkey", F.round("beta", 8).alias("centred"))


@query("""with s as (select count(*) as n, sum(l_quantity) as sx, sum(l_extendedprice) as sy, sum(l_quantity * l_quantity) as sxx, sum(l_quantity * l_extendedprice) as sxy, sum(l_extendedprice * l_extendedprice) as syy from lineitem),
b as (select *, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b1 from s), c as (select *, (sy - b1 * sx) / n as b0 from b), v as (select *, (syy - b0 * sy - b1 * sxy) / (n - 2) as s2 from c)
select 'intercept' as term, round(b0, 2) as estimate, round(sqrt(s2 * sxx / (n * sxx - sx * sx)), 3) as std_error from v union all select 'l_quantity', round(b1, 2), round(sqrt(s2 * n / (n * sxx - sx * sx)), 3) from v""")
def regression_standard_errors(spark, sf_dir):
    """Least squares from moment sums with standard errors."""
    l = table(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice"])
    return estimate.regression(l, ["l_quantity"], "l_extendedprice").select("term", F.round("estimate", 2).alias("estimate"), F.round("std_error", 3).alias("std_error"))


@query("""with l as (select l_orderkey % 5 as fold, l_suppkey, l_discount - 0.05 as y from lineitem), g as (select fold, l_suppkey, count(*) as n, sum(y) as s from l group by 1, 2), t as (select l_suppkey, sum(n) as n, sum(s) as s from g group by 1), al as (select unnest([1.0, 30.0, 300.0, 3000.0]) as alpha),
e as (select alpha, l.fold, avg((l.y - (t.s - g.s) / (t.n - g.n + alpha)) ** 2) as mse from l join g on g.fold = l.fold and g.l_suppkey = l.l_suppkey join t on t.l_suppkey = l.l_suppkey, al group by 1, 2),
m as (select alpha, avg(mse) as mse, stddev_samp(mse) / sqrt(count(*)) as se from e group by 1), b as (select mse + se as most from m order by mse limit 1)
select max(alpha) as alpha from m, b where mse <= most""")
def one_error_rule(spark, sf_dir):
    """The strongest penalty whose error over five folds is within one standard error of the best."""
    l = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_discount"]).select((F.col("l_orderkey") % 5).alias("fold"), "l_suppkey", (F.col("l_discount") - 0.05).alias("y"))
    g = l.groupBy("fold", "l_suppkey").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    t = g.groupBy("l_suppkey").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    alphas = [1.0, 30.0, 300.0, 3000.0]
    j = g.join(t, "l_suppkey").withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in alphas))))
    b = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n") + F.col("alpha"))
    e = j.groupBy("alpha", "fold").agg((F.sum(F.col("q") - 2 * b * F.col("s") + b * b * F.col("n")) / F.sum("n")).alias("mse"))
    return estimate.one_standard_error(e, "alpha", "mse")


@query("""with o as (select o_custkey, o_orderdate::date as d, o_totalprice as v from orders), days as (select d, sum(v) as s, count(*) as n from o group by 1),
c as (select d, sum(s) over w / sum(n) over w as m from days window w as (order by d rows between unbounded preceding and 1 preceding))
select o_custkey, strftime(o.d, '%Y-%m-%d') as day, round(v - m, 3) as centred from o join c on o.d = c.d where m is not null""")
def asof_centering(spark, sf_dir):
    """Prices less the mean of all days before."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]).select("o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    c = o.groupBy("d").agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("d", (F.sum("s").over(w) / F.sum("n").over(w)).alias("m"))
    return o.join(c, "d").where("m is not null").select("o_custkey", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round(F.col("v") - F.col("m"), 3).alias("centred"))


@query("""with x as (select max(o_orderdate::date) as top from orders), g as (select o_custkey, o_totalprice as v, 0.5 ** (datediff('day', o_orderdate::date, top) / 180.0) as w from orders, x), l as (select sum(w * v) / sum(w) as m from g)
select o_custkey, round((sum(w * v) + 3 * m) / (sum(w) + 3), 3) as value from g, l group by o_custkey, m""")
def decayed_snapshot(spark, sf_dir):
    """Values decayed by half in 180 days before the last one, shrunk to the league's as by a weight of 3."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    top = o.agg(F.max(F.to_date("o_orderdate"))).scalar()
    g = o.select("o_custkey", F.col("o_totalprice").alias("v"), F.pow(F.lit(0.5), F.datediff(top, F.to_date("o_orderdate")) / 180.0).alias("w"))
    m = g.agg(F.sum(F.col("w") * F.col("v")) / F.sum("w")).scalar()
    sums = g.groupBy("o_custkey").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"))
    return sums.select("o_custkey", F.round((F.col("wv") + 3 * m) / (F.col("w") + 3), 3).alias("value"))


@query("""with recursive e as (select user_id, ts::date as d, case when event_type = 'purchase' then 1 else 0 end as ask, value as y, event_id from events),
dd as (select user_id, d, coalesce(sum(1 / 50.0) filter (where ask = 0 and y is not null), 0) as info, coalesce(sum(y / 50.0) filter (where ask = 0 and y is not null), 0) as wy, row_number() over (partition by user_id order by d) as rn from e group by 1, 2),
s as (select user_id, d, rn, info, wy, 40.0::double as m, 100.0::double as v from dd where rn = 1
 union all select n.user_id, n.d, n.rn, n.info, n.wy, case when n.d - s.d > 3 then 40.0 when s.info > 0 then (s.m / s.v + s.wy) / (1 / s.v + s.info) else s.m end,
  case when n.d - s.d > 3 then 100.0 else (case when s.info > 0 then 1 / (1 / s.v + s.info) else s.v end) + 0.5 * (n.d - s.d) + case when month(n.d) <> month(s.d) then 2.0 else 0 end end from s join dd n on n.user_id = s.user_id and n.rn = s.rn + 1)
select e.user_id, e.event_id, round(s.m, 6) as pre_mean, round(s.v, 6) as pre_var from e join s on s.user_id = e.user_id and s.d = e.d""")
def state_before_day(spark, sf_dir):
    """What a filter knew before each event's day: a day's events together, purchases only ask, months as
    seasons, states of more than three days ago forgotten."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id", "ts", "event_type", "value"])
    e = e.select("user_id", "event_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").alias("ask"), F.col("value").alias("y"), F.lit(1.0).alias("e"), F.month("ts").alias("season"))
    got = estimate.day_filter(e, by=["user_id"], day="day", tie=["event_id"], value="y", exposure="e", query_only="ask", season="season", prior_mean=40.0, prior_var=100.0, q_day=0.5, q_season=2.0, r=50.0, expire_days=3)
    return got.select("user_id", "event_id", F.round("pre_mean", 6).alias("pre_mean"), F.round("pre_var", 6).alias("pre_var"))
