"""Publication, logs, filters and streaming over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimate
from ..sources import files, publish
from ..streaming import pipelines
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


@query("select 'customers' as slug, c_custkey::varchar as row_key, c_name as name, c_mktsegment as segment from customer where c_acctbal >= 0")
def publish_current_view(spark, sf_dir):
    """Two versions are published, the pointer goes to the second: the view has its rows alone."""
    customers = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    old, new = customers.where("c_acctbal < 0"), customers.where("c_acctbal >= 0")
    sets = [publish.publish(d.drop("c_acctbal"), ["c_custkey"], expected=["c_name"], least=0) for d in (old, new)]
    versions = sets[0][1].unionByName(sets[1][1]).withColumn("dataset", F.lit("customers"))
    rows = sets[0][0].withColumn("version_id", sets[0][1].select("version_id").scalar()).unionByName(sets[1][0].withColumn("version_id", sets[1][1].select("version_id").scalar()))
    registry = sets[1][1].select(F.lit("customers").alias("slug"), F.col("version_id").alias("latest_version_id"))
    view = publish.current_rows(registry, versions, rows)
    return view.select("slug", "row_key", F.get_json_object("payload", "$.c_name").alias("name"), F.get_json_object("payload", "$.c_mktsegment").alias("segment"))


_BODY = "user_id::varchar || ':' || event_id::varchar || ':' || event_type"


@query(f"""with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events),
c as (select user_id, event_id, rn, sha256(repeat('0', 64) || {_BODY}) as h from e where rn = 1 union all select e.user_id, e.event_id, e.rn, sha256(c.h || e.user_id::varchar || ':' || e.event_id::varchar || ':' || e.event_type) from c join e on e.user_id = c.user_id and e.rn = c.rn + 1)
select user_id, event_id, h as record_hash from c""")
def hash_chain(spark, sf_dir):
    """Each user's append log, every record's hash over the one before it."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id", "event_type", "ts"])
    return publish.chain(e, ["user_id"], ["ts", "event_id"], F.concat_ws(":", "user_id", "event_id", "event_type")).select("user_id", "event_id", "record_hash")


@query("""with e as (select user_id, event_id, value > 99.5 as altered, lag(value > 99.5) over (partition by user_id order by ts, event_id) as before from events) select user_id, event_id from e where altered or before""")
def hash_chain_verify(spark, sf_dir):
    """Records altered in a real chain, hash kept, and records whose stored hash was replaced: an altered
    record breaks its own link, a replaced hash its own and the next one's."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id", "event_type", "ts", "value"])
    body = F.concat_ws(":", "user_id", "event_id", "event_type")
    log = publish.chain(e, ["user_id"], ["ts", "event_id"], body)
    broken = log.withColumn("record_hash", F.when(F.col("value") > 99.5, F.lit("f" * 64)).otherwise(F.col("record_hash")))
    return publish.broken_links(broken, ["user_id"], ["ts", "event_id"], body).select("user_id", "event_id")


@query("""select event_id, user_id from events where event_type <> 'view' qualify row_number() over (partition by user_id, ts::date order by ts desc, event_id desc) = 1
and not exists (select 1 from events k where k.event_type = 'view' and k.user_id = events.user_id and k.ts::date = events.ts::date)""")
def incremental_append(spark, sf_dir):
    """New user days of other events beside the days of views that are there already."""
    e = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "ts"]).withColumn("day", F.to_date("ts"))
    return files.append_new(e.where("event_type = 'view'"), e.where("event_type != 'view'"), ["user_id", "day"], order=["ts", "event_id"]).select("event_id", "user_id")


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'UPDATED' else c_mktsegment end as segment from customer union all select -c_custkey, 'NEW' from customer where c_acctbal < 0")
def upsert_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    old = c.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = old.where("segment = 'BUILDING'").select("c_custkey", F.lit("UPDATED").alias("segment"))
    new = c.where("c_acctbal < 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("segment"))
    return files.upsert(old, changed.unionByName(new), ["c_custkey"])


@query("""with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from events),
k as (select user_id, event_id, rn, (value * (100.0 + 1) / (100.0 + 1 + 50))::double as m, ((100.0 + 1) * 50 / (100.0 + 1 + 50))::double as v from e where rn = 1
union all select e.user_id, e.event_id, e.rn, k.m + (k.v + 1) / (k.v + 1 + 50) * (e.value - k.m), (1 - (k.v + 1) / (k.v + 1 + 50)) * (k.v + 1) from k join e on e.user_id = k.user_id and e.rn = k.rn + 1)
select user_id, event_id, round(m, 5) as mean, round(v, 5) as var from k""")
def kalman_one_step(spark, sf_dir):
    """A scalar filter along each user's ordered values, in one streaming pass."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id", "ts", "value"])
    got = estimate.scalar_filter(e, by=["user_id"], order=["ts", "event_id"], value="value", prior_var=100.0, q=1.0, r=50.0)
    return got.select("user_id", "event_id", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


_DAY = "(select user_id, ts::date as d, max_by(value, (ts, event_id)) as v from events group by 1, 2)"


@query(f"""with s as {_DAY}, c as (select distinct user_id, cut from events, (select unnest([date '1995-06-30', date '1997-12-31', date '2024-01-15', date '2024-02-15']) as cut))
select c.user_id, strftime(c.cut, '%Y-%m-%d') as cut, strftime(s.d, '%Y-%m-%d') as as_of, round(case when datediff('day', s.d, c.cut) <= 730 then s.v end, 4) as held from c asof left join s on c.user_id = s.user_id and c.cut > s.d""")
def held_snapshot(spark, sf_dir):
    """Last state strictly before each cut; null once it is older than 730 days."""
    from ..operators.joins import asof_join

    e = table(spark, sf_dir, "events", ["user_id", "event_id", "ts", "value"])
    s = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    cuts = F.array(*(F.lit(c).cast("date") for c in ("1995-06-30", "1997-12-31", "2024-01-15", "2024-02-15")))
    c = e.select("user_id").distinct().select("user_id", F.explode(cuts).alias("cut"))
    got = asof_join(c, s, left_on="cut", right_on="d", by=["user_id"], values=["v"], strict=True)
    held = F.when(F.datediff("cut", "_at") <= 730, F.col("v"))
    return got.select("user_id", F.date_format("cut", "yyyy-MM-dd").alias("cut"), F.date_format("_at", "yyyy-MM-dd").alias("as_of"), F.round(held, 4).alias("held"))


@query("select user_id, count(*) as n from (select distinct on (user_id, event_id) * from events) group by user_id")
def stream_ingest_once(spark, sf_dir):
    """The events read as a stream, deduplicated within a watermark, counted per user at its end."""
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path)).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    once = pipelines.ingest_once(stream, ["user_id", "event_id"], "ts", late="400 days")
    return pipelines.run_to_end(once).groupBy("user_id").agg(F.count("*").alias("n"))


def _folder(path: str) -> str:
    """A glob that a file stream takes for one file as well as for a folder of files."""
    return path if not path.endswith(".parquet") else path[: -len(".parquet")] + ".parq*t"


@query("""with i as (select *, coalesce(sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as session from events),
g as (select user_id, session, count(*) as n, sum(value) as total, max((event_type = 'purchase')::int) as done from i group by 1, 2) select user_id, session::bigint as session, n, round(total, 4) as total from g where done = 1""")
def stream_closed_sessions(spark, sf_dir):
    """Sessions closed by a purchase, from a stateful stream over the events."""
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path))
    order = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = stream.select("user_id", order.alias("place"), (F.col("event_type") == "purchase").alias("terminal"), "value")
    got = pipelines.run_to_end(pipelines.closed_sessions(rows, "user_id", "place", "terminal", "value"))
    return got.select("user_id", "session", "n", F.round("total", 4).alias("total"))


@query("""with g as (select l_suppkey, l_linenumber, count(*) as n, sum(l_discount) as s from lineitem group by 1, 2), t as (select l_suppkey, sum(s) / sum(n) as m from g group by 1)
select l_suppkey, round(m, 8) as mean from t""")
def cluster_sums(spark, sf_dir):
    """Means from per-cluster sufficient statistics (the small table a bootstrap resamples)."""
    g = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_linenumber", "l_discount"]).groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_discount").alias("s"))
    return g.groupBy("l_suppkey").agg(F.round(F.sum("s") / F.sum("n"), 8).alias("mean"))


_STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


@query(f"""with g as (select l_returnflag, l_orderkey, count(*) as n, sum(l_discount) as s from lineitem group by 1, 2), b as (select *, unnest(range(50)) as k from g), c as (select *, md5(l_orderkey || '-' || k) as h from b), d as (select *, unnest(range(4)) as j from c),
u as (select *, 4 * k + j as r, ('0x' || substr(h, 8 * j + 1, 8))::bigint / 4294967296.0 as u from d), w as (select *, {' + '.join(f'(u > {x})::int' for x in _STEPS)} as w from u),
m as (select l_returnflag, r, sum(w * s) / sum(w * n) as m from w group by 1, 2)
select l_returnflag, round(quantile_cont(m, 0.025), 8) as lo, round(quantile_cont(m, 0.5), 8) as mid, round(quantile_cont(m, 0.975), 8) as hi from m group by 1""")
def bootstrap_interval(spark, sf_dir):
    """Poisson bootstrap of the mean discount over orders as clusters, by hashed weights: l_returnflag, lo, mid, hi."""
    g = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_discount"]).groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"), F.sum("l_discount").alias("s"))
    # a hash has the numbers of four of the 200 rounds
    h = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("h", F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("k").cast("string"))))
    parts = F.array(*(F.struct((4 * F.col("k") + j).alias("r"), (F.conv(F.substring("h", 8 * j + 1, 8), 16, 10).cast("double") / 4294967296.0).alias("u")) for j in range(4)))
    b = h.select("l_returnflag", "n", "s", F.explode(parts).alias("x")).select("l_returnflag", "n", "s", "x.r", "x.u")
    # inverse of the Poisson(1) distribution function at u
    b = b.withColumn("w", sum((F.when(F.col("u") > x, 1).otherwise(0) for x in _STEPS), F.lit(0)))
    m = b.groupBy("l_returnflag", "r").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return m.groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", F.round(F.col("q")[0], 8).alias("lo"), F.round(F.col("q")[1], 8).alias("mid"), F.round(F.col("q")[2], 8).alias("hi"))


@query("""with s as (select *, row_number() over (order by l_orderkey, l_linenumber) as rn from (select l_orderkey, l_linenumber, l_shipdate::date as d from lineitem)) select strftime(d, '%Y-%m-%d') as day, count(*) as n from s group by 1""")
def stream_daily_counts(spark, sf_dir):
    """A watermarked daily window over line items as a stream, in complete mode."""
    path = f"{sf_dir}/lineitem.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(_folder(path)).select(F.col("l_shipdate").cast("timestamp").alias("ts"))
    got = pipelines.run_to_end(pipelines.windowed_counts(stream, "ts", "1 day", late="400 days"), mode="complete")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
