"""Joins beyond equality: as-of, interval, tolerance, provenance, and checked cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: Sequence[str] = (), values: Sequence[str], strict: bool = False, stale: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """left with ``values`` of the last right row at or before (``strict``: before) ``left_on``.

    Both sides go into one sequence per key and the last right row is carried forward as a struct,
    so that null values of it stay null. ``by`` are equal columns; rows with a null in them or in
    the time match nothing. Of right rows of one time the greatest by ``ties`` counts. With
    ``stale``, a match older than so many days gives nulls. One shuffle, whatever the sizes.
    """
    by = list(by)
    payload = F.struct(F.col(right_on).alias("_at"), *values)
    kind = left.select(F.struct(*left.columns)).schema[0].dataType
    state = right.select(payload.alias("s")).schema[0].dataType
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_k"), F.struct(*ties, F.lit(0).alias("_z")).alias("_tie") if ties else F.struct(F.lit(0).alias("_z")).alias("_tie"), payload.alias("_s"), F.lit(None).cast(kind).alias("_l"))
    r = r.where(" and ".join(f"`{c}` is not null" for c in [*by, "_t"]))
    tie = r.select("_tie").schema[0].dataType
    q = left.select(*by, F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_k"), F.lit(None).cast(tie).alias("_tie"), F.lit(None).cast(state).alias("_s"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*by).orderBy("_t", "_k", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = r.unionByName(q).select(*by, "_t", "_l", F.last("_s", ignorenulls=True).over(w).alias("_s")).where("_l is not null")
    ok = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    if stale is not None:
        ok = ok & (F.datediff("_t", "_s._at") <= stale)
    return carried.select("_l.*", *(F.when(ok, F.col(f"_s.{v}")).alias(v) for v in values), F.when(ok, F.col("_s._at")).alias("_at"))


def interval_join(points: DataFrame, spans: DataFrame, *, at: str, start: str, end: str, by: Sequence[str] = (), width: float) -> DataFrame:
    """points inside half-open spans [start, end) of equal ``by``.

    Both sides are cut into buckets of ``width`` on the axis, so the join is one of equality on key
    and bucket; a span is repeated once per bucket it touches. Choose width near a span's length.
    """
    b = "_bucket"
    p = points.withColumn(b, F.floor(F.col(at) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn(b, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*by, b]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(b)


def tolerance_join(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: Sequence[str], tolerance: float) -> DataFrame:
    """Pairs of equal ``by`` whose numbers differ by less than ``tolerance``, found by buckets."""
    b = "_bucket"
    near = F.floor(F.col(left_on) / tolerance)
    lft = left.withColumn(b, F.explode(F.array(near - 1, near, near + 1)))
    return lft.join(right.withColumn(b, F.floor(F.col(right_on) / tolerance)), [*by, b]).where(F.abs(F.col(left_on) - F.col(right_on)) < tolerance).drop(b)


def full_with_provenance(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with _merge: both, left_only or right_only."""
    joined = left.withColumn("_in_left", F.lit(True)).join(right.withColumn("_in_right", F.lit(True)), list(on), "full")
    side: Column = F.when(F.col("_in_left") & F.col("_in_right"), "both").when(F.col("_in_left"), "left_only").otherwise("right_only")
    return joined.withColumn("_merge", side).drop("_in_left", "_in_right")


def unordered_pairs(df: DataFrame, by: Sequence[str], member: str, first: str = "a", second: str = "b") -> DataFrame:
    """Each unordered pair of distinct members of a small group (a lineup), once per group.

    Groups must be small by definition; members are gathered into one array per group.
    """
    sets = df.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("_m"))
    pairs = F.flatten(F.transform("_m", lambda x, i: F.transform(F.slice(F.col("_m"), i + 2, F.size("_m")), lambda y: F.struct(x.alias(first), y.alias(second)))))
    return sets.select(*by, F.explode(pairs).alias("_p")).select(*by, f"_p.{first}", f"_p.{second}")
