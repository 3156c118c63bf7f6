"""Attributes of an entity as they were known at the time of an event.

Events and attribute changes are put into one sequence per entity, sorted by the time from which
each is available, attribute changes before events of the same instant, and the best attribute so
far is carried forward. An attribute has two times: the day it applies from and the instant it was
known from. Both are brought onto the one time axis of the events: with ``off`` the number of days
from an event's instant to the event's own date, an attribute of day r known from instant k is
available to those events from max(k, midnight of r - off) on. Entities see only the few
values of ``off`` that their own events have.

What is carried is the greatest (day, rank) seen, so late deliveries of an earlier day do not
replace a later one. The greatest of a whole is the greatest of its parts: sequences are cut into
calendar months, each month is carried on its own, and the best of all months before is added, so
an entity with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known_at(events: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """events with one struct column per source: the attribute that applied and was known, or null.

    events: _entity BIGINT, _date DATE, _time TIMESTAMP_NTZ and any further columns. Each source:
    _entity, _day DATE, _rank INT, _known TIMESTAMP_NTZ, _value DOUBLE; the result's struct has
    _day, _rank and _value of the row with _day <= _date and _known <= _time that has the latest
    _day, then the highest _rank (then the greatest value). Source rows with a null in entity, day
    or known apply to nothing; events with a null entity, date or time get null. Events are kept
    one for one.
    """
    spare = [c for c in events.columns if c not in ("_entity", "_date", "_time")]
    names = list(sources)
    whole = F.col("_entity").isNotNull() & F.col("_date").isNotNull() & F.col("_time").isNotNull()
    placed = events.where(whole).withColumn("_off", F.datediff("_date", F.to_date("_time")))
    offs = placed.select("_entity", "_off").distinct()
    nothing = F.lit(None).cast("struct<_day:date,_rank:int,_value:double>")

    def changes(name: str) -> DataFrame:
        rows = sources[name].where("_entity is not null and _day is not null and _known is not null").join(offs, "_entity")
        best = F.struct("_day", "_rank", "_value")
        return rows.select(
            "_entity",
            "_off",
            F.greatest("_known", F.date_sub("_day", F.col("_off")).cast("timestamp_ntz")).alias("_t"),
            *((best if n == name else nothing).alias(n) for n in names),
        )

    attributes = changes(names[0])
    for name in names[1:]:
        attributes = attributes.unionByName(changes(name))
    attributes = attributes.withColumn("_month", F.trunc("_t", "month"))
    months = attributes.groupBy("_entity", "_off", "_month").agg(*(F.max(n).alias(n) for n in names))

    sequence = attributes.select("_entity", "_off", "_month", "_t", F.lit(0).alias("_tie"), *names, F.lit(None).cast(events.select(F.struct(*events.columns)).schema[0].dataType).alias("_event"))
    happened = placed.select(
        "_entity", "_off", F.trunc("_time", "month").alias("_month"), F.col("_time").alias("_t"), F.lit(1).alias("_tie"),
        *(nothing.alias(n) for n in names), F.struct(*events.columns).alias("_event"),
    )
    w = Window.partitionBy("_entity", "_off", "_month").orderBy("_t", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sequence.unionByName(happened).select("_entity", "_off", "_month", "_tie", "_event", *(F.max(n).over(w).alias(n) for n in names)).where("_tie = 1")

    # the months of events among the months of attributes: the best of all months before
    wanted = placed.select("_entity", "_off", F.trunc("_time", "month").alias("_month")).distinct()
    both = months.withColumn("_tie", F.lit(1)).unionByName(wanted.withColumns({"_tie": F.lit(0)} | {n: nothing for n in names}))
    last = Window.partitionBy("_entity", "_off").orderBy("_month", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    left = both.select("_entity", "_off", "_month", "_tie", *(F.max(n).over(last).alias(f"_to_{n}") for n in names)).where("_tie = 0").drop("_tie")
    joined = inside.join(left, ["_entity", "_off", "_month"], "left").select("_event.*", *(F.greatest(n, f"_to_{n}").alias(n) for n in names))
    without = events.where(~whole).withColumns({n: nothing for n in names})
    columns = ["_entity", "_date", "_time", *spare, *names]
    return joined.select(columns).unionByName(without.select(columns))
