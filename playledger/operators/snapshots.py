"""Changes between consecutive full snapshots of one table.

Each snapshot is kept range-partitioned and sorted by key. One task owns a range of keys and
streams through the snapshots in order; it holds the slice of the snapshot before and merges the
next slice into it with two pointers, comparing the columns and emitting typed changes. Memory of
a task is two slices of one snapshot, whatever the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import broadcast_if_fits

KINDS = ("added", "removed", "changed")
_NULL = np.iinfo(np.int64).min  # a missing value in the compared columns


def at_precision(c: Column, decimals: int) -> Column:
    """A double as a whole number of 10^-decimals; null and NaN both give null.

    Values beyond the range of BIGINT at that precision (infinities too) are held at its ends.
    """
    scaled = F.round(c * F.lit(10.0**decimals))
    return F.when(
        c.isNotNull() & ~F.isnan(c),
        F.when(scaled >= F.lit(9.2e18), F.lit(2**63 - 1)).when(scaled <= F.lit(-9.2e18), F.lit(-(2**63) + 1)).otherwise(scaled.cast("bigint")),
    )


def _merge(before: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The two-pointer merge of two slices sorted by their first row (the keys, unique in each).

    Both pointers move at once for a whole slice: the place of each key of one side in the other
    is its pointer's position when that key comes up. Gives the keys of each kind of change.
    """
    a, b = before[0], after[0]
    at = np.searchsorted(b, a)
    there = np.zeros(len(a), dtype=bool)
    inside = at < len(b)
    there[inside] = b[at[inside]] == a[inside]
    met = at[there]
    new = np.ones(len(b), dtype=bool)
    new[met] = False
    differs = (before[1:, there] != after[1:, met]).any(axis=0)
    return [(b[new], 0), (a[~there], 1), (a[there][differs], 2)]


def _range_merge(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, sorted by (snapshot, key): its changes as (_at, _key, _kind)."""

    def out(parts: list[tuple[np.ndarray, int]], at: int) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in parts])
        if len(keys):
            kinds = np.repeat([kind for _, kind in parts], [len(k) for k, _ in parts])
            yield pa.record_batch([pa.array(np.full(len(keys), at, np.int32)), pa.array(keys), pa.array(kinds.astype(np.int32))], names=["_at", "_key", "_kind"])

    nothing = np.empty((1 + len(columns), 0), dtype=np.int64)
    before, before_at, parts, at, last = nothing, -1, [], -1, -1

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal before, before_at
        now = np.concatenate(parts, axis=1)
        if before_at >= 0 and at > before_at + 1:  # a snapshot without any key of this range
            yield from out([(before[0], 1)], before_at + 1)
            before = nothing
        if at > 0:  # the first snapshot has nothing before it
            yield from out(_merge(before, now), at)
        before, before_at = now, at

    for batch in batches:
        if not batch.num_rows:
            continue
        ats = batch.column("_at").to_numpy(zero_copy_only=False)
        last = int(batch.column("_last")[0].as_py())
        rows = np.stack([batch.column("_key").to_numpy(zero_copy_only=False), *(batch.column(c).fill_null(_NULL).to_numpy(zero_copy_only=False) for c in columns)])
        edges = [0, *(np.flatnonzero(np.diff(ats)) + 1).tolist(), len(ats)]
        for start, end in zip(edges, edges[1:], strict=False):
            if parts and ats[start] != at:
                yield from close()
                parts = []
            at = int(ats[start])
            parts.append(rows[:, start:end])
    if parts:
        yield from close()
        if at < last:
            yield from out([(before[0], 1)], at + 1)


def snapshot_changes(
    rows: DataFrame,
    *,
    snapshot: str,
    key: str,
    delivery: str,
    order: str,
    compare: Sequence[str],
    decimals: int = 3,
) -> DataFrame:
    """Changes between each snapshot and the one before it: (snapshot, key, change_kind).

    A snapshot's content is its highest ``delivery``; of several rows of a key in it the one with
    the highest ``order`` counts (then the greatest values, so that ties have one result).
    ``compare`` are numeric columns, equal if they are so after rounding to ``decimals``; null and
    NaN are one missing value. The first snapshot has no changes. Rows without snapshot or key
    belong to no list and are left out; a null delivery or order counts as the lowest. An empty
    table gives no changes. Columns not named do not matter.

    Repeats of a hot key within a snapshot are folded before the shuffle by the partial
    aggregation, so a key has at most one row per snapshot after it.
    """
    low = F.lit(-(2**62))
    values = [f"_c{i}" for i in range(len(compare))]
    narrow = rows.select(
        F.col(snapshot).alias("_snap"),
        F.col(key).cast("bigint").alias("_key"),
        F.coalesce(F.col(delivery).cast("bigint"), low).alias("_delivery"),
        F.coalesce(F.col(order).cast("bigint"), low).alias("_order"),
        *(at_precision(F.col(c), decimals).alias(v) for c, v in zip(compare, values, strict=True)),
    ).where("_snap is not null")
    # one row per snapshot; snapshots are days of a calendar, and their number is checked below
    content = narrow.groupBy("_snap").agg(F.max("_delivery").alias("_delivery"))
    by_time = Window.orderBy("_snap")
    content = content.select("_snap", "_delivery", (F.row_number().over(by_time) - 1).alias("_at"), (F.count("*").over(Window.partitionBy()) - 1).cast("int").alias("_last"))
    content = broadcast_if_fits(content, 100_000)
    kept = narrow.where("_key is not null").join(content, ["_snap", "_delivery"]).groupBy("_at", "_last", "_key").agg(F.max(F.struct("_order", *values)).alias("_row"))
    ranged = kept.select("_at", "_last", "_key", *(F.col(f"_row.{v}").alias(v) for v in values)).repartitionByRange("_key").sortWithinPartitions("_at", "_key")
    changes = ranged.mapInArrow(lambda batches: _range_merge(batches, values), "_at int, _key bigint, _kind int")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return changes.join(content.select("_at", "_snap"), "_at").select(F.col("_snap").alias(snapshot), F.col("_key").alias(key), F.element_at(kinds, F.col("_kind") + 1).alias("change_kind"))
