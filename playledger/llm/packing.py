"""Filling containers of fixed capacity by sum-of-squares packing.

The open containers are kept only as counts per residual gap. Each item goes where the sum of the
squared counts becomes smallest, which keeps all gaps about equally frequent, so that later items
find a gap that they close. Items are spread over shards by a hash of their key; a shard is packed
by one task, and shards have about equal size however the keys are spread over the sources.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_PER_SHARD = 50_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers); sizes are in 1..capacity, taken in order.

    Placing a size s into a gap g changes the sum by (N[g]-1)^2 - N[g]^2 + (N[g-s]+1)^2 - N[g-s]^2;
    gap 0 is closed and does not count, gap ``capacity`` is a new container. Of equal changes the
    smallest gap is taken.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        n_from = count[s:capacity]  # gaps s..capacity-1
        n_to = count[: capacity - s]
        change = np.where(n_from > 0, 2 * (n_to - n_from) + 2, far)
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        gap = capacity
        if len(change):
            if n_from[0] > 0:
                change[0] = 1 - 2 * n_from[0]  # closes a container: gap 0 does not count
            best = int(np.argmin(change))
            if change[best] != far and change[best] <= new:
                gap = best + s
        if gap == capacity:
            c = made
            made += 1
        else:
            c = stacks[gap].pop()
            count[gap] -= 1
        left = gap - s
        if left:
            stacks[left].append(c)
            count[left] += 1
        out[i] = c
    return out, made


def pack(items: DataFrame, kinds: DataFrame, *, key: str, size: str, kind: str, capacity: str, per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Where each item goes: kind, container (STRING), key, piece_no, start, n.

    An item above the capacity is cut into pieces; all but its last fill a container each, the last
    is packed as an item. No other item is cut. An item of size 0 takes no space; it stands in the
    first container of its shard, which is made if there is none. A null size counts as 0; items
    with a null key are packed too. Kinds without a capacity of at least 1 hold nothing and give no
    rows. The same input gives the same containers, but for items with a null key. Within a shard the
    largest items come first, then the lowest keys.
    """
    narrow = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("_size"))
    n = narrow.count()
    shards = max(1, -(-n // per_shard))
    valid = kinds.where(F.col(capacity) >= 1).select(F.col(kind).alias("_kind"), F.col(capacity).cast("int").alias("_capacity"))
    # two numbers a kind, where the result has a row per item and kind
    kind_type = dict(valid.dtypes)["_kind"]
    listed = json.dumps([{"k": r._kind, "c": r._capacity} for r in valid.collect()])
    each = F.from_json(F.lit(listed), f"array<struct<k:{kind_type},c:int>>")
    spread = narrow.withColumn("_shard", F.pmod(F.xxhash64(F.coalesce(F.col("_key"), F.monotonically_increasing_id())), F.lit(shards)).cast("int")).withColumn("_e", F.explode(each))
    spread = spread.select("_key", "_size", "_shard", F.col("_e.k").alias("_kind"), F.col("_e.c").alias("_capacity"))
    pieces = F.greatest(F.floor((F.col("_size") - 1) / F.col("_capacity")), F.lit(0)).cast("int")
    whole = spread.where("_size > _capacity").select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    whole = whole.select("_kind", F.format_string("%d-w%s-%d", "_shard", F.coalesce(F.col("_key").cast("string"), F.lit("")), "piece_no").alias("container"), "_key", "piece_no", (F.col("piece_no") * F.col("_capacity")).alias("start"), F.col("_capacity").alias("n"))
    rest = spread.select("_kind", "_capacity", "_shard", "_key", pieces.alias("piece_no"), (pieces * F.col("_capacity")).alias("start"), (F.col("_size") - pieces * F.col("_capacity")).alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "_key"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        sizes = pdf["n"].to_numpy()
        into = np.zeros(len(pdf), dtype=np.int64)
        filled = sizes > 0
        into[filled], _ = sum_of_squares(sizes[filled], int(pdf["_capacity"].iloc[0]))
        shard = int(pdf["_shard"].iloc[0])
        return pd.DataFrame({"_kind": pdf["_kind"], "container": [f"{shard}-{c}" for c in into], "_key": pdf["_key"], "piece_no": pdf["piece_no"], "start": pdf["start"], "n": pdf["n"]})

    kinds_type = dict(items.select(F.col(key).alias("k")).dtypes)["k"]
    schema = f"_kind {dict(valid.dtypes)['_kind']}, container string, _key {kinds_type}, piece_no int, start int, n int"
    packed = rest.groupBy("_kind", "_shard").applyInPandas(one, schema)
    return packed.unionByName(whole.select("_kind", "container", "_key", "piece_no", F.col("start").cast("int").alias("start"), "n")).select(F.col("_kind").alias(kind), "container", F.col("_key").alias(key), "piece_no", "start", "n")


def report(placed: DataFrame, kinds: DataFrame, *, kind: str, capacity: str) -> DataFrame:
    """Per kind: n_containers, n_tokens and the share of the space that is filled."""
    per = placed.groupBy(kind).agg(F.countDistinct("container").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return per.join(kinds.select(kind, capacity), kind).select(kind, capacity, "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col(capacity))).alias("filled"))
