"""Structured Streaming forms of the incremental steps: ingest once, close sessions by a terminal
event, keep filter states, hold late records back from a fence."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingest_once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key's first arrival; repeats within the watermark are left out."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def before_fence(stream: DataFrame, sent: str, fence: str) -> DataFrame:
    """Records sent before their fence (a tip-off); later ones tell what was not known."""
    return stream.where(F.col(sent) < F.col(fence))


def closed_sessions(stream: DataFrame, key: str, order: str, terminal: str, value: str) -> DataFrame:
    """key, session, n, total: a session ends with a terminal row; open sessions stay in state.

    Rows of one trigger are taken in order; a row that comes in a later trigger than a row after it
    belongs to the session open then.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples():
            n, total = n + 1, total + float(getattr(row, value))
            if getattr(row, terminal):
                out.append((k[0], session, n, total))
                session, n, total = session + 1, 0, 0.0
        state.update((session, n, total))
        yield pd.DataFrame(out, columns=[key, "session", "n", "total"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, session bigint, n bigint, total double", "session bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)


def filter_states(stream: DataFrame, key: str, order: str, value: str, *, prior_var: float, q: float, r: float) -> DataFrame:
    """key, order, mean, var after each row of a scalar Kalman filter whose state outlives triggers."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v = state.get if state.exists else (0.0, prior_var)
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples():
            y = getattr(row, value)
            v += q
            if y is not None and y == y:
                g = v / (v + r)
                m, v = m + g * (y - m), (1 - g) * v
            out.append((k[0], getattr(row, order), m, v))
        state.update((m, v))
        yield pd.DataFrame(out, columns=[key, order, "mean", "var"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, mean double, var double", "mean double, var double", "append", GroupStateTimeout.NoTimeout)


def expiring_states(stream: DataFrame, key: str, day: str, value: str, *, expire_days: int = 730) -> DataFrame:
    """key, day, n, mean of the values before each row; a state not touched for ``expire_days`` is forgotten.

    ``day`` is a timestamp with a watermark. A row after a longer gap starts anew, and a key whose
    time the watermark has passed by that much leaves the state store.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, None)
        out = []
        for row in pd.concat(list(batches)).sort_values([day, value], kind="stable").itertuples():
            at, y = getattr(row, day), getattr(row, value)
            if last is not None and (at - last).days > expire_days:
                n, total = 0, 0.0
            out.append((k[0], at, n, total / n if n else None))
            if y is not None and y == y:
                n, total = n + 1, total + y
            last = at
        if last is not None:
            state.update((n, total, last))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + expire_days * 86_400_000 + 1)
        yield pd.DataFrame(out, columns=[key, day, "n", "mean"]).astype({"mean": "float64"})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {day} timestamp, n bigint, mean double", "n bigint, total double, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def add_sums(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch's sufficient statistics under its own number.

    Written again after a failure, a batch replaces itself; the total is the sum over batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def run_to_end(stream: DataFrame, mode: str = "append", *, checkpoint: str | None = None) -> DataFrame:
    """What a stream gives of all that is there now, from a table written in the shared folder.

    Each batch has a folder of its own, which a repeated batch replaces; in complete mode the last
    batch is the result. Nothing passes through the driver. With a ``checkpoint`` the stream goes on
    from there when run again.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{base}/rows"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        last.append(number)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{base}/checkpoint").start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{target}/batch={last[-1]}")
    return spark.read.schema(stream.schema).parquet(*(f"{target}/batch={n}" for n in sorted(set(last))))
