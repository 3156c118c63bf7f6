"""Table access: one Parquet file or folder per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
    "raw_event", "ft_sequence", "parsed_free_throw", "game_metadata", "player_game", "epm_snapshot",
    "player_rating_history", "team", "documents", "container_kind", "skill_file_row", "feed_line",
)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table ``name`` below ``sf_dir``; columns beyond ``columns`` are dropped at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def fits(df: DataFrame, most: int) -> bool:
    """Whether df has at most ``most`` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def broadcast_if_fits(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its row count was checked to be at most ``most``, else df as it is."""
    return F.broadcast(df) if fits(df, most) else df
