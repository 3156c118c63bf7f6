"""Checks at the boundaries of a pipeline; each raises ContractError with what it found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data does not keep what was promised of it."""


def expect_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"keys {list(keys)} repeat, for example {[tuple(r)[:-1] for r in twice]}")
    return df


def expect_closure(df: DataFrame, whole: str, parts: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """The parts of each row add up to the whole."""
    gap = F.abs(F.col(whole) - sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0.0)))
    worst = df.agg(F.max(gap).alias("g")).first().g
    if worst is not None and worst > tolerance:
        raise ContractError(f"{whole} differs from its parts by {worst}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str = "many_to_one", how: str = "left") -> DataFrame:
    """A join whose sides are first checked: one_to_one, many_to_one or one_to_many."""
    if kind.endswith("_to_one"):
        expect_unique(right, on)
    if kind.startswith("one_"):
        expect_unique(left, on)
    return left.join(right, list(on), how)
