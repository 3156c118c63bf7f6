"""Versioned publication: immutable content-addressed versions, a pointer, and a view of the current rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts
from ..operators.sequences import along


def row_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))


def payload_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_key, payload (JSON with columns by name) and its SHA-256."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(row_key(keys).alias("row_key"), body.alias("payload")).withColumn("row_hash", F.sha2("payload", 256))


def version_of(rows: DataFrame) -> DataFrame:
    """One row: version_id, row_count. The id depends on the rows' content, not on their order.

    Row hashes are added up in four parts of 32 bits, so nothing is gathered to make the id.
    """
    parts = [F.sum(F.conv(F.substring("row_hash", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.agg(F.count("*").alias("row_count"), *(p.alias(f"p{i}") for i, p in enumerate(parts))).select(F.sha2(F.concat_ws("-", "row_count", "p0", "p1", "p2", "p3"), 256).alias("version_id"), "row_count")


def publish(df: DataFrame, keys: Sequence[str], *, expected: Sequence[str] = (), least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, version) of a dataset that keeps its contract: columns there, keys unique, rows enough."""
    contracts.expect_columns(df, expected)
    contracts.expect_unique(df, keys)
    rows = payload_rows(df, keys)
    version = version_of(rows)
    if version.first().row_count < least:
        raise contracts.ContractError(f"fewer than {least} rows")
    return rows, version


def current_rows(registry: DataFrame, versions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each dataset's latest version, where that version belongs to it and has all its rows."""
    have = rows.groupBy("version_id").agg(F.count("*").alias("_have"))
    good = registry.join(versions, [registry.latest_version_id == versions.version_id, registry.slug == versions.dataset]).select("slug", "version_id", "row_count")
    whole = good.join(have, "version_id").where("row_count = _have").select("slug", "version_id")
    return rows.join(whole, "version_id").select("slug", "version_id", "row_key", "payload")


def chain(log: DataFrame, by: Sequence[str], order: Sequence[str], body: Column) -> DataFrame:
    """log with record_hash over its body and the hash before it, per key in order; a null body counts as ''."""

    def step(h: str, rows: pd.DataFrame) -> tuple[str, dict]:
        out = []
        for b in rows["_body"]:
            h = hashlib.sha256((h + ("" if b is None else b)).encode()).hexdigest()
            out.append(h)
        return h, {"record_hash": out}

    return along(log.withColumn("_body", body), by, order, lambda: "0" * 64, step, "record_hash string").drop("_body")


def broken_links(log: DataFrame, by: Sequence[str], order: Sequence[str], body: Column) -> DataFrame:
    """Records whose hash does not follow from the stored hash before them: one window, no fold."""
    w = Window.partitionBy(*by).orderBy(*order)
    prev = F.coalesce(F.lag("record_hash").over(w), F.lit("0" * 64))
    return log.withColumn("_want", F.sha2(F.concat(prev, F.coalesce(body, F.lit(""))), 256)).where("record_hash is null or record_hash != _want").drop("_want")


def promote(spark: SparkSession, at: str, slug: str, rows: DataFrame, version: DataFrame) -> str:
    """Write a version's rows and let the dataset's pointer show it; returns the version's id.

    Rows are written to a folder named by their content, then the pointer, a file of its own, is put in
    place by one rename: a reader sees the version before or this one, never half of it. The same
    version promoted again is not written again. Pointers are numbered and never changed.
    """
    version_id = version.first().version_id
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    rows_at = f"{at}/{slug}/versions/{version_id}"
    if not fs.exists(path(f"{rows_at}/_SUCCESS")):
        rows.write.mode("overwrite").parquet(rows_at)
    number = len(history(spark, at, slug)) + 1
    draft = path(f"{at}/{slug}/drafts/{version_id}-{number}")
    out = fs.create(draft, True)
    out.write(bytearray(version_id.encode()))
    out.close()
    fs.mkdirs(path(f"{at}/{slug}/pointers"))
    if not fs.rename(draft, path(f"{at}/{slug}/pointers/{number:012d}-{version_id}")):
        raise contracts.ContractError(f"{slug}: another promotion took number {number}")
    return version_id


def history(spark: SparkSession, at: str, slug: str) -> list[str]:
    """The ids of the versions that the dataset's pointer has shown, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{slug}/pointers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    return [n.partition("-")[2] for n in names if not n.startswith(".")]


def promoted(spark: SparkSession, at: str, slug: str) -> DataFrame:
    """The rows of the version that the pointer shows."""
    shown = history(spark, at, slug)
    if not shown:
        raise contracts.ContractError(f"{slug} has no version")
    return spark.read.parquet(f"{at}/{slug}/versions/{shown[-1]}")


def visible(df: DataFrame, grants: DataFrame, *, role: str, on: Sequence[str]) -> DataFrame:
    """The rows that a role's grants (role, and the columns of ``on``) let it see; without a grant none."""
    return df.join(grants.where(F.col("role") == role).select(*on).distinct(), list(on), "left_semi")
