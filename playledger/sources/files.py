"""Reading and writing tables as files: schemas told, drifting footers merged, appends without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, *, header: bool = True, bad_rows: str | None = None) -> DataFrame:
    """CSV with a told schema (never inferred); with ``bad_rows`` a column of that name keeps broken lines."""
    reader = spark.read.option("header", header).option("escape", '"')
    if bad_rows:
        schema = schema if isinstance(schema, str) else schema.toDDL()
        return reader.schema(f"{schema}, `{bad_rows}` string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_rows).csv(path)
    return reader.schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, paths: Sequence[str], *, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Several Parquet files or folders as one table with the columns of all of them, by name."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The column names in a file's footer; no data is read."""
    return spark.read.parquet(path).columns


def write_parquet(df: DataFrame, path: str, *, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    (df.write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` does not have, one per key (the last by ``order``).

    A null in a key equals a null.
    """
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)) if order else Window.partitionBy(*keys).orderBy(F.lit(1))
    one = incoming.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    known = existing.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    return one.join(known, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with the rows of incoming in place of those of equal key; incoming has unique keys."""
    new = incoming.select(*(F.col(k).alias(f"_k_{k}") for k in keys))
    kept = existing.join(new, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
