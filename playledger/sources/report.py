"""Reports of small tables as one page of HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession

from ..contracts import ContractError


def table_html(df: DataFrame, title: str, *, most: int = 10_000) -> str:
    """A page with the table; one of more than ``most`` rows is no report and raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"a report of more than {most} rows")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    name = html.escape(title)
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{name}</title></head>\n<body><h1>{name}</h1>\n<table><thead><tr>{head}</tr></thead>\n<tbody>\n{body}\n</tbody></table></body></html>\n'


def write_html(df: DataFrame, path: str, title: str, *, most: int = 10_000) -> None:
    """The page as a file of the session's file system; what was there before is replaced."""
    spark: SparkSession = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(table_html(df, title, most=most).encode()))
    out.close()
