"""Tables from HTTP: CSV files, JSON pages and ranged table APIs, fetched on the executors with retries.

What is fetched is a list of addresses, one row each, spread over tasks; bodies go straight into rows
and never through the driver. Failures are rows with their reason, so that one bad address does not
end the job; ``only_good`` raises if there are any.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..session import cut

#: answers that may be other ones when asked again
AGAIN = (408, 425, 429, 500, 502, 503, 504)


def fetch_one(url: str, *, tries: int = 4, wait_s: float = 0.5, timeout_s: float = 60.0, headers: dict[str, str] | None = None, proxy: str | None = None) -> tuple[str | None, str | None, int]:
    """(body, error, tries used): asked again after a pause that doubles, where another answer may come."""
    handlers = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
    opener = urllib.request.build_opener(*handlers)
    error = "not asked"
    for n in range(1, tries + 1):
        try:
            with opener.open(urllib.request.Request(url, headers=headers or {}), timeout=timeout_s) as answer:
                return answer.read().decode("utf-8"), None, n
        except urllib.error.HTTPError as e:
            error = f"status {e.code}"
            if e.code not in AGAIN:
                return None, error, n
        except (urllib.error.URLError, OSError, UnicodeDecodeError) as e:
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            time.sleep(wait_s * 2 ** (n - 1))
    return None, error, tries


def fetch(urls: DataFrame, url: str = "url", *, threads: int = 8, tasks: int | None = None, **options) -> DataFrame:
    """urls with body, error and tries. ``threads`` requests run at once in a task; options go to ``fetch_one``.

    A null address gives a null body and the error 'no address'. The answers are kept in the shared
    folder, so that no address is asked again when the result is read twice.
    """
    columns = [c for c in urls.columns if c not in ("body", "error", "tries")]
    kinds = dict(urls.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["body string", "error string", "tries int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(lambda u: fetch_one(u, **options) if isinstance(u, str) else (None, "no address", 0), pdf[url]))
                body, error, tries = zip(*got, strict=True) if got else ((), (), ())
                yield pdf[columns].assign(body=list(body), error=list(error), tries=list(tries))

    spread = urls.select(*columns).repartition(tasks or max(1, urls.sparkSession.sparkContext.defaultParallelism))
    return cut(spread.mapInPandas(run, schema))


def only_good(fetched: DataFrame) -> DataFrame:
    """The fetched rows, if none has an error."""
    bad = fetched.where("error is not null").limit(3).collect()
    if bad:
        raise ContractError(f"not fetched: {[(r[0], r.error) for r in bad]}")
    return fetched


def csv_over_http(spark: SparkSession, urls: Sequence[str], schema: str, *, header: bool = True, **options) -> DataFrame:
    """The records of CSV files behind addresses, by a told schema; a record may hold line breaks in quotes."""
    rows = only_good(fetch(spark.createDataFrame([(u,) for u in urls], "url string"), **options))
    # an even number of quotes before a line break means that it ends a record
    lines = rows.select("url", F.posexplode(F.split("body", r'\r?\n(?=(?:[^"]*"[^"]*")*[^"]*$)')).alias("n", "line")).where("line != ''")
    body = lines.where("n > 0") if header else lines
    return body.select(F.from_csv("line", schema, {"escape": '"'}).alias("r")).select("r.*")


def json_over_http(spark: SparkSession, urls: Sequence[str], item: str, *, at: str | None = None, **options) -> DataFrame:
    """The items of JSON arrays behind addresses; ``at`` names the member that holds the array."""
    rows = only_good(fetch(spark.createDataFrame([(u,) for u in urls], "url string"), **options))
    body = F.get_json_object("body", f"$.{at}") if at else F.col("body")
    return rows.select(F.explode(F.from_json(body, f"array<struct<{item}>>")).alias("r")).select("r.*")


def ranged_table(spark: SparkSession, base: str, item: str, *, rows: int, page: int = 1000, **options) -> DataFrame:
    """A table served in pages by limit and offset: as many addresses as ``rows`` need."""
    joint = "&" if "?" in base else "?"
    return json_over_http(spark, [f"{base}{joint}limit={page}&offset={k}" for k in range(0, max(rows, 1), page)], item, **options)
