"""Recurrences along the ordered rows of a key, in one streaming pass.

Rows are partitioned by key and sorted; batches pass through a task one after the other and only the
state of the key at hand is kept. Time and memory are linear however long a key's sequence is: it is
never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def along(df: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, dict[str, object]]], made: str) -> DataFrame:
    """df with the columns that ``step`` makes: (state, rows of one key in order) -> (state, columns).

    A key's rows may come in several calls, each with the state that the one before left; ``start``
    gives the first. A null in a key is a key of its own; nulls in the order come first. ``made`` is
    the schema of the new columns.
    """
    kept = df.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [made])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            new = pd.Series(False, index=pdf.index)
            for c in by:
                x = pdf[c]
                new |= ~((x == x.shift()) | (x.isna() & x.shift().isna())).fillna(False).astype(bool)
            starts = [*(i for i, b in enumerate(new.to_numpy()) if b and i), len(pdf)]
            parts, a = [], 0
            for b in starts:
                piece = pdf.iloc[a:b]
                key = tuple(None if pd.isna(piece[c].iloc[0]) else piece[c].iloc[0] for c in by)
                if last is None or key != last[0]:
                    last, state = (key,), start()
                state, columns = step(state, piece)
                parts.append(piece[kept].assign(**columns))
                a = b
            yield pd.concat(parts)

    sorted_rows = df.repartition(*by).sortWithinPartitions(*by, *(F.col(c).asc_nulls_first() for c in order))
    return sorted_rows.mapInPandas(run, schema)
