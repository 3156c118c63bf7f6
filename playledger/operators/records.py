"""Delimited records split by a quote-aware finite-state machine that runs over chunks of bytes.

All records of a batch are laid end to end, each followed by an end symbol, and the bytes are cut
into chunks of equal length wherever that falls. For each chunk the machine's effect is a map from
the state before it to the state after it; it is found for all chunks and all states at once. A
prefix composition of these maps gives the state in which every chunk begins, and a second pass
gives the state at every byte. No chunk has to wait for the one before it, so one very long record
costs as much per byte as many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# states: at the start of a field, in a bare field, in quotes, after a quote in quotes, broken
START, BARE, QUOTED, CLOSED, BROKEN = range(5)
# symbols: anything, comma, quote, end of a record, filler after the last record
OTHER, COMMA, QUOTE, END, FILL = range(5)
#: NEXT[symbol, state]
NEXT = np.array(
    [
        [BARE, BARE, QUOTED, BROKEN, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
        [START, START, START, START, START],
        [START, BARE, QUOTED, CLOSED, BROKEN],
    ],
    dtype=np.uint8,
)
CHUNK = 128


def states(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The machine's state before each symbol, beginning in START."""
    n = len(symbols)
    rows = max(1, -(-n // chunk))
    grid = np.full(rows * chunk, FILL, dtype=np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # effect of each chunk: from each state before it to the state after it
    effect = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for column in grid:
        effect = NEXT[column[:, None], effect]
    # prefix composition by doubling: effect[i] becomes that of chunks 0..i
    step = 1
    while step < rows:
        effect[step:] = np.take_along_axis(effect[step:], effect[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.concatenate([np.array([START], dtype=np.uint8), effect[:-1, START]])
    found = np.empty((chunk, rows), dtype=np.uint8)
    for k, column in enumerate(grid):
        found[k] = now
        now = NEXT[column, now]
    return found.T.reshape(-1)[:n]


_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord(",")], _CLASS[ord('"')] = COMMA, QUOTE


def split_batch(text: pa.Array, chunk: int = CHUNK) -> tuple[pa.Array, pa.Array]:
    """(fields ARRAY<STRING>, error_offset BIGINT) of each record.

    A record whose quoting is broken has null fields and the byte at which it broke (the length
    of the record if a quote stays open); any other has its fields, unescaped, and a null offset.
    A null text counts as an empty record. It has one empty field, as an empty text has.
    """
    n = len(text)
    blob = text.cast(pa.large_binary()).fill_null(b"")
    if isinstance(blob, pa.ChunkedArray):
        blob = blob.combine_chunks()
    offsets = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + n + 1]
    data = np.frombuffer(blob.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = offsets[1:] + np.arange(n)  # where each record's end symbol stands
    total = int(offsets[-1]) + n
    body = np.ones(total, dtype=bool)
    body[ends] = False
    symbols = np.full(total, END, dtype=np.uint8)
    symbols[body] = _CLASS[data]
    before = states(symbols, chunk)
    after = NEXT[symbols, before]
    bad = np.isin(before[ends], (QUOTED, BROKEN))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if n else ends
    # the first byte that leads to BROKEN, for the records that have one
    breaks = np.flatnonzero((after == BROKEN) & (before != BROKEN))
    error = np.where(bad, ends - starts, 0)
    if len(breaks):
        of = np.searchsorted(ends, breaks)
        error[of] = breaks - starts[of]
    # bytes that stay: neither separators, ends nor the quotes around and before others
    separates = (symbols == COMMA) & (before != QUOTED) & (before != BROKEN)
    drops = separates | ~body | ((symbols == QUOTE) & ((before == START) | (before == QUOTED)))
    good = ~bad
    keep = ~drops
    whole = np.repeat(good, ends - starts + 1)
    keep &= whole
    closes = (separates | ~body) & whole  # each ends one field of a good record
    at = np.flatnonzero(closes)
    upto = np.cumsum(keep, dtype=np.int64)
    field_offsets = np.concatenate([np.zeros(1, np.int64), upto[at]])
    kept = np.empty(total, dtype=np.uint8)
    kept[body] = data
    values = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(field_offsets), pa.py_buffer(kept[keep].tobytes())).cast(pa.string())
    per = np.cumsum(np.bincount(np.searchsorted(ends, at), minlength=n)) if n else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), per]).astype(np.int32)), values, mask=pa.array(bad))
    return lists, pa.array(error.astype(np.int64), mask=good)


def split_records(df: DataFrame, text: str) -> DataFrame:
    """df with _fields ARRAY<STRING> and _error_offset BIGINT of the comma-separated column ``text``.

    Columns of df with these names are left out; all others stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    df = df.drop("_fields", "_error_offset")
    schema = StructType([*df.schema.fields]).add("_fields", ArrayType(StringType())).add("_error_offset", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, errors = split_batch(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, errors], schema=pa.schema([*batch.schema, arrow.field("_fields"), arrow.field("_error_offset")]))

    return df.mapInArrow(run, schema)


# fixed values: the feeds' columns and the forms of their valid values
GAME_ID = r"[0-9]{1,10}(\.0)?"
COUNT = r"[0-9]{1,9}"
PERSON = r"[0-9]{1,12}"
SCORE = r"[0-9]{1,3}"
TEAM = r"[A-Z]{3}"
DIGIT_OR_NOTHING = r"[1-9]?"
FEEDS: dict[str, dict[str, tuple[str | None, str]]] = {
    "substitution": {
        "game_id": (GAME_ID, "game_id"),
        "period": (r"[1-9]|10", "int"),
        "elapsed_tenths": (r"[0-9]+(\.[0-9]+)?", "double"),
        "event_num": (COUNT, "bigint"),
        "outgoing": (PERSON, "bigint"),
        "incoming": (PERSON, "bigint"),
        "description": (None, "string"),
    },
    "game_metadata": {
        "game_id": (GAME_ID, "game_id"),
        "home_team": (TEAM, "string"),
        "away_team": (TEAM, "string"),
        "home_score": (SCORE, "int"),
        "away_score": (SCORE, "int"),
        "game_date": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "date"),
        "venue": (None, "string"),
    },
    "free_throw": {
        "game_id": (GAME_ID, "game_id"),
        "event_num": (COUNT, "bigint"),
        "description": (None, "string"),
        "made": (r"[01]", "int"),
        "declared_num": (DIGIT_OR_NOTHING, "int"),
        "declared_total": (DIGIT_OR_NOTHING, "int"),
        "explicit_kind": (r"ordinary|technical|flagrant|clear_path", "string"),
        "ambiguous_no_outcome_marker": (r"(?i:true|false)|[01]", "boolean"),
    },
}


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _typed(c: Column, form: str | None, kind: str) -> Column:
    if form is None:
        return c
    t = _trimmed(c)
    if kind == "string":
        return t
    if kind == "game_id":
        return F.lpad(F.regexp_replace(t, r"\.0$", ""), 10, "0")
    if kind == "boolean":
        return F.lower(t).isin("true", "1")
    return t.try_cast(kind)


def classify(lines: DataFrame, *, feed: str = "feed", text: str = "line_text") -> DataFrame:
    """lines with _fields, _error_offset, _bad_field and reason.

    reason is null for a valid line, else the first that applies of ``quoting`` (by RFC 4180;
    _error_offset has the byte), ``column_count`` and ``invalid_value`` (_bad_field has the first
    column at fault). A null or empty line has one empty field. A line of an unknown or null feed
    has no valid number of columns.
    """
    split = split_records(lines, text)
    known = F.col(feed)
    n = F.size("_fields")
    count_ok = F.lit(False)
    bad = F.lit(None).cast("string")
    for name, columns in FEEDS.items():
        count_ok = F.when(known == name, n == len(columns)).otherwise(count_ok)
        first = F.lit(None).cast("string")
        for k, (column, (form, kind)) in reversed(list(enumerate(columns.items()))):
            if form is None:
                continue
            value = _trimmed(F.get("_fields", F.lit(k)))
            ok = value.rlike(f"\\A(?:{form})\\z")
            if kind == "date":
                ok = ok & value.try_cast("date").isNotNull() & ~value.startswith("0000")
            first = F.when(~F.coalesce(ok, F.lit(False)), F.lit(column)).otherwise(first)
        bad = F.when(known == name, first).otherwise(bad)
    return split.withColumn("_bad_field", F.when(F.col("_fields").isNotNull() & F.coalesce(count_ok, F.lit(False)), bad)).withColumn(
        "reason",
        F.when(F.col("_fields").isNull(), "quoting").when(~F.coalesce(count_ok, F.lit(False)), "column_count").when(F.col("_bad_field").isNotNull(), "invalid_value"),
    )


def typed_rows(classified: DataFrame, of: str, keep: list[str], *, feed: str = "feed") -> DataFrame:
    """The valid lines of one feed with typed columns; ``keep`` are columns of the line to keep.

    Blanks around a value go with its form; columns of any text keep theirs.
    """
    fields = [_typed(F.get("_fields", F.lit(k)), form, kind).alias(column) for k, (column, (form, kind)) in enumerate(FEEDS[of].items())]
    return classified.where((F.col(feed) == of) & F.col("reason").isNull()).select(*keep, *fields)
