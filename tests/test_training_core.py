"""Snapshots, attributes known at event time and broken records: defined results on small input."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from playledger.operators.known_at import known_at
from playledger.operators.records import FEEDS, classify, split_batch, typed_rows
from playledger.operators.snapshots import snapshot_changes

SNAP = "requested_date date, player_id long, delivery_no int, row_no long, oepm double, depm double, extra string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    got = snapshot_changes(df, snapshot="requested_date", key="player_id", delivery="delivery_no", order="row_no", compare=["oepm", "depm"])
    return sorted((str(r.requested_date), r.player_id, r.change_kind) for r in got.collect())


def plain_changes(rows):
    content = {}
    for d, p, n, *_ in rows:
        content[d] = max(content.get(d, -1), n)
    tables = {}
    for d, p, n, r, o, e, _ in sorted(rows, key=lambda x: x[3]):
        if n == content[d]:
            tables.setdefault(d, {})[p] = tuple(None if v is None or v != v else round(v * 1000) for v in (o, e))
    out, days = [], sorted(tables)
    for a, b in zip(days, days[1:]):
        x, y = tables[a], tables[b]
        out += [(str(b), p, "added") for p in y.keys() - x.keys()] + [(str(b), p, "removed") for p in x.keys() - y.keys()]
        out += [(str(b), p, "changed") for p in x.keys() & y.keys() if x[p] != y[p]]
    return sorted(out)


def test_snapshot_changes_equal_plain_reading(spark):
    rng = random.Random(5)
    day = dt.date(2025, 11, 1)
    rows = []
    for d in range(6):
        for n in range(rng.choice([1, 2])):
            for p in rng.sample(range(40), rng.choice([0, 5, 30]) or 1):
                for r in range(rng.choice([1, 1, 3])):
                    rows.append((day + dt.timedelta(d), p, n, r * 100 + p, rng.choice([1.0, 1.0000001, 2.5, None, float("nan")]), rng.choice([0.5, None]), "x"))
    assert changes(spark, rows) == plain_changes(rows)


def test_snapshot_changes_of_odd_input(spark):
    d1, d2, d3 = (dt.date(2025, 1, k) for k in (1, 2, 3))
    assert changes(spark, []) == []
    assert changes(spark, [(d1, 1, 1, 1, 1.0, 1.0, None)]) == []
    # null keys and dates belong nowhere; null and NaN are one missing value; a hot key folds
    rows = [(d1, 1, 1, 1, None, 1.0, None), (d2, 1, 1, 1, float("nan"), 1.0004, None), (d3, 2, None, None, 1.0, 1.0, None), (None, 3, 1, 1, 1.0, 1.0, None), (d2, None, 1, 1, 1.0, 1.0, None)]
    rows += [(d3, 2, None, k, 9.0, 9.0, None) for k in range(50)]
    assert changes(spark, rows) == [("2025-01-03", 1, "removed"), ("2025-01-03", 2, "added")]


def at(day, hour=0):
    return dt.datetime(2025, 11, day, hour)


def test_known_at_equals_plain_search(spark):
    rng = random.Random(3)
    src = "_entity long, _day date, _rank int, _known timestamp_ntz, _value double"
    rows = [(rng.randrange(4), dt.date(2025, rng.choice([10, 11, 12]), rng.randrange(1, 29)), rng.randrange(3), dt.datetime(2025, rng.choice([10, 11, 12]), rng.randrange(1, 29), rng.randrange(24)), float(k)) for k in range(150)]
    rows += [(None, dt.date(2025, 11, 1), 1, at(1), 1.0), (1, None, 9, at(1), 1.0), (1, dt.date(2025, 11, 1), 9, None, 1.0)]
    events = []
    for k in range(120):
        t = dt.datetime(2025, rng.choice([10, 11, 12]), rng.randrange(1, 29), rng.randrange(24))
        events.append((rng.randrange(5), (t - dt.timedelta(days=rng.choice([0, 0, 1, -1, 40]))).date(), t, k))
    events += [(None, dt.date(2025, 11, 1), at(2), 900), (1, None, at(2), 901), (1, dt.date(2025, 11, 1), None, 902)]
    e = spark.createDataFrame(events, "_entity long, _date date, _time timestamp_ntz, k int")
    got = {r.k: r.epm and (r.epm._day, r.epm._rank) for r in known_at(e, {"epm": spark.createDataFrame(rows, src)}).collect()}

    def plain(x):
        ok = [(d, r) for n, d, r, f, _ in rows if None not in (n, d, f, x[0], x[1], x[2]) and n == x[0] and d <= x[1] and f <= x[2]]
        return max(ok) if ok else None

    assert got == {x[3]: plain(x) for x in events}


def test_known_at_exact_instant_counts_and_later_day_wins(spark):
    src = "_entity long, _day date, _rank int, _known timestamp_ntz, _value double"
    e = spark.createDataFrame([(1, dt.date(2025, 11, 5), at(6, 1))], "_entity long, _date date, _time timestamp_ntz")
    s = spark.createDataFrame([(1, dt.date(2025, 11, 5), 1, at(6, 1), 5.0), (1, dt.date(2025, 11, 4), 7, at(6, 0), 4.0), (1, dt.date(2025, 11, 6), 1, at(1), 6.0)], src)
    none = spark.createDataFrame([], src)
    row = known_at(e, {"epm": s, "dpm": none}).first()
    assert row.epm._value == 5.0 and row.dpm is None


def plain_split(text):
    """RFC 4180 by a character at a time; None if the quoting is broken."""
    s, i, fields = text or "", 0, []
    while True:
        if s[i : i + 1] == '"':
            v, i = "", i + 1
            while True:
                j = s.find('"', i)
                if j < 0:
                    return None
                v += s[i:j]
                i = j + 1
                if s[i : i + 1] != '"':
                    break
                v, i = v + '"', i + 1
            fields.append(v)
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return None
            fields.append(s[i:j])
            i = j
        if i >= len(s):
            return fields
        if s[i] != ",":
            return None
        i += 1


@pytest.mark.parametrize("chunk", [1, 2, 7, 128])
def test_state_machine_equals_plain_split(chunk):
    rng = random.Random(chunk)
    for _ in range(150):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice('a",é\n ') for _ in range(rng.choice([0, 1, 3, 8, 200]))) for _ in range(rng.choice([0, 1, 20]))]
        fields, errors = split_batch(pa.array(texts, pa.string()), chunk)
        assert fields.to_pylist() == [plain_split(t) for t in texts]
        assert [e is None for e in errors.to_pylist()] == [plain_split(t) is not None for t in texts]
    long = ['"' + "x" * 300_000 + '",b', "y" * 300_000]
    assert [len(f) for f in split_batch(pa.array(long), chunk)[0].to_pylist()] == [2, 1] if chunk > 2 else True


def test_reasons_and_typed_rows(spark):
    good = "22500001.0,1,13,42,1,2,text"
    lines = [
        ("substitution", good), ("substitution", '0022500001, 1 ,13.5,42,1,2,"a ""b"", c"'), ("substitution", '1,1,1,1,1,1,a"b'), ("substitution", '1,1,1,1,1,1,"ab'),
        ("substitution", "1,1,1"), ("substitution", "1,11,1,1,1,1,x"), ("substitution", "1,1,1,٣,1,1,x"), ("substitution", None), ("substitution", ""), (None, good), ("other", good),
        ("game_metadata", "1,ABC,DEF,1,2,2025-02-30,v"), ("game_metadata", "1,ABC,DEF,1,2,2024-02-29,v"), ("game_metadata", "1,ABc,DEF,1,2,2024-02-29,v"),
        ("free_throw", "1,2,,1,,,ordinary,TRUE"), ("free_throw", "1,2,,1,0,,ordinary,1"), ("free_throw", "1,2,,1,1,2,Ordinary,1"),
    ]
    df = spark.createDataFrame([(i, f, t, "kept") for i, (f, t) in enumerate(lines)], "line_id int, feed string, line_text string, _fields string")
    got = {r.line_id: (r.reason, r._error_offset, r._bad_field) for r in classify(df).collect()}
    reasons = [None, None, "quoting", "quoting", "column_count", "invalid_value", "invalid_value", "column_count", "column_count", "column_count", "column_count", "invalid_value", None, "invalid_value", None, "invalid_value", "invalid_value"]
    assert [got[i][0] for i in range(len(lines))] == reasons
    assert got[2][1] == 13 and got[3][1] == 15 and got[5][2] == "period"
    rows = typed_rows(classify(df), "substitution", ["line_id"]).orderBy("line_id").collect()
    assert [(r.game_id, r.period, r.elapsed_tenths, r.description) for r in rows] == [("0022500001", 1, 13.0, "text"), ("0022500001", 1, 13.5, 'a "b", c')]
    throws = typed_rows(classify(df), "free_throw", ["line_id"]).collect()
    assert [(r.declared_num, r.ambiguous_no_outcome_marker) for r in throws] == [(None, True)]
    assert classify(df.limit(0)).count() == 0 and set(FEEDS) == {"substitution", "game_metadata", "free_throw"}
