"""Drift against a plain re-reading of the files, and its defined results for odd input."""

import json
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from playledger.operators.drift import Drift

DATA = Path("/root/testdata/sf0.01/skill_file_row.parquet")


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    return {int: "integer", float: "decimal", str: "string", list: "array", dict: "object"}.get(type(v))


def plain(rows):
    """The changes of all streams, found record by record."""
    files = defaultdict(dict)
    for r in rows:
        files[r["stream_id"]].setdefault((r["delivered_ts"], r["file_id"]), []).append(json.loads(r["payload"]))
    out = set()
    for stream in files.values():
        kinds, before = {}, None
        for (_, file_id), recs in sorted(stream.items()):
            votes = defaultdict(Counter)
            for rec in recs:
                for k, v in rec.items():
                    votes[k][kind(v)] += 1
            types = {k: max((n, x) for x, n in c.items() if x)[1] if any(c) and set(c) != {None} else None for k, c in votes.items()}
            now = {(x["player_id"], x.get("game_id", x.get("requested_date"))): x for x in recs}
            if before is None:
                kinds = dict(types)
            else:
                old_types, old = before
                gone, come = sorted(set(old_types) - set(types)), sorted(set(types) - set(old_types))
                for a in gone:
                    for b in come:
                        pairs = [(old[k].get(a), now[k].get(b)) for k in set(old) & set(now)]
                        pairs = [(x, y) for x, y in pairs if not (x is not None and kind(x) != old_types[a]) and not (y is not None and kind(y) != types[b])]
                        if pairs and all(x == y for x, y in pairs) and any(x is not None for x, _ in pairs):
                            out.add((file_id, "renamed", a, b))
                            kinds[b] = kinds.pop(a, None)
                            gone[gone.index(a)] = None
                            come = [c for c in come if c != b]
                            break
                out |= {(file_id, "removed", a, "") for a in gone if a} | {(file_id, "added", "", b) for b in come}
                for a in gone:
                    kinds.pop(a, None)
                for k, t in types.items():
                    if t and kinds.get(k) and kinds[k] != t:
                        out.add((file_id, "retyped", k, k))
                    kinds[k] = t or kinds.get(k)
            before = (types, now)
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_changes_equal_plain_reading(spark):
    rows = spark.read.parquet(str(DATA))
    found = {tuple(r) for r in Drift(rows).changes().collect()}
    assert found == plain([r.asDict() for r in rows.collect()])


def rows_of(spark, files):
    data = [(1, f, f"{f}.jsonl", "epm_all", None, n, p) for f, payloads in files for n, p in enumerate(payloads)]
    return spark.createDataFrame(data, "stream_id long, file_id long, file_name string, record_kind string, delivered_ts timestamp_ntz, row_no int, payload string")


def test_odd_payloads_and_chain_of_names(spark):
    rec = '{{"player_id": {}, "requested_date": "2025-01-01", "{}": {}}}'
    rows = rows_of(
        spark,
        [
            (1, [rec.format(1, "a", 5), rec.format(2, "a", "null"), None, "[1]", "not json"]),
            (2, [rec.format(1, "b", 5), rec.format(2, "b", "null")]),
            (3, [rec.format(1, "b", "null")]),
            (4, [rec.format(1, "b", '"7"'), rec.format(3, "b", '"x"'), rec.format(4, "b", '"8"')]),
            (5, []),
        ],
    )
    drift = Drift(rows)
    assert {tuple(r) for r in drift.changes().collect()} == {(2, "renamed", "a", "b"), (4, "retyped", "b", "b")}
    table = drift.unified()
    assert table.count() == rows.count()
    got = {(r.file_id, r.row_no): r.a for r in table.collect()}
    assert got[(1, 0)] == 5 and got[(2, 0)] == 5 and got[(4, 0)] == 7 and got[(4, 1)] is None and got[(1, 2)] is None
    assert got[(4, 1)] is None and {r.row_no: r.a__raw for r in table.where("file_id = 4").collect()} == {0: None, 1: '"x"', 2: None}
    assert [c[0] for c in drift.columns()] == ["a", "player_id", "requested_date"]


def test_a_name_that_is_used_anew(spark):
    def rec(n, **fields):
        return json.dumps({"player_id": n, "requested_date": "2025-01-01"} | fields)

    rows = rows_of(spark, [(1, [rec(1, a=5), rec(2, a=6)]), (2, [rec(1, b=5), rec(2, b=6)]), (3, [rec(1, b=5, a=1), rec(3, b=7, a=2)]), (4, [rec(1, b=5), rec(4)])])
    drift = Drift(rows)
    assert {tuple(r) for r in drift.changes().collect()} == {(2, "renamed", "a", "b"), (3, "added", "", "a"), (4, "removed", "a", "")}
    got = {(r.file_id, r.row_no): (r.a, r["a#3"]) for r in drift.unified().collect()}
    assert got[(1, 0)] == (5, None) and got[(2, 1)] == (6, None) and got[(3, 0)] == (5, 1) and got[(4, 1)] == (None, None)


def test_no_value_is_lost_or_altered(spark):
    values = [
        5, 3.7, -2, "12", "007", " 1", "n/a", "", "1.50", {"value": 4}, {"value": 4, "unit": "n"}, {"value": "x"}, {}, [9], ["8"], [1, 2], [], [[3]], True, None, 1e30,
        9007199254740993, 123456789012345678901234567890, 0.1234567890123456789, 2.0, "é\n\"q\"",
    ]
    for base in (values, ["name", "other", *values], [7, 8, 9, 10] * 9 + values):
        rows = rows_of(spark, [(1, [json.dumps({"player_id": i, "requested_date": "2025-01-01", "x": v}) for i, v in enumerate(base)])])
        table = {r.row_no: r for r in Drift(rows).unified().collect()}
        for i, v in enumerate(base):
            r = table[i].asDict()
            x, raw = r["x"], r.get("x__raw")
            if v is None:
                assert x is None and raw is None
                continue
            assert x is not None or raw is not None
            if raw is not None:
                assert json.loads(raw) == v or (isinstance(v, float) and float(raw) == v), (v, raw)
            elif isinstance(x, str):
                assert x == v
            elif isinstance(v, (int, float)):
                assert x == v and type(v) is not bool
            else:
                inner = v["value"] if isinstance(v, dict) else v[0] if isinstance(v, list) else v
                assert float(inner) == x
    rows = rows_of(spark, [(1, [json.dumps({"player_id": 1, "requested_date": "d", "X": True, "x": 1, "x__raw": "a"}), json.dumps({"player_id": 2, "requested_date": "d", "x": "b", "file_id": 3})])])
    out = Drift(rows).unified()
    assert sorted(out.columns) == sorted(["stream_id", "file_id", "row_no", "record_kind", "delivered_ts", "X", "file_id_2", "player_id", "requested_date", "x_2", "x__raw", "x_2__raw"])
    assert Drift(rows).cells().count() == 9


def test_empty_table(spark):
    drift = Drift(rows_of(spark, []))
    assert drift.changes().count() == 0
    assert drift.unified().count() == 0
