"""Runs against a plain reading of each game, over several bucket widths."""

import datetime as dt
import random

import pytest

from playledger.llm import runs

SCHEMA = (
    "game_id string, event_num long, event_type int, event_action_type int, period int, minute_remaining_quarter int, seconds_remaining_quarter int, "
    "home_description string, neutral_description string, visitor_description string, player1_id long, received_ts timestamp_ntz, extra int"
)


def row(game, num, kind, left, text, player=7, period=1, ts=None, action=11):
    return (game, num, kind, action, period, left // 60, left % 60, text, None, None, player, ts, 0)


def plain(items):
    """Runs of the read items, game by game."""
    out = []
    games = {}
    for r in items:
        games.setdefault(r.game_id, {}).setdefault(r.event_num, r)
    for g, rows in games.items():
        order = sorted(rows.values(), key=lambda r: (r.period, -r.clock, r.event_num))
        run = order[:1]
        for a, b in list(zip(order, order[1:])) + [(None, None)]:
            ok = b is not None and a.period == b.period and a.event_type == b.event_type and a.event_type in (3, 6) and a.clock - b.clock <= 2
            ok = ok and all(a[c] is None or b[c] is None or a[c] == b[c] for c in runs.ITEMS)
            if ok:
                run.append(b)
            else:
                if len(run) > 1:
                    out.append((g, run[0].event_num, run[-1].event_num, len(run), run[0].clock - run[-1].clock))
                run = [b]
    return sorted(out)


@pytest.mark.parametrize("bucket", [3, 10, 60])
def test_runs_equal_plain_reading(spark, bucket):
    rng = random.Random(bucket)
    texts = ["A Free Throw 1 of 2 (1 PTS)", "a  free throw 1 of 3", "MISS A Free Throw 1 of 2", "A Free Throw 2 of 2 (2 PTS)", "A S.FOUL (P1.T1)", "B. A S.FOUL", "A P.FOUL (P2.PN)", None, ""]
    rows = [row(f"g{rng.randrange(3)}", n, rng.choice([3, 3, 6, 6, 1]), rng.randrange(40), rng.choice(texts), rng.choice([7, 7, 0, None, 8]), rng.choice([1, 2])) for n in range(400)]
    rows += rows[:50]  # exact copies
    items = runs.link_items(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.game_id, r.first_event_num, r.last_event_num, r.n_reports, r.duration_s) for r in runs.collapse(items, bucket_s=bucket).where("n_reports > 1").collect())
    assert got == plain(items.collect())


def test_everything_is_kept_once(spark):
    rows = [row("g", n, 1, n // 3, None) for n in range(200)]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    all_ = runs.collapse(runs.link_items(df))
    assert all_.count() == 200 and all_.agg({"n_reports": "sum"}).first()[0] == 200


def test_a_run_over_many_buckets_and_odd_rows(spark):
    t = "X Free Throw 1 of 2 (3 PTS)"
    rows = [row("g", 100 - s, 3, s, t, ts=dt.datetime(2025, 1, 1)) for s in range(0, 90)]
    rows += [row(None, 1, 3, 5, t), row("h", None, 3, 5, t), row("h", 1, 3, 5, t, period=None), (*row("h", 2, 3, 5, t)[:5], None, 5, t, None, None, 7, None, 0)]
    got = runs.runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.first_event_num, r.last_event_num, r.n_reports, r.duration_s) for r in got] == [(11, 100, 90, 89)]
    assert runs.runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_items(spark):
    rows = [row("g", 1, 6, 9, "K. Ab L.B.FOUL (P3.T2) (X)"), row("g", 2, 6, 9, "Ab FLAGRANT.FOUL.TYPE1 (P2.PN)"), row("g", 3, 3, 9, "MISS Ab Free Throw Flagrant 2 of 3", 0), row("g", 4, 3, 9, None, action=14), row("g", 5, 1, 9, "Ab S.FOUL")]
    got = {r.event_num: (r.player, r.kind, r.number, r.outcome, r.points, r.fouls) for r in runs.link_items(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (7, "L.B", None, None, None, 3), 2: (7, "FLAGRANT1", None, None, None, 2), 3: (None, "FLAGRANT", 2, 0, None, None), 4: (7, "ORDINARY", 2, None, None, None), 5: (None, None, None, None, None, None)}


def test_a_copy_at_another_clock_counts_once(spark):
    schema = "game_id string, period int, clock int, event_num long, event_type int, received_ts string, player long, kind string, number int, outcome int, points int, fouls int"
    rows = [("1", 1, 100, 5, 3, "b", 7, None, 1, None, None, None), ("1", 1, 300, 5, 3, "a", 7, None, 1, None, None, None), ("1", 1, 299, 6, 3, "a", 7, None, 1, None, None, None), ("1", 1, 40, 9, 3, None, 7, None, 1, None, None, None)]
    got = [(r.first_event_num, r.last_event_num, r.n_reports, r.duration_s) for r in runs.collapse(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [(5, 6, 2, 1), (9, 9, 1, 0)]
