"""The possession rules on hand-made games."""

from playledger.operators import possessions as pos

SCHEMA = (
    "game_id string, event_num long, event_type int, event_action_type int, period int, minute_remaining_quarter int, seconds_remaining_quarter int, "
    "home_description string, neutral_description string, visitor_description string, player1_id long, player1_team_id long, player1_team_abbreviation string, "
    "home_score double, away_score double, received_ts timestamp_ntz, " + ", ".join(f"{s}_player{i} long" for s in ("home", "away") for i in range(1, 6))
)
HOME, AWAY = [1, 2, 3, 4, 5], [11, 12, 13, 14, 15]


def game(spark, events):
    """events: (second of the period left, type, home text, visitor text[, home five, away five])."""
    rows = []
    for n, (left, kind, home, away, *five) in enumerate(events):
        h, a = five if five else (HOME, AWAY)
        rows.append(("1", n + 1, kind, 0, 1, left // 60, left % 60, home, None, away, None, None, None, None, None, None, *h, *a))
    return spark.createDataFrame(rows, SCHEMA)


def flags(spark, events):
    rows = pos.terminals(pos.timeline(game(spark, events))).orderBy("event_num").collect()
    return [(r.eop, r.offense) for r in rows]


def test_terminal_rules(spark):
    events = [
        (700, 1, "Ab 20' Jump Shot (2 PTS)", None),  # made: over, home
        (690, 2, None, "MISS Cd 3' Layup"),
        (689, 4, "Ab REBOUND (Off:0 Def:1)", None),  # defensive rebound: over, away had it
        (670, 5, "Ab Bad Pass Turnover (P1.T1)", "Cd STEAL (1 STL)"),  # turnover
        (650, 1, None, "Cd 2' Dunk (4 PTS)"),  # made with a shooting foul after: goes on
        (650, 6, "Ab S.FOUL (P1.T1)", None),
        (650, 3, None, "Cd Free Throw 1 of 1 (5 PTS)"),  # last free throw made: over
        (630, 3, "MISS Ab Free Throw 1 of 2", None),  # not the last: goes on
        (630, 3, "MISS Ab Free Throw 2 of 2", None),  # missed, live rebound follows: goes on
        (629, 4, None, "Cd REBOUND (Off:0 Def:2)"),  # over
        (610, 6, None, "Cd Offensive Charge Foul"),  # without a turnover next: over
        (600, 13, None, None),  # end with the clock running before: over
    ]
    got = flags(spark, events)
    assert [e for e, _ in got] == [True, False, True, True, False, False, True, False, False, True, True, True]
    assert [o for _, o in got][:4] == ["Home", "Away", "Away", "Home"] and got[6][1] == "Away" and got[9][1] == "Home" and got[10][1] == "Away"


def test_possession_points_and_lineups(spark):
    events = [
        (700, 1, "Ab 3' Layup (2 PTS)", None),
        (690, 2, None, "MISS Cd 25' 3PT Jump Shot"),
        (689, 4, None, "Cd REBOUND (Off:1 Def:0)"),
        (680, 1, None, "Cd 25' 3PT Jump Shot (3 PTS) (Ef 1 AST)"),
        (600, 13, None, None),
    ]
    rows = pos.fill_lineups(pos.foul_lineups(pos.terminals(pos.timeline(game(spark, events)))))
    table = pos.possession_table(pos.possessions(rows)).orderBy("poss").collect()
    assert [(r.poss_offense, r.points, r.second_chance_points, r.offensive_rebounds, r.assist_points) for r in table[:2]] == [("Home", 2, 0, 0, 0), ("Away", 3, 3, 1, 3)]
    assert table[0].O == HOME and table[1].O == AWAY and table[1].D == HOME
    assert table[2].poss_offense == "Home"  # a bare terminal takes the other side
    assert pos.complete(spark.createDataFrame(table)).count() == 3


def test_foul_lineups_are_carried_over_the_free_throws(spark):
    new = [6, 2, 3, 4, 5]
    events = [
        (700, 6, None, "Cd P.FOUL (P1.T1)"),
        (700, 8, "SUB: G FOR Ab", None, new, AWAY),
        (700, 3, "Ab Free Throw 1 of 2 (1 PTS)", None, new, AWAY),
        (700, 3, "Ab Free Throw 2 of 2 (2 PTS)", None, new, AWAY),
        (690, 2, None, "MISS Cd 3' Layup", new, AWAY),
        (689, 4, "G REBOUND (Off:0 Def:1)", None, new, AWAY),
        (680, 5, "G Turnover", None, new, AWAY),
    ]
    rows = pos.foul_lineups(pos.terminals(pos.timeline(game(spark, events)))).orderBy("event_num").collect()
    assert [r.l_h for r in rows] == [HOME] * 4 + [new] * 3


def test_copies_gaps_nulls_and_empty(spark):
    events = [(700, 1, "Ab 3' Layup (2 PTS)", None), (690, 5, None, "Cd Turnover", [None, 2, 3, 4, 5], AWAY), (680, 5, None, "Cd Turnover", [0, 2, 2, 4, 5], AWAY)]
    df = game(spark, events)
    twice = df.unionByName(df)
    rows = pos.timeline(twice).orderBy("event_num").collect()
    assert [r.event_num for r in rows] == [1, 3] and rows[1].l_h == [2, 4, 5, 0, 0]
    assert pos.timeline(twice, allow_partial=True).count() == 3
    assert pos.possession_table(pos.possessions(pos.terminals(pos.timeline(df.limit(0))))).count() == 0
