"""Goal placement from two incomplete signals, against a plain restatement."""
import random

import pytest

from touchline.plans import enrich as E

COLS = "match_id long, event_id long, event_type string, team_id long, frame_start long, frame_end long, end_type string, game_interruption_after string, team_score long"


def place(rows, gap, lookback):
    out = []
    for team in sorted({r[3] for r in rows}):
        mine = sorted((r for r in rows if r[3] == team), key=lambda r: (r[4], r[1]))
        pp = [r for r in mine if r[2] == "player_possession"]
        shots = sorted(r[5] for r in pp if r[6] == "shot")
        placed = []
        for f in sorted(r[5] for r in pp if r[7] == "goal_for"):
            if not placed or f - placed[-1][0] > gap:
                placed.append((f, "goal_marker"))
        before = 0
        for r in mine:
            step = 0 if r[8] is None or before is None else r[8] - before
            before = r[8]
            for _ in range(max(step, 0)):
                if any(0 <= r[4] - f <= lookback for f, _s in placed):
                    continue
                floor = max([f for f, _s in placed if f < r[4]], default=-10 ** 9)
                options = [s for s in shots if floor < s <= r[4]]
                placed.append((options[-1], "last_shot") if options else (r[4], "score_change"))
        out += [(team, f, s) for f, s in placed]
    return sorted(out)


def rows_of(seed, n=120, span=9000):
    rng = random.Random(seed)
    rows, score = [], {1: 0, 2: 0}
    for i, t in enumerate(sorted(rng.randrange(span) for _ in range(n))):
        team = rng.choice((1, 2))
        if rng.random() < 0.06:
            score[team] += rng.choice((1, 1, 1, 2, 3))
        kind = rng.choice(("player_possession", "player_possession", "on_ball_engagement"))
        rows.append((7, i, kind, team, t, t + rng.randrange(20), "shot" if rng.random() < 0.15 else "pass", "goal_for" if rng.random() < 0.07 else None,
                     None if rng.random() < 0.03 else score[team]))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_random_matches(spark, seed):
    rows = rows_of(seed)
    matches = spark.createDataFrame([(7, 4500)], "match_id long, period_1_end long")
    got = E.goal_timeline(spark.createDataFrame(rows, COLS), matches, gap=100, lookback=800, block=500).collect()
    assert sorted((r["scoring_team_id"], r["frame"], r["frame_source"]) for r in got) == place(rows, 100, 800)
    assert all(r["period"] == (2 if r["frame"] > 4500 else 1) for r in got)
