"""Two small deterministic matches written as raw files.

Positions come from sines of frame and player number; event coordinates are the player's own tracked
position mirrored into the team's attacking frame, so signs and own-box flags can be reproduced.
"""
from __future__ import annotations

import csv
import json
import math
from pathlib import Path

HALF = 400
SQUAD = ["GK", "LB", "LCB", "RCB", "RB", "DM", "CM", "AM", "LW", "RW", "CF", "SUB", "SUB"]
REAL = {11: "CF", 12: "LW"}
PITCH = {101: (104.0, 68.0), 102: (106.0, 68.0)}


def teams(mid):
    return mid * 10 + 1, mid * 10 + 2


def player_id(mid, side, i):
    return mid * 100 + side * 50 + i


def on_pitch(i, frame):
    if i == 10:
        return frame <= 600
    if i == 9:
        return frame <= 600
    if i >= 11:
        return frame >= 600
    return True


def xy(mid, side, i, frame):
    """Absolute position; team 0 attacks +x in the first half."""
    length = PITCH[mid][0]
    way = 1 if (side == 0) == (frame <= HALF) else -1
    depth = [-48, -30, -32, -32, -30, -10, 0, 10, 20, 20, 28, 28, 20][i]
    width = [0, -20, -7, 7, 20, 0, 8, -8, -24, 24, 2, -2, -24][i]
    x = depth + 12 * math.sin(frame / 37.0 + i * 1.3 + side) + 3 * math.sin(frame / 9.0 + i)
    y = width + 5 * math.cos(frame / 29.0 + i * 0.7 + mid)
    return way * max(-length / 2, min(length / 2, x)), way * max(-34.0, min(34.0, y))


def sign(side, frame):
    return 1 if (side == 0) == (frame <= HALF) else -1


def tracked(frame):
    """A quarter of the frames carries no players."""
    return not (250 <= frame < 300 or frame % 40 in (0, 1, 2, 3, 4, 5))


def ball(mid, frame):
    if frame in (330, 331, 332):            # at the corner that team 0 attacks in the first half
        return PITCH[mid][0] / 2 - 2.0, 32.0
    if 333 <= frame < 350:
        return PITCH[mid][0] / 2 - 6.0, 32.0 - (frame - 332) * 1.7
    if frame == 260:
        return None, None
    return 20 * math.sin(frame / 31.0), 15 * math.cos(frame / 17.0)


def make_events(mid):
    """Rows of the event file: every 4th frame one possession row, in between the other types."""
    rows, types = [], ["player_possession", "passing_option", "off_ball_run", "on_ball_engagement"]
    last_pp = None
    home_goals = {180}          # a second one would lie within the look-back of the first
    for n, frame in enumerate(range(11, 2 * HALF - 10, 3)):
        side = (n // 6) % 2
        kind = types[n % 4]
        i = (n * 7) % 11
        if not on_pitch(i, frame):
            i = {10: 11, 9: 12}[i]
        fx, fy = xy(mid, side, i, frame)
        s = sign(side, frame)
        ev = {
            "match_id": mid, "event_id": f"{mid}_{n:04d}", "index": n, "event_type": kind, "frame_start": frame, "frame_end": frame + 3 + n % 9,
            "period": 1 if frame <= HALF else 2, "minute_start": frame // 10, "team_id": teams(mid)[side], "player_id": player_id(mid, side, i),
            "player_position": REAL.get(i, SQUAD[i]), "x_start": round(fx * s, 2), "y_start": round(fy * s, 2), "x_end": round(fx * s + 5, 2), "y_end": round(fy * s, 2),
            "phase_index": n // 8, "team_score": sum(1 for g in home_goals if frame > g + 20) if side == 0 else 0,
            "opponent_team_score": sum(1 for g in home_goals if frame > g + 20) if side == 1 else 0,
            "game_state": "drawing", "team_in_possession_phase_type": "create", "team_out_of_possession_phase_type": "medium_block",
            "third_end": "attacking_third" if fx * s > 17 else "middle_third", "penalty_area_end": str(fx * s + 5 > 36),
            "lead_to_shot": "False", "pressing_chain": "True" if kind == "on_ball_engagement" else "",
        }
        if kind == "player_possession":
            ev["first_player_possession_in_team_possession"] = "True" if n % 12 == 4 else ("" if n % 16 == 0 else "False")
            ev["end_type"] = "shot" if n % 20 == 0 else ("possession_loss" if n % 8 == 4 else "pass")
            ev["start_type"] = "pass_reception"
            ev["carry"] = "" if mid == 101 else ("True" if n % 3 else "False")     # all null in the first match
            last_pp = ev["event_id"]
        else:
            ev["associated_player_possession_event_id"] = "nobody" if n % 29 == 1 else last_pp
        if kind == "off_ball_run":
            ev["event_subtype"] = "behind" if n % 8 == 2 else "dropping_off"
            ev["player_id"], ev["player_position"] = player_id(mid, side, 10 if on_pitch(10, frame) else 11), "CF"
            gx, gy = xy(mid, side, 10 if on_pitch(10, frame) else 11, frame)
            ev["x_start"], ev["y_start"] = round(gx * s, 2), round(gy * s, 2)
        rows.append(ev)
    pp0 = [r for r in rows if r["event_type"] == "player_possession" and r["team_id"] == teams(mid)[0]]
    goal = min(pp0, key=lambda r: abs(r["frame_end"] - 180))
    goal["game_interruption_after"], goal["end_type"] = "goal_for", "shot"
    decoy = next(r for r in rows if r["event_type"] == "on_ball_engagement" and r["team_id"] == teams(mid)[1])
    decoy["game_interruption_after"] = "goal_for"
    near = min(pp0, key=lambda r: abs(r["frame_start"] - 340))
    near["game_interruption_before"] = "corner_for"
    return rows


def write_bronze(root: Path) -> str:
    for mid, (length, width) in PITCH.items():
        folder = root / "matches" / str(mid)
        folder.mkdir(parents=True)
        rows = make_events(mid)
        names = list(dict.fromkeys(k for r in rows for k in r))
        if mid == 102:
            names = [n for n in reversed(names)] + ["extra_note", "tag"]     # another header: order and columns differ
            for r in rows:
                r["extra_note"], r["tag"] = f"note {r['index']}, free text", "True" if r["index"] % 2 else ""
        with open(folder / f"{mid}_dynamic_events.csv", "w", newline="") as fh:
            w = csv.DictWriter(fh, names, restval="")
            w.writeheader()
            w.writerows(rows)
        home, away = teams(mid)
        players = []
        for side, team in enumerate((home, away)):
            for i, pos in enumerate(SQUAD):
                start, end = (600, 2 * HALF) if i >= 11 else (1, 600 if i in (9, 10) else 2 * HALF)
                time = {"total": {"start_frame": start, "end_frame": end}}
                if mid == 101:
                    time["sequences"] = [{"start_frame": start, "end_frame": end}]
                players.append({"id": player_id(mid, side, i), "team_id": team, "number": i + 1, "short_name": f"P{i}", "start_time": "00:10:00" if i >= 11 else "00:00:00",
                                "goal": int(side == 0 and i == 10), "own_goal": 0, "player_role": {"acronym": pos}, "playing_time": time})
        players.append({"id": mid * 100 + 99, "team_id": home, "number": 99, "short_name": "Bench", "start_time": None, "goal": None, "own_goal": None,
                        "player_role": {"acronym": "SUB"}, "playing_time": {"sequences": [], "total": None}})
        match = {"id": mid, "home_team": {"id": home, "short_name": "H"}, "away_team": {"id": away, "short_name": "A"}, "home_team_score": 1, "away_team_score": 0,
                 "pitch_length": length, "pitch_width": width, "date_time": "2024-05-01T15:00:00Z", "stadium": {"name": "S"},
                 "match_periods": [{"period": 1, "start_frame": 1, "end_frame": HALF}, {"period": 2, "start_frame": HALF + 1, "end_frame": 2 * HALF}], "players": players}
        (folder / f"{mid}_match.json").write_text(json.dumps(match, indent=1))
        with open(folder / f"{mid}_phases_of_play.csv", "w", newline="") as fh:
            cols = ["team_in_possession_id", "team_in_possession_phase_type", "team_out_of_possession_phase_type", "frame_start", "frame_end",
                    "team_in_possession_width_end", "team_out_of_possession_width_end"]
            w = csv.writer(fh)
            w.writerow((["match_id"] if mid == 101 else []) + cols)
            for k in range(40):
                row = [(home, away)[k % 2], "create", "medium_block", k * 20, k * 20 + 19, 40 + k % 7, "" if k % 9 == 0 else 30 + (k * 5) % 11]
                w.writerow(([mid] if mid == 101 else []) + row)
        with open(folder / f"{mid}_tracking_extrapolated.jsonl", "w") as fh:
            for frame in range(1, 2 * HALF + 1):
                pd = []
                if tracked(frame):
                    for side in (0, 1):
                        for i in range(13):
                            if on_pitch(i, frame):
                                x, y = xy(mid, side, i, frame)
                                pd.append({"x": round(x, 2), "y": round(y, 2), "player_id": player_id(mid, side, i), "is_detected": (frame + i) % 8 != 0})
                bx, by = ball(mid, frame)
                group = [None, "home team", "away team"][(frame // 30) % 3]
                fh.write(json.dumps({"frame": frame, "timestamp": "t", "period": 1 if frame <= HALF else 2, "ball_data": {"x": bx, "y": by},
                                     "possession": {"player_id": None, "group": group}, "image_corners_projection": [], "player_data": pd}) + "\n")
    (root / "captains.json").write_text(json.dumps({"101": {str(teams(101)[0]): player_id(101, 0, 2)}}))
    return str(root)
