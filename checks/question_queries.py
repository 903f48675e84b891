"""The event questions over gold events, each next to its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import lake
from checks import oracle as O
from checks.registry import query
from touchline.plans import questions as Q

KEY = ["event_id", "match_id", "event_type", "player_id", "frame_start"]
SEL = ", ".join(KEY)
PP, OBR, OBE, PO = ("event_type = 'player_possession'", "event_type = 'off_ball_run'",
                    "event_type = 'on_ball_engagement'", "event_type = 'passing_option'")
CBS, FBS, PIV = "player_position IN ('CB','LCB','RCB')", "player_position IN ('LB','RB','LWB','RWB')", "player_position IN ('DM','LDM','RDM')"
WING, PRESS = "player_position IN ('LW','RW')", "overall_pressure_start IN ('high_pressure','very_high_pressure')"
REC = "start_type = 'pass_reception'"
Q12 = f"{PP} AND {WING} AND out_to_in AND third_end = 'attacking_third' AND x_end >= 20 AND x_end <= 40"

# question -> (derivations it needs, WHERE clause)
SQL = {
    1: ("", f"{PP} AND player_position = 'LW' AND {REC} AND third_start = 'attacking_third'"),
    2: ("roster", f"number = 9 AND {PP} AND (penalty_area_start OR penalty_area_end)"),
    3: ("", f"{PP} AND player_position = 'RB' AND carry AND x_start < 0 AND x_end >= 0"),
    4: ("roster", f"is_starting_cb_pair AND {OBE} AND period = 2"),
    6: ("", f"{PP} AND player_position = 'GK' AND end_type = 'pass' AND third_end = 'middle_third' AND {PRESS}"),
    7: ("", f"{OBR} AND player_position = 'RW' AND speed_avg_band = 'sprinting'"),
    8: ("", f"{PP} AND player_position IN ('CM','RM','LM','AM') AND one_touch AND third_end = 'attacking_third'"),
    9: ("", f"{OBR} AND player_position = 'LB' AND intended_run_behind"),
    10: ("", f"{PP} AND player_position = 'GK' AND pass_range = 'long' AND high_pass"),
    11: ("", f"{OBR} AND player_position = 'CF' AND event_subtype = 'dropping_off'"),
    12: ("", Q12),
    13: ("", f"{PP} AND channel_start IN ('half_space_left','half_space_right') AND {REC}"),
    14: ("units", f"team_back_line_size = 4 AND ({CBS} OR {FBS}) AND x_start < -5 AND game_state = 'winning'"),
    15: ("", f"{OBR} AND event_subtype = 'cross_receiver' AND channel_start IN ('wide_left','wide_right')"),
    16: ("", f"{FBS} AND x_start > 10 AND n_teammates_ahead_start <= 1"),
    18: ("", f"{PP} AND penalty_area_start AND {REC}"),
    19: ("", f"{PP} AND inside_defensive_shape_start AND {REC}"),
    20: ("", f"{PP} AND last_line_break"),
    21: ("zones", f"{PP} AND end_type = 'pass' AND opp_six_yard_box_reception"),
    22: ("", f"{PP} AND {WING} AND channel_start IN ('wide_left','wide_right') AND {REC}"),
    23: ("", f"{PP} AND end_type = 'shot' AND penalty_area_end = FALSE"),
    24: ("", "game_interruption_before = 'corner_against'"),
    25: ("", f"{PP} AND third_start = 'attacking_third' AND first_line_break"),
    26: ("", f"{PP} AND start_type = 'pass_interception' AND third_start = 'defensive_third'"),
    28: ("", f"{PP} AND player_position = 'GK' AND pass_range = 'long'"),
    29: ("zones", f"{PP} AND end_type = 'clearance' AND own_penalty_area_start AND {PRESS}"),
    30: ("", f"{PP} AND quick_pass AND third_start = 'defensive_third'"),
    31: ("", f"{OBR} AND (give_and_go OR initiate_give_and_go)"),
    32: ("zones", "is_header AND own_penalty_area_start AND game_interruption_before IN ('corner_against','free_kick_against')"),
    33: ("", f"{PP} AND player_targeted_dangerous AND player_targeted_difficult_pass_target"),
    34: ("", f"{PP} AND start_type IN ('recovery','pass_interception') AND third_start = 'middle_third' AND lead_to_shot"),
    35: ("chains", f"{PP} AND team_in_possession_phase_type = 'build_up' AND game_interruption_before = 'goal_kick_for' AND chain_reached_final_third"),
    36: ("outcomes", f"{PP} AND is_header AND end_type = 'clearance' AND ({CBS} OR {FBS}) AND seconds_to_next_shot_same_team <= 30"),
    37: ("", f"{PP} AND n_player_possessions_in_phase >= 5 AND team_possession_loss_in_phase"),
    38: ("", f"{OBR} AND give_and_go AND lead_to_shot"),
    39: ("outcomes", "game_interruption_before = 'corner_for' AND seconds_to_next_shot_same_team <= 6"),
    40: ("", f"{OBR} AND give_and_go AND lead_to_shot"),
    41: ("outcomes", f"{PP} AND (first_line_break OR second_last_line_break OR last_line_break) AND seconds_to_next_shot_same_team <= 8"),
    42: ("", f"{OBE} AND pressing_chain AND pressing_chain_length >= 3 AND pressing_chain_end_type = 'regain'"),
    43: ("chains", f"{PP} AND start_type = 'throw_in_reception' AND chain_reached_box"),
    44: ("", f"{OBE} AND event_subtype = 'counter_press' AND team_out_of_possession_phase_type = 'high_block'"),
    45: ("", "minute_start >= 75 AND game_state = 'winning' AND team_out_of_possession_phase_type IS NOT NULL"),
    46: ("", "minute_start < 10 AND (team_in_possession_phase_type = 'transition' OR team_out_of_possession_phase_type = 'defending_transition')"),
    47: ("", "game_state = 'losing' AND game_interruption_before IS NOT NULL"),
    48: ("", f"{PP} AND minute_start >= 80 AND start_type IN ('throw_in_reception','keep_possession')"),
    49: ("goal_time", f"{OBE} AND seconds_since_goal_against <= 300 AND event_subtype IN ('pressing','pressure','counter_press')"),
    50: ("", f"{PP} AND minute_start < 5 AND team_in_possession_phase_type = 'build_up'"),
    51: ("goal_time", "seconds_since_goal_for <= 120"),
    52: ("", f"{PP} AND minute_start >= 80 AND game_state = 'losing' AND team_in_possession_phase_type = 'direct'"),
    53: ("", "minute_start >= 90 AND game_interruption_before IS NOT NULL"),
    55: ("", f"{PP} AND {FBS} AND interplayer_distance IS NOT NULL AND n_teammates_ahead_start = 0"),
    57: ("", f"{PP} AND {PIV} AND last_line_break"),
    58: ("", f"{PP} AND n_opponents_ahead_end = 0"),
    60: ("", f"{FBS} AND separation_start < 2"),
    61: ("", f"{PP} AND {PIV} AND n_teammates_ahead_start < 2"),
    62: ("", f"{OBE} AND {CBS} AND event_subtype IN ('pressing','pressure') AND pressing_chain_end_type = 'regain'"),
    63: ("", "n_opponents_overtaken >= 2"),
    64: ("", f"{PP} AND n_passing_options_dangerous_difficult >= 1"),
    71: ("", f"{PO} AND penalty_area_end AND targeted = FALSE"),
    72: ("", f"{PP} AND first_line_break AND lead_to_shot = FALSE"),
    73: ("", f"{OBE} AND pressing_chain AND pressing_chain_end_type = 'disruption'"),
    75: ("", f"{Q12} AND game_state = 'winning' AND minute_start >= 75"),
    76: ("goal_time", f"{OBR} AND seconds_since_goal_against <= 600 AND player_position = 'RB' AND speed_avg_band IN ('hsr','sprinting')"),
    77: ("outcomes", f"{OBR} AND give_and_go AND third_start = 'attacking_third' AND seconds_to_next_shot_same_team <= 6"),
    79: ("units", f"{OBE} AND player_position IN ('CF','LF','RF') AND team_front_line_size = 2 AND game_interruption_before IN "
                  "('goal_kick_for','goal_kick_against') AND pressing_chain AND pressing_chain_end_type = 'regain'"),
    80: ("roster", f"{PP} AND is_substitute AND last_line_break AND lead_to_shot"),
}
COVER = ("player_position IN ('CB','LCB','RCB','LB','RB','LWB','RWB')")
ABSENT = {
    65: ("game_interruption_before IN ('goal_kick_for','goal_kick_against')", f"o.event_type = 'on_ball_engagement' AND o.player_position = 'CF'"),
    67: (f"{PP} AND team_in_possession_phase_type = 'quick_break' AND n_opponents_ahead_end = 0", "o.event_type = 'player_possession' AND o.end_type = 'shot'"),
    69: (f"{OBE} AND {FBS} AND (beaten_by_possession OR beaten_by_movement)",
         f"o.event_type = 'on_ball_engagement' AND o.{COVER} AND o.player_id <> e.player_id"),
    74: (f"{PP} AND team_in_possession_phase_type = 'transition'", "o.event_type = 'on_ball_engagement' AND o.event_subtype = 'counter_press'"),
}


def _register(qid: int, sql: str) -> None:
    @query(f"question_{qid:02d}", sql)
    def run(spark, sf, qid=qid):
        return Q.answer(qid, lake.gold_events(spark, sf)).select(*KEY)


for _qid, (_needs, _where) in SQL.items():
    _ctes = O.gold([_needs]) if _needs else ["gd AS (SELECT * FROM ev)"]
    _register(_qid, O.with_base(*_ctes, select=f"SELECT {SEL} FROM gd WHERE {_where}"))
for _qid, (_where, _present) in ABSENT.items():
    _register(_qid, O.with_base(select=f"SELECT {SEL} FROM ev e WHERE {_where} AND NOT EXISTS (SELECT 1 FROM ev o WHERE o._pk = e._pk AND {_present})"))


@query("question_54", O.with_base(select=f"""
SELECT COALESCE(team_score - opponent_team_score >= 2, FALSE) AS leading_by_two,
  ROUND(AVG(CASE WHEN pass_range = 'long' THEN 1.0e0 ELSE 0.0e0 END), 6) AS long_pass_share, COUNT(*) AS rows
FROM ev WHERE {PP} GROUP BY 1"""))
def question_54(spark, sf):
    return Q.answer(54, lake.gold_events(spark, sf)).withColumn("long_pass_share", F.round("long_pass_share", 6))


def _report_sql() -> str:
    parts = sorted({n for n, _ in SQL.values() if n})
    counted = " UNION ALL ".join(
        f"SELECT {q} AS qid, COUNT(*) AS hits, COUNT(DISTINCT match_id) AS matches FROM gd WHERE {w}" for q, (_, w) in SQL.items())
    absent = " UNION ALL ".join(
        f"SELECT {q}, COUNT(*), COUNT(DISTINCT match_id) FROM ev e WHERE {w} AND NOT EXISTS (SELECT 1 FROM ev o WHERE o._pk = e._pk AND {p})"
        for q, (w, p) in ABSENT.items())
    return O.with_base(*O.gold(parts), select=f"SELECT qid, hits, matches FROM ({counted} UNION ALL {absent} UNION ALL SELECT 54, NULL, NULL)")


@query("question_report", _report_sql())
def question_report(spark, sf):
    return Q.run_event_questions(lake.gold_events(spark, sf)).select("qid", "hits", "matches")


@query("share_by_condition", """
SELECT l_linestatus, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END), 6) AS share, COUNT(*) AS rows,
  COALESCE(l_quantity >= 25, FALSE) AS condition FROM lineitem GROUP BY ALL""")
def share_by_condition(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    shares = Q.share_by_condition(lines, F.col("l_quantity") >= 25, F.col("l_returnflag") == "R", by=("l_linestatus",))
    return shares.select("l_linestatus", "condition", F.round("share", 6).alias("share"), "rows")
