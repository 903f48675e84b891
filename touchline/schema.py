"""Names, fixed values and explicit schemas of the match-event data model."""
from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model: frame rate, pitch geometry in metres, thresholds.
FPS = 10.0
BOX_DEPTH, BOX_HALF_WIDTH = 16.5, 20.16
SIX_DEPTH, SIX_HALF_WIDTH = 5.5, 9.16
POST_OFFSET = 3.66
DEFAULT_PITCH_LENGTH, DEFAULT_PITCH_WIDTH = 105.0, 68.0
GOAL_CLUSTER_FRAMES = 100
SCORE_LOOKBACK_FRAMES = 1500
BAND_RUNNING, BAND_HSR, BAND_SPRINT = 15.0, 20.0, 25.0
MIN_COVERAGE = 0.70
#: First words of a large-file pointer that stands for a tracking file.
POINTER_LINE = "version https://git-lfs"
POPULATED_SHARE = 0.01

# Event types and position groups.
PP, PO, OBR, OBE = "player_possession", "passing_option", "off_ball_run", "on_ball_engagement"
EVENT_TYPES = (PP, PO, OBR, OBE)
BACK_LINE = ("CB", "LCB", "RCB", "LB", "RB", "LWB", "RWB")
CENTRE_BACKS = ("CB", "LCB", "RCB")
FULL_BACKS = ("LB", "RB", "LWB", "RWB")
FRONT_LINE = ("CF", "LF", "RF")
PIVOT = ("DM", "LDM", "RDM")
WINGERS = ("LW", "RW")
WIDE_PLAYERS = ("LW", "RW", "LM", "RM")
PULLING_SUBTYPES = ("dropping_off", "pulling_wide", "pulling_half_space", "coming_short")

#: Columns the gold build must add to the events (fixed values).
DERIVED_COLUMNS = (
    "seconds_since_goal_for",
    "seconds_since_goal_against",
    "seconds_until_goal_for",
    "seconds_until_goal_against",
    "seconds_to_next_shot_same_team",
    "seconds_to_next_shot_opponent",
    "seconds_to_next_goal_same_team",
    "seconds_to_next_goal_opponent",
    "team_possession_id",
    "chain_n_possessions",
    "chain_reached_final_third",
    "chain_reached_box",
    "chain_ended_in_shot",
    "chain_duration_s",
    "own_penalty_area_start",
    "own_penalty_area_end",
    "own_penalty_area_reception",
    "own_six_yard_box_start",
    "own_six_yard_box_end",
    "own_six_yard_box_reception",
    "opp_penalty_area_start",
    "opp_penalty_area_end",
    "opp_penalty_area_reception",
    "opp_six_yard_box_start",
    "opp_six_yard_box_end",
    "opp_six_yard_box_reception",
    "number",
    "is_substitute",
    "is_starter",
    "team_back_line_size",
    "team_front_line_size",
    "team_pivot_size",
    "is_starting_cb_pair",
    "is_captain",
)

#: Typed columns of the raw event files; any other column is read as text and conformed by profile.
EVENT_COLUMN_TYPES = {
    "long": ("match_id", "team_id", "player_id", "index", "frame_start", "frame_end", "period", "minute_start",
             "phase_index", "team_score", "opponent_team_score", "n_player_possessions_in_phase",
             "pressing_chain_length"),
    "double": ("x_start", "y_start", "x_end", "y_end", "player_targeted_x_reception",
               "player_targeted_y_reception", "separation_start", "interplayer_distance",
               "n_teammates_ahead_start", "n_opponents_ahead_end", "n_opponents_overtaken",
               "n_passing_options_dangerous_difficult"),
    "boolean": ("penalty_area_start", "penalty_area_end", "first_player_possession_in_team_possession",
                "team_possession_loss_in_phase", "lead_to_shot", "lead_to_goal", "carry", "one_touch", "quick_pass",
                "is_header", "high_pass", "first_line_break", "second_last_line_break", "last_line_break",
                "give_and_go", "initiate_give_and_go", "intended_run_behind", "targeted", "received",
                "pressing_chain", "beaten_by_possession", "beaten_by_movement", "out_to_in",
                "inside_defensive_shape_start", "player_targeted_dangerous",
                "player_targeted_difficult_pass_target"),
    "string": ("event_id", "event_type", "event_subtype", "player_position", "third_start", "third_end",
               "channel_start", "channel_end", "start_type", "end_type", "game_interruption_before",
               "game_interruption_after", "game_state", "team_in_possession_phase_type",
               "team_out_of_possession_phase_type", "associated_player_possession_event_id", "pass_range",
               "pressing_chain_end_type", "overall_pressure_start", "speed_avg_band"),
}

#: Text columns whose values are a fixed list; their filters are checked against the values that occur.
ENUMERABLE = ("event_type", "event_subtype", "player_position", "player_in_possession_position", "third_start", "third_end", "channel_start", "channel_end",
              "start_type", "end_type", "game_interruption_before", "game_interruption_after", "game_state", "team_in_possession_phase_type",
              "team_out_of_possession_phase_type", "pass_range", "pressing_chain_end_type", "overall_pressure_start", "speed_avg_band")

PHASE_COLUMN_TYPES = {
    "long": ("match_id", "team_in_possession_id", "frame_start", "frame_end"),
    "double": tuple(f"team_{side}_{dim}_{at}" for side in ("in_possession", "out_of_possession")
                    for dim in ("width", "length") for at in ("start", "end")),
    "string": ("team_in_possession_phase_type", "team_out_of_possession_phase_type"),
}


def _f(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


SPAN = T.StructType([_f("start_frame", T.LongType()), _f("end_frame", T.LongType())])
TEAM = T.StructType([_f("id", T.LongType()), _f("short_name", T.StringType())])

MATCH_JSON = T.StructType([
    _f("id", T.LongType()), _f("home_team", TEAM), _f("away_team", TEAM),
    _f("home_team_score", T.LongType()), _f("away_team_score", T.LongType()),
    _f("pitch_length", T.DoubleType()), _f("pitch_width", T.DoubleType()),
    _f("date_time", T.StringType()),
    _f("stadium", T.StructType([_f("name", T.StringType())])),
    _f("match_periods", T.ArrayType(T.StructType([
        _f("period", T.LongType()), _f("start_frame", T.LongType()), _f("end_frame", T.LongType())]))),
    _f("players", T.ArrayType(T.StructType([
        _f("id", T.LongType()), _f("team_id", T.LongType()), _f("number", T.LongType()),
        _f("short_name", T.StringType()), _f("start_time", T.StringType()),
        _f("goal", T.LongType()), _f("own_goal", T.LongType()),
        _f("player_role", T.StructType([_f("acronym", T.StringType())])),
        _f("playing_time", T.StructType([_f("sequences", T.ArrayType(SPAN)), _f("total", SPAN)])),
    ]))),
])

TRACKED_PLAYER = T.StructType([
    _f("x", T.DoubleType()), _f("y", T.DoubleType()), _f("player_id", T.LongType()), _f("is_detected", T.BooleanType())])

TRACKING_JSON = T.StructType([
    _f("frame", T.LongType()), _f("timestamp", T.StringType()), _f("period", T.LongType()),
    _f("ball_data", T.StructType([_f("x", T.DoubleType()), _f("y", T.DoubleType())])),
    _f("possession", T.StructType([_f("player_id", T.LongType()), _f("group", T.StringType())])),
    _f("player_data", T.ArrayType(TRACKED_PLAYER)),
])
