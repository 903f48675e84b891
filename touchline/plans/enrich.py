"""Gold derivations on the event table: goals, outcome windows, chains, zones, squad units."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.joins import left_lookup
from touchline.operators.ordered import (
    CROWD, asof, block_of, greedy_collapse, interval_headcount, previous_row, running_sum, tie_level,
)

#: Frames per block of the ordered operators (five minutes of play).
BLOCK = 3000
TEAM = ["match_id", "team_id"]


def is_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def no(c: str | Column) -> Column:
    """Three-valued flag as a plain yes/no: null counts as no."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


# --------------------------------------------------------------------------------------
# goals
# --------------------------------------------------------------------------------------
def goal_markers(events: DataFrame, gap: int = S.GOAL_CLUSTER_FRAMES) -> DataFrame:
    """Collapsed goal markers of possession rows: match_id, team_id, frame."""
    marked = events.where(is_type(S.PP) & (F.col("game_interruption_after") == "goal_for"))
    return greedy_collapse(marked.select(*TEAM, F.col("frame_end").alias("frame")), TEAM, "frame", gap)


def own_shots(events: DataFrame) -> DataFrame:
    return events.where(is_type(S.PP) & (F.col("end_type") == "shot")).select(*TEAM, F.col("frame_end").alias("frame"))


def score_steps(events: DataFrame) -> DataFrame:
    """Rows at which a team's running score rises: match_id, team_id, observed, event_id, step."""
    rows = events.where(F.col("team_id").isNotNull()).select(*TEAM, "event_id", "frame_start", "team_score")
    rows = rows.withColumn("__seen", F.lit(True))
    prev = previous_row(
        rows, TEAM, [block_of("frame_start", BLOCK), F.col("frame_start"), tie_level(rows, "event_id")], ["frame_start", "event_id"],
        {"before": "team_score", "__before_seen": "__seen"}, CROWD)
    # the very first row of a team is compared with 0; a null score on either side is no step
    base = F.when(F.col("__before_seen").isNull(), F.lit(0)).otherwise(F.col("before"))
    step = F.col("team_score") - base
    return prev.where(step > 0).select(*TEAM, F.col("frame_start").alias("observed"), "event_id", step.alias("step"))


def goal_timeline(
    events: DataFrame, matches: DataFrame, gap: int = S.GOAL_CLUSTER_FRAMES,
    lookback: int = S.SCORE_LOOKBACK_FRAMES, block: int = BLOCK,
) -> DataFrame:
    """One row per goal: match_id, frame, period, scoring_team_id, frame_source.

    Markers come first.  A score step that no placed goal of the last ``lookback`` frames explains
    adds a goal at the last own shot since the previous goal, or else where the step was seen.  The
    order-dependent part folds over the goals of one team in one match.
    """
    markers = goal_markers(events, gap).select(*TEAM, F.col("frame").cast("long").alias("frame"))
    steps = asof(score_steps(events), own_shots(events), TEAM, "observed", "frame", block, {"shot": ("since", None)})
    goal = "struct<frame:bigint,frame_source:string>"
    m = markers.groupBy(*TEAM).agg(F.sort_array(F.collect_list(
        F.struct(F.col("frame"), F.lit("goal_marker").alias("frame_source")))).alias("placed"))
    b = steps.groupBy(*TEAM).agg(F.sort_array(F.collect_list(F.struct(
        F.col("observed").cast("long").alias("observed"), F.col("event_id"),
        F.col("shot.at").cast("long").alias("shot"), F.col("step").cast("long").alias("step")))).alias("steps"))

    def place(placed: Column, s: Column) -> Column:
        explained = F.exists(placed, lambda p: (s["observed"] - p["frame"]).between(0, lookback))
        floor = F.array_max(F.transform(F.filter(placed, lambda p: p["frame"] < s["observed"]), lambda p: p["frame"]))
        by_shot = s["shot"].isNotNull() & (floor.isNull() | (s["shot"] > floor))
        new = F.struct(
            F.when(by_shot, s["shot"]).otherwise(s["observed"]).alias("frame"),
            F.when(by_shot, F.lit("last_shot")).otherwise(F.lit("score_change")).alias("frame_source"))
        return F.when(explained, placed).otherwise(F.array_append(placed, new))

    def fold(placed: Column, s: Column) -> Column:
        once = place(placed, s)
        # a step of two or more can place a second goal; a third is always explained by the second
        return F.when(s["step"] >= 2, place(once, s)).otherwise(once)

    start = F.coalesce("placed", F.array().cast(f"array<{goal}>"))
    folded = F.aggregate(F.coalesce("steps", F.expr("slice(steps, 1, 0)")), start, fold)
    folded = F.when(F.col("steps").isNull(), start).otherwise(folded)
    goals = m.join(b, TEAM, "full").select(*TEAM, F.explode(folded).alias("g"))
    ends = matches.select("match_id", "period_1_end")
    return goals.join(ends, "match_id").select(
        "match_id", F.col("g.frame").alias("frame"),
        F.when(F.col("g.frame") > F.col("period_1_end"), 2).otherwise(1).alias("period"),
        F.col("team_id").alias("scoring_team_id"), F.col("g.frame_source").alias("frame_source"))


def goals_vs_official(goals: DataFrame, matches: DataFrame) -> DataFrame:
    """Derived against official score per match, with an ``ok`` flag."""
    sides = matches.select("match_id", "home_team_id", "away_team_id")
    derived = goals.join(sides, "match_id").groupBy("match_id").agg(
        F.count_if(F.col("scoring_team_id") == F.col("home_team_id")).alias("h"),
        F.count_if(F.col("scoring_team_id") == F.col("away_team_id")).alias("a"))
    h, a = F.coalesce("h", F.lit(0)), F.coalesce("a", F.lit(0))
    return matches.join(derived, "match_id", "left").select(
        "match_id",
        F.concat_ws("-", "home_team_score", "away_team_score").alias("official"),
        F.concat_ws("-", h, a).alias("derived"),
        ((h == F.col("home_team_score")) & (a == F.col("away_team_score"))).alias("ok"))


# --------------------------------------------------------------------------------------
# time to and from outcomes
# --------------------------------------------------------------------------------------
def _for_each_team(events: DataFrame, marks: DataFrame, frame: str, team: str, what: str) -> DataFrame:
    """Marks of a match seen from each of its teams, tagged own or other."""
    teams = events.where(F.col("team_id").isNotNull()).select(*TEAM).distinct()
    seen = marks.select("match_id", F.col(team).alias("__by"), F.col(frame).alias("__mark")).distinct()
    tag = F.when(F.col("__by") == F.col("team_id"), f"{what}_own").otherwise(f"{what}_other")
    return seen.join(teams, "match_id").select(*TEAM, "__mark", tag.alias("__kind"))


def add_goal_relative_time(events: DataFrame, goals: DataFrame, block: int = BLOCK, base: DataFrame | None = None) -> DataFrame:
    """Seconds since and until own and conceded goals, measured from frame_start."""
    base = events if base is None else base
    marks = _for_each_team(base, goals, "frame", "scoring_team_id", "goal")
    found = asof(events, marks, TEAM, "frame_start", "__mark", block, {
        "__sf": ("since", "goal_own"), "__sa": ("since", "goal_other"),
        "__uf": ("until", "goal_own"), "__ua": ("until", "goal_other")}, kind="__kind", axis=base)
    at = F.col("frame_start")
    return found.select(
        *events.columns,
        ((at - F.col("__sf.at")) / S.FPS).alias("seconds_since_goal_for"),
        ((at - F.col("__sa.at")) / S.FPS).alias("seconds_since_goal_against"),
        ((F.col("__uf.at") - at) / S.FPS).alias("seconds_until_goal_for"),
        ((F.col("__ua.at") - at) / S.FPS).alias("seconds_until_goal_against"))


def add_outcome_windows(events: DataFrame, goals: DataFrame, block: int = BLOCK, base: DataFrame | None = None) -> DataFrame:
    """Seconds from frame_end to the next shot and goal of the row's team and of any other team."""
    base = events if base is None else base
    marks = _for_each_team(base, own_shots(base), "frame", "team_id", "shot").unionByName(
        _for_each_team(base, goals, "frame", "scoring_team_id", "goal"))
    names = {
        "seconds_to_next_shot_same_team": "shot_own", "seconds_to_next_goal_same_team": "goal_own",
        "seconds_to_next_shot_opponent": "shot_other", "seconds_to_next_goal_opponent": "goal_other"}
    found = asof(events, marks, TEAM, "frame_end", "__mark", block,
                 {n: ("until", k) for n, k in names.items()}, kind="__kind", axis=base)
    return found.select(*events.columns, *[((F.col(n)["at"] - F.col("frame_end")) / S.FPS).alias(n) for n in names])


# --------------------------------------------------------------------------------------
# possession chains
# --------------------------------------------------------------------------------------
def chain_numbers(
    possessions: DataFrame, entity: str, position: str, tiebreak: str, flag: Column, block: int | None = None,
    out: str = "chain",
) -> DataFrame:
    """Running count of chain-opening flags per entity (0 before the first).

    Rows meet per block of positions, in crowded blocks per position and tiebreak range.
    """
    opened = no(flag).cast("int")
    levels = [block_of(position, BLOCK if block is None else block), F.col(position), tie_level(possessions, tiebreak)]
    return running_sum(possessions, [entity], levels, [position, tiebreak], {out: opened}, CROWD)


def add_chain_id(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """team_possession_id on possession rows and, through their parent, on all other rows."""
    pp = (events if base is None else base).where(is_type(S.PP)).select(
        "match_id", "event_id", "frame_start", "first_player_possession_in_team_possession")
    numbered = chain_numbers(
        pp, "match_id", "frame_start", "event_id", F.col("first_player_possession_in_team_possession"))
    ids = numbered.select(
        F.col("match_id").alias("__m"), F.col("event_id").alias("__e"),
        F.concat(F.col("match_id").cast("string"), F.lit("_tp"), F.col("chain").cast("string")).alias("team_possession_id"))
    owner = F.when(is_type(S.PP), F.col("event_id")).otherwise(F.col("associated_player_possession_event_id"))
    keyed = events.withColumn("__owner", owner)
    return left_lookup(keyed, ids, {"match_id": "__m", "__owner": "__e"}, F.col("event_id")).drop("__owner")


def chain_rollup(events: DataFrame) -> DataFrame:
    """Rollup per chain over all its rows, not only the possessions."""
    span = F.max("frame_end") - F.min("frame_start")
    return events.where(F.col("team_possession_id").isNotNull()).groupBy("team_possession_id").agg(
        F.count(F.lit(1)).alias("chain_n_possessions"),
        F.bool_or(no(F.col("third_end") == "attacking_third")).alias("chain_reached_final_third"),
        F.bool_or(no("penalty_area_end")).alias("chain_reached_box"),
        F.bool_or(no(F.col("end_type") == "shot")).alias("chain_ended_in_shot"),
        (span / S.FPS).alias("chain_duration_s"))


def add_possession_chains(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Chain id and the chain's rollup on every row."""
    base = events if base is None else base
    with_id = add_chain_id(events, base)
    roll = chain_rollup(add_chain_id(base)).withColumnRenamed("team_possession_id", "__tp")
    return left_lookup(with_id, roll, {"team_possession_id": "__tp"}, F.col("event_id"))


def possession_chains(events: DataFrame) -> DataFrame:
    """Chain table.  The team is the one of the chain's first possession row."""
    g = events.where(F.col("team_possession_id").isNotNull()).groupBy("team_possession_id").agg(
        F.min("match_id").alias("match_id"),
        F.min(F.when(is_type(S.PP), F.struct("frame_start", "event_id", "team_id"))).alias("__first"),
        F.min("frame_start").alias("frame_start"), F.max("frame_end").alias("frame_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.bool_or(no(F.col("third_end") == "attacking_third")).alias("reached_final_third"),
        F.bool_or(no("penalty_area_end")).alias("reached_box"),
        F.bool_or(no(F.col("end_type") == "shot")).alias("ended_in_shot"))
    return g.select(
        "team_possession_id", "match_id", F.col("__first.team_id").alias("team_id"), "frame_start", "frame_end",
        "n_events", F.col("n_events").alias("n_possessions"), "reached_final_third", "reached_box", "ended_in_shot",
        ((F.col("frame_end") - F.col("frame_start")) / S.FPS).alias("duration_s"))


# --------------------------------------------------------------------------------------
# zones and squad attributes
# --------------------------------------------------------------------------------------
def zone_flags(x: str, y: str, half: Column, suffix: str) -> list[Column]:
    """own/opp penalty-area and six-yard-box flags; a missing coordinate is outside."""
    out = []
    for zone, depth, width in (
        ("penalty_area", S.BOX_DEPTH, S.BOX_HALF_WIDTH), ("six_yard_box", S.SIX_DEPTH, S.SIX_HALF_WIDTH)):
        edge = half - depth
        across = F.abs(F.col(y)) <= width
        out.append(no((F.col(x) < -edge) & across).alias(f"own_{zone}_{suffix}"))
        out.append(no((F.col(x) > edge) & across).alias(f"opp_{zone}_{suffix}"))
    return out


def add_zone_flags(events: DataFrame, matches: DataFrame) -> DataFrame:
    joined = events.join(matches.select("match_id", (F.col("pitch_length") / 2.0).alias("__half")), "match_id", "left")
    half = F.col("__half")
    return joined.select(
        *events.columns,
        *zone_flags("x_start", "y_start", half, "start"),
        *zone_flags("x_end", "y_end", half, "end"),
        *zone_flags("player_targeted_x_reception", "player_targeted_y_reception", half, "reception"))


def unit_sizes(players: DataFrame, block: int = BLOCK) -> DataFrame:
    """Back-line, front-line and pivot head-count at each squad change of a team."""
    spans = players.select(*TEAM, "position", F.explode("on_pitch_intervals").alias("s")).select(
        *TEAM, "position", F.col("s.start_frame").alias("start"), F.col("s.end_frame").alias("end"))
    return interval_headcount(spans, TEAM, "start", "end", block, {
        "team_back_line_size": F.col("position").isin(*S.BACK_LINE),
        "team_front_line_size": F.col("position").isin(*S.FRONT_LINE),
        "team_pivot_size": F.col("position").isin(*S.PIVOT)})


def add_unit_sizes(events: DataFrame, players: DataFrame, block: int = BLOCK, base: DataFrame | None = None) -> DataFrame:
    names = ["team_back_line_size", "team_front_line_size", "team_pivot_size"]
    found = asof(events, unit_sizes(players, block), TEAM, "frame_start", "boundary", block,
                 {"__at": ("since", None), "__first": ("until", None)}, payload=names, axis=base)
    # before the first boundary the first one counts
    slot = F.coalesce("__at", "__first")
    return found.select(*events.columns, *[slot[n].alias(n) for n in names])


def add_roster_attributes(events: DataFrame, players: DataFrame) -> DataFrame:
    """is_starter, is_starting_cb_pair, number and is_substitute from the roster."""
    roster = players.groupBy("match_id", "player_id").agg(
        F.bool_or("is_starter").alias("__st"), F.min(F.struct("number", "is_substitute")).alias("__r"))
    joined = left_lookup(
        events, roster.withColumnsRenamed({"match_id": "__rm", "player_id": "__rp"}),
        {"match_id": "__rm", "player_id": "__rp"}, F.col("event_id"))
    starter = no("__st")
    return joined.select(
        *events.columns,
        F.col("__r.number").alias("number"), no(F.col("__r.is_substitute")).alias("is_substitute"),
        starter.alias("is_starter"), (no(F.col("player_position").isin(*S.CENTRE_BACKS)) & starter).alias("is_starting_cb_pair"))


def add_captain_flag(events: DataFrame, captains: DataFrame) -> DataFrame:
    """True where the row's player is the captain named for its match and team."""
    c = captains.select(F.col("match_id").alias("__cm"), F.col("team_id").alias("__ct"), F.col("player_id").alias("__cp"))
    joined = left_lookup(events, c, {"match_id": "__cm", "team_id": "__ct"}, F.col("event_id"))
    return joined.select(*events.columns, no(F.col("__cp") == F.col("player_id")).alias("is_captain"))


def modal_position(events: DataFrame, entity=("match_id", "player_id"), value: str = "player_position") -> DataFrame:
    """Most frequent observed value per entity; a tie goes to the alphabetically first."""
    counts = events.where(F.col(value).isNotNull()).groupBy(*entity, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*entity).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("b"))
    return best.select(*entity, F.col("b.v").alias(value), (-F.col("b.neg")).alias("n"))


# --------------------------------------------------------------------------------------
# the whole gold build
# --------------------------------------------------------------------------------------
PARTS = ("goal_time", "outcomes", "chains", "zones", "units", "roster", "captains")
#: Source columns the derivations read.
SOURCE_COLUMNS = (
    "match_id", "event_id", "event_type", "team_id", "player_id", "player_position", "frame_start", "frame_end",
    "end_type", "third_end", "penalty_area_end", "game_interruption_after", "team_score",
    "first_player_possession_in_team_possession", "associated_player_possession_event_id",
    "x_start", "y_start", "x_end", "y_end", "player_targeted_x_reception", "player_targeted_y_reception")


def enrich(
    events: DataFrame, matches: DataFrame, players: DataFrame, captains: DataFrame | None = None,
    goals: DataFrame | None = None, parts: Iterable[str] = PARTS, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame | None]:
    """Add the derived columns of ``parts``; returns (events, goals).

    All joins run on the few columns the derivations read, and their side tables come from the
    source rather than from the step before, so each step reads its input once.  The wide rows are
    shuffled a single time, to receive the derived columns by (match_id, event_id).
    """
    parts = set(parts)
    base = events.select(*SOURCE_COLUMNS)
    if goals is None and parts & {"goal_time", "outcomes"}:
        goals = goal_timeline(base, matches, block=block)
    out = base
    if "goal_time" in parts:
        out = add_goal_relative_time(out, goals, block, base)
    if "outcomes" in parts:
        out = add_outcome_windows(out, goals, block, base)
    if "units" in parts:
        out = add_unit_sizes(out, players, block, base)
    if "chains" in parts:
        out = add_possession_chains(out, base)
    if "roster" in parts:
        out = add_roster_attributes(out, players)
    if "captains" in parts:
        out = out.withColumn("is_captain", F.lit(False)) if captains is None else add_captain_flag(out, captains)
    if "zones" in parts:
        out = add_zone_flags(out, matches)
    derived = [c for c in out.columns if c not in base.columns]
    return events.join(out.select("match_id", "event_id", *derived), ["match_id", "event_id"], "left"), goals


def require_derived(df: DataFrame, declared: Iterable[str] = S.DERIVED_COLUMNS) -> DataFrame:
    missing = sorted(set(declared) - set(df.columns))
    if missing:
        raise RuntimeError(f"derivation did not produce declared columns: {missing}")
    return df
