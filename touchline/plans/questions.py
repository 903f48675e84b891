"""The analyst questions: each a filter, an absence, an aggregate or a tracking predicate."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.concepts import blocked_questions
from touchline.operators.joins import without, without_other

C = F.col


def has(column: str, *values) -> Column:
    return C(column).isin(*values) if len(values) > 1 else C(column) == values[0]


def pos(*names: str) -> Column:
    return has("player_position", *names)


def pp() -> Column:
    return has("event_type", S.PP)


def obr() -> Column:
    return has("event_type", S.OBR)


def obe() -> Column:
    return has("event_type", S.OBE)


def under_pressure() -> Column:
    return has("overall_pressure_start", "high_pressure", "very_high_pressure")


def reception() -> Column:
    return has("start_type", "pass_reception")


def cut_inside() -> Column:
    return pp() & pos(*S.WINGERS) & C("out_to_in") & has("third_end", "attacking_third") & C("x_end").between(20, 40)


def goal_kick() -> Column:
    return has("game_interruption_before", "goal_kick_for", "goal_kick_against")


@dataclass(frozen=True)
class Question:
    qid: int
    category: str
    fidelity: str
    where: Callable[[], Column]
    needs: tuple[str, ...] = ()


CATEGORIES = ((1, "Player-specific"), (12, "Spatial"), (23, "Event-type"), (34, "Sequence"), (45, "Game-state"),
              (55, "Comparative"), (65, "Negative/absence"), (75, "Composite"))


def category_of(qid: int) -> str:
    return [name for first, name in CATEGORIES if qid >= first][-1]


FILTERS: dict[int, Question] = {}


def _q(qid: int, where: Callable[[], Column], *needs: str, fidelity: str = "exact") -> None:
    FILTERS[qid] = Question(qid, category_of(qid), fidelity, where, needs)


# The predicates of the questions.
_q(1, lambda: pp() & pos("LW") & reception() & has("third_start", "attacking_third"))
_q(2, lambda: pp() & has("number", 9) & (C("penalty_area_start") | C("penalty_area_end")), "roster")
_q(3, lambda: pp() & pos("RB") & C("carry") & (C("x_start") < 0) & (C("x_end") >= 0))
_q(4, lambda: obe() & C("is_starting_cb_pair") & has("period", 2), "roster")
_q(6, lambda: pp() & pos("GK") & has("end_type", "pass") & has("third_end", "middle_third") & under_pressure(), fidelity="approximate")
_q(7, lambda: obr() & pos("RW") & has("speed_avg_band", "sprinting"), fidelity="approximate")
_q(8, lambda: pp() & pos("CM", "RM", "LM", "AM") & C("one_touch") & has("third_end", "attacking_third"))
_q(9, lambda: obr() & pos("LB") & C("intended_run_behind"))
_q(10, lambda: pp() & pos("GK") & has("pass_range", "long") & C("high_pass"))
_q(11, lambda: obr() & pos("CF") & has("event_subtype", "dropping_off"))
_q(12, cut_inside)
_q(13, lambda: pp() & has("channel_start", "half_space_left", "half_space_right") & reception())
_q(14, lambda: has("team_back_line_size", 4) & pos(*S.BACK_LINE) & (C("x_start") < -5) & has("game_state", "winning"), "units")
_q(15, lambda: obr() & has("event_subtype", "cross_receiver") & has("channel_start", "wide_left", "wide_right"))
_q(16, lambda: pos(*S.FULL_BACKS) & (C("x_start") > 10) & (C("n_teammates_ahead_start") <= 1))
_q(18, lambda: pp() & C("penalty_area_start") & reception(), fidelity="approximate")
_q(19, lambda: pp() & C("inside_defensive_shape_start") & reception())
_q(20, lambda: pp() & C("last_line_break"))
_q(21, lambda: pp() & has("end_type", "pass") & C("opp_six_yard_box_reception"), "zones")
_q(22, lambda: pp() & pos(*S.WINGERS) & has("channel_start", "wide_left", "wide_right") & reception())
_q(23, lambda: pp() & has("end_type", "shot") & ~C("penalty_area_end"))
_q(24, lambda: has("game_interruption_before", "corner_against"))
_q(25, lambda: pp() & has("third_start", "attacking_third") & C("first_line_break"), fidelity="approximate")
_q(26, lambda: pp() & has("start_type", "pass_interception") & has("third_start", "defensive_third"))
_q(28, lambda: pp() & pos("GK") & has("pass_range", "long"))
_q(29, lambda: pp() & has("end_type", "clearance") & C("own_penalty_area_start") & under_pressure(), "zones")
_q(30, lambda: pp() & C("quick_pass") & has("third_start", "defensive_third"))
_q(31, lambda: obr() & (C("give_and_go") | C("initiate_give_and_go")))
_q(32, lambda: C("is_header") & C("own_penalty_area_start") & has("game_interruption_before", "corner_against", "free_kick_against"), "zones")
_q(33, lambda: pp() & C("player_targeted_dangerous") & C("player_targeted_difficult_pass_target"))
_q(34, lambda: pp() & has("start_type", "recovery", "pass_interception") & has("third_start", "middle_third") & C("lead_to_shot"))
_q(35, lambda: pp() & has("team_in_possession_phase_type", "build_up") & has("game_interruption_before", "goal_kick_for")
   & C("chain_reached_final_third"), "chains")
_q(36, lambda: pp() & C("is_header") & has("end_type", "clearance") & pos(*S.BACK_LINE) & (C("seconds_to_next_shot_same_team") <= 30),
   "outcomes", fidelity="approximate")
_q(37, lambda: pp() & (C("n_player_possessions_in_phase") >= 5) & C("team_possession_loss_in_phase"))
_q(38, lambda: obr() & C("give_and_go") & C("lead_to_shot"))
_q(39, lambda: has("game_interruption_before", "corner_for") & (C("seconds_to_next_shot_same_team") <= 6), "outcomes")
_q(40, lambda: obr() & C("give_and_go") & C("lead_to_shot"))
_q(41, lambda: pp() & (C("first_line_break") | C("second_last_line_break") | C("last_line_break"))
   & (C("seconds_to_next_shot_same_team") <= 8), "outcomes")
_q(42, lambda: obe() & C("pressing_chain") & (C("pressing_chain_length") >= 3) & has("pressing_chain_end_type", "regain"))
_q(43, lambda: pp() & has("start_type", "throw_in_reception") & C("chain_reached_box"), "chains")
_q(44, lambda: obe() & has("event_subtype", "counter_press") & has("team_out_of_possession_phase_type", "high_block"), fidelity="approximate")
_q(45, lambda: (C("minute_start") >= 75) & has("game_state", "winning") & C("team_out_of_possession_phase_type").isNotNull())
_q(46, lambda: (C("minute_start") < 10) & (has("team_in_possession_phase_type", "transition")
   | has("team_out_of_possession_phase_type", "defending_transition")))
_q(47, lambda: has("game_state", "losing") & C("game_interruption_before").isNotNull())
_q(48, lambda: pp() & (C("minute_start") >= 80) & has("start_type", "throw_in_reception", "keep_possession"), fidelity="approximate")
_q(49, lambda: obe() & (C("seconds_since_goal_against") <= 300) & has("event_subtype", "pressing", "pressure", "counter_press"), "goal_time")
_q(50, lambda: pp() & (C("minute_start") < 5) & has("team_in_possession_phase_type", "build_up"))
_q(51, lambda: C("seconds_since_goal_for") <= 120, "goal_time")
_q(52, lambda: pp() & (C("minute_start") >= 80) & has("game_state", "losing") & has("team_in_possession_phase_type", "direct"))
_q(53, lambda: (C("minute_start") >= 90) & C("game_interruption_before").isNotNull())
_q(55, lambda: pp() & pos(*S.FULL_BACKS) & C("interplayer_distance").isNotNull() & has("n_teammates_ahead_start", 0), fidelity="approximate")
_q(57, lambda: pp() & pos(*S.PIVOT) & C("last_line_break"), fidelity="approximate")
_q(58, lambda: pp() & has("n_opponents_ahead_end", 0))
_q(60, lambda: pos(*S.FULL_BACKS) & (C("separation_start") < 2))
_q(61, lambda: pp() & pos(*S.PIVOT) & (C("n_teammates_ahead_start") < 2))
_q(62, lambda: obe() & pos(*S.CENTRE_BACKS) & has("event_subtype", "pressing", "pressure") & has("pressing_chain_end_type", "regain"),
   fidelity="approximate")
_q(63, lambda: C("n_opponents_overtaken") >= 2)
_q(64, lambda: pp() & (C("n_passing_options_dangerous_difficult") >= 1))
_q(71, lambda: has("event_type", S.PO) & C("penalty_area_end") & ~C("targeted"))
_q(72, lambda: pp() & C("first_line_break") & ~C("lead_to_shot"))
_q(73, lambda: obe() & C("pressing_chain") & has("pressing_chain_end_type", "disruption"))
_q(75, lambda: cut_inside() & has("game_state", "winning") & (C("minute_start") >= 75))
_q(76, lambda: obr() & pos("RB") & (C("seconds_since_goal_against") <= 600) & has("speed_avg_band", "hsr", "sprinting"), "goal_time")
_q(77, lambda: obr() & C("give_and_go") & has("third_start", "attacking_third") & (C("seconds_to_next_shot_same_team") <= 6), "outcomes")
_q(79, lambda: obe() & pos(*S.FRONT_LINE) & has("team_front_line_size", 2) & goal_kick() & C("pressing_chain")
   & has("pressing_chain_end_type", "regain"), "units", fidelity="approximate")
_q(80, lambda: pp() & C("is_substitute") & C("last_line_break") & C("lead_to_shot"), "roster")


# --------------------------------------------------------------------------------------
# absences and the aggregate
# --------------------------------------------------------------------------------------
def goal_kicks_without_striker_press(events: DataFrame) -> DataFrame:
    """65: goal-kick rows in whose phase no centre forward engaged."""
    return without(events.where(goal_kick()), events.where(obe() & pos("CF")), ["_pk"])


def breaks_without_shot(events: DataFrame) -> DataFrame:
    """67: quick breaks with nobody ahead, in whose phase no shot followed."""
    rows = events.where(pp() & has("team_in_possession_phase_type", "quick_break") & has("n_opponents_ahead_end", 0))
    return without(rows, events.where(pp() & has("end_type", "shot")), ["_pk"])


def beaten_full_back_without_cover(events: DataFrame) -> DataFrame:
    """69: beaten full backs in whose phase no *other* defender engaged."""
    beaten = obe() & pos(*S.FULL_BACKS) & (F.coalesce("beaten_by_possession", F.lit(False)) | F.coalesce("beaten_by_movement", F.lit(False)))
    cover = events.where(obe() & pos(*S.BACK_LINE))
    return without_other(events.where(beaten), cover, ["_pk"], "player_id")


def transitions_without_counter_press(events: DataFrame) -> DataFrame:
    """74: transition possessions in whose phase nobody counter-pressed."""
    rows = events.where(pp() & has("team_in_possession_phase_type", "transition"))
    return without(rows, events.where(obe() & has("event_subtype", "counter_press")), ["_pk"])


def share_by_condition(df: DataFrame, condition: Column, hit: Column, name: str = "condition", share: str = "share", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of hits on both sides of a condition, in each group of ``by``; nulls count as no, and stay in the denominator."""
    flag = F.coalesce(condition, F.lit(False))
    return df.groupBy(*by, flag.alias(name)).agg(
        F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias(share), F.count(F.lit(1)).alias("rows"))


def long_pass_share_by_lead(events: DataFrame) -> DataFrame:
    """54: share of long passes when two or more goals ahead, against the rest."""
    lead = C("team_score") - C("opponent_team_score") >= 2
    return share_by_condition(events.where(pp()), lead, has("pass_range", "long"), "leading_by_two", "long_pass_share")


ABSENCES: dict[int, Callable[[DataFrame], DataFrame]] = {
    65: goal_kicks_without_striker_press, 67: breaks_without_shot,
    69: beaten_full_back_without_cover, 74: transitions_without_counter_press}
APPROXIMATE_ABSENCES = (67, 69, 74)
TRACKING_QUESTIONS = (56, 59, 66, 68, 70)
UNANSWERABLE = (5, 27, 78)


def answer(qid: int, events: DataFrame) -> DataFrame:
    """Rows answering one event question on enriched events."""
    if qid in FILTERS:
        return events.where(FILTERS[qid].where())
    if qid in ABSENCES:
        return ABSENCES[qid](events)
    if qid == 54:
        return long_pass_share_by_lead(events)
    raise KeyError(f"question {qid} is not an event question")


def refusals(spark) -> DataFrame:
    """qid, concept, verdict of the questions no available source can answer."""
    rows = [(q, c.name, c.verdict) for q, c in sorted(blocked_questions().items()) if q in UNANSWERABLE]
    return spark.createDataFrame(rows, "qid int, concept string, verdict string")


def run_filters(events: DataFrame, qids: Sequence[int] | None = None) -> DataFrame:
    """qid, category, fidelity, hits, matches of the filter questions, all from one scan.

    Counting per match first turns "distinct matches with a hit" into a plain count, so that no
    distinct aggregate multiplies the rows.
    """
    chosen = [FILTERS[q] for q in (qids or FILTERS)]
    lacking = {part for q in chosen for part in q.needs} - _available(events)
    if lacking:
        raise ValueError(f"the events lack derived columns: {sorted(lacking)}")
    per_match = events.groupBy("match_id").agg(*[F.count_if(q.where()).alias(f"q{q.qid}") for q in chosen])
    one = per_match.agg(*[
        F.struct(F.lit(q.qid).alias("qid"), F.lit(q.category).alias("category"), F.lit(q.fidelity).alias("fidelity"),
                 F.coalesce(F.sum(f"q{q.qid}"), F.lit(0)).alias("hits"), F.count_if(C(f"q{q.qid}") > 0).alias("matches")).alias(f"q{q.qid}")
        for q in chosen])
    return one.select(F.explode(F.array(*[C(f"q{q.qid}") for q in chosen])).alias("r")).select("r.*")


def _available(events: DataFrame) -> set[str]:
    marks = {"goal_time": "seconds_since_goal_for", "outcomes": "seconds_to_next_shot_same_team", "chains": "chain_reached_box",
             "zones": "opp_six_yard_box_reception", "units": "team_back_line_size", "roster": "is_starting_cb_pair"}
    return {part for part, column in marks.items() if column in events.columns}


def tally(qid: int, rows: DataFrame, fidelity: str) -> DataFrame:
    """One row of the run report for a question answered by its own plan."""
    return rows.groupBy("match_id").count().agg(
        F.lit(qid).alias("qid"), F.lit(category_of(qid)).alias("category"), F.lit(fidelity).alias("fidelity"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("matches"))


def run_event_questions(events: DataFrame) -> DataFrame:
    """Run report of all filter, absence and aggregate questions; an aggregate has no hits (null)."""
    out = run_filters(events)
    for q, fn in ABSENCES.items():
        out = out.unionByName(tally(q, fn(events), "approximate" if q in APPROXIMATE_ABSENCES else "exact"))
    shares = long_pass_share_by_lead(events).agg(
        F.lit(54).alias("qid"), F.lit(category_of(54)).alias("category"), F.lit("exact").alias("fidelity"),
        F.lit(None).cast("bigint").alias("hits"), F.count(F.lit(1)).cast("bigint").alias("matches"))
    return out.unionByName(shares.withColumn("matches", F.lit(None).cast("bigint")))


def run_all_questions(events: DataFrame, phase_shape: DataFrame, tracking, candidates: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """Run report of all 77 answerable questions: those on events, on phase shape (17) and on tracking.

    ``candidates`` are the written candidate tables of the tracking questions; without them they are found in ``events``.
    """
    from touchline.plans import predicates, shape

    out = run_event_questions(events).unionByName(tally(17, shape.narrow_blocks(phase_shape), "exact"))
    for q in TRACKING_QUESTIONS:
        chosen = candidates[q] if candidates else predicates.candidates(q, events, tracking.index)
        out = out.unionByName(tally(q, predicates.rank_measured(q, chosen, tracking), "exact"))
    return out
