"""Build the lake: raw files -> silver (typed, validated) -> gold (derived)."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.plans import enrich as E
from touchline.plans import predicates, shape
from touchline.plans import tracking as T
from touchline.plans.predicates import Tracking
from touchline.session import compiled_methods, shared_folder
from touchline.sources import gates, layers, raw
from touchline.sources.conform import conform


def conform_undeclared(df: DataFrame, declared: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns the schema does not declare get the type of their values; declared text stays text."""
    known = {c for names in declared.values() for c in names} | {"_pk"}
    return conform(df, [c for c in df.columns if c not in known])


def build_silver(spark: SparkSession, bronze: str, lake: str, check_only: bool = False) -> DataFrame:
    """Read, validate, write and publish the silver tables; returns the gate table.

    The raw files of each kind are read once, into typed Parquet in the shared folder; profiles, gates and the
    tables themselves come from there.  Nothing reaches the lake when a fatal gate fails or
    ``check_only`` is set, and readers see the new tables only when all of them are written.
    """
    version = f"build-{uuid.uuid4().hex[:12]}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(spark)}/silver-{version}/{name}"
        with compiled_methods(spark):  # the casts of the wide event columns are too long for one method
            layers.write(df, path, codec="zstd")
        return spark.read.schema(df.schema).parquet(path)

    events = staged(raw.parse_events(staged(raw.event_lines(spark, bronze), "event_lines")), "events")
    events = conform_undeclared(events, S.EVENT_COLUMN_TYPES)
    files = staged(raw.read_match_files(spark, bronze), "match_files")
    matches, players = raw.matches_table(files), raw.players_table(files, events)
    lines = raw.tracking_lines(spark, bronze)
    if lines is not None and not check_only:
        lines = staged(lines, "tracking_lines")
    # the gates ask for the files' counts only, so a check reads every line but stages no frame
    inventory = None if lines is None else staged(raw.inventory_of(lines), "tracking_inventory")
    found = gates.event_gates(events, matches).unionByName(gates.note_gates(matches, players, inventory))
    found = staged(found, "gates")
    gates.require(found)
    if check_only:
        return found

    def save(df: DataFrame, table: str, sort: Sequence[str] = (), part: Column | None = None) -> DataFrame:
        path = f"{lake}/silver/{version}/{table}"
        layers.write(df, path, sort, part)
        return spark.read.parquet(path)

    written = save(events, "events", ["match_id", "frame_start"])
    save(matches, "matches")
    save(players, "players")
    phases = raw.phase_lines(spark, bronze)
    if phases is not None:
        phases = staged(raw.parse_phases(staged(phases, "phase_lines")), "phases")
        save(conform_undeclared(phases, S.PHASE_COLUMN_TYPES), "phases")
    if lines is not None:
        save(inventory, "tracking_inventory")
        frames = save(raw.frames_of(lines), "frames", ["match_id", "frame"], T.part_of())
        index = save(T.frame_index(frames), "frame_index", ["match_id", "bucket"], T.part_of())
        save(T.require_signs(T.vote_signs(written, frames, index)), "mirror_signs")
    layers.publish(spark, lake, "silver", version)
    return found


def build_gold(spark: SparkSession, lake: str, captains: DataFrame | None = None, block: int = E.BLOCK) -> DataFrame:
    """Derive and write the gold tables; returns derived against official scores."""
    events, matches, players = (layers.load(spark, lake, "silver", t) for t in ("events", "matches", "players"))
    # the goal list is a handful of rows per match and feeds eight columns: write it before it is used
    layers.save(E.goal_timeline(events.select(*E.SOURCE_COLUMNS), matches, block=block), lake, "gold", "goals")
    goals = layers.load(spark, lake, "gold", "goals")
    out, _ = E.enrich(events, matches, players, captains, goals=goals, block=block)
    layers.save(E.require_derived(out), lake, "gold", "events_enriched", ["match_id", "frame_start"])
    gold = layers.load(spark, lake, "gold", "events_enriched")
    layers.save(E.possession_chains(gold), lake, "gold", "possession_chains")
    try:
        phases = layers.load(spark, lake, "silver", "phases")
    except layers.MissingTable:
        phases = None
    if phases is not None:
        layers.save(shape.phase_shape(phases), lake, "gold", "phase_shape")
    return E.goals_vs_official(goals, matches)


def build_baselines(spark: SparkSession, lake: str, min_frames: int = 600) -> None:
    t = load_tracking(spark, lake, baselines=False)
    layers.save(T.player_baselines(t.frames, t.matches, t.players, t.signs, min_frames), lake, "gold", "player_baselines")


def build_candidates(spark: SparkSession, lake: str) -> None:
    """Write the candidates of every tracking question."""
    events, index = layers.load(spark, lake, "gold", "events_enriched"), layers.load(spark, lake, "silver", "frame_index")
    for qid in predicates.QUESTIONS:
        layers.save(predicates.candidates(qid, events, index), lake, "gold", f"candidates_{qid}")


def load_candidates(spark: SparkSession, lake: str) -> dict[int, DataFrame]:
    return {qid: layers.load(spark, lake, "gold", f"candidates_{qid}") for qid in predicates.QUESTIONS}


def load_tracking(spark: SparkSession, lake: str, baselines: bool = True) -> Tracking:
    frames, index, signs, matches, players = (
        layers.load(spark, lake, "silver", t) for t in ("frames", "frame_index", "mirror_signs", "matches", "players"))
    return Tracking(frames, index, signs, matches, players, layers.load(spark, lake, "gold", "player_baselines") if baselines else None)


def base_positions(baselines: DataFrame) -> DataFrame:
    """Players and median defending depth per position, deepest first."""
    from touchline.operators.ordered import exact_percentiles
    mid = exact_percentiles(baselines.where(F.col("reliable") & F.col("position").isNotNull()), ["position"], "base_x", {"median_x": 0.5}, 1.0)
    return mid.withColumnRenamed("n", "players").orderBy("median_x", "position")
