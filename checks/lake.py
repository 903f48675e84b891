"""Gold tables derived from the driver's tables, written once per session like any build of the lake.

Questions read gold, as they do in a real deployment.  The tables go to the shared folder named by
``spark.checkpoint.dir``; a temporary folder serves only where none is named (tests, a laptop).
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import driver_tables as D
from touchline.plans import enrich as E
from touchline.plans import tracking as T
from touchline.session import compiled_methods, shared_folder
from touchline.sources import layers

BLOCK = 50
_written: dict = {}
_read: dict = {}


def table(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame], **layout) -> DataFrame:
    """The named table for this session and folder, built and written on first use.

    Its plan is kept, so that the folders of a table are listed once and not for every reader.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/gold-{uuid.uuid4().hex[:12]}/{name}"
        with compiled_methods(spark):  # the projection of the wide event columns is far too long for one method
            layers.write(build(), path, **layout)
        _written[key] = path
    if key not in _read:
        _read[key] = spark.read.parquet(_written[key])
    return _read[key]


def gold_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with every derived column."""
    def build():
        goals_ = goals(spark, sf)
        out, _ = E.enrich(D.events(spark, sf), matches(spark, sf), players(spark, sf), D.captains(spark, sf),
                          goals=goals_, block=BLOCK)
        return E.require_derived(out)
    return table(spark, sf, "events_enriched", build)


def goals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "goals", lambda: E.goal_timeline(D.events(spark, sf), matches(spark, sf), block=BLOCK))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking frames as the lake lays them out: in folders by match, sorted by (match_id, frame)."""
    return table(spark, sf, "frames", lambda: D.frames(spark, sf), sort=["match_id", "frame"], part=T.part_of(), dealt=True)


def frame_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frame_index", lambda: T.frame_index(frames(spark, sf)), sort=["match_id", "bucket"], part=T.part_of())


def tracked_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose coordinates come from tracking."""
    return table(spark, sf, "tracked_events", lambda: D.tracked_events(spark, sf, frames(spark, sf)))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "matches", lambda: D.matches(spark, sf))


def players(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "players", lambda: D.players(spark, sf))


def signs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mirror_signs", lambda: D.signs(spark, sf))


#: Defending frames for a baseline on the short axis (the full axis asks for 600).
BASELINE_FRAMES = 100


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "baselines", lambda: T.player_baselines(
        frames(spark, sf), matches(spark, sf), players(spark, sf), signs(spark, sf), min_frames=BASELINE_FRAMES))


def tracking(spark: SparkSession, sf: str, with_baselines: bool = False):
    from touchline.plans.predicates import Tracking
    return Tracking(frames(spark, sf), frame_index(spark, sf), signs(spark, sf), matches(spark, sf), players(spark, sf),
                    baselines(spark, sf) if with_baselines else None)


def candidates(spark: SparkSession, sf: str, qid: int, gold: DataFrame | None = None) -> DataFrame:
    """The candidates of a tracking question, written like those of the lake.

    They are found in ``gold`` where a caller has it at hand.  A question by itself reads the driver's events, with the one derived
    column that runs and turnovers are told apart by: the chain.  Filters reach the events before their chains are looked up.
    From gold only the columns that the question reads are taken and written.
    """
    from touchline.plans import predicates

    def build():
        found = D.events(spark, sf) if gold is None else gold.select(*predicates.SOURCE_COLUMNS)
        if gold is None and predicates.QUESTIONS[qid].by_chain:
            found = E.add_chain_id(found)
        return predicates.candidates(qid, found, frame_index(spark, sf))
    return table(spark, sf, f"candidates_{qid}" if gold is None else f"slim_candidates_{qid}", build)
