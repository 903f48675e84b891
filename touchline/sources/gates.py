"""Validation gates: a bad table is never written."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("match_id", "event_id", "event_type", "frame_start", "frame_end", "team_id")


class GateError(RuntimeError):
    """A fatal gate failed; nothing was written."""


def _gate(df: DataFrame, name: str, severity: str, n_bad) -> DataFrame:
    return df.select(F.lit(name).alias("gate"), F.lit(severity).alias("severity"), F.coalesce(n_bad.cast("bigint"), F.lit(0)).alias("n_bad"))


def event_gates(events: DataFrame, matches: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(gate, severity, n_bad) of the fatal gates on events."""
    present = [c for c in required if c in events.columns]
    counts = events.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present],
        F.count_if(F.col("frame_end") < F.col("frame_start")).alias("frame_order"))
    rows = [*(f"null_{c}" for c in present), "frame_order"]
    pairs = F.array(*[F.struct(F.lit(r).alias("gate"), F.col(r).alias("n_bad")) for r in rows])
    simple = counts.select(F.explode(pairs).alias("p")).select("p.gate", F.lit("fail").alias("severity"), "p.n_bad")

    per_key = events.groupBy("match_id", "event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    duplicates = _gate(per_key.agg((F.sum("n") - F.count(F.lit(1))).alias("x")), "duplicate_keys", "fail", F.col("x"))
    sides = matches.select("match_id", "home_team_id", "away_team_id")
    teams = events.select("match_id", "team_id").distinct().join(sides, "match_id", "left")
    known = (F.col("team_id") == F.col("home_team_id")) | (F.col("team_id") == F.col("away_team_id"))
    strangers = _gate(teams.where(F.col("team_id").isNotNull()).agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("x")),
                      "team_not_in_match", "fail", F.col("x"))
    seen = events.where(F.col("match_id").isNotNull()).select("match_id", F.lit(1).alias("e"), F.lit(0).alias("m"))
    listed = matches.select("match_id", F.lit(0).alias("e"), F.lit(1).alias("m"))
    both = seen.unionByName(listed).groupBy("match_id").agg(F.max("e").alias("e"), F.max("m").alias("m"))
    coverage = _gate(both.agg(F.count_if(F.col("e") != F.col("m")).alias("x")), "match_coverage", "fail", F.col("x"))
    out = simple.unionByName(duplicates).unionByName(strangers).unionByName(coverage)
    missing = [c for c in required if c not in events.columns]
    if missing:
        out = out.unionByName(events.sparkSession.createDataFrame([(f"missing_{c}", "fail", 1) for c in missing], "gate string, severity string, n_bad bigint"))
    return out


def note_gates(matches: DataFrame, players: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Findings that are reported but stop nothing: scorers against the official score, and what tracking there is."""
    scored = players.groupBy("match_id").agg(F.sum("goals").alias("g"))
    differs = matches.join(scored, "match_id", "left").where(F.coalesce("g", F.lit(0)) != F.col("home_team_score") + F.col("away_team_score"))
    out = _gate(differs.agg(F.count(F.lit(1)).alias("x")), "scorers_vs_score", "note", F.col("x"))
    if inventory is None:
        return out.unionByName(_gate(matches.agg(F.lit(1).alias("x")), "no_tracking", "note", F.col("x")))
    else:
        # a match may have its tracking in several files
        frames = inventory.agg(F.sum("n_frames").alias("f"), F.count_distinct(F.when(F.col("n_frames") > 0, F.col("match_id"))).alias("m"))
        out = out.unionByName(_gate(frames, "frames_indexed", "note", F.col("f"))).unionByName(_gate(frames, "matches_indexed", "note", F.col("m")))
        stubs = inventory.agg(F.count_if(F.col("status") == "lfs_stub").alias("x"))
        out = out.unionByName(_gate(stubs, "tracking_stubs", "note", F.col("x")))
    return out


def require(gates: DataFrame) -> DataFrame:
    """Raise on any fatal finding.  The gate table has one row per gate."""
    bad = gates.where((F.col("severity") == "fail") & (F.col("n_bad") > 0)).collect()
    if bad:
        raise GateError("; ".join(f"{r['gate']}: {r['n_bad']}" for r in sorted(bad, key=lambda r: r["gate"])))
    return gates
