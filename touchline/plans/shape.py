"""Phase widths against each team's own distribution."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import left_lookup
from touchline.operators.ordered import exact_percentiles, value_counts

#: Width of the value blocks (metres) that carry ranks and medians.
LEVEL = 1.0


def with_defender(phases: DataFrame) -> DataFrame:
    """defending_team_id: the smallest team of the match that is not in possession."""
    teams = phases.groupBy("match_id").agg(F.sort_array(F.collect_set("team_in_possession_id")).alias("__teams"))
    other = F.try_element_at(F.filter("__teams", lambda t: ~t.eqNullSafe(F.col("team_in_possession_id"))), F.lit(1))
    return phases.join(teams, "match_id", "left").select(*phases.columns, other.alias("defending_team_id"))


def relative_to_group(df: DataFrame, by: list[str], value: str, names: tuple[str, str, str],
                      level: float = LEVEL, base: DataFrame | None = None) -> DataFrame:
    """Adds average-rank percentile, z-score (sample deviation) and median of ``value`` within ``by``.

    Ranks come from counts per distinct value accumulated in value blocks and moments from partial
    aggregates; no task ever holds a group.  ``base`` is a cheaper table with the same values.
    """
    pctile, z, median = names
    base = df if base is None else base
    cum = value_counts(base, by, value, level)
    stats = base.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__avg"), F.stddev_samp(value).alias("__sd"))
    mid = exact_percentiles(base, by, value, {"__med": 0.5}, level).drop("n")
    # rank of a value = smaller values + half of its ties (plus one half)
    ranks = cum.select(*by, value, (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("__rank"))
    group = stats.join(mid, by)
    # rows without a value, a team or a type match nothing and are spread over the tasks
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    out = left_lookup(df, ranks, {c: c for c in (*by, value)}, spread)
    out = left_lookup(out, group, {c: c for c in by}, spread)
    return out.select(
        *df.columns, (F.col("__rank") / F.col("__n")).alias(pctile),
        F.try_divide(F.col(value) - F.col("__avg"), F.col("__sd")).alias(z), F.col("__med").alias(median))


def phase_shape(phases: DataFrame, level: float = LEVEL) -> DataFrame:
    """Phases with width percentile, z-score and baseline of both sides."""
    base = out = with_defender(phases)
    for side, team in (("out_of_possession", "defending_team_id"), ("in_possession", "team_in_possession_id")):
        value = f"team_{side}_width_end"
        if value in phases.columns:
            out = relative_to_group(out, [team, f"team_{side}_phase_type"], value,
                                    (f"{side}_width_pctile", f"{side}_width_z", f"{side}_width_baseline"), level, base)
    return out


def narrow_blocks(shape: DataFrame) -> DataFrame:
    """Medium blocks with a width z-score; order by it to read the narrowest first."""
    return shape.where((F.col("team_out_of_possession_phase_type") == "medium_block") & F.col("out_of_possession_width_z").isNotNull())
