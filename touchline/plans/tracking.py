"""Tracking frames: window fetches, coverage, coordinate signs, motion and positional baselines.

``frames`` has one row per (match_id, frame): ball_x, ball_y, possession_group and ``players``, an
array of (player_id, x, y, is_detected) bounded by the players on the pitch.  Windows join on frames,
not on player rows, and the arrays are filtered before anything is exploded.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.ordered import block_of, previous_row, running_sum, with_median

#: Frames per bucket of the range join.
BUCKET = 256
#: Frames per row of the frame index: the bits of a number.
INDEX_BUCKET = 64
#: Values of the partition column ``part`` of the tracking tables, which bounds what tells a scan which folders it needs.
PARTS = 4096
#: The index row of a whole match stands at this bucket.
EXTENT = -(1 << 40)
KEY = ["match_id", "event_id"]


# --------------------------------------------------------------------------------------
# fetching
# --------------------------------------------------------------------------------------
def usable(players: str | Column = "players") -> Column:
    return F.coalesce(F.size(players) > 0, F.lit(False))


def part_of(match_id: str | Column = "match_id") -> Column:
    """The folder of a match's tracking."""
    return F.pmod(match_id if isinstance(match_id, Column) else F.col(match_id), F.lit(PARTS)).cast("int")


def pruned(table: DataFrame, windows: DataFrame) -> DataFrame:
    """``table`` without the folders that no window touches; a table that is not laid out in folders stays as it is.

    The folders are found when the query runs, and Spark reads no others.  What is broadcast are distinct
    values of ``part``: at most ``PARTS`` numbers, however many windows there are.
    """
    if "part" not in table.columns:
        return table
    needed = windows.select(part_of().alias("part")).distinct()
    return table.join(F.broadcast(needed), "part", "left_semi").drop("part")


def occupied(windows: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The windows that can hold a frame at all; Spark skips folders only for a side that is filtered."""
    return windows.where(F.col(lo) <= F.col(hi))


def fetch_window(windows: DataFrame, frames: DataFrame, lo: str = "lo", hi: str = "hi", bucket: int = BUCKET, scope: DataFrame | None = None) -> DataFrame:
    """All frames of each window, both ends inclusive.

    A range join on match_id alone would pair a whole match with every window; joining on
    (match_id, frame bucket) pairs a window only with the few buckets it touches, and spreads a
    match over as many tasks as it has buckets.  ``scope`` names windows that are cheaper to look up and
    touch at least the same folders.
    """
    w = windows.withColumn("__b", F.explode(F.sequence(block_of(lo, bucket), block_of(hi, bucket))))
    f = pruned(frames, occupied(windows, lo, hi) if scope is None else scope).withColumn("__b", block_of("frame", bucket))
    return w.join(f, ["match_id", "__b"]).where(F.col("frame").between(F.col(lo), F.col(hi))).drop("__b")


def fetch_balls(windows: DataFrame, index: DataFrame, lo: str = "lo", hi: str = "hi", scope: DataFrame | None = None) -> DataFrame:
    """frame, ball_x and ball_y of the usable frames of each window, from the frame index alone."""
    w = windows.withColumn("bucket", F.explode(F.sequence(block_of(lo, INDEX_BUCKET), block_of(hi, INDEX_BUCKET))))
    found = w.join(pruned(index, occupied(windows, lo, hi) if scope is None else scope).select("match_id", "bucket", "balls"), ["match_id", "bucket"]).drop("bucket")
    inside = F.filter("balls", lambda b: b["frame"].between(F.col(lo), F.col(hi)))
    return found.withColumn("__ball", F.explode(inside)).select(*windows.columns, "__ball.*")


def sample_count(lo: Column, hi: Column, n: int) -> Column:
    """How many frames of [lo, hi] are asked for."""
    return F.greatest(F.least(F.lit(n).cast("bigint"), hi - lo + 1), F.lit(0))


def explode_samples(windows: DataFrame, n: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``windows`` once for each of n evenly spaced frames of [lo, hi], halves to even; one frame is the midpoint.

    The ordinal is exploded and the frame computed from it afterwards, so what stands behind ``lo`` and
    ``hi`` is evaluated once per window and not once per sample.
    """
    w = windows.withColumn("requested", sample_count(F.col(lo), F.col(hi), n))
    w = w.where(F.col("requested") > 0).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("requested") - 1)))
    step = F.try_divide(F.col(hi) - F.col(lo), F.col("requested") - 1)
    spread = F.bround(F.col(lo) + F.col("__i") * step).cast("bigint")
    middle = F.floor((F.col(lo) + F.col(hi)) / 2) if n == 1 else F.col(lo)
    return w.withColumn("frame", F.when(F.col("requested") > 1, spread).otherwise(middle)).drop("__i")


def fetch_at(windows: DataFrame, frames: DataFrame, wanted: str) -> DataFrame:
    """The frames named in an array column; frames that do not exist are skipped."""
    w = windows.withColumn("frame", F.explode(wanted))
    return w.join(pruned(frames, windows.where(F.size(wanted) > 0)), ["match_id", "frame"])


def fetch_sampled(windows: DataFrame, frames: DataFrame, n: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    return explode_samples(windows, n, lo, hi).join(pruned(frames, occupied(windows, lo, hi)), ["match_id", "frame"])


def frame_index(frames: DataFrame, block: int = 256) -> DataFrame:
    """One row per match and bucket of 64 frames: counts of frames and usable frames before it, and which of its frames exist.

    Bit i of ``here`` (``used``) tells that the bucket's frame i exists (is usable); ``balls`` has the ball of the usable ones.
    Buckets without frames between a match's first and last get a row too (frame numbers count tenths of
    a second, so a pause costs one row per 64 of them), and one row at ``EXTENT`` tells the totals of the match
    and its last bucket.  With that, the frames of any window are counted from two buckets.  A frame that
    stands twice in ``frames`` counts once.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("frame", F.lit(INDEX_BUCKET)).cast("int"))
    held = frames.where("match_id is not null and frame is not null").groupBy("match_id", block_of("frame", INDEX_BUCKET).alias("bucket")).agg(
        F.bit_or(bit).alias("here"), F.coalesce(F.bit_or(F.when(usable(), bit)), F.lit(0)).alias("used"),
        F.sort_array(F.collect_list(F.when(usable(), F.struct("frame", "ball_x", "ball_y")))).alias("balls"))
    levels = [block_of("bucket", block)]
    counts = held.select("match_id", "bucket", F.bit_count("here").cast("long").alias("n"), F.bit_count("used").cast("long").alias("n_used"))
    counts = running_sum(counts, ["match_id"], levels, ["bucket"], {"req": F.col("n"), "use": F.col("n_used")})
    linked = previous_row(counts, ["match_id"], levels, "bucket", {"earlier": "bucket"})
    gap = F.sequence(F.coalesce(F.col("earlier") + 1, F.col("bucket")), F.col("bucket"))
    filled = linked.select("match_id", F.explode(gap).alias("bucket"), (F.col("req") - F.col("n")).alias("req"), (F.col("use") - F.col("n_used")).alias("use"))
    rows = filled.join(held, ["match_id", "bucket"], "left").fillna(0, ["here", "used"])
    whole = counts.groupBy("match_id").agg(F.sum("n").alias("req"), F.sum("n_used").alias("use"), F.max("bucket").alias("last"))
    return rows.unionByName(whole.withColumn("bucket", F.lit(EXTENT)), allowMissingColumns=True)


def coverage(windows: DataFrame, index: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Adds requested (frames that exist in the window), n_frames (usable ones) and coverage.  Windows are distinct rows.

    The counts up to both ends come from their two buckets and from the match's own row, all met in
    one join, so the cost of a window does not depend on its length and no frame row is read.
    """
    ends = F.array(block_of(F.col(lo) - 1, INDEX_BUCKET), block_of(hi, INDEX_BUCKET), F.lit(EXTENT))
    probes = windows.withColumn("bucket", F.explode(F.array_distinct(ends)))
    found = probes.join(pruned(index, occupied(windows, lo, hi)).select("match_id", "bucket", "req", "use", "here", "used", "last"), ["match_id", "bucket"], "left")

    def up_to(end: Column, counted: str, bits: str) -> Column:
        """Frames up to ``end``, known in the row of its bucket."""
        low = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (INDEX_BUCKET - 1 - F.pmod(end, F.lit(INDEX_BUCKET))).cast("int"))
        return F.max(F.when(F.col("bucket") == block_of(end, INDEX_BUCKET), F.col(counted) + F.bit_count(F.col(bits).bitwiseAND(low))))

    def total(name: str) -> Column:
        return F.max(F.when(F.col("bucket") == EXTENT, F.col(name))).alias(f"__{name}")

    before, last = F.col(lo) - 1, F.col(hi)
    met = found.groupBy(*windows.columns).agg(
        up_to(before, "req", "here").alias("__req_lo"), up_to(last, "req", "here").alias("__req_hi"),
        up_to(before, "use", "used").alias("__use_lo"), up_to(last, "use", "used").alias("__use_hi"), *[total(c) for c in ("req", "use", "last")])

    def between(name: str) -> Column:
        def at(end: Column, known: str) -> Column:  # an end outside the match has no bucket
            return F.coalesce(F.col(known), F.when(block_of(end, INDEX_BUCKET) > F.col("__last"), F.col(f"__{name}")), F.lit(0))
        return F.when(F.col(hi) >= F.col(lo), at(last, f"__{name}_hi") - at(before, f"__{name}_lo")).otherwise(0)

    return met.select(*windows.columns, between("req").alias("requested"), between("use").alias("n_frames"),
                      F.coalesce(F.try_divide(between("use"), between("req")), F.lit(0.0)).alias("coverage"))


def tracked_matches(index: DataFrame) -> DataFrame:
    """Matches with at least one usable frame."""
    return index.where((F.col("bucket") == EXTENT) & (F.col("use") > 0)).select("match_id")


def in_tracked_matches(df: DataFrame, index: DataFrame) -> DataFrame:
    return df.join(tracked_matches(index), "match_id", "left_semi")


# --------------------------------------------------------------------------------------
# coordinates
# --------------------------------------------------------------------------------------
def player_of(players: str | Column, player_id: Column) -> Column:
    """The first entry of a player in a frame, or null."""
    return F.try_element_at(F.filter(players, lambda p: p["player_id"] == player_id), F.lit(1))


def signed_players(players: str | Column, sign: Column, detected_only: bool = False) -> Column:
    """Positions in the event frame; entries without a coordinate (and, on request, extrapolated ones) are left out."""
    kept = F.filter(players, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.coalesce(p["is_detected"], F.lit(False)) | F.lit(not detected_only)))
    return F.transform(kept, lambda p: F.struct(
        p["player_id"].alias("player_id"), (p["x"] * sign).alias("x"), (p["y"] * sign).alias("y"), p["is_detected"].alias("is_detected")))


def to_event_frame(frames: DataFrame, sign: Column) -> DataFrame:
    """Signed players and ball; a ball without both coordinates is no ball."""
    return signed_ball(frames, sign).withColumn("players", signed_players("players", sign))


def signed_ball(frames: DataFrame, sign: Column) -> DataFrame:
    seen = F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    return frames.withColumns({"ball_x": F.when(seen, F.col("ball_x") * sign), "ball_y": F.when(seen, F.col("ball_y") * sign)})


def detection_rate(players: str | Column = "players") -> Column:
    """Share of a frame's players that were observed rather than extrapolated; 0 without players."""
    seen = F.size(F.filter(players, lambda p: F.coalesce(p["is_detected"], F.lit(False))))
    return F.coalesce(F.try_divide(seen, F.greatest(F.size(players), F.lit(0))), F.lit(0.0))


def box_edge_x(length: Column) -> Column:
    return length / 2.0 - S.BOX_DEPTH


def six_edge_x(length: Column) -> Column:
    return length / 2.0 - S.SIX_DEPTH


def goal_x(length: Column, own: Column) -> Column:
    return F.when(own, -length / 2.0).otherwise(length / 2.0)


def in_penalty_area(x: Column, y: Column, edge: Column, own: bool) -> Column:
    return ((x < -edge) if own else (x > edge)) & (F.abs(y) <= S.BOX_HALF_WIDTH)


# --------------------------------------------------------------------------------------
# mirror signs
# --------------------------------------------------------------------------------------
def vote_signs(events: DataFrame, frames: DataFrame, index: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """sign, confidence, n_votes and n_sampled (events that could vote) per (match, team, period) of the tracked matches.

    Every event votes: +1 when its position equals the tracked one and -1 when it equals the negation.
    """
    group = ["match_id", "team_id", "period"]
    pool = in_tracked_matches(events.where(F.col("team_id").isNotNull()).select(
        *group, "event_id", "player_id", "frame_start", "x_start", "y_start"), index)
    complete = (F.col("x_start").isNotNull() & F.col("y_start").isNotNull() & F.col("player_id").isNotNull() & F.col("frame_start").isNotNull())
    picked = pool.where(complete)
    at = picked.withColumn("frame", F.col("frame_start")).join(pruned(frames, picked.where("frame_start >= 0")).select("match_id", "frame", "players"), ["match_id", "frame"], "left")
    seen = at.withColumn("__p", player_of("players", F.col("player_id")))
    tx, ty = F.col("__p.x"), F.col("__p.y")
    same = (F.abs(F.col("x_start") - tx) <= tolerance) & (F.abs(F.col("y_start") - ty) <= tolerance)
    mirrored = (F.abs(F.col("x_start") + tx) <= tolerance) & (F.abs(F.col("y_start") + ty) <= tolerance)
    votes = seen.groupBy(*group).agg(
        F.count_if(F.coalesce(same, F.lit(False))).alias("__pos"),
        F.count_if(F.coalesce(~same & mirrored, F.lit(False))).alias("__neg"), F.count(F.lit(1)).alias("n_sampled"))
    out = pool.select(*group).distinct().join(votes, group, "left").fillna(0, ["__pos", "__neg", "n_sampled"])
    n = F.col("__pos") + F.col("__neg")
    return out.select(
        *group, F.when(n == 0, 0).when(F.col("__pos") >= F.col("__neg"), 1).otherwise(-1).alias("sign"),
        F.coalesce(F.try_divide(F.greatest("__pos", "__neg"), n), F.lit(0.0)).alias("confidence"), n.alias("n_votes"), "n_sampled")


def sign_problems(signs: DataFrame, min_confidence: float = 0.90) -> DataFrame:
    """(problem, match_id, team_id, period): unresolved groups, equal teams, teams that do not flip."""
    low = signs.where((F.col("sign") == 0) | (F.col("confidence") < min_confidence)).select(
        F.lit("low_confidence").alias("problem"), "match_id", "team_id", "period")
    alike = (F.count(F.lit(1)) == 2) & (F.min("sign") == F.max("sign"))
    teams = signs.groupBy("match_id", "period").agg(alike.alias("bad")).where("bad").select(
        F.lit("teams_agree").alias("problem"), "match_id", F.lit(None).cast("bigint").alias("team_id"), "period")
    flips = signs.groupBy("match_id", "team_id").agg(alike.alias("bad")).where("bad").select(
        F.lit("no_flip").alias("problem"), "match_id", "team_id", F.lit(None).cast("bigint").alias("period"))
    return low.unionByName(teams).unionByName(flips)


class UnresolvedSigns(RuntimeError):
    """A mirror sign could not be measured, or the signs contradict each other."""


def require_signs(signs: DataFrame, min_confidence: float = 0.90) -> DataFrame:
    found = sign_problems(signs, min_confidence).groupBy("problem").count().collect()
    if found:
        raise UnresolvedSigns(", ".join(f"{r['problem']}: {r['count']} groups" for r in found))
    return signs


# --------------------------------------------------------------------------------------
# motion
# --------------------------------------------------------------------------------------
def smoothed(value: str, window) -> Column:
    """Centred five-row mean; the ends use the rows there are."""
    return F.avg(value).over(window.rowsBetween(-2, 2))


def add_motion(series: DataFrame, by: Sequence[str], frame: str = "frame", x: str = "x", y: str = "y") -> DataFrame:
    """sx, sy (smoothed), vx, vy (m/s), speed (km/h) and step (m) of each series.

    A velocity belongs to the earlier of its two frames; the last frame has none.  The series of one
    ``by`` key must be short (a candidate's window); for whole-match series see ``long_motion``.
    """
    w = Window.partitionBy(*by).orderBy(frame)
    out = series.withColumns({"sx": smoothed(x, w), "sy": smoothed(y, w)})
    return _differences(out, w, frame)


def _differences(df: DataFrame, w, frame: str) -> DataFrame:
    out = df.withColumns({
        "__dx": F.lead("sx").over(w) - F.col("sx"), "__dy": F.lead("sy").over(w) - F.col("sy"),
        "__dt": (F.lead(frame).over(w) - F.col(frame)) / S.FPS})
    return out.withColumns({
        "vx": F.try_divide("__dx", "__dt"), "vy": F.try_divide("__dy", "__dt"),
        "step": F.hypot("__dx", "__dy"), "speed": F.try_divide(F.hypot("__dx", "__dy"), F.col("__dt")) * 3.6}).drop("__dx", "__dy", "__dt")


def long_motion(series: DataFrame, by: Sequence[str], index: str, frame: str = "frame", x: str = "x", y: str = "y", block: int = 2048) -> DataFrame:
    """``add_motion`` for series of any length, cut into blocks with three neighbour rows on each side."""
    from touchline.operators.ordered import with_halo
    spread = with_halo(series, index, block, 3)
    return add_motion(spread, [*by, "block"], frame, x, y).where("is_home").drop("block", "is_home")


# --------------------------------------------------------------------------------------
# positional baselines
# --------------------------------------------------------------------------------------
def defending_positions(frames: DataFrame, matches: DataFrame, players: DataFrame, signs: DataFrame) -> DataFrame:
    """(match_id, player_id, team_id, x, y): each player's signed position on every frame where the other side has the ball.

    Six slim columns of the player rows are shuffled, once, so that a player's frames of a match lie together;
    team, sides and signs come from one row per player.
    """
    signed = signs.groupBy("match_id", "team_id").agg(*[F.max(F.when(F.col("period") == p, F.col("sign"))).alias(f"__sign_{p}") for p in (1, 2)])
    about = players.select("match_id", "player_id", "team_id").join(
        matches.select("match_id", "period_2_start", "home_team_id", "away_team_id"), "match_id").join(signed, ["match_id", "team_id"])
    seen = F.filter("players", lambda p: p["player_id"].isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    held = frames.where(F.col("possession_group").isin("home team", "away team")).select(
        "match_id", "frame", (F.col("possession_group") == "home team").alias("__home"), F.explode(seen).alias("p")).select(
        "match_id", "p.player_id", "frame", "__home", "p.x", "p.y").repartition("match_id", "player_id")
    holder = F.when(F.col("__home"), F.col("home_team_id")).otherwise(F.col("away_team_id"))
    sign = F.when(F.col("frame") < F.col("period_2_start"), F.col("__sign_1")).otherwise(F.col("__sign_2"))
    away = held.join(about, ["match_id", "player_id"]).where((holder.isNull() | (F.col("team_id") != holder)) & sign.isNotNull())
    return away.select("match_id", "player_id", "team_id", (F.col("x") * sign).alias("x"), (F.col("y") * sign).alias("y"))


def player_baselines(frames: DataFrame, matches: DataFrame, players: DataFrame, signs: DataFrame, min_frames: int = 600) -> DataFrame:
    """Median defending position and its median absolute deviation per (match, player), both where the player's rows lie.

    Players with few frames stay, with ``reliable`` false: a baseline is chosen where it is used.
    """
    by = ["match_id", "player_id", "team_id"]
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("x", "y")])
    values = defending_positions(frames, matches, players, signs).select(*by, F.explode(sides).alias("side")).select(*by, "side.axis", "side.v")
    mid = with_median(values, [*by, "axis"], "v", "base", "n")
    both = with_median(mid.select(*by, "axis", "n", "base", F.abs(F.col("v") - F.col("base")).alias("d")), [*by, "axis"], "d", "spread", "n")

    def of(axis: str, c: str) -> Column:
        return F.max(F.when(F.col("axis") == axis, F.col(c))).alias(f"{c}_{axis}")

    wide = both.groupBy(*by).agg(
        F.max("n").alias("n_frames"), of("x", "base"), of("y", "base"), of("x", "spread"), of("y", "spread"))
    return wide.join(players.select("match_id", "player_id", "position"), ["match_id", "player_id"], "left").select(
        "match_id", "player_id", "team_id", "position", "n_frames", "base_x", "base_y", "spread_x", "spread_y", (F.col("n_frames") >= min_frames).alias("reliable"))
