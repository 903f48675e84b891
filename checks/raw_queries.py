"""Raw files written from the driver's tables and read back through the readers."""
from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import oracle as O
from checks.registry import query
from touchline import schema as S
from touchline.operators import compare as M
from touchline.plans import enrich as E
from touchline.plans import lake as L
from touchline.session import compiled_methods
from touchline.sources import layers, raw

KINDS = ("events", "phases", "matches", "tracking", "captains")
#: Renames under way at a time; each only waits for the file system.
RENAMES = 16
#: How the two large kinds are written: compressed, and a file of bounded length, as one task unpacks it.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1 << 18}
_written: dict = {}


def _files(df: DataFrame, match: str, root: str, suffix: str, write, dealt: bool = False) -> None:
    """A few files ``<root>/matches/<match>/<match>_<n><suffix>`` for each match, moved into place after Spark's commit.

    Rows meet by match before they are written, so there are about as many files as matches and not one per
    match and task; Spark splits a match that is large (rebalancing), which then gets several files.
    Rows that are ``dealt`` lie together by match already and are written where they are.
    """
    spark = df.sparkSession
    staged = f"{root}/staged-{uuid.uuid4().hex[:8]}"
    rows = df.withColumn("__m", F.col(match))
    with compiled_methods(spark):  # the wide event columns are derived where they are written
        write((rows if dealt else rows.hint("rebalance", F.col("__m"))).write.partitionBy("__m"), staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(conf)

    def move(at: str, n: int) -> None:
        m = at.rsplit("/", 2)[1].split("=")[1]
        fs.mkdirs(path(f"{root}/matches/{m}"))
        if not fs.rename(path(at), path(f"{root}/matches/{m}/{m}_{n}{suffix}")):
            raise OSError(f"{at} could not be moved")

    found = [status.getPath().toString() for status in fs.globStatus(path(f"{staged}/__m=*/part-*"))]
    with ThreadPool(RENAMES) as pool:
        pool.starmap(move, zip(found, range(len(found))))


def bronze(spark: SparkSession, sf: str, *kinds: str) -> str:
    """The folder of raw files; the named kinds are written on first use."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        _written[key] = (f"{lake.shared_folder(spark)}/bronze-{uuid.uuid4().hex[:12]}", set())
    root, there = _written[key]
    for kind in kinds:
        if kind not in there:
            _WRITE[kind](spark, sf, root)
            there.add(kind)
    return root


def _write_events(spark: SparkSession, sf: str, root: str) -> None:
    ev = D.events(spark, sf, dealt=True).drop("_pk")
    text = ev.select(*[F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if k == "boolean" else F.col(c) for c, k in ev.dtypes])
    _files(text, "match_id", root, raw.EVENTS[1:] + raw.PACKED, lambda w, at: w.options(**PACKED).option("header", True).csv(at), dealt=True)


def _write_phases(spark: SparkSession, sf: str, root: str) -> None:
    phases = D.events(spark, sf).groupBy("match_id", "phase_index").agg(
        F.min("frame_start").alias("frame_start"), F.max("frame_end").alias("frame_end"), F.max("team_in_possession_phase_type").alias("team_in_possession_phase_type"))
    _files(phases.drop("phase_index"), "match_id", root, raw.PHASES[1:], lambda w, at: w.option("header", True).csv(at))


def _write_matches(spark: SparkSession, sf: str, root: str) -> None:
    whole = F.struct(F.col("p.on_pitch_intervals").alias("sequences"))
    entry = F.struct(F.col("p.player_id").alias("id"), F.col("p.team_id").alias("team_id"), F.col("p.number").alias("number"),
                     F.when(F.col("p.is_substitute"), "01:06:40").otherwise("00:00:00").alias("start_time"), F.lit(0).alias("goal"), F.lit(0).alias("own_goal"),
                     F.struct(F.col("p.roster_position").alias("acronym")).alias("player_role"), whole.alias("playing_time"))
    squads = D.players(spark, sf).select("match_id", F.struct("*").alias("p")).groupBy("match_id").agg(F.collect_list(entry).alias("players"))
    period = lambda n: F.struct(F.lit(n).alias("period"), F.col(f"period_{n}_start").alias("start_frame"), F.col(f"period_{n}_end").alias("end_frame"))
    files = D.matches(spark, sf).join(squads, "match_id").select(
        F.col("match_id").alias("id"), F.struct(F.col("home_team_id").alias("id")).alias("home_team"), F.struct(F.col("away_team_id").alias("id")).alias("away_team"),
        "home_team_score", "away_team_score", "pitch_length", "pitch_width", F.array(period(1), period(2)).alias("match_periods"), "players")
    _files(files, "id", root, raw.MATCH[1:], lambda w, at: w.json(at))


def _write_tracking(spark: SparkSession, sf: str, root: str) -> None:
    frames = D.frames(spark, sf).select(
        "match_id", "frame", F.struct(F.col("ball_x").alias("x"), F.col("ball_y").alias("y")).alias("ball_data"),
        F.struct(F.col("possession_group").alias("group")).alias("possession"), F.col("players").alias("player_data"))
    _files(frames.withColumnRenamed("match_id", "m"), "m", root, raw.TRACKING[1:] + raw.PACKED, lambda w, at: w.options(**PACKED).json(at), dealt=True)


def _write_captains(spark: SparkSession, sf: str, root: str) -> None:
    teams = D.captains(spark, sf).groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("team_id").cast("string"), "player_id"))).alias("t"))
    lines = teams.select(F.to_json(F.create_map(F.col("match_id").cast("string"), "t")).alias("value"))
    lines.write.text(f"{root}/captains.json")


_WRITE = dict(zip(KINDS, (_write_events, _write_phases, _write_matches, _write_tracking, _write_captains)))


COLUMNS = ["event_id", "match_id", "team_id", "player_id", "frame_start", "frame_end", "x_start", "carry", "targeted", "end_type", "n_opponents_ahead_end", "_pk"]


@query("raw_events", O.with_base(select=f"SELECT {', '.join(COLUMNS)} FROM ev"))
def raw_events(spark, sf):
    return raw.read_events(spark, bronze(spark, sf, "events")).select(F.col("event_id").cast("bigint").alias("event_id"), *COLUMNS[1:])


@query("raw_phases", O.with_base(select="""
SELECT match_id, MIN(frame_start) AS frame_start, MAX(frame_end) AS frame_end, MAX(team_in_possession_phase_type) AS team_in_possession_phase_type FROM ev GROUP BY match_id, phase_index"""))
def raw_phases(spark, sf):
    return raw.read_phases(spark, bronze(spark, sf, "phases")).select("match_id", "frame_start", "frame_end", "team_in_possession_phase_type")


@query("raw_matches", O.with_base(select="SELECT * FROM mt"))
def raw_matches(spark, sf):
    return raw.matches_table(raw.read_match_files(spark, bronze(spark, sf, "matches"))).select(*D.MATCH_COLUMNS)


@query("raw_players", O.with_base(select="""
SELECT match_id, player_id, team_id, number, roster_position, is_starter, is_substitute, CASE WHEN s2 IS NULL THEN 1 ELSE 2 END AS intervals, 'sequences' AS interval_source FROM pl"""))
def raw_players(spark, sf):
    at = bronze(spark, sf, "matches", "events")
    got = raw.players_table(raw.read_match_files(spark, at), raw.read_events(spark, at))
    return got.select("match_id", "player_id", "team_id", "number", "roster_position", "is_starter", "is_substitute", F.size("on_pitch_intervals").alias("intervals"), "interval_source")


@query("raw_tracking", O.with_base(D.positions_cte(), select="""
SELECT f.match_id, n_frames, n_players, sum_x, COALESCE(n_ball, 0) AS n_ball FROM (SELECT match_id, COUNT(*) AS n_frames FROM fr GROUP BY match_id) f
LEFT JOIN (SELECT match_id, COUNT(*) AS n_players, ROUND(SUM(x), 2) AS sum_x FROM tk GROUP BY match_id) t ON t.match_id = f.match_id
LEFT JOIN (SELECT match_id, COUNT(ball_x) AS n_ball FROM bf GROUP BY match_id) b ON b.match_id = f.match_id"""))
def raw_tracking(spark, sf):
    f = raw.read_tracking(spark, bronze(spark, sf, "tracking")).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count("ball_x").alias("n_ball"))
    p = raw.player_frames(raw.read_tracking(spark, bronze(spark, sf, "tracking"))).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_players"), F.round(F.sum("x"), 2).alias("sum_x"))
    return f.join(p, "match_id", "left").select("match_id", "n_frames", "n_players", "sum_x", "n_ball")


@query("tracking_inventory", O.with_base(D.positions_cte(), select="SELECT match_id, COUNT(*) AS n_frames, TRUE AS ok FROM fr GROUP BY match_id"))
def tracking_inventory(spark, sf):
    got = raw.tracking_inventory(spark, bronze(spark, sf, "tracking"))
    return got.groupBy("match_id").agg(F.sum("n_frames").alias("n_frames"), F.min(F.col("status") == "ok").alias("ok"))


@query("raw_captains", O.with_base(select="SELECT match_id, team_id, player_id FROM cap"))
def raw_captains(spark, sf):
    return raw.read_captains(spark, f"{bronze(spark, sf, 'captains')}/captains.json/part-*")


@query("silver_check", O.with_base(D.positions_cte(), select="""
SELECT gate, 'fail' AS severity, 0 AS n_bad FROM (VALUES ('null_match_id'), ('null_event_id'), ('null_event_type'), ('null_frame_start'), ('null_frame_end'), ('null_team_id'),
  ('frame_order'), ('duplicate_keys'), ('team_not_in_match'), ('match_coverage')) g(gate)
UNION ALL SELECT 'scorers_vs_score', 'note', COUNT(*) FROM mt UNION ALL SELECT 'frames_indexed', 'note', COUNT(*) FROM fr
UNION ALL SELECT 'matches_indexed', 'note', COUNT(DISTINCT match_id) FROM fr UNION ALL SELECT 'tracking_stubs', 'note', 0"""))
def silver_check(spark, sf):
    at = bronze(spark, sf, *KINDS)
    found = L.build_silver(spark, at, f"{at}/unwritten", check_only=True)
    return found.groupBy("gate", "severity").agg(F.sum("n_bad").alias("n_bad"))


@query("layer_round_trip", O.with_base(select="SELECT * FROM mt"))
def layer_round_trip(spark, sf):
    at = f"{bronze(spark, sf)}/lake-{uuid.uuid4().hex[:8]}"
    layers.save(D.matches(spark, sf), at, "silver", "matches", ["match_id"])
    return layers.load(spark, at, "silver", "matches")


@query("declared_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", TRUE AS present, (SELECT COUNT(*) FROM events) AS rows" for c in S.DERIVED_COLUMNS))
def declared_columns(spark, sf):
    gold = E.require_derived(lake.gold_events(spark, sf))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in gold.columns).alias("present")) for c in S.DERIVED_COLUMNS])
    return gold.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(rows).alias("r"), "rows").select("r.*", "rows")


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|1')), o_orderkey LIMIT 400")
def seeded_sample(spark, sf):
    return M.seeded_sample(spark.read.parquet(f"{sf}/orders.parquet"), 400, ["o_orderkey"], seed=1).select("o_orderkey")
