"""Readers of the raw match files: event and phase CSVs, match JSON, tracking JSON lines, captain list."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schema as S
from touchline.plans.enrich import modal_position

EVENTS, PHASES, MATCH, TRACKING = "*_dynamic_events.csv", "*_phases_of_play.csv", "*_match.json", "*_tracking_extrapolated.jsonl"
#: Ending of a compressed raw file.
PACKED = ".gz"


class MissingSource(FileNotFoundError):
    """No raw file of a kind under the bronze folder."""


class MissingHeader(ValueError):
    """A raw file without the header line of its kind."""


def match_id_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_", 1).try_cast("bigint")


def _pattern(bronze: str, kind: str) -> str:
    """The files of a kind, plain or compressed; Spark unpacks by the ending."""
    return f"{bronze}/matches/*/{kind}{{,{PACKED}}}"


def _has_files(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _number(c: Column) -> Column:
    """Whole numbers, also when written with a fraction of zero."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def typed(df: DataFrame, kinds: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Cast the declared columns; a value that does not convert becomes null, a missing column is added."""
    casts = {}
    for kind, names in kinds.items():
        for n in names:
            if n not in df.columns:
                casts[n] = F.lit(None).cast("bigint" if kind == "long" else kind)
            elif kind == "long":
                casts[n] = _number(F.col(n))
            elif kind != "string":
                casts[n] = F.col(n).try_cast(kind)
    return df.withColumns(casts)


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """path, file_match and value of every line of the files of a pattern."""
    if not _has_files(spark, pattern):
        raise MissingSource(f"no files match {pattern}")
    return spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), match_id_of_file().alias("file_match"), "value")


def _names(line: str | Column):
    """The column names of a header line."""
    if isinstance(line, str):
        return [c.strip().strip('"') for c in line.lstrip("\ufeff").split(",")]
    return F.transform(F.split(F.regexp_replace(line, "^\ufeff", ""), ","), lambda c: F.btrim(F.btrim(c), F.lit('"')))


def parse_by_header(lines: DataFrame, marker: str) -> DataFrame:
    """CSV lines of many files as text columns, joined by column name; ``__file_match`` is the match in the file's name.

    Each file's header (the line with column ``marker``) is found where its lines are, and only the
    different headers reach the driver, with a count of files without one.  Lines meet the number of their file's
    header by a join on the path if there are several, and every line is parsed once, by its own header;
    columns missing from a header are null.
    """
    # only a line that holds the marker's text is taken apart
    is_header = F.col("value").contains(marker) & F.array_contains(_names(F.col("value")), marker)
    per_file = lines.groupBy("path").agg(F.min(F.when(is_header, F.col("value"))).alias("header"))
    headers = per_file.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one")).collect()
    lost = [h for h in headers if h["header"] is None]
    if lost:
        raise MissingHeader(f"{lost[0]['n']} files have no header with column {marker!r}, for example {lost[0]['one']}")
    if not headers:
        raise MissingSource(f"no line of a file with column {marker!r}")
    known = sorted(h["header"] for h in headers)
    if len(known) == 1:
        told = lines.withColumn("version", F.lit(0))
    else:
        version = F.array_position(F.array(*[F.lit(h) for h in known]), F.col("header")).cast("int") - 1
        told = lines.join(per_file.select("path", version.alias("version")), "path")
    body = told.where((F.btrim("value") != "") & (F.col("value") != F.get(F.array(*[F.lit(h) for h in known]), F.col("version"))))
    shapes = [T.StructType([T.StructField(c, T.StringType()) for c in _names(h)]) for h in known]
    parsed = body.select("file_match", "version", *[F.when(F.col("version") == i, F.from_csv("value", _ddl(shape), {"escape": '"'})).alias(f"v{i}") for i, shape in enumerate(shapes)])
    columns = list(dict.fromkeys(c for shape in shapes for c in shape.names))
    pick = {c: F.coalesce(*[F.col(f"v{i}")[c] for i, shape in enumerate(shapes) if c in shape.names]) for c in columns}
    return parsed.select(*[e.alias(c) for c, e in pick.items()], F.col("file_match").alias("__file_match"))


def _ddl(shape: T.StructType) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in shape.names)


def event_lines(spark: SparkSession, bronze: str) -> DataFrame:
    return read_lines(spark, _pattern(bronze, EVENTS))


def parse_events(lines: DataFrame) -> DataFrame:
    """One row per event, typed, with the phase key ``_pk``."""
    out = typed(parse_by_header(lines, "event_id").drop("__file_match"), S.EVENT_COLUMN_TYPES)
    return out.withColumn("_pk", F.concat(F.col("match_id").cast("string"), F.lit("_"), F.col("phase_index").cast("string")))


def read_events(spark: SparkSession, bronze: str) -> DataFrame:
    return parse_events(event_lines(spark, bronze))


def phase_lines(spark: SparkSession, bronze: str) -> DataFrame | None:
    """None without files."""
    pattern = _pattern(bronze, PHASES)
    return read_lines(spark, pattern) if _has_files(spark, pattern) else None


def parse_phases(lines: DataFrame) -> DataFrame:
    """One row per phase; the match id comes from the file name where the column is absent."""
    out = typed(parse_by_header(lines, "team_in_possession_phase_type"), S.PHASE_COLUMN_TYPES)
    return out.withColumn("match_id", F.coalesce("match_id", "__file_match")).drop("__file_match")


def read_phases(spark: SparkSession, bronze: str) -> DataFrame | None:
    lines = phase_lines(spark, bronze)
    return None if lines is None else parse_phases(lines)


def read_match_files(spark: SparkSession, bronze: str) -> DataFrame:
    pattern = _pattern(bronze, MATCH)
    if not _has_files(spark, pattern):
        raise MissingSource(f"no files match {pattern}")
    return spark.read.json(pattern, schema=S.MATCH_JSON, multiLine=True)


def matches_table(files: DataFrame) -> DataFrame:
    def period(n: int) -> Column:
        return F.try_element_at(F.filter("match_periods", lambda p: p["period"] == n), F.lit(1))

    return files.select(
        F.col("id").alias("match_id"), F.col("home_team.id").alias("home_team_id"), F.col("away_team.id").alias("away_team_id"),
        F.col("home_team.short_name").alias("home_team_name"), F.col("away_team.short_name").alias("away_team_name"),
        "home_team_score", "away_team_score", "pitch_length", "pitch_width",
        period(1)["start_frame"].alias("period_1_start"), period(1)["end_frame"].alias("period_1_end"),
        period(2)["start_frame"].alias("period_2_start"), period(2)["end_frame"].alias("period_2_end"),
        "date_time", F.try_to_timestamp("date_time").alias("kickoff_at"), F.col("stadium.name").alias("stadium"))


def players_table(files: DataFrame, events: DataFrame) -> DataFrame:
    """Roster with on-pitch intervals and the modal observed position.

    Intervals come from the sequences, else from the total, else the player is left out.
    """
    rows = files.select(
        F.col("id").alias("match_id"), F.try_element_at("match_periods", F.lit(1))["start_frame"].alias("kickoff"), F.explode("players").alias("p"))
    sequences, total = F.col("p.playing_time.sequences"), F.col("p.playing_time.total")
    listed = F.coalesce(F.size(sequences) > 0, F.lit(False))
    intervals = F.when(listed, sequences).when(total["start_frame"].isNotNull(), F.array(total))
    flat = rows.select(
        "match_id", F.col("p.id").alias("player_id"), F.col("p.team_id").alias("team_id"), F.col("p.number").alias("number"),
        F.col("p.short_name").alias("short_name"), F.col("p.player_role.acronym").alias("roster_position"),
        (F.array_min(F.transform(intervals, lambda s: s["start_frame"])) <= F.col("kickoff") + 1).alias("is_starter"),
        (F.col("p.start_time").isNotNull() & (F.col("p.start_time") != "00:00:00")).alias("is_substitute"),
        F.coalesce("p.goal", F.lit(0)).alias("goals"), F.coalesce("p.own_goal", F.lit(0)).alias("own_goals"),
        intervals.alias("on_pitch_intervals"), F.when(listed, "sequences").otherwise("total").alias("interval_source")
    ).where(F.col("on_pitch_intervals").isNotNull())
    seen = modal_position(events).drop("n")
    return flat.join(seen, ["match_id", "player_id"], "left").withColumn(
        "position", F.coalesce("player_position", "roster_position")).drop("player_position")


def tracking_lines(spark: SparkSession, bronze: str) -> DataFrame | None:
    """Every line of the tracking files, parsed once: its file's match, size and time, whether it is a pointer's, and the frame.  None without files."""
    pattern = _pattern(bronze, TRACKING)
    if not _has_files(spark, pattern):
        return None
    at = F.from_json("value", S.TRACKING_JSON)
    lines = spark.read.text(pattern).select(
        match_id_of_file().alias("match_id"), F.col("_metadata.file_size").alias("source_bytes"), F.col("_metadata.file_modification_time").alias("source_mtime"),
        F.startswith("value", F.lit(S.POINTER_LINE)).alias("pointer"), at.alias("r"))
    return lines.select("match_id", "source_bytes", "source_mtime", "pointer", "r.*")


def frames_of(lines: DataFrame) -> DataFrame:
    """Nested frames; a frame without players stays, as unusable."""
    return lines.where(F.col("frame").isNotNull()).select(
        "match_id", "frame", "timestamp", "period", F.col("ball_data.x").alias("ball_x"), F.col("ball_data.y").alias("ball_y"),
        F.col("possession.group").alias("possession_group"),
        F.transform("player_data", lambda p: F.struct(
            p["player_id"].alias("player_id"), p["x"].alias("x"), p["y"].alias("y"), p["is_detected"].alias("is_detected"))).alias("players"))


def read_tracking(spark: SparkSession, bronze: str) -> DataFrame | None:
    lines = tracking_lines(spark, bronze)
    return None if lines is None else frames_of(lines)


def player_frames(frames: DataFrame) -> DataFrame:
    """One row per tracked player and frame, for work that needs whole series."""
    return frames.select("match_id", "frame", "period", F.explode("players").alias("p")).select("match_id", "frame", "period", "p.*")


def inventory_of(lines: DataFrame) -> DataFrame:
    """match_id, n_frames, status (ok or lfs_stub) and a size/time fingerprint per tracking file."""
    stub = F.col("pointers") > 0
    return lines.groupBy("match_id", "source_bytes", "source_mtime").agg(F.count(F.lit(1)).alias("n"), F.count_if("pointer").alias("pointers")).select(
        "match_id", F.when(stub, 0).otherwise(F.col("n")).alias("n_frames"), F.when(stub, "lfs_stub").otherwise("ok").alias("status"), "source_bytes", "source_mtime")


def tracking_inventory(spark: SparkSession, bronze: str) -> DataFrame | None:
    lines = tracking_lines(spark, bronze)
    return None if lines is None else inventory_of(lines)


def stale_matches(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Matches whose tracking file changed size since it was recorded."""
    now = current.select("match_id", F.col("source_bytes").alias("actual_bytes"))
    return recorded.join(now, "match_id").where(F.col("source_bytes") != F.col("actual_bytes")).select("match_id", "source_bytes", "actual_bytes")


def read_captains(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(match_id, team_id, player_id) from objects ``{match: {team: player}}``, one per line; empty when there is no file.

    ``whole`` reads files that spread one object over several lines; each file is then one value.
    """
    shape = "match_id bigint, team_id bigint, player_id bigint"
    if not _has_files(spark, path):
        return spark.createDataFrame([], shape)
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))
    text = spark.read.text(path, wholetext=whole).select(F.from_json("value", kind).alias("m"))
    teams = text.select(F.explode("m").alias("match_id", "teams")).select("match_id", F.explode("teams").alias("team_id", "player_id"))
    return teams.select(F.col("match_id").cast("bigint"), F.col("team_id").cast("bigint"), "player_id")
