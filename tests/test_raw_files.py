"""Raw files written from the driver's tables."""
from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import raw_queries as Q


def test_a_match_has_few_files_however_many_tasks_write(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 10).alias("m"), "id").repartition(40)
    Q._files(rows, "m", f"file://{tmp_path}", "_x.csv", lambda w, at: w.option("header", True).csv(at))
    files = sorted(tmp_path.glob("matches/*/*_x.csv"))
    assert len(files) == 10 and {f.parent.name for f in files} == {str(m) for m in range(10)}
    assert all(f.name.startswith(f.parent.name + "_") for f in files)
    assert sum(len(f.read_text().splitlines()) - 1 for f in files) == 4000


def test_only_the_files_of_a_question_are_written(spark):
    at = Q.bronze(spark, "/root/testdata/sf0.001", "phases")
    assert Q.bronze(spark, "/root/testdata/sf0.001", "phases") == at
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath().getName() for s in path(at).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{at}/matches/*/*"))]
    assert found and all(n.endswith(Q.raw.PHASES[1:]) for n in found)


def test_tracked_events_from_written_frames(spark):
    sf = "/root/testdata/sf0.001"
    direct, written = (sorted(map(tuple, df.collect())) for df in (D.tracked_events(spark, sf).select("event_id", F.coalesce("x_start", F.lit(-999.0)), F.coalesce("y_start", F.lit(-999.0))),
                                                                  lake.tracked_events(spark, sf).select("event_id", F.coalesce("x_start", F.lit(-999.0)), F.coalesce("y_start", F.lit(-999.0)))))
    assert direct == written and any(x != -999.0 for _, x, _ in direct)
    assert "lineitem" not in D.tracked_events(spark, sf, lake.frames(spark, sf))._jdf.queryExecution().toString()


def test_frames_meet_in_the_shuffle_that_lays_them_out(spark):
    """Player and ball rows are shuffled once by match and stretch and not again for the join or the files; the rows are those of a full join."""
    import re
    sf = "/root/testdata/sf0.001"
    df = D.frames(spark, sf)
    got = sorted(map(repr, df.select("match_id", "frame", "ball_x", "ball_y", "possession_group", "players").collect()))
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(match_id#\d+L?, (?:frame|__stretch)#", text)) == 1, text
    squads = D.positions(spark, sf).groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(F.struct("player_id", "x", "y", "is_detected"))).alias("players"))
    want = D.ball(spark, sf).join(squads, ["match_id", "frame"], "full").select("match_id", "frame", "ball_x", "ball_y", "possession_group", "players")
    assert got == sorted(map(repr, want.collect()))


def test_a_question_by_itself_needs_no_gold(spark):
    """Candidates of a question by itself come from events (and chains), not from the whole gold table."""
    from checks import tracking_queries
    sf, before = "/root/testdata/sf0.001", dict(lake._written)
    lake._written.clear()
    try:
        for q in (68, 59):
            tracking_queries.tracked(spark, sf, q).collect()
        assert not {name for _, _, name in lake._written} & {"events_enriched", "goals"}
    finally:
        lake._written.update(before)


def test_large_kinds_are_written_compressed_from_slim_rows(spark):
    """Events and frames take the most room, as raw files and in the shuffle before them; the rows read back are those written."""
    sf = "/root/testdata/sf0.001"
    at = Q.bronze(spark, sf, "events", "tracking")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind in (Q.raw.EVENTS, Q.raw.TRACKING):
        found = list(fs.globStatus(path(f"{at}/matches/*/{kind}*")))
        plain = sum(len(r["value"]) for r in spark.read.text([s.getPath().toString() for s in found]).collect())
        assert found and all(s.getPath().getName().endswith(kind[1:] + ".gz") for s in found)
        assert sum(s.getLen() for s in found) * 3 < plain
    dealt = D.events(spark, sf, dealt=True)
    plan = dealt._jdf.queryExecution().optimizedPlan()
    while "Rebalance" not in plan.nodeName():
        plan = plan.children().head()
    assert {plan.output().apply(i).name() for i in range(plan.output().size())} == {"event_id", "t", "user_id", "etype", "k", "__m"}
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, D.events(spark, sf).collect()))
    columns = ["event_id", "match_id", "x_start", "carry", "end_type", "_pk"]
    got = Q.raw.read_events(spark, at).select(F.col("event_id").cast("bigint").alias("event_id"), *columns[1:])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, D.events(spark, sf).select(columns).collect()))
    frames = ["match_id", "frame", "ball_x", "ball_y", "possession_group", "players"]
    order = F.transform("players", lambda p: F.struct(*[p[c].alias(c) for c in ("player_id", "x", "y", "is_detected")])).alias("players")
    assert sorted(map(repr, Q.raw.read_tracking(spark, at).select(*frames[:-1], order).collect())) == sorted(map(repr, D.frames(spark, sf).select(frames).collect()))


def test_a_long_file_is_cut(spark, tmp_path):
    """One task unpacks a compressed file, so that a hot match needs several."""
    rows = spark.range(1000).select(F.lit(7).alias("m"), "id")
    Q._files(rows, "m", f"file://{tmp_path}", "_x.csv.gz", lambda w, at: w.options(**Q.PACKED | {"maxRecordsPerFile": 300}).option("header", True).csv(at), dealt=True)
    files = sorted(tmp_path.glob("matches/7/7_*_x.csv.gz"))
    assert len(files) >= 4 and spark.read.csv([str(f) for f in files], header=True).count() == 1000
    assert Q.PACKED["maxRecordsPerFile"] > 0


def test_wide_rows_are_written_with_compiled_methods(spark, bronze, tmp_path, monkeypatch):
    from touchline.plans import lake as L
    from touchline.session import COMPILED_METHOD
    from touchline.sources import layers
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, write = spark.conf.get(name), layers.write
    Q._files(spark.range(5).select(F.lit(7).alias("m"), "id"), "m", f"file://{tmp_path}", "_x.csv", lambda w, at: (seen.append(spark.conf.get(name)), w.csv(at)))
    monkeypatch.setattr(layers, "write", lambda df, *a, **k: (seen.append(spark.conf.get(name)), write(df, *a, **k)))
    L.build_silver(spark, bronze, str(tmp_path / "lake"), check_only=True)
    assert len(seen) > 4 and {int(v) for v in seen} == {COMPILED_METHOD} and spark.conf.get(name) == before
