"""Raw files to silver and gold on the fixture matches, and one broken copy per gate."""

import pytest
from pyspark.sql import functions as F

import fixture_match as X
from touchline import schema as S
from touchline.plans import enrich as E
from touchline.plans import lake as L
from touchline.plans import questions as Q
from touchline.plans import tracking as T
from touchline.sources import gates, layers, raw
from touchline.sources.conform import conform, profile_text


def gold(spark, lake):
    return layers.load(spark, lake, "gold", "events_enriched")


def test_events_are_typed_across_two_headers(spark, lake):
    ev = layers.load(spark, lake, "silver", "events")
    assert ev.count() == sum(len(X.make_events(m)) for m in X.PITCH)
    assert dict(ev.dtypes)["carry"] == "boolean" and dict(ev.dtypes)["tag"] == "boolean" and dict(ev.dtypes)["extra_note"] == "string"
    assert ev.where("match_id = 101 and carry is not null").count() == 0 and ev.where("match_id = 102 and carry").count() > 0
    assert ev.where("extra_note like '%, free text'").count() == len(X.make_events(102))
    assert ev.where("_pk <> concat(match_id, '_', phase_index)").count() == 0


def test_matches_and_players(spark, lake):
    m = {r["match_id"]: r for r in layers.load(spark, lake, "silver", "matches").collect()}
    assert (m[101]["pitch_length"], m[101]["period_2_start"], m[101]["stadium"]) == (104.0, X.HALF + 1, "S")
    p = {r["player_id"]: r for r in layers.load(spark, lake, "silver", "players").collect()}
    assert len(p) == 2 * 26                                              # the player without any interval is left out
    sub = p[X.player_id(101, 0, 11)]
    assert sub["roster_position"] == "SUB" and sub["position"] == "CF" and sub["is_substitute"] and not sub["is_starter"]
    assert p[X.player_id(101, 0, 3)]["interval_source"] == "sequences" and p[X.player_id(102, 0, 3)]["interval_source"] == "total"
    assert p[X.player_id(102, 1, 3)]["is_starter"]


def test_phases_take_the_match_from_the_file_name(spark, lake):
    ph = layers.load(spark, lake, "silver", "phases")
    assert {r["match_id"]: r["count"] for r in ph.groupBy("match_id").count().collect()} == {101: 40, 102: 40}
    sh = layers.load(spark, lake, "gold", "phase_shape")
    assert sh.where("defending_team_id = team_in_possession_id or defending_team_id is null").count() == 0
    assert Q.FILTERS and sh.where("out_of_possession_width_z is not null").count() > 0


def test_goals_agree_with_the_official_score(spark, lake):
    g = layers.load(spark, lake, "gold", "goals")
    assert E.goals_vs_official(g, layers.load(spark, lake, "silver", "matches")).where("not ok").count() == 0
    src = {(r["match_id"], r["frame_source"]) for r in g.collect()}
    assert src == {(101, "goal_marker"), (102, "goal_marker")}
    assert g.where(f"scoring_team_id in ({X.teams(101)[1]}, {X.teams(102)[1]})").count() == 0      # the decoy marker scores for nobody


def test_gold_has_every_declared_column(spark, lake):
    ev = gold(spark, lake)
    assert set(S.DERIVED_COLUMNS) <= set(ev.columns)
    with pytest.raises(RuntimeError):
        E.require_derived(ev.drop("chain_reached_box"))
    assert ev.count() == layers.load(spark, lake, "silver", "events").count()


def test_chains_against_a_plain_restatement(spark, lake):
    got = {(r["match_id"], r["event_id"]): r["team_possession_id"] for r in gold(spark, lake).collect()}
    for m in X.PITCH:
        n, ids = 0, {}
        rows = X.make_events(m)
        for r in sorted((r for r in rows if r["event_type"] == S.PP), key=lambda r: (r["frame_start"], r["event_id"])):
            n += r.get("first_player_possession_in_team_possession") == "True"
            ids[r["event_id"]] = f"{m}_tp{n}"
        for r in rows:
            want = ids.get(r["event_id"] if r["event_type"] == S.PP else r.get("associated_player_possession_event_id"))
            assert got[(m, r["event_id"])] == want
    chains = layers.load(spark, lake, "gold", "possession_chains")
    sizes = gold(spark, lake).where("team_possession_id is not null").groupBy("team_possession_id").count()
    assert chains.join(sizes, "team_possession_id").where("n_events <> count").count() == 0


def test_units_count_both_players_at_a_substitution(spark, lake):
    sizes = E.unit_sizes(layers.load(spark, lake, "silver", "players"), 100)
    at = {(r["team_id"], r["boundary"]): r for r in sizes.where("match_id = 101").collect()}
    home = X.teams(101)[0]
    assert at[(home, 1)]["team_front_line_size"] == 1 and at[(home, 600)]["team_front_line_size"] == 2
    assert at[(home, 1)]["team_back_line_size"] == 4 and at[(home, 1)]["team_pivot_size"] == 1


def test_captains_and_roster(spark, lake):
    ev = gold(spark, lake)
    assert {r["player_id"] for r in ev.where("is_captain").select("player_id").distinct().collect()} == {X.player_id(101, 0, 2)}
    assert ev.where("is_starting_cb_pair and player_position not in ('CB','LCB','RCB')").count() == 0
    assert ev.where(f"player_id = {X.player_id(102, 1, 4)} and number <> 5").count() == 0
    empty, _ = E.enrich(layers.load(spark, lake, "silver", "events"), layers.load(spark, lake, "silver", "matches"),
                        layers.load(spark, lake, "silver", "players"), None, parts=["captains"])
    assert empty.where("is_captain").count() == 0


def test_zone_flags_scale_with_the_pitch(spark):
    half = F.col("l") / 2
    df = spark.createDataFrame([(-35.6, 0.0, 104.0), (-35.6, 0.0, 106.0), (36.0, 20.16, 105.0), (50.0, 9.17, 105.0), (None, 0.0, 105.0)], "x double, y double, l double")
    rows = df.select(*E.zone_flags("x", "y", half, "start")).collect()
    assert [r["own_penalty_area_start"] for r in rows] == [True, False, False, False, False]
    assert [r["opp_penalty_area_start"] for r in rows] == [False, False, False, True, False]      # the edge itself is outside
    assert not rows[3]["opp_six_yard_box_start"] and rows[4]["own_six_yard_box_start"] is False


def test_signs_and_frames(spark, lake):
    signs = layers.load(spark, lake, "silver", "mirror_signs").collect()
    assert len(signs) == 8 and all(r["confidence"] == 1.0 for r in signs)
    for r in signs:
        side = X.teams(r["match_id"]).index(r["team_id"])
        assert r["sign"] == X.sign(side, 1 if r["period"] == 1 else X.HALF + 1)
    frames = layers.load(spark, lake, "silver", "frames")
    assert frames.count() == 2 * 2 * X.HALF
    usable = sum(X.tracked(f) for f in range(1, 2 * X.HALF + 1))
    assert frames.where(T.usable()).count() == 2 * usable
    assert raw.player_frames(frames).where("match_id = 101 and frame = 100").count() == 22


def test_sign_contradictions_are_found(spark):
    bad = spark.createDataFrame([(1, 10, 1, 1, 1.0), (1, 11, 1, 1, 1.0), (1, 10, 2, 1, 1.0), (1, 11, 2, -1, 0.6)],
                                "match_id long, team_id long, period int, sign int, confidence double")
    kinds = {r["problem"] for r in T.sign_problems(bad).collect()}
    assert kinds == {"low_confidence", "teams_agree", "no_flip"}
    with pytest.raises(T.UnresolvedSigns):
        T.require_signs(bad)


def test_inventory_and_staleness(spark, bronze, tmp_path):
    inv = raw.tracking_inventory(spark, bronze)
    assert {r["match_id"]: (r["n_frames"], r["status"]) for r in inv.collect()} == {m: (2 * X.HALF, "ok") for m in X.PITCH}
    assert raw.stale_matches(inv, inv).count() == 0
    assert raw.stale_matches(inv, inv.withColumn("source_bytes", F.col("source_bytes") + 1)).count() == 2
    stub = tmp_path / "matches" / "7"
    stub.mkdir(parents=True)
    (stub / "7_tracking_extrapolated.jsonl").write_text("version https://git-lfs\noid sha256:1\nsize 5\n")
    assert raw.tracking_inventory(spark, str(tmp_path)).first()["status"] == "lfs_stub"
    assert raw.read_tracking(spark, str(tmp_path)).count() == 0


def test_a_match_with_several_tracking_files_is_one_match(spark, tmp_path):
    for m, n in ((7, 1), (7, 2), (8, 3)):
        folder = tmp_path / "matches" / str(m)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{m}_{n}_tracking_extrapolated.jsonl").write_text('{"frame": 5, "period": 1, "player_data": []}\n' * n)
    matches = spark.createDataFrame([(7, 0, 0), (8, 0, 0)], "match_id long, home_team_score long, away_team_score long")
    players = spark.createDataFrame([], "match_id long, goals long")
    notes = {r["gate"]: r["n_bad"] for r in gates.note_gates(matches, players, raw.tracking_inventory(spark, str(tmp_path))).collect()}
    assert (notes["frames_indexed"], notes["matches_indexed"], notes["tracking_stubs"]) == (6, 2, 0)


def test_check_mode_writes_nothing(spark, bronze, tmp_path):
    found = L.build_silver(spark, bronze, str(tmp_path / "lake"), check_only=True)
    assert found.where("severity = 'fail' and n_bad > 0").count() == 0 and not (tmp_path / "lake").exists()


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(layers.MissingTable, match="build_gold"):
        layers.load(spark, str(tmp_path), "gold", "goals")
    with pytest.raises(raw.MissingSource):
        raw.read_events(spark, str(tmp_path))
    assert raw.read_phases(spark, str(tmp_path)) is None and raw.read_captains(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("gate,change", [
    ("duplicate_keys", lambda e: e.unionByName(e.limit(1))),
    ("frame_order", lambda e: e.withColumn("frame_end", F.when(F.col("index") == 5, F.col("frame_start") - 1).otherwise(F.col("frame_end")))),
    ("null_team_id", lambda e: e.withColumn("team_id", F.when(F.col("index") != 5, F.col("team_id")))),
    ("team_not_in_match", lambda e: e.withColumn("team_id", F.when(F.col("index") == 5, F.lit(1)).otherwise(F.col("team_id")))),
    ("match_coverage", lambda e: e.where("match_id = 101")),
    ("missing_event_type", lambda e: e.drop("event_type"))])
def test_each_gate_fails_on_its_own_fault(spark, lake, gate, change):
    ev, m = layers.load(spark, lake, "silver", "events"), layers.load(spark, lake, "silver", "matches")
    assert gates.event_gates(ev, m).where("n_bad > 0").count() == 0
    found = gates.event_gates(change(ev), m)
    assert {r["gate"] for r in found.where("n_bad > 0").collect()} == {gate}
    with pytest.raises(gates.GateError, match=gate):
        gates.require(found)


def test_conform(spark):
    df = spark.createDataFrame([("True", "True", None, "x", "2.0", "1.5", "2"), (None, "no", None, "y", "3", None, "x"), ("False", "True", None, "z", None, "2", "3")],
                               "a string, b string, c string, d string, e string, f string, g string")
    assert profile_text(df) == {"a": "boolean", "b": "text", "c": "empty", "d": "text", "e": "long", "f": "double", "g": "text"}
    done = conform(df)
    assert [t for _, t in done.dtypes] == ["boolean", "string", "string", "string", "bigint", "double", "string"]
    assert done.where("e = 2").count() == 1 and [r["f"] for r in done.collect()] == [1.5, None, 2.0]


def test_short_tracking_file_is_read_and_headerless_csv_raises(spark, tmp_path):
    folder = tmp_path / "matches" / "7"
    folder.mkdir(parents=True)
    (folder / "7_tracking_extrapolated.jsonl").write_text('{"frame": 5, "period": 1, "player_data": []}\n')
    assert raw.read_tracking(spark, str(tmp_path)).count() == 1
    assert raw.tracking_inventory(spark, str(tmp_path)).first()["status"] == "ok"
    (folder / "7_dynamic_events.csv").write_text('"event_id",match_id,event_type\n1,7,player_possession\n')
    assert raw.read_events(spark, str(tmp_path)).count() == 1
    (folder / "8_dynamic_events.csv").write_text("1,7,player_possession\n")
    with pytest.raises(raw.MissingHeader):
        raw.read_events(spark, str(tmp_path))


def test_question_report_runs_in_one_scan(spark, lake):
    ev = gold(spark, lake)
    report = {r["qid"]: r for r in Q.run_event_questions(ev).collect()}
    assert set(report) == set(Q.FILTERS) | set(Q.ABSENCES) | {54}
    with pytest.raises(ValueError):
        Q.run_filters(ev.drop("chain_reached_box"))
    for q in (12, 24, 31, 41, 60, 65, 69, 74):
        rows = Q.answer(q, ev)
        assert report[q]["hits"] == rows.count() and report[q]["matches"] == rows.select("match_id").distinct().count()
    assert [r["qid"] for r in Q.refusals(spark).orderBy("qid").collect()] == [5, 27, 78]


def scans_of(spark, since, part):
    """How often plans executed since then read files whose path holds ``part``."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    text = [runs.apply(i).physicalPlanDescription() for i in range(since, runs.size())]
    return [line for t in text for line in t.splitlines() if line.startswith("Location") and part in line]


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsList().size()


def test_each_kind_of_raw_file_is_read_once(spark, bronze, tmp_path):
    before = executions(spark)
    L.build_silver(spark, bronze, str(tmp_path / "lake"))
    for kind in (raw.EVENTS, raw.PHASES, raw.MATCH, raw.TRACKING):
        assert len(scans_of(spark, before, kind[1:])) == 1, (kind, scans_of(spark, before, "matches"))


def test_a_failed_gate_publishes_nothing(spark, bronze, tmp_path):
    import shutil
    lake = str(tmp_path / "lake")
    L.build_silver(spark, bronze, lake)
    n = layers.load(spark, lake, "silver", "events").count()
    where = layers.published(spark, lake, "silver")
    broken = tmp_path / "bronze"
    shutil.copytree(bronze, broken)
    file = sorted(broken.glob(f"matches/*/{raw.EVENTS}"))[0]
    head, first, *rest = file.read_text().splitlines()
    file.write_text("\n".join([head, first, first, *rest]) + "\n")
    with pytest.raises(gates.GateError, match="duplicate_keys: 1"):
        L.build_silver(spark, str(broken), lake)
    with pytest.raises(gates.GateError):
        L.build_silver(spark, str(broken), str(tmp_path / "new"))
    assert not (tmp_path / "new").exists() and layers.published(spark, lake, "silver") == where
    assert layers.load(spark, lake, "silver", "events").count() == n
    L.build_silver(spark, bronze, lake)
    assert layers.published(spark, lake, "silver") != where and layers.load(spark, lake, "silver", "events").count() == n


def test_lines_meet_their_own_header(spark, tmp_path):
    texts = {"1": '﻿event_id,match_id,note\n1,1,"a, ""b"""\n\n2,1,\n', "2": "note,event_id\nx,7\n", "3": '"event_id" , extra,match_id\n5,event_id,9\n6\n'}
    for m, t in texts.items():
        (tmp_path / f"{m}_x.csv").write_text(t)
    got = raw.parse_by_header(raw.read_lines(spark, str(tmp_path / "*_x.csv")), "event_id")
    rows = {r["event_id"]: (r["match_id"], r["note"], r["extra"], r["__file_match"]) for r in got.collect()}
    assert rows == {"1": ("1", 'a, "b"', None, 1), "2": ("1", None, None, 1), "7": (None, "x", None, 2), "5": ("9", None, "event_id", 3), "6": (None, None, None, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    (tmp_path / "4_x.csv").write_text("1,2\n")
    with pytest.raises(raw.MissingHeader, match="1 files .*4_x.csv"):
        raw.parse_by_header(raw.read_lines(spark, str(tmp_path / "*_x.csv")), "event_id")


def test_captains_line_by_line_or_whole(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"1": {"10": 100}}\n{"2": {"20": 200, "21": 201}}\n')
    (tmp_path / "whole.json").write_text('{\n "1": {"10": 100},\n "2": {"20": 200, "21": 201}\n}\n')
    lines, whole = raw.read_captains(spark, str(tmp_path / "lines.json")), raw.read_captains(spark, str(tmp_path / "whole.json"), whole=True)
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, whole.collect())) == [(1, 10, 100), (2, 20, 200), (2, 21, 201)]


def test_compressed_files_are_read_like_plain_ones(spark, bronze, tmp_path):
    import gzip
    import shutil
    packed = tmp_path / "bronze"
    shutil.copytree(bronze, packed)
    for file in sorted(packed.glob("matches/101/*")):
        (file.parent / f"{file.name}.gz").write_bytes(gzip.compress(file.read_bytes()))
        file.rename(tmp_path / file.name)
    read = lambda at: [sorted(map(repr, df.collect())) for df in (raw.read_events(spark, at).drop("extra_note"), raw.read_phases(spark, at), raw.matches_table(raw.read_match_files(spark, at)), raw.read_tracking(spark, at))]
    assert read(str(packed)) == read(bronze)
    got, want = (sorted(map(tuple, L.build_silver(spark, str(at), str(tmp_path / "lake"), check_only=True).collect())) for at in (packed, bronze))
    assert got == want


def test_check_mode_reads_each_file_once_and_stages_no_frames(spark, bronze, tmp_path, monkeypatch):
    import shutil
    own = tmp_path / "own"
    shutil.copytree(bronze, own)
    monkeypatch.setattr(L, "shared_folder", lambda spark: str(tmp_path / "shared"))
    found = {r["gate"]: r["n_bad"] for r in L.build_silver(spark, str(own), str(tmp_path / "lake"), check_only=True).collect()}
    assert (found["frames_indexed"], found["matches_indexed"], found["tracking_stubs"]) == (4 * X.HALF, 2, 0)
    staged = {p.name for p in (tmp_path / "shared").glob("silver-*/*")}
    assert staged == {"event_lines", "events", "match_files", "tracking_inventory", "gates"}
    assert all(".zstd." in p.name for p in (tmp_path / "shared").glob("silver-*/*/part-*"))
    for kind in (raw.EVENTS, raw.MATCH, raw.TRACKING):
        assert len([line for line in scans_of(spark, 0, str(own)) if kind[1:] in line]) == 1, kind
