"""The driver contract."""
import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 120
    missing = {f"question_{q:02d}" for q in range(1, 81) if q not in (5, 27, 78)} - set(queries)
    assert not missing


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "team_possession_id" in df.columns


def test_no_plan_pairs_everything_with_everything(spark):
    for name in ("band_histogram", "distribution_summary", "chain_columns", "goal_timeline", "greedy_marker_collapse", "phase_shape", "result_set_verdict", "concept_tags"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_first_per_key_is_pruned_before_the_shuffle(spark):
    from touchline.plans.predicates import first_per
    df = spark.range(1000).selectExpr("id % 3 as k", "id as frame_start", "id as event_id")
    plan = first_per(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_share_by_condition_reads_every_status(spark, tmp_path):
    import __spark_entry__
    rows = [("O", 30.0, "R"), ("F", 10.0, "N"), ("P", 30.0, "R"), (None, 30.0, "N"), (None, None, "R")]
    spark.createDataFrame(rows, "l_linestatus string, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["l_linestatus"], r["condition"]): (r["share"], r["rows"]) for r in __spark_entry__.queries()["share_by_condition"](spark, str(tmp_path)).collect()}
    assert got == {("O", True): (1.0, 1), ("F", False): (0.0, 1), ("P", True): (1.0, 1), (None, True): (0.0, 1), (None, False): (1.0, 1)}
