"""Filter specs, guardrails, concepts and the field catalog."""
import pytest

from touchline.functions import concepts as K
from touchline.functions import filters as X
from touchline.plans import catalog as C

ROWS = [
    ("1", "m1", "player_possession", "Long", True, 9.0, None), ("2", "m1", "player_possession", "short", False, 0.0, "x"),
    ("3", "m1", "player_possession", None, None, None, "12"), ("4", "m2", "off_ball_run", None, None, 3.0, "7"),
    ("5", "m2", "on_ball_engagement", None, None, None, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "event_id string, match_id string, event_type string, pass_range string, carry boolean, n double, text string")


def ids(df, *specs):
    return sorted(r["event_id"] for r in X.execute(df, [dict(column=c, op=o, value=v) for c, o, v in specs]).collect())


def test_ops(df):
    assert ids(df, ("pass_range", "eq", "LONG")) == ["1"]
    assert ids(df, ("pass_range", "ne", "long")) == ["2", "3", "4", "5"]            # ne keeps nulls
    assert ids(df, ("n", "eq", 0)) == ["2"] and ids(df, ("n", "eq", "9")) == ["1"]
    assert ids(df, ("n", "ne", 0)) == ["1", "3", "4", "5"]
    assert ids(df, ("n", "in", [0, 3])) == ["2", "4"]
    assert ids(df, ("carry", "eq", True)) == ["1"] and ids(df, ("carry", "in", ["false"])) == ["2"]
    assert ids(df, ("text", "gt", 8)) == ["3"] and ids(df, ("n", "lte", 3)) == ["2", "4"]      # text that is no number drops out
    assert ids(df, ("text", "notnull", None)) == ["2", "3", "4"]
    assert ids(df, ("nowhere", "eq", 1)) == []
    with pytest.raises(ValueError):
        ids(df, ("n", "like", 1))


def test_scope_last_event_type_wins(df):
    assert ids(df, ("event_type", "eq", "off_ball_run"), ("event_type", "in", ["on_ball_engagement"])) == ["5"]


def test_funnel_and_reasons(df):
    pp = dict(column="event_type", op="eq", value="player_possession")
    specs = [pp, dict(column="carry", op="eq", value=True), dict(column="pass_range", op="eq", value="short")]
    assert [(r["rows"], r["alone"]) for r in X.funnel(df, specs).orderBy("step").collect()] == [(3, 3), (1, 1), (0, 1)]
    r = X.explain_empty(df, specs).first()
    assert (r["step"], r["rows_before"], r["alone"], r["reason"]) == (2, 1, 1, "conflict")
    assert X.explain_empty(df, [pp, dict(column="pass_range", op="eq", value="huge")]).first()["reason"] == "impossible"
    assert X.explain_empty(df, [dict(column="event_type", op="eq", value="none")]).first()["reason"] == "no_scope_rows"
    assert X.explain_empty(df, [pp]).first()["reason"] is None


def test_guardrail(df):
    checks = C.FieldChecks.of(df)
    assert checks.problem("carry", "player_possession", "eq", True) is None
    assert checks.problem("carry", "off_ball_run") == "wrong_event_type"
    assert checks.problem("pass_range", "player_possession", "eq", "huge") == "value_never_seen"
    assert checks.problem("pass_range", "player_possession", "in", ["huge", "long"]) is None
    assert checks.problem("invented") == "unknown_column"
    with pytest.raises(C.FilterError):
        checks.validate("carry", "on_ball_engagement")


def test_vocabulary_drops_booleans_that_are_never_true(spark, df):
    v = {r["column"]: r for r in C.field_vocabulary(df, {"g": ("pass_range", "carry", "n", "absent")}).collect()}
    assert v["pass_range"]["kind"] == "enum" and v["pass_range"]["values"] == ["long", "short"]
    assert v["carry"]["kind"] == "bool" and v["n"]["kind"] == "numeric" and "absent" not in v
    none_true = df.where("event_id <> '1'")
    assert "carry" not in {r["column"] for r in C.field_vocabulary(none_true, {"g": ("pass_range", "carry")}).collect()}


def test_catalog_shares(df):
    r = {x["column"]: x for x in C.field_catalog(df).collect()}
    assert r["carry"]["player_possession"] == 66.7 and r["carry"]["passing_option"] == 0.0
    assert r["carry"]["single_type"] and r["carry"]["partial_matches"] and not r["event_id"]["single_type"]


def test_concepts(spark):
    text = [("captain (player role attribute)", "captain"), ("Offside call?", "offside_call"), ("offsides_ratio", None), ("a through-ball", "through_ball"),
            ("overload near the captain", "captain"), ("nothing", None), ("duel_won", "duel_won"), (None, None)]
    got = K.tag_concepts(spark.createDataFrame(text, "t string, want string"), "t").collect()
    assert all(r["concept"] == r["want"] for r in got)


def test_proxies(df):
    duel = [c for c in K.CONCEPTS if c.name == "duel_won"]

    class Fine:
        def problem(self, *a):
            return None

    class Bad:
        def problem(self, *a):
            return "no"

    out, shown, failed = K.apply_proxies([], duel, ["on_ball_engagement"], Fine())
    assert len(out) == 1 and shown == ["duel_won"] and not failed
    taken = [dict(column="pressing_chain_end_type", op="eq", value="disruption")]
    assert K.apply_proxies(taken, duel, [], Fine())[0] == taken
    out, shown, failed = K.apply_proxies([], duel, ["passing_option"], Bad())
    assert out == [] and shown == [] and failed == ["duel_won"]
