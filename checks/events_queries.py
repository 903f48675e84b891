"""Queries over ``events`` read as match events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import oracle as O
from checks.registry import query
from touchline import schema as S
from touchline.operators.ordered import asof, greedy_collapse
from touchline.plans import enrich as E

#: Blocks of 50 frames on the 600-frame axis; of 12 hours on the fine axis.
BLOCK = 50
FINE_BLOCK = 432_000


def gold_events(spark: SparkSession, sf: str, parts) -> DataFrame:
    """Adapter events with the named derivations."""
    out, _ = E.enrich(D.events(spark, sf), D.matches(spark, sf), D.players(spark, sf), D.captains(spark, sf),
                      parts=parts, block=BLOCK)
    return out


def close_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Goal table with thresholds fit for the 600-frame axis, written once."""
    return lake.table(spark, sf, "goals_25_60", lambda: E.goal_timeline(
        D.events(spark, sf), D.matches(spark, sf), gap=25, lookback=60, block=BLOCK))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


CHAIN_COLS = ["team_possession_id", "match_id", "team_id", "frame_start", "frame_end", "n_events", "n_possessions",
              "reached_final_third", "reached_box", "ended_in_shot", "duration_s"]


@query("chain_rollup", O.with_base(O.CHAIN_IDS, select="""
SELECT c.team_possession_id, MIN(c.match_id) AS match_id,
  arg_min(c.team_id, c.frame_start * 100000000 + c.event_id) FILTER (WHERE c.event_type = 'player_possession') AS team_id,
  MIN(frame_start) AS frame_start, MAX(frame_end) AS frame_end, COUNT(*) AS n_events, COUNT(*) AS n_possessions,
  COALESCE(BOOL_OR(third_end = 'attacking_third'), FALSE) AS reached_final_third,
  COALESCE(BOOL_OR(penalty_area_end), FALSE) AS reached_box, COALESCE(BOOL_OR(end_type = 'shot'), FALSE) AS ended_in_shot,
  ROUND((MAX(frame_end) - MIN(frame_start)) / 10.0e0, 6) AS duration_s
FROM ec c WHERE c.team_possession_id IS NOT NULL GROUP BY c.team_possession_id"""))
def chain_rollup(spark, sf):
    chained = E.add_chain_id(D.events(spark, sf))
    return rounded(E.possession_chains(chained), "duration_s")


@query("chain_columns", O.with_base(*O.gold(["chains"]), select="""
SELECT event_id, team_possession_id, chain_n_possessions, chain_reached_final_third, chain_reached_box, chain_ended_in_shot,
  ROUND(chain_duration_s, 6) AS chain_duration_s FROM gd"""))
def chain_columns(spark, sf):
    g = gold_events(spark, sf, ["chains"])
    return rounded(g, "chain_duration_s").select(
        "event_id", "team_possession_id", "chain_n_possessions", "chain_reached_final_third", "chain_reached_box",
        "chain_ended_in_shot", "chain_duration_s")


@query("chain_numbers_fine", O.with_base(select="""
SELECT event_id, match_id, CAST(SUM(CASE WHEN first_player_possession_in_team_possession THEN 1 ELSE 0 END)
  OVER (PARTITION BY match_id ORDER BY frame_fine, event_id) AS BIGINT) AS chain
FROM ev WHERE event_type = 'player_possession'"""))
def chain_numbers_fine(spark, sf):
    pp = D.events(spark, sf).where(E.is_type(S.PP))
    return E.chain_numbers(pp, "match_id", "frame_fine", "event_id", F.col("first_player_possession_in_team_possession"),
                           FINE_BLOCK).select("event_id", "match_id", "chain")


@query("parent_propagation", """
WITH oc AS (SELECT o_orderkey, o_custkey % 50 AS entity, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
    OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS chain FROM orders)
SELECT oc.entity, oc.chain, COUNT(*) AS n_rows, ROUND(SUM(l_quantity), 2) AS quantity, CAST(COUNT(oc.o_orderkey) AS BIGINT) AS n_matched
FROM lineitem LEFT JOIN oc ON oc.o_orderkey = l_orderkey GROUP BY oc.entity, oc.chain""")
def parent_propagation(spark, sf):
    from touchline.operators.joins import left_lookup
    from touchline.operators.ordered import running_sum, tie_level
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("entity"), F.col("o_orderstatus"), "o_orderdate")
    month = F.floor(F.date_diff("o_orderdate", F.lit("1970-01-01").cast("date")) / 30)
    numbered = running_sum(orders, ["entity"], [month, F.col("o_orderdate"), tie_level(orders, "o_orderkey")], ["o_orderkey"],
                           {"chain": (F.col("o_orderstatus") == "F").cast("int")})
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    joined = left_lookup(lines, numbered.select(F.col("o_orderkey").alias("pk"), "entity", "chain", "o_orderkey"),
                         {"l_orderkey": "pk"}, F.col("l_linenumber"))
    return joined.groupBy("entity", "chain").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.count("o_orderkey").alias("n_matched"))


@query("goal_timeline", O.with_base(O.goals(25, 60), select="SELECT match_id, frame, period, scoring_team_id, frame_source FROM gl"))
def goal_timeline(spark, sf):
    return E.goal_timeline(D.events(spark, sf), D.matches(spark, sf), gap=25, lookback=60, block=BLOCK)


@query("goals_vs_official", O.with_base(O.goals(25, 60), select="""
SELECT match_id, concat(home_team_score, '-', away_team_score) AS official, concat(h, '-', a) AS derived,
  h = home_team_score AND a = away_team_score AS ok
FROM (SELECT mt.*, (SELECT COUNT(*) FROM gl WHERE gl.match_id = mt.match_id AND scoring_team_id = home_team_id) AS h,
  (SELECT COUNT(*) FROM gl WHERE gl.match_id = mt.match_id AND scoring_team_id = away_team_id) AS a FROM mt)"""))
def goals_vs_official(spark, sf):
    m = D.matches(spark, sf)
    return E.goals_vs_official(close_goals(spark, sf), m)


@query("counts_vs_official", """
SELECT o_orderkey, o_orderkey % 4 AS official, COUNT(l_orderkey) AS derived, COUNT(l_orderkey) = o_orderkey % 4 AS ok
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def counts_vs_official(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    n = F.coalesce("n", F.lit(0))
    official = F.col("o_orderkey") % 4
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        "o_orderkey", official.alias("official"), n.alias("derived"), (n == official).alias("ok"))


@query("greedy_marker_collapse", O.with_base(
    "mf AS (SELECT match_id, frame_fine FROM ev WHERE game_interruption_after IS NOT NULL OR etype_purchase)".replace(
        "game_interruption_after IS NOT NULL OR etype_purchase", "end_type = 'shot'"),
    O.collapse("mf", "kf", "match_id", "frame_fine", 200_000), select="SELECT match_id, frame_fine FROM kf"))
def greedy_marker_collapse(spark, sf):
    shots = D.events(spark, sf).where(F.col("end_type") == "shot")
    return greedy_collapse(shots, ["match_id"], "frame_fine", 200_000)


@query("since_until_marker", O.with_base(O.goals(25, 60), select=f"""
SELECT event_id, {', '.join(f'ROUND({c.rsplit(" AS ", 1)[0]}, 6) AS {c.rsplit(" AS ", 1)[1]}' for c in O.GOAL_TIME)} FROM ev g"""))
def since_until_marker(spark, sf):
    ev = D.events(spark, sf)
    goals = close_goals(spark, sf)
    names = [f"seconds_{d}_goal_{s}" for d in ("since", "until") for s in ("for", "against")]
    return rounded(E.add_goal_relative_time(ev, goals, BLOCK).select("event_id", *names), *names)


@query("next_marker_same_and_other", O.with_base(O.goals(25, 60), select=f"""
SELECT event_id, {', '.join(f'ROUND({c.rsplit(" AS ", 1)[0]}, 6) AS {c.rsplit(" AS ", 1)[1]}' for c in O.OUTCOMES)} FROM ev g"""))
def next_marker_same_and_other(spark, sf):
    ev = D.events(spark, sf)
    goals = close_goals(spark, sf)
    names = [f"seconds_to_next_{w}_{who}" for w in ("shot", "goal") for who in ("same_team", "opponent")]
    return rounded(E.add_outcome_windows(ev, goals, BLOCK).select("event_id", *names), *names)


@query("asof_fine_axis", O.with_base("sf AS (SELECT DISTINCT match_id, frame_fine AS m FROM ev WHERE end_type = 'shot')", select="""
SELECT event_id, (SELECT MAX(m) FROM sf WHERE sf.match_id = ev.match_id AND m <= frame_fine) AS last_shot,
  (SELECT MIN(m) FROM sf WHERE sf.match_id = ev.match_id AND m >= frame_fine) AS next_shot FROM ev"""))
def asof_fine_axis(spark, sf):
    ev = D.events(spark, sf).select("event_id", "match_id", "frame_fine", "end_type")
    shots = ev.where(F.col("end_type") == "shot").select("match_id", F.col("frame_fine").alias("m"))
    found = asof(ev, shots, ["match_id"], "frame_fine", "m", FINE_BLOCK, {"s": ("since", None), "u": ("until", None)})
    return found.select("event_id", F.col("s.at").alias("last_shot"), F.col("u.at").alias("next_shot"))


ZONES = [f"{o}_{z}_{a}" for a in ("start", "end", "reception") for z in ("penalty_area", "six_yard_box") for o in ("own", "opp")]


@query("zone_flags", O.with_base(*O.gold(["zones"]), select=f"SELECT event_id, {', '.join(ZONES)} FROM gd"))
def zone_flags(spark, sf):
    return gold_events(spark, sf, ["zones"]).select("event_id", *ZONES)


@query("unit_sizes", O.with_base(*O.gold(["units"]), select="SELECT event_id, team_back_line_size, team_front_line_size, team_pivot_size FROM gd"))
def unit_sizes(spark, sf):
    return gold_events(spark, sf, ["units"]).select("event_id", "team_back_line_size", "team_front_line_size", "team_pivot_size")


@query("roster_attributes", O.with_base(*O.gold(["roster", "captains"]), select="""
SELECT event_id, number, is_substitute, is_starter, is_starting_cb_pair, is_captain FROM gd"""))
def roster_attributes(spark, sf):
    return gold_events(spark, sf, ["roster", "captains"]).select(
        "event_id", "number", "is_substitute", "is_starter", "is_starting_cb_pair", "is_captain")


@query("modal_position", O.with_base(select="""
SELECT match_id, player_id, player_position, n FROM (
  SELECT match_id, player_id, player_position, COUNT(*) AS n,
    ROW_NUMBER() OVER (PARTITION BY match_id, player_id ORDER BY COUNT(*) DESC, player_position) AS rn
  FROM ev WHERE player_position IS NOT NULL GROUP BY match_id, player_id, player_position) WHERE rn = 1"""))
def modal_position(spark, sf):
    return E.modal_position(D.events(spark, sf))


@query("interval_headcount", """
WITH iv AS (SELECT l_suppkey, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS s,
    date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) + CAST(l_quantity AS BIGINT) AS e, l_returnflag AS f FROM lineitem),
bd AS (SELECT l_suppkey, s AS boundary FROM iv UNION SELECT l_suppkey, e FROM iv)
SELECT bd.l_suppkey, bd.boundary, COUNT(*) FILTER (WHERE f = 'R') AS n_r, COUNT(*) FILTER (WHERE f <> 'R') AS n_other
FROM bd JOIN iv ON iv.l_suppkey = bd.l_suppkey AND bd.boundary BETWEEN iv.s AND iv.e GROUP BY ALL""")
def interval_headcount_lines(spark, sf):
    from touchline.operators.ordered import interval_headcount
    day = F.date_diff("l_shipdate", F.lit("1970-01-01").cast("date"))
    iv = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey", day.cast("long").alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), "l_returnflag")
    r = F.col("l_returnflag") == "R"
    return interval_headcount(iv, ["l_suppkey"], "s", "e", 100, {"n_r": r, "n_other": ~r})
