"""Filter specs, field catalog, concept tags, verdicts and phase shape on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import oracle as O
from checks.registry import query
from touchline import schema as S
from touchline.functions import concepts as K
from touchline.functions import filters as X
from touchline.operators import compare as M
from touchline.plans import catalog as C
from touchline.plans import shape

PP_ONLY = {"column": "event_type", "op": "eq", "value": "player_possession"}
SPEC = [
    PP_ONLY,
    {"column": "game_state", "op": "in", "value": ["WINNING", "drawing"]},
    {"column": "pass_range", "op": "ne", "value": "Long"},
    {"column": "carry", "op": "eq", "value": True},
    {"column": "n_opponents_ahead_end", "op": "ne", "value": 0},
    {"column": "x_start", "op": "gt", "value": -20},
    {"column": "second_last_line_break", "op": "notnull", "value": None},
]
SPEC_SQL = [
    "COALESCE(lower(game_state) IN ('winning', 'drawing'), FALSE)",
    "lower(pass_range) IS DISTINCT FROM 'long'",
    "COALESCE(carry, FALSE)",
    "n_opponents_ahead_end IS DISTINCT FROM 0",
    "COALESCE(x_start > -20, FALSE)",
    "second_last_line_break IS NOT NULL",
]
CONFLICT = [PP_ONLY, {"column": "third_start", "op": "eq", "value": "attacking_third"}, {"column": "x_start", "op": "lt", "value": 0}]
IMPOSSIBLE = [PP_ONLY, {"column": "carry", "op": "eq", "value": True}, {"column": "give_and_go", "op": "eq", "value": True}]


@query("apply_filters", O.with_base(select=f"SELECT event_id, match_id FROM ev WHERE event_type = 'player_possession' AND {' AND '.join(SPEC_SQL)}"))
def apply_filters(spark, sf):
    return X.execute(D.events(spark, sf), SPEC).select("event_id", "match_id")


def _funnel_sql() -> str:
    steps = [f"SELECT 0 AS step, CAST(NULL AS VARCHAR) AS filter, COUNT(*) AS rows, COUNT(*) AS alone FROM p"]
    for i in range(1, len(SPEC_SQL) + 1):
        text = X.describe(SPEC[i]).replace("'", "''")
        steps.append(f"SELECT {i}, '{text}', COUNT(*) FILTER (WHERE {' AND '.join(SPEC_SQL[:i])}), COUNT(*) FILTER (WHERE {SPEC_SQL[i - 1]}) FROM p")
    return O.with_base("p AS (SELECT * FROM ev WHERE event_type = 'player_possession')", select=" UNION ALL ".join(steps))


@query("funnel", _funnel_sql())
def funnel(spark, sf):
    return X.funnel(D.events(spark, sf), SPEC)


@query("zero_row_conflict", O.with_base("p AS (SELECT * FROM ev WHERE event_type = 'player_possession')", select="""
SELECT 0 AS rows, 2 AS step, 'x_start lt 0' AS filter, (SELECT COUNT(*) FROM p WHERE third_start = 'attacking_third') AS rows_before,
  (SELECT COUNT(*) FROM p WHERE x_start < 0) AS alone, 'conflict' AS reason"""))
def zero_row_conflict(spark, sf):
    return X.explain_empty(D.events(spark, sf), CONFLICT)


@query("zero_row_impossible", O.with_base("p AS (SELECT * FROM ev WHERE event_type = 'player_possession')", select="""
SELECT 0 AS rows, 2 AS step, 'give_and_go eq True' AS filter, (SELECT COUNT(*) FROM p WHERE carry) AS rows_before,
  (SELECT COUNT(*) FROM p WHERE give_and_go) AS alone, 'impossible' AS reason"""))
def zero_row_impossible(spark, sf):
    return X.explain_empty(D.events(spark, sf), IMPOSSIBLE)


CATALOG_COLUMNS = [c for c in D.EVENT_COLUMNS if not c.startswith("_")]


def _catalog_sql() -> str:
    short = list(S.EVENT_TYPES)
    per = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(c in S.DERIVED_COLUMNS).upper()} AS derived, "
        + ", ".join(f"COALESCE(ROUND(100.0e0 * COUNT({c}) FILTER (WHERE event_type = '{t}') / NULLIF(COUNT(*) FILTER (WHERE event_type = '{t}'), 0), 1), 0) AS {t}" for t in short)
        + f", COUNT(DISTINCT CASE WHEN {c} IS NOT NULL THEN match_id END) AS matches_with_any, COUNT(DISTINCT match_id) AS matches FROM ev"
        for c in CATALOG_COLUMNS)
    n = " + ".join(f"CASE WHEN {t} > 0 THEN 1 ELSE 0 END" for t in short)
    return O.with_base(select=f"SELECT *, ({n}) = 1 AS single_type, matches_with_any < matches AS partial_matches FROM ({per})")


@query("field_catalog", _catalog_sql())
def field_catalog(spark, sf):
    return C.field_catalog(D.events(spark, sf))


@query("availability", O.with_base(select=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", event_type, ROUND(COUNT({c}) * 1.0e0 / COUNT(*), 6) AS share FROM ev GROUP BY event_type HAVING COUNT({c}) * 1.0e0 / COUNT(*) > 0.01"
    for c in D.EVENT_COLUMNS)))
def availability(spark, sf):
    return C.availability(D.events(spark, sf)).withColumn("share", F.round("share", 6))


BOOLEANS = [c for c in D.EVENT_COLUMNS if c in S.EVENT_COLUMN_TYPES["boolean"]]
LISTED = [c for c in D.EVENT_COLUMNS if c in S.ENUMERABLE]


@query("observed_values", O.with_base(select=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", event_type, lower(CAST({c} AS VARCHAR)) AS value, COUNT(*) AS n FROM ev WHERE {c} IS NOT NULL GROUP BY 2, 3" for c in [*BOOLEANS, *LISTED])))
def observed_values(spark, sf):
    return C.observed_values(D.events(spark, sf))


def _vocabulary_sql() -> str:
    rows = []
    for group, columns in C.FIELD_GROUPS.items():
        for c in columns:
            if c not in D.EVENT_COLUMNS:
                continue
            kind = "bool" if c in BOOLEANS else "enum" if c in LISTED else "text" if c in (*S.EVENT_COLUMN_TYPES["string"], "team_possession_id") else "numeric"
            values = (f"COALESCE((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT lower(CAST({c} AS VARCHAR)) AS v FROM ev WHERE {c} IS NOT NULL)), '')"
                      if kind == "enum" else "''")
            types = (f"COALESCE((SELECT string_agg(event_type, '|' ORDER BY event_type) FROM (SELECT event_type FROM ev GROUP BY event_type "
                     f"HAVING COUNT({c}) * 1.0e0 / COUNT(*) > 0.01)), '')")
            only = f" WHERE EXISTS (SELECT 1 FROM ev WHERE {c})" if kind == "bool" else ""
            rows.append(f"SELECT '{group}' AS field_group, '{c}' AS \"column\", '{kind}' AS kind, {values} AS vals, {types} AS types{only}")
    return O.with_base(select=" UNION ALL ".join(rows))


@query("field_vocabulary", _vocabulary_sql())
def field_vocabulary(spark, sf):
    v = C.field_vocabulary(D.events(spark, sf))
    return v.select("field_group", "column", "kind", F.array_join("values", "|").alias("vals"), F.array_join("event_types", "|").alias("types"))


PROXY_SQL = {
    "cutback": "COALESCE(opp_penalty_area_start, FALSE) AND COALESCE(start_type = 'pass_reception', FALSE)",
    "through_ball": "COALESCE(first_line_break, FALSE)",
    "game_management": "COALESCE(minute_start >= 80, FALSE) AND COALESCE(start_type IN ('throw_in_reception', 'keep_possession'), FALSE)",
    "duel_won": None,      # the stand-in is never populated on possession rows, so it is not applied
    "numerical_advantage": "COALESCE(n_opponents_ahead_end = 0, FALSE)",
}


@query("proxy_filters", O.with_base(*O.gold(["zones"]), "p AS (SELECT * FROM gd WHERE event_type = 'player_possession')", select=" UNION ALL ".join(
    f"SELECT '{c}' AS concept, {str(w is not None).upper()} AS disclosed, COUNT(*) FILTER (WHERE {w or 'TRUE'}) AS rows FROM p" for c, w in PROXY_SQL.items())))
def proxy_filters(spark, sf):
    ev = lake.gold_events(spark, sf)
    checks = C.FieldChecks.of(ev)
    out = None
    for concept in [c for c in K.CONCEPTS if c.name in PROXY_SQL]:
        specs, disclosed, _ = K.apply_proxies([PP_ONLY], [concept], [S.PP], checks)
        row = X.execute(ev, specs).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(concept.name).alias("concept"), F.lit(bool(disclosed)).alias("disclosed"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


CHECKED = [
    {"column": "carry", "op": "eq", "value": True}, {"column": "give_and_go", "op": "eq", "value": True},
    {"column": "end_type", "op": "in", "value": ["shot", "nothing"]}, {"column": "end_type", "op": "eq", "value": "nothing"},
    {"column": "no_such_column", "op": "eq", "value": 1}, {"column": "x_start", "op": "gt", "value": 0}]


PP_ROWS = "event_type = 'player_possession'"


def _reason_sql(column: str, values: str | None) -> str:
    """The code of the first check that a filter on possession rows fails."""
    share = f"SELECT event_type, COUNT({column}) * 1.0e0 / COUNT(*) AS s FROM ev GROUP BY event_type"
    seen = f"WHEN NOT EXISTS (SELECT 1 FROM ev WHERE {PP_ROWS} AND lower(CAST({column} AS VARCHAR)) IN ({values})) THEN 'value_never_seen'" if values else ""
    return (f"CASE WHEN NOT EXISTS (SELECT 1 FROM ({share}) WHERE s > 0.01) THEN 'empty_column' "
            f"WHEN NOT EXISTS (SELECT 1 FROM ({share}) WHERE s > 0.01 AND {PP_ROWS}) THEN 'wrong_event_type' {seen} END")


VALIDATED = [("carry", "'true'"), ("give_and_go", "'true'"), ("end_type", "'shot', 'nothing'"), ("end_type", "'nothing'"), ("x_start", None)]


@query("validated_filters", O.with_base(select=" UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", r AS problem, r IS NULL AS usable FROM (SELECT {_reason_sql(c, v)} AS r)" for c, v in VALIDATED]
    + ["SELECT 'no_such_column', 'unknown_column', FALSE"])))
def validated_filters(spark, sf):
    return C.explain_filters(D.events(spark, sf), CHECKED, S.PP).select("column", "problem", F.col("problem").isNull().alias("usable"))


TRUTH = [PP_ONLY, {"column": "end_type", "op": "eq", "value": "shot"}]
NARROW = [*TRUTH, {"column": "lead_to_shot", "op": "eq", "value": False}]
WIDE = [PP_ONLY, {"column": "end_type", "op": "in", "value": ["shot", "pass"]}]
NOTHING = [*TRUTH, {"column": "give_and_go", "op": "eq", "value": True}]
RIVALS = {"same": TRUTH, "narrow": NARROW, "wide": WIDE, "nothing": NOTHING}
RIVAL_SQL = {"same": "end_type = 'shot'", "narrow": "end_type = 'shot' AND NOT lead_to_shot", "wide": "end_type IN ('shot', 'pass')",
             "nothing": "end_type = 'shot' AND COALESCE(give_and_go, FALSE)"}


def _verdict_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT '{n}' AS spec, COUNT(*) FILTER (WHERE end_type = 'shot') AS t, COUNT(*) FILTER (WHERE {w}) AS p, "
        f"COUNT(*) FILTER (WHERE end_type = 'shot' AND {w}) AS b, COUNT(*) FILTER (WHERE end_type = 'shot' OR {w}) AS e "
        "FROM ev WHERE event_type = 'player_possession'" for n, w in RIVAL_SQL.items())
    return O.with_base(select=f"""
SELECT spec, t AS truth_rows, p AS got_rows, ROUND(b * 1.0e0 / t, 6) AS recall, ROUND(b * 1.0e0 / e, 6) AS jaccard, ROUND(p * 1.0e0 / t, 6) AS blowup,
  CASE WHEN p = 0 AND t > 0 THEN 'SILENT ZERO' WHEN b >= 0.9 * t AND p <= 1.5 * t THEN 'equivalent' WHEN b >= 0.9 * t THEN 'superset'
       WHEN b >= 0.5 * t THEN 'partial' ELSE 'misses' END AS verdict FROM ({one})""")


@query("result_set_verdict", _verdict_sql())
def result_set_verdict(spark, sf):
    ev = D.events(spark, sf)
    truth = X.execute(ev, TRUTH)
    out = None
    for name, spec in RIVALS.items():
        row = M.result_set_verdict(truth, X.execute(ev, spec), ["match_id", "event_id"]).select(F.lit(name).alias("spec"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "jaccard", "blowup")})


def _concept_sql(concepts) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(w, ' {' '.join(p.lower().split())} ')" for p in c.all_phrases) + f" THEN '{c.name}'" for c in concepts)
    verdicts = " ".join(f"WHEN '{c.name}' THEN '{c.verdict}'" for c in concepts)
    return f"""
SELECT doc_id, concept, CASE concept {verdicts} END AS verdict FROM (SELECT doc_id, CASE {arms} END AS concept FROM
  (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents))"""


@query("concept_tags", _concept_sql(K.CONCEPTS))
def concept_tags(spark, sf):
    return K.tag_concepts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "concept", "verdict")


# phrases that the invented prose really contains
PROSE = (K.Concept("license", K.NO_DATA, ("all rights reserved", "licensed under")), K.Concept("password", K.NO_DATA, ("api key", "secret")),
         K.Concept("of_the", K.APPROXIMATE, ("in the", "to the")), K.Concept("and", K.APPROXIMATE, ("y", "et", "und")))


@query("phrase_tags", _concept_sql(PROSE))
def phrase_tags(spark, sf):
    return K.tag_concepts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text", PROSE).select("doc_id", "concept", "verdict")


# --------------------------------------------------------------------------------------
# phase shape: each order is one phase
# --------------------------------------------------------------------------------------
PHASE_COLUMNS = {
    "phase_id": "o_orderkey", "match_id": "o_custkey % 40",
    "team_in_possession_id": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN (o_custkey % 40) % 20 ELSE ((o_custkey % 40) * 3 + 1) % 20 END",
    "team_in_possession_phase_type": D.pick("(o_orderkey % 8)", D.PHASES_IN),
    "team_out_of_possession_phase_type": D.pick("(o_orderkey % 8)", D.PHASES_OUT),
    "team_in_possession_width_end": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE " + D.fl("o_totalprice - FLOOR(o_totalprice / 400e0) * 400e0") + " / 10e0 + 15e0 END",
    "team_out_of_possession_width_end": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE " + D.fl("o_totalprice - FLOOR(o_totalprice / 300e0) * 300e0") + " / 10e0 + 12e0 END",
}


def phases(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*[f"{e} AS {n}" for n, e in PHASE_COLUMNS.items()])


def _side(side: str, team: str) -> str:
    v, t = f"team_{side}_width_end", f"team_{side}_phase_type"
    return f"""
{side}_s AS (SELECT {team} AS tm, {t} AS ty, COUNT({v}) AS n, AVG({v}) AS m, STDDEV_SAMP({v}) AS sd, QUANTILE_CONT({v}, 0.5) AS med FROM dp
             WHERE {team} IS NOT NULL GROUP BY 1, 2),
{side}_r AS (SELECT phase_id, (RANK() OVER w + (COUNT(*) OVER (PARTITION BY {team}, {t}, {v}) - 1) / 2.0e0) AS rk FROM dp
             WHERE {team} IS NOT NULL AND {v} IS NOT NULL WINDOW w AS (PARTITION BY {team}, {t} ORDER BY {v}))"""


PHASE_SQL = f"""
WITH ph AS ({D._layer(PHASE_COLUMNS, 'orders', False)}),
tm AS (SELECT DISTINCT match_id, team_in_possession_id AS t FROM ph WHERE team_in_possession_id IS NOT NULL),
dp AS (SELECT ph.*, (SELECT MIN(t) FROM tm WHERE tm.match_id = ph.match_id AND t IS DISTINCT FROM ph.team_in_possession_id) AS defending_team_id FROM ph),
{_side('out_of_possession', 'defending_team_id')}, {_side('in_possession', 'team_in_possession_id')},
sh AS (SELECT dp.phase_id, dp.match_id, dp.defending_team_id, dp.team_out_of_possession_phase_type, """ + ", ".join(
    f"ROUND({s}_r.rk / {s}_s.n, 6) AS {s}_width_pctile, ROUND((team_{s}_width_end - {s}_s.m) / NULLIF({s}_s.sd, 0), 6) AS {s}_width_z, ROUND({s}_s.med, 6) AS {s}_width_baseline"
    for s in ("out_of_possession", "in_possession")) + """
FROM dp LEFT JOIN out_of_possession_s ON out_of_possession_s.tm = defending_team_id AND out_of_possession_s.ty = team_out_of_possession_phase_type
LEFT JOIN in_possession_s ON in_possession_s.tm = team_in_possession_id AND in_possession_s.ty = team_in_possession_phase_type
LEFT JOIN out_of_possession_r ON out_of_possession_r.phase_id = dp.phase_id LEFT JOIN in_possession_r ON in_possession_r.phase_id = dp.phase_id)
"""
SHAPE = [f"{s}_width_{m}" for s in ("out_of_possession", "in_possession") for m in ("pctile", "z", "baseline")]


@query("phase_shape", PHASE_SQL + f"SELECT phase_id, match_id, defending_team_id, {', '.join(SHAPE)} FROM sh")
def phase_shape(spark, sf):
    out = shape.phase_shape(phases(spark, sf)).withColumns({c: F.round(c, 6) for c in SHAPE})
    return out.select("phase_id", "match_id", "defending_team_id", *SHAPE)


@query("question_17", PHASE_SQL + "SELECT phase_id, match_id, out_of_possession_width_z FROM sh WHERE team_out_of_possession_phase_type = 'medium_block' AND out_of_possession_width_z IS NOT NULL")
def question_17(spark, sf):
    out = shape.narrow_blocks(shape.phase_shape(phases(spark, sf))).withColumn("out_of_possession_width_z", F.round("out_of_possession_width_z", 6))
    return out.select("phase_id", "match_id", "out_of_possession_width_z").orderBy("out_of_possession_width_z", "phase_id")


@query("group_pct_z_median", """
WITH s AS (SELECT l_suppkey, l_returnflag, COUNT(*) AS n, AVG(l_quantity) AS m, STDDEV_SAMP(l_quantity) AS sd, QUANTILE_CONT(l_quantity, 0.5) AS med FROM lineitem GROUP BY 1, 2),
v AS (SELECT l_suppkey, l_returnflag, l_quantity, COUNT(*) AS c FROM lineitem GROUP BY 1, 2, 3)
SELECT v.l_suppkey, v.l_returnflag, v.l_quantity, v.c AS rows, ROUND(((SELECT COALESCE(SUM(u.c), 0) FROM v u WHERE u.l_suppkey = v.l_suppkey AND u.l_returnflag = v.l_returnflag
  AND u.l_quantity < v.l_quantity) + (v.c + 1) / 2.0e0) / s.n, 6) AS pctile, ROUND((v.l_quantity - m) / NULLIF(sd, 0), 6) AS z, ROUND(med, 6) AS median
FROM v JOIN s ON s.l_suppkey = v.l_suppkey AND s.l_returnflag = v.l_returnflag""")
def group_pct_z_median(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_quantity")
    out = shape.relative_to_group(lines, ["l_suppkey", "l_returnflag"], "l_quantity", ("pctile", "z", "median"), 5.0)
    return out.groupBy("l_suppkey", "l_returnflag", "l_quantity").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("pctile"), 6).alias("pctile"), F.round(F.max("z"), 6).alias("z"),
        F.round(F.max("median"), 6).alias("median"))


@query("modal_value", """
SELECT l_suppkey, l_returnflag, n FROM (SELECT l_suppkey, l_returnflag, COUNT(*) AS n,
  ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY COUNT(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def modal_value(spark, sf):
    from touchline.plans.enrich import modal_position
    return modal_position(spark.read.parquet(f"{sf}/lineitem.parquet"), ("l_suppkey",), "l_returnflag")


@query("distribution_summary", """
SELECT l_returnflag, COUNT(*) AS count, ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS std, MIN(l_extendedprice) AS min,
  ROUND(QUANTILE_CONT(l_extendedprice, 0.1), 4) AS p10, ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 4) AS p50, ROUND(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS p90,
  MAX(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag""")
def distribution_summary(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = M.summary(lines, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 500.0, ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p10", "p50", "p90")})


@query("band_histogram", """
SELECT b AS band, n, ROUND(n * 1.0e0 / SUM(n) OVER (), 6) AS share FROM (
  SELECT CASE WHEN l_quantity >= 25 THEN 'sprinting' WHEN l_quantity >= 20 THEN 'hsr' WHEN l_quantity >= 15 THEN 'running' ELSE 'jogging' END AS b, COUNT(*) AS n
  FROM lineitem GROUP BY 1)""")
def band_histogram(spark, sf):
    bands = [("jogging", 0.0), ("running", S.BAND_RUNNING), ("hsr", S.BAND_HSR), ("sprinting", S.BAND_SPRINT)]
    return M.band_histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity", bands).withColumn("share", F.round("share", 6))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf):
    return M.top_k(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")
