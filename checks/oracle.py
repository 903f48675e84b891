"""DuckDB CTEs of the gold derivations, written from their definitions."""
from __future__ import annotations

from checks import driver_tables as D

BASE = f"{D.events_cte()}, {D.matches_cte()}, {D.players_cte()}, {D.captains_cte()}"


def with_base(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BASE, *[c for c in ctes if c]]) + " " + select


CHAIN_IDS = """
pn AS (SELECT match_id, event_id, concat(match_id, '_tp', CAST(SUM(CASE WHEN first_player_possession_in_team_possession THEN 1 ELSE 0 END)
         OVER (PARTITION BY match_id ORDER BY frame_start, event_id) AS BIGINT)) AS team_possession_id
       FROM ev WHERE event_type = 'player_possession'),
ec AS (SELECT ev.*, pn.team_possession_id FROM ev LEFT JOIN pn ON ev.match_id = pn.match_id AND pn.event_id =
         CASE WHEN ev.event_type = 'player_possession' THEN ev.event_id ELSE ev.associated_player_possession_event_id END)"""

CHAIN_ROLLUP = """
cr AS (SELECT team_possession_id, COUNT(*) AS chain_n_possessions,
         COALESCE(BOOL_OR(third_end = 'attacking_third'), FALSE) AS chain_reached_final_third,
         COALESCE(BOOL_OR(penalty_area_end), FALSE) AS chain_reached_box,
         COALESCE(BOOL_OR(end_type = 'shot'), FALSE) AS chain_ended_in_shot,
         (MAX(frame_end) - MIN(frame_start)) / 10.0e0 AS chain_duration_s
       FROM ec WHERE team_possession_id IS NOT NULL GROUP BY team_possession_id)"""


def collapse(source: str, out: str, by: str, at: str, gap: int) -> str:
    """Recursive greedy collapse against the last kept marker."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"m.{k} = k.{k}" for k in keys)
    cols = ", ".join(f"m.{k}" for k in keys)
    return f"""
{out}_o AS (SELECT {by}, {at}, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {at}) AS rn FROM (SELECT DISTINCT {by}, {at} FROM {source})),
{out}_r AS (SELECT {by}, rn, {at}, {at} AS kept, TRUE AS keep FROM {out}_o WHERE rn = 1
  UNION ALL SELECT {cols}, m.rn, m.{at}, CASE WHEN m.{at} - k.kept > {gap} THEN m.{at} ELSE k.kept END, m.{at} - k.kept > {gap}
  FROM {out}_r k JOIN {out}_o m ON {same} AND m.rn = k.rn + 1),
{out} AS (SELECT {by}, {at} FROM {out}_r WHERE keep)"""


def goals(gap: int = 100, lookback: int = 1500) -> str:
    return f"""
mk AS (SELECT match_id, team_id, frame_end AS frame FROM ev WHERE event_type = 'player_possession' AND game_interruption_after = 'goal_for'),
{collapse('mk', 'km', 'match_id, team_id', 'frame', gap)},
sh AS (SELECT DISTINCT match_id, team_id, frame_end AS frame FROM ev WHERE event_type = 'player_possession' AND end_type = 'shot'),
sc AS (SELECT match_id, team_id, event_id, frame_start AS observed, team_score - COALESCE(LAG(team_score) OVER w, 0) AS step
       FROM ev WINDOW w AS (PARTITION BY match_id, team_id ORDER BY frame_start, event_id)),
st AS (SELECT sc.match_id, sc.team_id, sc.event_id, observed, step, MAX(sh.frame) AS shot FROM sc LEFT JOIN sh
       ON sh.match_id = sc.match_id AND sh.team_id = sc.team_id AND sh.frame <= sc.observed WHERE step > 0 GROUP BY ALL),
su AS (SELECT st.*, ROW_NUMBER() OVER (PARTITION BY match_id, team_id ORDER BY observed, event_id, i) AS n
       FROM (SELECT *, UNNEST(generate_series(1, step)) AS i FROM st) st),
fo AS (SELECT tm.match_id, tm.team_id, CAST(0 AS BIGINT) AS n,
              COALESCE((SELECT LIST(km.frame ORDER BY km.frame) FROM km WHERE km.match_id = tm.match_id AND km.team_id = tm.team_id), CAST([] AS BIGINT[])) AS fr,
              COALESCE((SELECT LIST('goal_marker') FROM km WHERE km.match_id = tm.match_id AND km.team_id = tm.team_id), CAST([] AS VARCHAR[])) AS src
       FROM (SELECT DISTINCT match_id, team_id FROM ev) tm
  UNION ALL
  SELECT match_id, team_id, n, CASE WHEN explained THEN fr ELSE list_append(fr, CASE WHEN shot > floor_ THEN shot ELSE observed END) END,
         CASE WHEN explained THEN src ELSE list_append(src, CASE WHEN shot > floor_ THEN 'last_shot' ELSE 'score_change' END) END
  FROM (SELECT f.match_id, f.team_id, u.n, f.fr, f.src, u.observed, u.shot,
               len(list_filter(f.fr, lambda x: u.observed - x BETWEEN 0 AND {lookback})) > 0 AS explained,
               COALESCE(list_max(list_filter(f.fr, lambda x: x < u.observed)), -1000000000) AS floor_
        FROM fo f JOIN su u ON u.match_id = f.match_id AND u.team_id = f.team_id AND u.n = f.n + 1)),
fe AS (SELECT match_id, team_id, arg_max(fr, n) AS fr, arg_max(src, n) AS src FROM fo GROUP BY match_id, team_id),
gl AS (SELECT x.match_id, x.frame, CASE WHEN x.frame > mt.period_1_end THEN 2 ELSE 1 END AS period, x.scoring_team_id, x.frame_source
       FROM (SELECT match_id, team_id AS scoring_team_id, UNNEST(fr) AS frame, UNNEST(src) AS frame_source FROM fe) x JOIN mt USING (match_id))"""


def nearest(out: str, source: str, team: str, rel: str, at: str, direction: str) -> str:
    agg, cmp = ("MAX", "<=") if direction == "since" else ("MIN", ">=")
    lookup = f"(SELECT {agg}(m.frame) FROM {source} m WHERE m.match_id = g.match_id AND m.{team} {rel} g.team_id AND m.frame {cmp} g.{at})"
    diff = f"(g.{at} - {lookup})" if direction == "since" else f"({lookup} - g.{at})"
    return f"{diff} / 10.0e0 AS {out}"


GOAL_TIME = [nearest(f"seconds_{d}_goal_{s}", "gl", "scoring_team_id", "=" if s == "for" else "<>", "frame_start", d)
             for d in ("since", "until") for s in ("for", "against")]
OUTCOMES = [nearest(f"seconds_to_next_{w}_{who}", src, team, "=" if who == "same_team" else "<>", "frame_end", "until")
            for w, src, team in (("shot", "sh", "team_id"), ("goal", "gl", "scoring_team_id"))
            for who in ("same_team", "opponent")]


def zones() -> list[str]:
    out = []
    for suf, x, y in (("start", "x_start", "y_start"), ("end", "x_end", "y_end"),
                      ("reception", "player_targeted_x_reception", "player_targeted_y_reception")):
        for zone, depth, width in (("penalty_area", 16.5, 20.16), ("six_yard_box", 5.5, 9.16)):
            edge = f"(mt.pitch_length / 2 - {depth})"
            out.append(f"COALESCE(g.{x} < -{edge} AND ABS(g.{y}) <= {width}, FALSE) AS own_{zone}_{suf}")
            out.append(f"COALESCE(g.{x} > {edge} AND ABS(g.{y}) <= {width}, FALSE) AS opp_{zone}_{suf}")
    return out


ON_PITCH = """
iv AS (SELECT match_id, team_id, position, s1 AS s, e1 AS e FROM pl UNION ALL SELECT match_id, team_id, position, s2, e2 FROM pl WHERE s2 IS NOT NULL),
bd AS (SELECT DISTINCT match_id, team_id, b FROM (SELECT match_id, team_id, s AS b FROM iv UNION ALL SELECT match_id, team_id, e FROM iv)),
us AS (SELECT bd.match_id, bd.team_id, bd.b,
         CAST(COUNT(*) FILTER (WHERE position IN ('CB','LCB','RCB','LB','RB','LWB','RWB')) AS BIGINT) AS team_back_line_size,
         CAST(COUNT(*) FILTER (WHERE position IN ('CF','LF','RF')) AS BIGINT) AS team_front_line_size,
         CAST(COUNT(*) FILTER (WHERE position IN ('DM','LDM','RDM')) AS BIGINT) AS team_pivot_size
       FROM bd JOIN iv ON iv.match_id = bd.match_id AND iv.team_id = bd.team_id AND bd.b BETWEEN iv.s AND iv.e GROUP BY ALL)"""


def gold(parts: set[str] | list[str], gap: int = 100, lookback: int = 1500) -> list[str]:
    """CTEs ending in ``g`` with the derived columns of ``parts`` (same names as the library's)."""
    parts = set(parts)
    ctes, src = [], "ev"
    if parts & {"goal_time", "outcomes"}:
        ctes.append(goals(gap, lookback))
    cols, joins = [], []
    if "chains" in parts:
        ctes += [CHAIN_IDS, CHAIN_ROLLUP]
        src = "ec"
        cols += ["cr.chain_n_possessions", "cr.chain_reached_final_third", "cr.chain_reached_box", "cr.chain_ended_in_shot", "cr.chain_duration_s"]
        joins.append("LEFT JOIN cr ON cr.team_possession_id = g.team_possession_id")
    if "goal_time" in parts:
        cols += GOAL_TIME
    if "outcomes" in parts:
        cols += OUTCOMES
    if "zones" in parts:
        cols += zones()
        joins.append("JOIN mt ON mt.match_id = g.match_id")
    if "units" in parts:
        ctes.append(ON_PITCH)
        cols += ["us.team_back_line_size", "us.team_front_line_size", "us.team_pivot_size"]
        joins.append("LEFT JOIN us ON us.match_id = g.match_id AND us.team_id = g.team_id AND us.b = COALESCE("
                     "(SELECT MAX(b) FROM bd WHERE bd.match_id = g.match_id AND bd.team_id = g.team_id AND bd.b <= g.frame_start), "
                     "(SELECT MIN(b) FROM bd WHERE bd.match_id = g.match_id AND bd.team_id = g.team_id))")
    if "roster" in parts:
        cols += ["ro.number", "COALESCE(ro.is_substitute, FALSE) AS is_substitute", "COALESCE(ro.is_starter, FALSE) AS is_starter",
                 "COALESCE(g.player_position IN ('CB','LCB','RCB'), FALSE) AND COALESCE(ro.is_starter, FALSE) AS is_starting_cb_pair"]
        joins.append("LEFT JOIN pl ro ON ro.match_id = g.match_id AND ro.player_id = g.player_id")
    if "captains" in parts:
        cols.append("COALESCE(cap.player_id = g.player_id, FALSE) AS is_captain")
        joins.append("LEFT JOIN cap ON cap.match_id = g.match_id AND cap.team_id = g.team_id")
    sel = ", ".join(["g.*", *cols])
    ctes.append(f"gd AS (SELECT {sel} FROM {src} g {' '.join(joins)})")
    return ctes
