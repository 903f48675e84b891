"""Window fetches, signs, motion, baselines and tracking predicates on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import oracle as O
from checks import question_queries, spec_queries  # noqa: F401  (their SQL is part of the whole report)
from checks.registry import ORACLES, query
from touchline.plans import enrich as E
from touchline.plans import lake as L
from touchline.plans import predicates as P
from touchline.plans import questions as Q
from touchline.plans import shape
from touchline.plans import tracking as T

BLOCK = 50
POS = D.positions_cte()


def windows(spark, sf, pre: int, post: int):
    ev = D.events(spark, sf)
    return ev.select("match_id", "event_id", (F.col("frame_start") - pre).alias("lo"), (F.col("frame_end") + post).alias("hi"))


def win_sql(pre: int, post: int) -> str:
    return f"w AS (SELECT match_id, event_id, frame_start - {pre} AS lo, frame_end + {post} AS hi FROM ev)"


@query("window_fetch", O.with_base(POS, win_sql(10, 30), select="""
SELECT w.event_id, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE u = 1) AS BIGINT) AS usable, MIN(frame) AS first_frame, MAX(frame) AS last_frame
FROM w JOIN fr ON fr.match_id = w.match_id AND fr.frame BETWEEN w.lo AND w.hi GROUP BY w.event_id"""))
def window_fetch(spark, sf):
    got = T.fetch_window(windows(spark, sf, 10, 30), lake.frames(spark, sf))
    return got.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.usable()).alias("usable"),
                                       F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("sampled_fetch", O.with_base(POS, win_sql(10, 30), select="""
SELECT w.event_id, COUNT(*) AS n, CAST(SUM(frame) AS BIGINT) AS frame_sum FROM w
JOIN (SELECT DISTINCT lo, hi, CAST(round_even(lo + i * ((hi - lo) / (LEAST(5, hi - lo + 1) - 1.0e0)), 0) AS BIGINT) AS f FROM w, range(5) r(i) WHERE i < LEAST(5, hi - lo + 1)) s
  ON s.lo = w.lo AND s.hi = w.hi JOIN fr ON fr.match_id = w.match_id AND fr.frame = s.f GROUP BY w.event_id"""))
def sampled_fetch(spark, sf):
    got = T.fetch_sampled(windows(spark, sf, 10, 30), lake.frames(spark, sf), 5)
    return got.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frame_sum"))


@query("fetch_at", O.with_base(POS, select="""
SELECT ev.event_id, COUNT(*) AS n FROM ev JOIN fr ON fr.match_id = ev.match_id AND fr.frame IN (ev.frame_start, ev.frame_end + 400)
GROUP BY ev.event_id"""))
def fetch_at(spark, sf):
    ev = D.events(spark, sf).select("match_id", "event_id", F.array("frame_start", F.col("frame_end") + 400).alias("wanted"))
    return T.fetch_at(ev, lake.frames(spark, sf).select("match_id", "frame"), "wanted").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("coverage", O.with_base(POS, win_sql(20, 120), select="""
SELECT w.event_id, COUNT(fr.frame) AS requested, CAST(COUNT(*) FILTER (WHERE u = 1) AS BIGINT) AS n_frames,
  ROUND(COALESCE(COUNT(*) FILTER (WHERE u = 1) * 1.0e0 / NULLIF(COUNT(fr.frame), 0), 0), 6) AS coverage
FROM w LEFT JOIN fr ON fr.match_id = w.match_id AND fr.frame BETWEEN w.lo AND w.hi GROUP BY w.event_id"""))
def coverage(spark, sf):
    got = T.coverage(windows(spark, sf, 20, 120), lake.frame_index(spark, sf))
    return got.select("event_id", "requested", "n_frames", F.round("coverage", 6).alias("coverage"))


VOTES = """
vt AS (SELECT et.match_id, et.team_id, et.period, CASE WHEN ABS(x_start - x) <= 0.5 AND ABS(y_start - y) <= 0.5 THEN 1
         WHEN ABS(x_start + x) <= 0.5 AND ABS(y_start + y) <= 0.5 THEN -1 END AS v
       FROM et LEFT JOIN tk ON tk.match_id = et.match_id AND tk.player_id = et.player_id AND tk.frame = et.frame_start
       WHERE et.x_start IS NOT NULL AND et.y_start IS NOT NULL),
sn AS (SELECT g.match_id, g.team_id, g.period, COUNT(*) FILTER (WHERE v = 1) AS p, COUNT(*) FILTER (WHERE v = -1) AS n, CAST(COUNT(vt.match_id) AS BIGINT) AS n_sampled
       FROM (SELECT DISTINCT match_id, team_id, period FROM et WHERE match_id IN (SELECT match_id FROM tk)) g
       LEFT JOIN vt ON vt.match_id = g.match_id AND vt.team_id = g.team_id AND vt.period = g.period GROUP BY ALL),
sv AS (SELECT match_id, team_id, period, CASE WHEN p + n = 0 THEN 0 WHEN p >= n THEN 1 ELSE -1 END AS sign,
       ROUND(COALESCE(GREATEST(p, n) * 1.0e0 / NULLIF(p + n, 0), 0), 6) AS confidence, p + n AS n_votes, n_sampled FROM sn)"""


@query("sign_vote", O.with_base(POS, D.tracked_events_cte(), VOTES, select="SELECT * FROM sv"))
def sign_vote(spark, sf):
    return T.vote_signs(lake.tracked_events(spark, sf), lake.frames(spark, sf), lake.frame_index(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("sign_vote_sampled", O.with_base(POS, D.tracked_events_cte(), VOTES, select="SELECT match_id, team_id, period, sign FROM sv"))
def sign_vote_sampled(spark, sf):
    """The signs alone; like ``sign_vote`` by the votes of all events."""
    return T.vote_signs(lake.tracked_events(spark, sf), lake.frames(spark, sf), lake.frame_index(spark, sf)).select("match_id", "team_id", "period", "sign")


@query("sign_problems", O.with_base(POS, select="""
SELECT 'low_confidence' AS problem, match_id, team_id, period FROM (SELECT match_id, team_id, period FROM ev GROUP BY ALL HAVING COUNT(*) % 3 = 0)
UNION ALL SELECT 'teams_agree', match_id, NULL, period FROM (SELECT match_id, period, team_id, COUNT(*) % 2 AS s FROM ev GROUP BY ALL) GROUP BY match_id, period HAVING COUNT(*) = 2 AND MIN(s) = MAX(s)
UNION ALL SELECT 'no_flip', match_id, team_id, NULL FROM (SELECT match_id, period, team_id, COUNT(*) % 2 AS s FROM ev GROUP BY ALL) GROUP BY match_id, team_id HAVING COUNT(*) = 2 AND MIN(s) = MAX(s)"""))
def sign_problems(spark, sf):
    n = F.count(F.lit(1))
    groups = D.events(spark, sf).groupBy("match_id", "team_id", "period").agg(
        F.when(n % 2 == 1, 1).otherwise(-1).alias("sign"), F.when(n % 3 == 0, 0.5).otherwise(1.0).alias("confidence"))
    return T.sign_problems(groups)


@query("signed_positions", O.with_base(POS, select="""
SELECT tk.match_id, tk.frame, COUNT(*) FILTER (WHERE is_detected) AS n_detected, ROUND(SUM(-x) FILTER (WHERE is_detected), 4) AS sum_x,
  ROUND(AVG(CASE WHEN is_detected THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate, ROUND(MAX(-ball_x), 4) AS ball_x
FROM tk LEFT JOIN bf ON bf.match_id = tk.match_id AND bf.frame = tk.frame GROUP BY tk.match_id, tk.frame"""))
def signed_positions(spark, sf):
    f = lake.frames(spark, sf).where(T.usable())
    s = f.select("match_id", "frame", T.signed_players("players", F.lit(-1), detected_only=True).alias("p"), T.detection_rate("players").alias("rate"),
                 (F.col("ball_x") * -1).alias("ball_x"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, e: acc + e["x"])
    return s.select("match_id", "frame", F.size("p").cast("bigint").alias("n_detected"),
                    F.round(F.when(F.size("p") > 0, total), 4).alias("sum_x"), F.round("rate", 6).alias("rate"), F.round("ball_x", 4).alias("ball_x"))


MOTION_SQL = """
sm AS (SELECT *, AVG(x) OVER w5 AS sx, AVG(y) OVER w5 AS sy FROM tk WINDOW w5 AS (PARTITION BY player_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
mv AS (SELECT *, (LEAD(sx) OVER f - sx) / ((LEAD(frame) OVER f - frame) / 10.0e0) AS vx, (LEAD(sy) OVER f - sy) / ((LEAD(frame) OVER f - frame) / 10.0e0) AS vy
       FROM sm WINDOW f AS (PARTITION BY player_id ORDER BY frame))"""


@query("smooth_velocity", O.with_base(POS, MOTION_SQL, select="""
SELECT player_id, frame, ROUND(sx, 4) AS sx, ROUND(sy, 4) AS sy, ROUND(vx, 4) AS vx, ROUND(vy, 4) AS vy, ROUND(SQRT(vx * vx + vy * vy) * 3.6, 3) AS speed FROM mv"""))
def smooth_velocity(spark, sf):
    m = T.long_motion(D.positions(spark, sf), ["player_id"], "frame", block=128)
    return m.select("player_id", "frame", *[F.round(c, 4).alias(c) for c in ("sx", "sy", "vx", "vy")], F.round("speed", 3).alias("speed"))


@query("peak_while_retreating", O.with_base(POS, MOTION_SQL, select="""
SELECT player_id, ROUND(MAX(SQRT(vx * vx + vy * vy) * 3.6) FILTER (WHERE vx < 0), 3) AS peak, ROUND(arg_min(sx, frame) - arg_max(sx, frame), 4) AS net FROM mv GROUP BY player_id"""))
def peak_while_retreating(spark, sf):
    m = T.long_motion(D.positions(spark, sf), ["player_id"], "frame", block=128)
    return m.groupBy("player_id").agg(F.round(F.max(F.when(F.col("vx") < 0, F.col("speed"))), 3).alias("peak"),
                                      F.round(F.min_by("sx", "frame") - F.max_by("sx", "frame"), 4).alias("net"))


BASELINE_SQL = f"""
df AS (SELECT tk.match_id, tk.player_id, pl.team_id, pl.position, tk.x * sg.sign AS x, tk.y * sg.sign AS y
       FROM tk JOIN bf ON bf.match_id = tk.match_id AND bf.frame = tk.frame JOIN mt ON mt.match_id = tk.match_id
       JOIN pl ON pl.match_id = tk.match_id AND pl.player_id = tk.player_id
       JOIN sg ON sg.match_id = tk.match_id AND sg.team_id = pl.team_id AND sg.period = CASE WHEN tk.frame < mt.period_2_start THEN 1 ELSE 2 END
       WHERE pl.team_id <> CASE possession_group WHEN 'home team' THEN home_team_id WHEN 'away team' THEN away_team_id END),
bm AS (SELECT match_id, player_id, team_id, position, COUNT(*) AS n_frames, QUANTILE_CONT(x, 0.5) AS base_x, QUANTILE_CONT(y, 0.5) AS base_y FROM df GROUP BY ALL HAVING COUNT(*) >= {lake.BASELINE_FRAMES}),
bl AS (SELECT bm.*, sp.spread_x, sp.spread_y FROM bm JOIN (SELECT df.match_id, df.player_id, QUANTILE_CONT(ABS(x - base_x), 0.5) AS spread_x, QUANTILE_CONT(ABS(y - base_y), 0.5) AS spread_y
       FROM df JOIN bm ON bm.match_id = df.match_id AND bm.player_id = df.player_id GROUP BY ALL) sp ON sp.match_id = bm.match_id AND sp.player_id = bm.player_id)"""


@query("baseline_median_mad", O.with_base(POS, BASELINE_SQL, select="""
SELECT match_id, player_id, team_id, position, n_frames, ROUND(base_x, 4) AS base_x, ROUND(base_y, 4) AS base_y, ROUND(spread_x, 4) AS spread_x, ROUND(spread_y, 4) AS spread_y FROM bl"""))
def baseline_median_mad(spark, sf):
    return lake.baselines(spark, sf).where("reliable").drop("reliable").withColumns({c: F.round(c, 4) for c in ("base_x", "base_y", "spread_x", "spread_y")})


@query("base_positions", O.with_base(POS, BASELINE_SQL, select="""
SELECT position, COUNT(*) AS players, ROUND(QUANTILE_CONT(base_x, 0.5), 4) AS median_x FROM bl WHERE position IS NOT NULL GROUP BY position"""))
def base_positions(spark, sf):
    return L.base_positions(lake.baselines(spark, sf)).select("position", "players", F.round("median_x", 4).alias("median_x"))


# --------------------------------------------------------------------------------------
# predicates
# --------------------------------------------------------------------------------------
def gate_sql(pre: int, post: int, share: float) -> str:
    """``cw`` = candidates ``cd`` with context and gate; ``wf`` = their usable frames; ``wp`` = signed player rows."""
    return f"""
cx AS (SELECT cd.event_id, cd.match_id, cd.team_id, cd.player_id, cd.period, cd.frame_start, cd.frame_end, cd.game_interruption_before AS gib, sg.sign,
         COALESCE(mt.pitch_length, 105) AS plen, COALESCE(mt.pitch_width, 68) AS pwid, cd.frame_start - {pre} AS lo, cd.frame_end + {post} AS hi
       FROM cd LEFT JOIN sg ON sg.match_id = cd.match_id AND sg.team_id = cd.team_id AND sg.period = cd.period LEFT JOIN mt ON mt.match_id = cd.match_id),
cw AS (SELECT cx.*, (SELECT COUNT(*) FROM fr WHERE fr.match_id = cx.match_id AND frame BETWEEN lo AND hi) AS req,
         (SELECT COUNT(*) FROM fr WHERE fr.match_id = cx.match_id AND frame BETWEEN lo AND hi AND u = 1) AS n_frames FROM cx),
cg AS (SELECT * FROM cw WHERE req > 0 AND n_frames * 1.0e0 / req >= {share}),
wf AS (SELECT cg.*, fr.frame, bf.ball_x * sign AS bx, CASE WHEN bf.ball_x IS NOT NULL THEN bf.ball_y * sign END AS by_ FROM cg JOIN fr ON fr.match_id = cg.match_id AND fr.frame BETWEEN lo AND hi AND u = 1
       LEFT JOIN bf ON bf.match_id = fr.match_id AND bf.frame = fr.frame),
wp AS (SELECT wf.*, tk.player_id AS pid, tk.x * sign AS x, tk.y * sign AS y, pl.team_id AS pteam, pl.position AS ppos FROM wf
       JOIN tk ON tk.match_id = wf.match_id AND tk.frame = wf.frame LEFT JOIN pl ON pl.match_id = tk.match_id AND pl.player_id = tk.player_id)"""


def tracked(spark, sf, qid: int):
    return P.rank_measured(qid, lake.candidates(spark, sf, qid), lake.tracking(spark, sf, qid == 56))


def measured(spark, sf, qid: int):
    return P.measured(qid, lake.candidates(spark, sf, qid), lake.tracking(spark, sf, qid == 56))


CORNER_CD = """cd AS (SELECT * FROM (SELECT ev.*, ROW_NUMBER() OVER (PARTITION BY match_id, phase_index ORDER BY frame_start, event_id) AS rn FROM ev
  WHERE game_interruption_before = '{tag}' AND match_id IN (SELECT match_id FROM tk)) WHERE rn = 1)"""
DELIVERY = """
dl AS (SELECT event_id, MAX(frame) AS d, arg_max(by_, frame) AS dy FROM wf WHERE CASE WHEN gib LIKE '%_against' THEN bx < -plen / 2 + 8 ELSE bx > plen / 2 - 8 END
         AND ABS(by_) > pwid / 2 - 8 GROUP BY event_id),
dk AS (SELECT dl.* FROM dl WHERE (SELECT COUNT(*) FROM wf WHERE wf.event_id = dl.event_id AND wf.frame > dl.d + 5) >= 10)"""
NEAR = """
np AS (SELECT wp.event_id, wp.frame, wp.pid, d, CASE WHEN gib LIKE '%_against' THEN x + plen / 2 ELSE plen / 2 - x END AS depth, y * CASE WHEN dy > 0 THEN 1 ELSE -1 END AS lat
       FROM wp JOIN dk ON dk.event_id = wp.event_id WHERE wp.frame BETWEEN d AND d + 25 AND CASE WHEN gib LIKE '%_against' THEN pteam <> team_id ELSE pteam = team_id END)"""
CORNER_COLS = "event_id, matched, value, status, evidence_lo, evidence_hi, n_frames"


def corner_result(spark, sf, tag, predicate):
    return P.evaluate(lake.candidates(spark, sf, 68 if tag == "corner_for" else 70), predicate, P.CORNER_WINDOW, lake.tracking(spark, sf))


@query("nearest_approach", O.with_base(POS, CORNER_CD.format(tag="corner_for"), gate_sql(250, 80, 0.10), DELIVERY, NEAR, select="""
SELECT cw.event_id, COALESCE(BOOL_OR(depth BETWEEN 0 AND 6 AND lat BETWEEN 1.5 AND 8), FALSE) AS matched,
  CASE WHEN MAX(dk.d) IS NOT NULL THEN ROUND(COALESCE(MIN(SQRT(depth * depth + (lat - 3.66) * (lat - 3.66))), 'inf'::DOUBLE), 4) END AS value,
  CASE WHEN MAX(dk.d) IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status,
  COALESCE(MIN(np.frame) FILTER (WHERE depth BETWEEN 0 AND 6 AND lat BETWEEN 1.5 AND 8), MAX(dk.d)) AS evidence_lo,
  COALESCE(MAX(np.frame) FILTER (WHERE depth BETWEEN 0 AND 6 AND lat BETWEEN 1.5 AND 8), MAX(dk.d) + 25) AS evidence_hi, MAX(cw.n_frames) AS n_frames
FROM cw LEFT JOIN dk ON dk.event_id = cw.event_id LEFT JOIN np ON np.event_id = cw.event_id GROUP BY cw.event_id"""))
def nearest_approach(spark, sf):
    r = corner_result(spark, sf, "corner_for", P.attacked_near_post())
    return r.select("event_id", "matched", F.round("value", 4).alias("value"), "status", "evidence_lo", "evidence_hi", "n_frames")


@query("near_post_sweep", O.with_base(POS, CORNER_CD.format(tag="corner_for"), gate_sql(250, 80, 0.10), DELIVERY, NEAR, select="""
SELECT depth_ AS depth, lo_ AS lateral_from, hi_ AS lateral_to, COUNT(*) AS resolved, COUNT(*) FILTER (WHERE NOT EXISTS
  (SELECT 1 FROM np WHERE np.event_id = dk.event_id AND np.depth BETWEEN 0 AND depth_ AND np.lat BETWEEN lo_ AND hi_)) AS missed
FROM dk, (VALUES (0.5e0, 9.16e0), (1.5e0, 8.0e0), (2.5e0, 7.0e0)) l(lo_, hi_), (VALUES (5.0e0), (6.0e0), (8.0e0)) z(depth_) GROUP BY ALL"""))
def near_post_sweep(spark, sf):
    return P.sweep_table(corner_result(spark, sf, "corner_for", P.near_post_sweep(P.SWEEP_ZONES)))


CONTACT = """
cb AS (SELECT wp.*, d, SQRT((x - bx) * (x - bx) + (y - by_) * (y - by_)) AS dist FROM wp JOIN dk ON dk.event_id = wp.event_id WHERE wp.frame >= d + 5 AND bx IS NOT NULL),
c1 AS (SELECT event_id, frame, MIN(dist) AS dmin FROM cb GROUP BY ALL HAVING MIN(dist) <= 1.5),
c2 AS (SELECT event_id, MIN(frame) AS frame FROM c1 GROUP BY event_id),
c3 AS (SELECT cb.*, ROW_NUMBER() OVER (PARTITION BY cb.event_id ORDER BY dist, pid) AS rk FROM cb JOIN c2 ON c2.event_id = cb.event_id AND c2.frame = cb.frame),
c4 AS (SELECT event_id, MAX(frame) AS frame, MIN(dist) FILTER (WHERE rk > 1 AND CASE WHEN gib LIKE '%_against' THEN pteam = team_id ELSE pteam <> team_id END) AS gap,
        BOOL_OR(rk = 1 AND CASE WHEN gib LIKE '%_against' THEN COALESCE(pteam = team_id, FALSE) ELSE pteam IS DISTINCT FROM team_id END) AS first_def, MAX(d) AS d FROM c3 GROUP BY event_id)"""


@query("first_contact", O.with_base(POS, CORNER_CD.format(tag="corner_against"), gate_sql(250, 80, 0.10), DELIVERY, CONTACT, select="""
SELECT cw.event_id, COALESCE(c4.first_def OR COALESCE(gap <= 2.5, FALSE), FALSE) AS matched, ROUND(CASE WHEN c4.event_id IS NOT NULL THEN COALESCE(gap, 'inf'::DOUBLE) END, 4) AS value,
  CASE WHEN c4.event_id IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, c4.d AS evidence_lo, c4.frame AS evidence_hi, cw.n_frames
FROM cw LEFT JOIN c4 ON c4.event_id = cw.event_id"""))
def first_contact(spark, sf):
    r = corner_result(spark, sf, "corner_against", P.first_ball_contested())
    return r.select("event_id", "matched", F.round("value", 4).alias("value"), "status", "evidence_lo", "evidence_hi", "n_frames")


@query("question_68", O.with_base(POS, CORNER_CD.format(tag="corner_for"), gate_sql(250, 80, 0.10), DELIVERY, NEAR, select="""
SELECT dk.event_id, ROUND(COALESCE(MIN(SQRT(depth * depth + (lat - 3.66) * (lat - 3.66))), 'inf'::DOUBLE), 4) AS value
FROM dk LEFT JOIN np ON np.event_id = dk.event_id GROUP BY dk.event_id"""))
def question_68(spark, sf):
    return tracked(spark, sf, 68).select("event_id", F.round("value", 4).alias("value"))


@query("question_70", O.with_base(POS, CORNER_CD.format(tag="corner_against"), gate_sql(250, 80, 0.10), DELIVERY, CONTACT, select="""
SELECT event_id, ROUND(COALESCE(gap, 'inf'::DOUBLE), 4) AS value FROM c4 WHERE NOT (first_def OR COALESCE(gap <= 2.5, FALSE))"""))
def question_70(spark, sf):
    return tracked(spark, sf, 70).select("event_id", F.round("value", 4).alias("value"))


SERIES = """
ps AS (SELECT event_id, match_id, pid, frame, x, y, player_id, AVG(x) OVER w5 AS sx, AVG(y) OVER w5 AS sy, COUNT(*) OVER (PARTITION BY event_id, pid) AS n FROM sel
       WINDOW w5 AS (PARTITION BY event_id, pid ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
pm AS (SELECT *, (LEAD(sx) OVER f - sx) / ((LEAD(frame) OVER f - frame) / 10.0e0) AS vx, (LEAD(sy) OVER f - sy) / ((LEAD(frame) OVER f - frame) / 10.0e0) AS vy,
         SQRT(POWER(LEAD(sx) OVER f - sx, 2) + POWER(LEAD(sy) OVER f - sy, 2)) AS step FROM ps WINDOW f AS (PARTITION BY event_id, pid ORDER BY frame))"""
FIRST = "ff AS (SELECT event_id, MIN(frame) AS f0, MAX(frame) AS f9 FROM wf GROUP BY event_id)"
TURNOVER_CD = """cd AS (SELECT * FROM (SELECT ec.*, ROW_NUMBER() OVER (PARTITION BY team_possession_id ORDER BY frame_start, event_id) AS rn FROM ec
  WHERE event_type = 'player_possession' AND end_type = 'possession_loss' AND x_start > 0 AND match_id IN (SELECT match_id FROM tk)) WHERE rn = 1)"""
RECOVERY = """
on_ AS (SELECT wp.event_id, wp.pid FROM wp JOIN ff ON ff.event_id = wp.event_id AND wp.frame = ff.f0 WHERE pteam = team_id AND ppos IN ('LW','RW','LM','RM')),
sel AS (SELECT wp.* FROM wp JOIN on_ ON on_.event_id = wp.event_id AND on_.pid = wp.pid)"""
RECOVERY_BEST = """
rp AS (SELECT event_id, pid, MAX(n) AS n, COALESCE(MAX(SQRT(vx * vx + vy * vy) * 3.6) FILTER (WHERE vx < 0), 0) AS peak, arg_min(sx, frame) - arg_max(sx, frame) AS net,
         COALESCE(SUM(step), 0) AS dist FROM pm GROUP BY ALL HAVING MAX(n) >= 10),
rb AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY peak DESC, pid) AS rk FROM rp) WHERE rk = 1)"""


@query("recovery_run", O.with_base(POS, O.CHAIN_IDS, TURNOVER_CD, gate_sql(0, 100, 0.50), FIRST, RECOVERY, SERIES, RECOVERY_BEST, select="""
SELECT cw.event_id, COALESCE(net >= 5 AND peak >= 15, FALSE) AS matched, ROUND(peak, 3) AS value, CASE WHEN rb.event_id IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status,
  rb.pid AS winger, ROUND(net, 4) AS net_retreat, ROUND(dist, 3) AS distance, net >= 5 AS tracked_back,
  CASE WHEN rb.event_id IS NOT NULL THEN f0 END AS evidence_lo, CASE WHEN rb.event_id IS NOT NULL THEN f9 END AS evidence_hi, cw.n_frames
FROM cw LEFT JOIN rb ON rb.event_id = cw.event_id LEFT JOIN ff ON ff.event_id = cw.event_id"""))
def recovery_run(spark, sf):
    r = measured(spark, sf, 66)
    return r.select("event_id", "matched", F.round("value", 3).alias("value"), "status", "winger", F.round("net_retreat", 4).alias("net_retreat"),
                    F.round("distance", 3).alias("distance"), "tracked_back", "evidence_lo", "evidence_hi", "n_frames")


@query("question_66", O.with_base(POS, O.CHAIN_IDS, TURNOVER_CD, gate_sql(0, 100, 0.50), FIRST, RECOVERY, SERIES, RECOVERY_BEST, select="""
SELECT event_id, ROUND(peak, 3) AS value FROM rb WHERE net >= 5"""))
def question_66(spark, sf):
    return tracked(spark, sf, 66).select("event_id", F.round("value", 3).alias("value"))


BEHIND_CD = """cd AS (SELECT * FROM (SELECT ec.*, ROW_NUMBER() OVER (PARTITION BY match_id, player_id, team_possession_id ORDER BY frame_start, event_id) AS rn FROM ec
  WHERE event_type = 'off_ball_run' AND event_subtype {sub} AND player_position IN ('CF','LF','RF') AND match_id IN (SELECT match_id FROM tk)) WHERE rn = 1)"""
RACE = """
on_ AS (SELECT wp.event_id, wp.pid FROM wp JOIN ff ON ff.event_id = wp.event_id AND wp.frame = ff.f0 WHERE pteam <> team_id AND ppos IN ('CB','LCB','RCB')),
sel AS (SELECT wp.* FROM wp WHERE pid = player_id OR EXISTS (SELECT 1 FROM on_ WHERE on_.event_id = wp.event_id AND on_.pid = wp.pid))"""
RACE_BEST = """
pr AS (SELECT c.event_id, c.pid, c.frame, c.vx AS cvx, c.vy AS cvy, r.vx AS rvx, r.vy AS rvy, SQRT(POWER(c.x - r.x, 2) + POWER(c.y - r.y, 2)) AS sep
       FROM pm c JOIN pm r ON r.event_id = c.event_id AND r.frame = c.frame AND r.pid = r.player_id WHERE c.pid <> c.player_id AND c.vx IS NOT NULL AND r.vx IS NOT NULL AND c.n >= 12 AND r.n >= 12),
rc AS (SELECT event_id, pid, MAX(SQRT(rvx * rvx + rvy * rvy) * 3.6) FILTER (WHERE cvx > 0 AND rvx > 0) AS peak_runner, MAX(SQRT(cvx * cvx + cvy * cvy) * 3.6) FILTER (WHERE cvx > 0 AND rvx > 0) AS peak_back,
         AVG((cvx * rvx + cvy * rvy) / (SQRT(cvx * cvx + cvy * cvy) * SQRT(rvx * rvx + rvy * rvy))) FILTER (WHERE cvx > 0 AND rvx > 0) AS cosine,
         arg_min(sep, frame) AS sep_start, arg_max(sep, frame) AS sep_end, MIN(frame) AS lo9, MAX(frame) AS hi9 FROM pr GROUP BY ALL HAVING COUNT(*) >= 12),
rr AS (SELECT * FROM (SELECT *, LEAST(peak_runner, peak_back) AS score, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY LEAST(peak_runner, peak_back) DESC, pid) AS rk FROM rc WHERE peak_runner IS NOT NULL) WHERE rk = 1)"""
RACE_CTES = (POS, O.CHAIN_IDS, BEHIND_CD.format(sub="= 'behind'"), gate_sql(10, 30, 0.50), FIRST, RACE, SERIES, RACE_BEST)


@query("foot_race", O.with_base(*RACE_CTES, select="""
SELECT cw.event_id, COALESCE(cosine >= 0.6 AND score >= 15, FALSE) AS matched, ROUND(score, 3) AS value, CASE WHEN rr.event_id IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status,
  rr.pid AS centre_back, ROUND(peak_runner, 3) AS peak_runner, ROUND(peak_back, 3) AS peak_back, ROUND(cosine, 4) AS cosine, ROUND(sep_start, 4) AS sep_start, ROUND(sep_end, 4) AS sep_end,
  lo9 AS evidence_lo, hi9 AS evidence_hi, cw.n_frames FROM cw LEFT JOIN rr ON rr.event_id = cw.event_id"""))
def foot_race(spark, sf):
    r = measured(spark, sf, 59)
    return r.select("event_id", "matched", *[F.round(c, 3).alias(c) for c in ("value", "peak_runner", "peak_back")], "status", "centre_back",
                    *[F.round(c, 4).alias(c) for c in ("cosine", "sep_start", "sep_end")], "evidence_lo", "evidence_hi", "n_frames")


@query("question_59", O.with_base(*RACE_CTES, select="SELECT event_id, ROUND(score, 3) AS value FROM rr"))
def question_59(spark, sf):
    return tracked(spark, sf, 59).select("event_id", F.round("value", 3).alias("value"))


PULLING_CD = BEHIND_CD.format(sub="IN ('dropping_off','pulling_wide','pulling_half_space','coming_short')")
DRAG = """
ln_ AS (SELECT wp.event_id, wp.pid, ppos IN ('CB','LCB','RCB') AS back FROM wp JOIN ff ON ff.event_id = wp.event_id AND wp.frame = ff.f0
       WHERE pteam <> team_id AND ppos IN ('CB','LCB','RCB','LB','RB','LWB','RWB')),
dn_ AS (SELECT wp.event_id, wp.pid, wp.frame, wp.x, wp.y, ln_.back, bl.base_x, bl.base_y, COUNT(*) OVER (PARTITION BY wp.event_id, wp.pid) AS n FROM wp
       JOIN ln_ ON ln_.event_id = wp.event_id AND ln_.pid = wp.pid LEFT JOIN bl ON bl.match_id = wp.match_id AND bl.player_id = wp.pid),
dq_ AS (SELECT event_id, pid, frame, x, y, back, SQRT(POWER(-x - base_x, 2) + POWER(-y - base_y, 2)) AS off FROM dn_ WHERE n >= 12 AND base_x IS NOT NULL),
rq_ AS (SELECT * FROM (SELECT wp.event_id, wp.frame, wp.x, wp.y, SQRT(POWER(wp.x - base_x, 2) + POWER(wp.y - base_y, 2)) AS off, COUNT(*) OVER (PARTITION BY wp.event_id) AS n
       FROM wp LEFT JOIN bl ON bl.match_id = wp.match_id AND bl.player_id = wp.pid WHERE wp.pid = wp.player_id) WHERE n >= 12),
ok_ AS (SELECT event_id FROM ln_ GROUP BY event_id HAVING COUNT(*) >= 3 AND BOOL_OR(back)
       INTERSECT SELECT event_id FROM dq_ GROUP BY event_id HAVING COUNT(DISTINCT pid) >= 3 INTERSECT SELECT event_id FROM rq_),
gr_ AS (SELECT dq_.event_id, frame AS f, ROW_NUMBER() OVER (PARTITION BY dq_.event_id ORDER BY frame) AS k FROM dq_ JOIN ok_ ON ok_.event_id = dq_.event_id
       JOIN (SELECT event_id, MIN(pid) AS p0 FROM dq_ GROUP BY event_id) z ON z.event_id = dq_.event_id AND z.p0 = dq_.pid),
sr_ AS (SELECT event_id, pid, back, frame, x, y, off FROM dq_ UNION ALL SELECT event_id, -1, FALSE, frame, x, y, off FROM rq_),
pk_ AS (SELECT DISTINCT gr_.event_id, sr_.pid, sr_.back, k, f FROM gr_ JOIN sr_ ON sr_.event_id = gr_.event_id),
nb_ AS (SELECT pk_.*, (SELECT MAX(frame) FROM sr_ WHERE sr_.event_id = pk_.event_id AND sr_.pid = pk_.pid AND frame <= f) AS fa,
              (SELECT MIN(frame) FROM sr_ WHERE sr_.event_id = pk_.event_id AND sr_.pid = pk_.pid AND frame >= f) AS fb FROM pk_),
ii_ AS (SELECT nb_.event_id, nb_.pid, nb_.back, k, f, CASE WHEN COALESCE(fb, fa) > COALESCE(fa, fb) THEN (f - fa) * 1.0e0 / (fb - fa) ELSE 0 END AS u,
              a.x AS ax, a.y AS ay, a.off AS ao, b.x AS bx2, b.y AS by2, b.off AS bo FROM nb_
       JOIN sr_ a ON a.event_id = nb_.event_id AND a.pid = nb_.pid AND a.frame = COALESCE(fa, fb) JOIN sr_ b ON b.event_id = nb_.event_id AND b.pid = nb_.pid AND b.frame = COALESCE(fb, fa)),
ip_ AS (SELECT event_id, pid, back, k, f, ax + (bx2 - ax) * u AS x, ay + (by2 - ay) * u AS y, ao + (bo - ao) * u AS off FROM ii_),
ex_ AS (SELECT c.event_id, c.pid, c.k, c.f, c.off - (SELECT MEDIAN(o.off) FROM ip_ o WHERE o.event_id = c.event_id AND o.k = c.k AND o.pid NOT IN (-1, c.pid)) AS rel,
              SQRT(POWER(c.x - r.x, 2) + POWER(c.y - r.y, 2)) AS gap, r.off AS moved
       FROM ip_ c JOIN ip_ r ON r.event_id = c.event_id AND r.k = c.k AND r.pid = -1 WHERE c.back),
ga_ AS (SELECT ex_.*, rel - FIRST_VALUE(rel) OVER w AS gained, FIRST_VALUE(gap) OVER w - gap AS closed, rel - AVG(rel) OVER (PARTITION BY event_id, pid) AS b_,
              moved - AVG(moved) OVER (PARTITION BY event_id, pid) AS a_ FROM ex_ WINDOW w AS (PARTITION BY event_id, pid ORDER BY k)),
lg_ AS (SELECT a.event_id, a.pid, b.k - a.k AS lag, SUM(a.a_ * b.b_) AS dot FROM ga_ a JOIN ga_ b ON b.event_id = a.event_id AND b.pid = a.pid GROUP BY ALL),
ld_ AS (SELECT event_id, pid, lag FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, pid ORDER BY dot DESC, lag) AS rk FROM lg_ WHERE dot IS NOT NULL) WHERE rk = 1),
pe_ AS (SELECT event_id, pid, arg_max(closed, gained) AS closed, MAX(gained) AS growth, MIN(f) AS lo9, MAX(f) AS hi9 FROM ga_ GROUP BY ALL),
be_ AS (SELECT * FROM (SELECT pe_.*, ld_.lag, ROW_NUMBER() OVER (PARTITION BY pe_.event_id ORDER BY growth DESC, pe_.pid) AS rk FROM pe_ LEFT JOIN ld_ ON ld_.event_id = pe_.event_id AND ld_.pid = pe_.pid) WHERE rk = 1)"""
DRAG_CTES = (POS, O.CHAIN_IDS, BASELINE_SQL, PULLING_CD, gate_sql(10, 30, 0.50), FIRST, DRAG)


@query("pulling_runs", O.with_base(POS, O.CHAIN_IDS, PULLING_CD, select="SELECT event_id, match_id, player_id, team_possession_id FROM cd"))
def pulling_runs(spark, sf):
    return lake.candidates(spark, sf, 56).select("event_id", "match_id", "player_id", "team_possession_id")


@query("dragged_out_of_position", O.with_base(*DRAG_CTES, select="""
SELECT cw.event_id, COALESCE(closed > 0 AND lag > 0 AND growth >= 5, FALSE) AS matched, ROUND(growth, 3) AS value, CASE WHEN be_.event_id IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status,
  be_.pid AS centre_back, ROUND(closed, 3) AS closed, CAST(lag AS DOUBLE) AS lead_frames, lo9 AS evidence_lo, hi9 AS evidence_hi, cw.n_frames
FROM cw LEFT JOIN be_ ON be_.event_id = cw.event_id"""))
def dragged_out_of_position(spark, sf):
    r = measured(spark, sf, 56)
    return r.select("event_id", "matched", *[F.round(c, 3).alias(c) for c in ("value", "closed")], "status", "centre_back", "lead_frames", "evidence_lo", "evidence_hi", "n_frames")


@query("question_56", O.with_base(*DRAG_CTES, select="SELECT event_id, ROUND(growth, 3) AS value FROM be_ WHERE closed > 0 AND lag > 0 AND growth >= 5"))
def question_56(spark, sf):
    return tracked(spark, sf, 56).select("event_id", F.round("value", 3).alias("value"))


BOX_EVENTS = f"""{D.tracked_events_cte()},
cd AS (SELECT et.*, CAST(NULL AS VARCHAR) AS game_interruption_before FROM et WHERE x_start IS NOT NULL)"""
BOX = """
bx_ AS (SELECT cw.event_id, wp.x, wp.y, wp.plen FROM cw JOIN wp ON wp.event_id = cw.event_id AND wp.frame = cw.frame_start AND wp.pid = cw.player_id)"""


def box_candidates(spark, sf):
    return lake.table(spark, sf, "box_candidates", lambda: _box_candidates(spark, sf))


def _box_candidates(spark, sf):
    ev = lake.tracked_events(spark, sf).where(F.col("x_start").isNotNull())
    return E.add_zone_flags(ev.withColumns({c: F.lit(None).cast("double") for c in ("x_end", "y_end", "player_targeted_x_reception", "player_targeted_y_reception")}),
                            D.matches(spark, sf)).select(*ev.columns, "own_penalty_area_start")


@query("player_in_own_box", O.with_base(POS, BOX_EVENTS, gate_sql(0, 0, 0.70), BOX, select="""
SELECT cw.event_id, COALESCE(x < -(plen_ / 2 - 16.5) AND ABS(y) <= 20.16, FALSE) AS matched, ROUND(x, 4) AS value, CASE WHEN x IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status
FROM cw LEFT JOIN (SELECT event_id, x, y, plen AS plen_ FROM bx_) b ON b.event_id = cw.event_id"""))
def player_in_own_box(spark, sf):
    r = P.evaluate(box_candidates(spark, sf), P.player_in_own_box(), P.WindowPolicy(), lake.tracking(spark, sf))
    return r.select("event_id", "matched", F.round("value", 4).alias("value"), "status")


@query("source_agreement", O.with_base(POS, BOX_EVENTS, gate_sql(0, 0, 0.70), BOX, select="""
SELECT COUNT(*) AS resolved, COUNT(*) FILTER (WHERE a) AS agree, COUNT(*) FILTER (WHERE g <= 1) AS concordant, COUNT(*) FILTER (WHERE g <= 1 AND a) AS concordant_agree,
  COUNT(*) FILTER (WHERE g <= 1 AND o >= 1) AS clean, COUNT(*) FILTER (WHERE g <= 1 AND o >= 1 AND a) AS clean_agree,
  COUNT(*) FILTER (WHERE g <= 1 AND o >= 1 AND a) >= 0.99 * COUNT(*) FILTER (WHERE g <= 1 AND o >= 1) AS passes
FROM (SELECT (b.x < -(plen / 2 - 16.5) AND ABS(b.y) <= 20.16) = (cd.x_start < -(plen / 2 - 16.5) AND ABS(cd.y_start) <= 20.16) AS a,
  SQRT(POWER(cd.x_start - b.x, 2) + POWER(cd.y_start - b.y, 2)) AS g, LEAST(ABS(cd.x_start + plen / 2 - 16.5), ABS(ABS(cd.y_start) - 20.16)) AS o
  FROM bx_ b JOIN cd ON cd.event_id = b.event_id)"""))
def source_agreement(spark, sf):
    m = D.matches(spark, sf).select("match_id", "pitch_length")
    cand = box_candidates(spark, sf)
    r = P.evaluate(cand, P.player_in_own_box(), P.WindowPolicy(), lake.tracking(spark, sf))
    return P.agreement(r.join(m, "match_id"))


@query("tracked_report", O.with_base(POS, CORNER_CD.format(tag="corner_against"), gate_sql(250, 80, 0.10), DELIVERY, CONTACT, select="""
SELECT (SELECT COUNT(*) FROM cw) AS candidates, COUNT(*) AS resolved, COUNT(*) FILTER (WHERE NOT (first_def OR COALESCE(gap <= 2.5, FALSE))) AS hits,
  ROUND(COUNT(*) FILTER (WHERE NOT (first_def OR COALESCE(gap <= 2.5, FALSE))) * 1.0e0 / NULLIF(COUNT(*), 0), 6) AS share FROM c4"""))
def tracked_report(spark, sf):
    return P.report(corner_result(spark, sf, "corner_against", P.first_ball_contested()), negate=True).withColumn("share", F.round("share", 6))


def _whole_report_sql() -> str:
    """Hits and matches of the questions on phase shape and tracking, next to those on events."""
    rows = [ORACLES["question_report"], "SELECT 17, COUNT(*), COUNT(DISTINCT match_id) FROM (" + ORACLES["question_17"] + ")"]
    match = O.with_base(select="SELECT event_id, match_id FROM ev")
    for q in (56, 59, 66, 68, 70):
        rows.append(f"SELECT {q}, COUNT(*), COUNT(DISTINCT match_id) FROM ({ORACLES[f'question_{q}']}) JOIN ({match}) USING (event_id)")
    return "SELECT qid, hits, matches FROM (" + ") UNION ALL SELECT * FROM (".join(rows) + ")"


@query("whole_report", _whole_report_sql())
def whole_report(spark, sf):
    from checks.spec_queries import phases
    gold = lake.gold_events(spark, sf)
    return Q.run_all_questions(gold, shape.phase_shape(phases(spark, sf)), lake.tracking(spark, sf, True),
                               {q: lake.candidates(spark, sf, q, gold) for q in P.QUESTIONS}).select("qid", "hits", "matches")
