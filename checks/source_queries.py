"""Conformance and gates on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import driver_tables as D
from checks import lake
from checks import oracle as O
from checks.registry import query
from touchline.plans import tracking as T
from touchline.sources import conform as C
from touchline.sources import gates as G

LINE_EVENTS = {
    "match_id": "l_orderkey", "event_id": "l_linenumber", "event_type": "CASE WHEN l_returnflag = 'N' AND l_tax = 0 THEN NULL ELSE l_returnflag END",
    "frame_start": "l_partkey", "frame_end": "l_partkey + CAST(l_quantity AS BIGINT) - 3", "team_id": "l_suppkey"}
ORDER_MATCHES = {"match_id": "o_orderkey", "home_team_id": "o_custkey % 7", "away_team_id": "o_custkey % 7 + 50"}


@query("quality_gates", f"""
WITH e AS ({D._layer(LINE_EVENTS, 'lineitem', False)}), m AS ({D._layer(ORDER_MATCHES, 'orders', False)})
SELECT 'null_match_id' AS gate, 'fail' AS severity, COUNT(*) FILTER (WHERE match_id IS NULL) AS n_bad FROM e
UNION ALL SELECT 'null_event_id', 'fail', COUNT(*) FILTER (WHERE event_id IS NULL) FROM e
UNION ALL SELECT 'null_event_type', 'fail', COUNT(*) FILTER (WHERE event_type IS NULL) FROM e
UNION ALL SELECT 'null_frame_start', 'fail', COUNT(*) FILTER (WHERE frame_start IS NULL) FROM e
UNION ALL SELECT 'null_frame_end', 'fail', COUNT(*) FILTER (WHERE frame_end IS NULL) FROM e
UNION ALL SELECT 'null_team_id', 'fail', COUNT(*) FILTER (WHERE team_id IS NULL) FROM e
UNION ALL SELECT 'frame_order', 'fail', COUNT(*) FILTER (WHERE frame_end < frame_start) FROM e
UNION ALL SELECT 'duplicate_keys', 'fail', (SELECT COUNT(*) FROM e) - (SELECT COUNT(*) FROM (SELECT DISTINCT match_id, event_id FROM e))
UNION ALL SELECT 'team_not_in_match', 'fail', COUNT(*) FROM (SELECT DISTINCT match_id, team_id FROM e) p WHERE NOT EXISTS
  (SELECT 1 FROM m WHERE m.match_id = p.match_id AND p.team_id IN (m.home_team_id, m.away_team_id))
UNION ALL SELECT 'match_coverage', 'fail', (SELECT COUNT(*) FROM (SELECT match_id FROM e WHERE match_id IS NOT NULL EXCEPT SELECT match_id FROM m)) + (SELECT COUNT(*) FROM (SELECT match_id FROM m EXCEPT SELECT match_id FROM e))""")
def quality_gates(spark, sf):
    e = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*[f"{x} AS {n}" for n, x in LINE_EVENTS.items()])
    m = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*[f"{x} AS {n}" for n, x in ORDER_MATCHES.items()])
    return G.event_gates(e, m)


@query("conform_types", """
SELECT 'flag' AS "column", COUNT(*) FILTER (WHERE l_quantity >= 25) AS trues, COUNT(*) FILTER (WHERE l_quantity < 25 AND l_linenumber <> 3) AS falses,
  COUNT(*) FILTER (WHERE NOT l_quantity >= 25 AND l_linenumber = 3) AS nulls, 'boolean' AS type FROM lineitem
UNION ALL SELECT 'mixed', COUNT(*) FILTER (WHERE l_returnflag = 'A'), 0, 0, 'string' FROM lineitem""")
def conform_types(spark, sf):
    q = F.col("l_quantity") >= 25
    text = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.when(q, "True").when(F.col("l_linenumber") != 3, "False").alias("flag"),
        F.when(F.col("l_returnflag") == "A", "True").otherwise("other").alias("mixed"))
    df = C.conform(text)
    flag = F.col("flag")
    one = df.agg(F.count_if(flag.cast("string") == "true").alias("t"), F.count_if(flag.cast("string") == "false").alias("f"), F.count_if(flag.isNull()).alias("n"),
                 F.count_if(F.col("mixed") == "True").alias("m"))
    kind = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    rows = F.array(
        F.struct(F.lit("flag").alias("column"), F.col("t").alias("trues"), F.col("f").alias("falses"), F.col("n").alias("nulls"), F.lit(kind["flag"]).alias("type")),
        F.struct(F.lit("mixed").alias("column"), F.col("m").alias("trues"), F.lit(0).cast("bigint").alias("falses"), F.lit(0).cast("bigint").alias("nulls"), F.lit(kind["mixed"]).alias("type")))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("tracked_matches", O.with_base(D.positions_cte(), select="SELECT DISTINCT match_id FROM tk"))
def tracked_matches(spark, sf):
    return T.tracked_matches(lake.frame_index(spark, sf))


@query("frame_inventory", O.with_base(D.positions_cte(), select="SELECT match_id, COUNT(*) AS n_frames, CAST(SUM(u) AS BIGINT) AS n_usable FROM fr GROUP BY match_id"))
def frame_inventory(spark, sf):
    return lake.frame_index(spark, sf).where(F.col("bucket") == T.EXTENT).select("match_id", F.col("req").alias("n_frames"), F.col("use").alias("n_usable"))


@query("conform_numbers", """
SELECT 'whole' AS "column", 'bigint' AS type, COUNT(*) FILTER (WHERE l_linenumber = 2) AS equal_two, COUNT(*) FILTER (WHERE l_linenumber >= 2) AS from_two FROM lineitem
UNION ALL SELECT 'fraction', 'double', COUNT(*) FILTER (WHERE l_discount = 0.02), COUNT(*) FILTER (WHERE l_discount >= 0.02) FROM lineitem
UNION ALL SELECT 'mixed', 'string', COUNT(*) FILTER (WHERE l_linenumber = 2), 0 FROM lineitem""")
def conform_numbers(spark, sf):
    """Numbers that arrive as text (also as ``2.0``) answer eq and gte filters."""
    from touchline.functions import filters as X
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = lines.select(F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("whole"), F.col("l_discount").cast("string").alias("fraction"),
                        F.when(F.col("l_linenumber") == 2, "2").otherwise("other").alias("mixed"))
    df = C.conform(text)
    kind = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    out = None
    for column, value in (("whole", 2), ("fraction", 0.02), ("mixed", "2")):
        equal = X.execute(df, [{"column": column, "op": "eq", "value": value}])
        row = equal.agg(F.count(F.lit(1)).alias("equal_two"))
        least = X.execute(df, [{"column": column, "op": "gte", "value": value}]).agg(F.count(F.lit(1)).alias("n")) if column != "mixed" else df.agg(F.lit(0).cast("bigint").alias("n"))
        both = row.select(F.lit(column).alias("column"), F.lit(kind[column]).alias("type"), "equal_two", F.lit(0).cast("bigint").alias("from_two")).unionByName(
            least.select(F.lit(column).alias("column"), F.lit(kind[column]).alias("type"), F.lit(0).cast("bigint").alias("equal_two"), F.col("n").alias("from_two")))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("column", "type").agg(F.sum("equal_two").alias("equal_two"), F.sum("from_two").alias("from_two"))
