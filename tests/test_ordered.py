"""Blocked ordered operators against brute force, with hot groups, ties and nulls."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import compare as M
from touchline.operators import joins as J
from touchline.operators import ordered as R
from touchline.plans import shape


def sample(spark, seed, n=400, hot=0.4):
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < hot else f"g{rng.randrange(6)}"), rng.randrange(0, 300), i, rng.randrange(0, 2), round(rng.random() * 20, 1) if rng.random() > 0.1 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, t long, id long, flag int, v double")


@pytest.mark.parametrize("seed,widths", [(1, [50]), (2, [100, 10]), (3, [])])
def test_running_sum(spark, seed, widths):
    rows, df = sample(spark, seed)
    levels = [R.block_of("t", w) for w in widths] + [F.col("t")]
    got = {r["id"]: r["c"] for r in R.running_sum(df, ["g"], levels, ["id"], {"c": F.col("flag")}).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += r[3]
            assert got[r[2]] == total


def test_previous_row(spark):
    rows, df = sample(spark, 4)
    got = {r["id"]: r["p"] for r in R.previous_row(df, ["g"], [R.block_of("t", 40), F.col("t")], "id", {"p": "id"}).collect()}
    for g in {r[0] for r in rows}:
        prev = None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[r[2]] == prev
            prev = r[2]


@pytest.mark.parametrize("crowd", [0, 15, 10_000])
def test_only_crowded_blocks_are_split(spark, crowd):
    rows, df = sample(spark, 6)
    df = df.withColumn("d", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(t)"))
    levels = [R.block_of("t", 100), F.col("d"), R.tie_level(df, "id", 7), F.substring(F.col("id").cast("string"), 1, 9)]
    sums = R.running_sum(df, ["g"], levels, ["t", "id"], {"c": F.col("flag")}, crowd)
    got = {r["id"]: r["c"] for r in sums.collect()}
    before = {r["id"]: r["p"] for r in R.previous_row(df, ["g"], levels, ["t", "id"], {"p": "id"}, crowd).collect()}
    for g in {r[0] for r in rows}:
        total, prev = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += r[3]
            assert (got[r[2]], before[r[2]]) == (total, prev)
            prev = r[2]
    split = R._fine_in_crowds(df.select("g", R.block_of("t", 100).alias("__lv0"), F.col("d").alias("__lv1")), ["g"], ["__lv0", "__lv1"], crowd)
    blocks = split.groupBy("g", "__lv0").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__lv1").alias("fine")).collect()
    assert all(b["fine"] == 1 for b in blocks if b["n"] <= crowd) and all(b["fine"] > 1 for b in blocks if b["n"] > max(crowd, 1))


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    rows, df = sample(spark, 5)
    marks = df.where("flag = 1 and id % 7 = 0").select("g", F.col("t").alias("m"))
    mk = {}
    for r in rows:
        if r[3] == 1 and r[2] % 7 == 0:
            mk.setdefault(r[0], set()).add(r[1])
    out = R.asof(df, marks, ["g"], "t", "m", 16, {"a": ("since", None), "b": ("until", None)}, strict=strict)
    for r in out.select("g", "t", F.col("a.at").alias("a"), F.col("b.at").alias("b")).collect():
        before = [m for m in mk.get(r["g"], ()) if (m < r["t"] if strict else m <= r["t"])]
        after = [m for m in mk.get(r["g"], ()) if (m > r["t"] if strict else m >= r["t"])]
        assert r["a"] == (max(before) if before else None) and r["b"] == (min(after) if after else None)


def greedy(values, gap):
    kept = []
    for v in sorted(set(values)):
        if not kept or v - kept[-1] > gap:
            kept.append(v)
    return kept


@pytest.mark.parametrize("seed,gap,span", [(1, 100, 4000), (2, 10, 300), (3, 7, 60), (4, 0, 30), (5, 25, 120)])
def test_greedy_collapse(spark, seed, gap, span):
    rng = random.Random(seed)
    rows = [("a" if rng.random() < 0.6 else "b", rng.randrange(span)) for _ in range(120)]
    got = R.greedy_collapse(spark.createDataFrame(rows, "g string, t long"), ["g"], "t", gap).collect()
    for g in ("a", "b"):
        assert sorted(r["t"] for r in got if r["g"] == g) == greedy([t for k, t in rows if k == g], gap)


def test_greedy_is_not_sessionisation(spark):
    df = spark.createDataFrame([("m", t) for t in (0, 60, 120, 170, 300)], "g string, t long")
    assert sorted(r["t"] for r in R.greedy_collapse(df, ["g"], "t", 100).collect()) == [0, 120, 300]


def test_interval_headcount_counts_shared_boundaries(spark):
    rng = random.Random(9)
    iv = [("a" if rng.random() < 0.7 else "b", s, s + rng.randrange(0, 30), rng.random() < 0.5) for s in (rng.randrange(0, 90) for _ in range(60))]
    df = spark.createDataFrame(iv, "g string, s long, e long, k boolean")
    for r in R.interval_headcount(df, ["g"], "s", "e", 8, {"n": F.col("k")}).collect():
        assert r["n"] == sum(1 for g, s, e, k in iv if g == r["g"] and k and s <= r["boundary"] <= e)


def test_exact_percentiles(spark):
    rows, df = sample(spark, 11)
    out = R.exact_percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 3.0).collect()
    for r in out:
        v = [x[4] for x in rows if x[0] == r["g"] and x[4] is not None]
        assert r["n"] == len(v)
        assert np.allclose([r["p10"], r["p50"], r["p90"]], np.percentile(v, [10, 50, 90]))
    whole = R.exact_percentiles(df, [], "v", {"m": 0.5}, 3.0).first()
    assert np.isclose(whole["m"], np.median([x[4] for x in rows if x[4] is not None]))


def test_relative_to_group_matches_average_rank(spark):
    rows, df = sample(spark, 12)
    pdf = pd.DataFrame(rows, columns=["g", "t", "id", "flag", "v"])
    g = pdf.groupby("g")["v"]
    want = pd.DataFrame({"id": pdf.id, "p": g.rank(pct=True), "z": (pdf.v - g.transform("mean")) / g.transform("std"), "m": g.transform("median")}).set_index("id")
    got = shape.relative_to_group(df, ["g"], "v", ("p", "z", "m"), 2.0).toPandas().set_index("id")[["p", "z", "m"]]
    got = got.loc[want.index]
    assert np.allclose(got.p, want.p, equal_nan=True) and np.allclose(got.z, want.z, equal_nan=True) and np.allclose(got.m.astype(float), want.m)


def test_constant_group_has_no_z(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 1.0)], "g string, v double")
    assert {r["z"] for r in shape.relative_to_group(df, ["g"], "v", ("p", "z", "m")).collect()} == {None}


def test_without_other(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(8)}", rng.randrange(3)) for _ in range(30)]
    present = [(f"k{rng.randrange(8)}", rng.randrange(3)) for _ in range(8)]
    got = J.without_other(spark.createDataFrame(rows, "k string, p long"), spark.createDataFrame(present, "k string, p long"), ["k"], "p").collect()
    want = [r for r in rows if not any(k == r[0] and p != r[1] for k, p in present)]
    assert sorted((r["k"], r["p"]) for r in got) == sorted(want)


def test_left_lookup_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    look = spark.createDataFrame([("a", 10)], "kk string, v long")
    got = {r["id"]: r["v"] for r in J.left_lookup(df, look, {"k": "kk"}, F.col("id")).collect()}
    assert got == {1: 10, 2: None, 3: None}


@pytest.mark.parametrize("truth,got,verdict", [
    (range(10), [], "SILENT ZERO"), (range(10), range(10), "equivalent"), (range(10), range(9), "equivalent"),
    (range(10), range(40), "superset"), (range(10), range(6), "partial"), (range(10), range(2), "misses"), ([], range(3), "misses")])
def test_verdicts(spark, truth, got, verdict):
    t, g = (spark.createDataFrame([(i,) for i in x], "id long") for x in (truth, got))
    assert M.result_set_verdict(t, g, ["id"]).first()["verdict"] == verdict


def test_sample_is_repeatable(spark):
    df = spark.range(200)
    a, b = (sorted(r["id"] for r in M.seeded_sample(d, 20, ["id"], 7).collect()) for d in (df, df.repartition(9)))
    assert a == b and len(a) == 20


@pytest.mark.parametrize("fold", [0, 3, 10 ** 6])
def test_greedy_collapse_by_pointers(spark, fold):
    rng = random.Random(fold)
    rows = [(rng.choice("aab"), rng.randrange(-300, 900) // rng.choice([1, 1, 40])) for _ in range(400)] + [("c", 5), ("c", 5), ("c", None), ("d", None)]
    got = R.greedy_collapse(spark.createDataFrame(rows, "g string, t long"), ["g"], "t", 11, fold=fold, block=4).collect()
    for g in "abcd":
        assert sorted(r["t"] for r in got if r["g"] == g) == greedy([t for k, t in rows if k == g and t is not None], 11)


def test_one_island_of_a_hundred_thousand_markers(spark):
    """Every cell's first offset is smaller than the last one's of the cell before, so nothing splits the island."""
    n, gap = 100_000, 9
    at = F.col("id") * 6 + F.pmod(F.col("id") * 7, F.lit(5))
    df = spark.range(n).select(F.lit("m").alias("g"), at.alias("t"))
    want = greedy([i * 6 + i * 7 % 5 for i in range(n)], gap)
    got = sorted(r["t"] for r in R.greedy_collapse(df, ["g"], "t", gap).collect())
    assert got == want and len(got) > 40_000


def test_asof_rows_without_position_or_key_and_strict_payload(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, 5, 3), ("a", 200, 4), ("b", 7, 5), ("a", -40, 6)], "g string, t int, id int")
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 90, "y"), (None, 5, "z"), ("a", None, "n")], "g string, m long, p string")
    got = {r["id"]: r for r in R.asof(df, marks, ["g"], "t", "m", 16, {"s": ("since", None), "u": ("until", None)}, payload=["p"]).collect()}
    assert {k: (r["s"] and r["s"]["p"], r["u"] and r["u"]["p"]) for k, r in got.items()} == {1: (None, None), 2: ("x", "x"), 3: (None, None), 4: ("y", None), 5: (None, None), 6: (None, "x")}
    strict = {r["id"]: r for r in R.asof(df, marks, ["g"], "t", "m", 16, {"s": ("since", None), "u": ("until", None)}, payload=["p"], strict=True).collect()}
    assert strict[2]["s"] is None and strict[2]["u"]["p"] == "y"
    assert dict(R.asof(df, marks, ["g"], "t", "m", 16, {"s": ("since", None)}).dtypes)["t"] == "int"


def test_asof_has_no_array_of_a_block(spark):
    df = spark.range(10).selectExpr("1L AS g", "id AS t")
    plan = R.asof(df, df, ["g"], "t", "t", 64, {"s": ("since", None)})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan


def test_percentiles_of_counted_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([1.5, 2.0, 2.5, 7.25, 9.0]), rng.randint(1, 5)) for _ in range(80)]
    counted = spark.createDataFrame(rows, "g string, v double, w long")
    plain = spark.createDataFrame([(g, v) for g, v, w in rows for _ in range(w)], "g string, v double")
    probs = {"q": 0.25, "m": 0.5, "p": 0.9}
    a, b = (sorted(map(tuple, R.exact_percentiles(df, ["g"], "v", probs, 2.0, weight=w).collect())) for df, w in ((counted, "w"), (plain, None)))
    assert a == b
