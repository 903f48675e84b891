"""Ranked search, mixing and hard negatives against plain versions, with the odd cases."""
import math
import random
import re
from collections import Counter, defaultdict

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing, negatives, ranking

LEXICAL = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ ranked search
def plain_ranking(rows, items, k=10):
    counted = [(key, Counter(LEXICAL.findall(B.low(text)))) for key, text in rows]
    counted = [(key, c) for key, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in LEXICAL.findall(B.low(text)) if c[t])
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank, r[2], -r[0]) for rank, r in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **kw):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.rank(docs, items, **kw).collect()), key=repr)


def passages(rows, n=25):
    rng = random.Random(4)
    out = []
    for i in range(n):
        w = (rng.choice(rows)[1] or "").split()
        at = rng.randrange(max(1, len(w) - 12))
        out.append((i, " ".join(w[at:at + 12])))
    return out + [(90, None), (91, ""), (92, "none-of-these unheardof"), (93, "The THE the"), (94, "A"), (90, rows[9][1])]


def test_ranking_equals_brute_force(spark, docs, rows):
    items = passages(rows)
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_ranking([r[:2] for r in rows], items)


@pytest.mark.parametrize("change", [{"SEEDS": 1, "BLOCK": 2}, {"REACH": 1}, {"CELLS": 1}, {"PART_BYTES": 300}])
def test_ranking_does_not_depend_on_its_sizes(spark, docs, rows, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(ranking, name, value)
    items = passages(rows, 8)
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_ranking([r[:2] for r in rows], items)


def test_blocks_are_skipped_and_their_bounds_hold(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(3, 30)))) for i in range(3000)]
    rows += [(5000 + i, f"rare{i} rarer needle " + rows[i][1]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    part = ranking.Part([(1, "needle rarer a bb ccc"), (2, "q z")])
    counted = ranking.vectors(docs, part, "doc_id", "text").cache()
    df = np.zeros(len(part.code), np.int64)
    for r in counted.select(F.explode("_codes").alias("c")).groupBy("c").count().collect():
        df[r["c"]] = r["count"]
    n, total = counted.count(), counted.agg(F.sum("_n")).first()[0]
    part.weigh(df, n)
    ordered = ranking.impacts(counted, part, n, total).orderBy("_key").withColumn("_mark", F.monotonically_increasing_id()).cache()
    most = np.full(len(part.code), 1000000, np.int64)
    least = ranking.seeds(ordered, part, 10)
    goals = ranking.Goals(part, most, least)
    index = ranking.blocks(ordered, goals, len(part.code)).collect()
    opened = ranking.open_blocks(spark.createDataFrame(index, "_term int, _members array<long>, _summary array<int>"), goals).collect()
    assert least[0] > 0 and set(df[list(goals.lists)]) >= {12}
    assert len(opened) < sum(len(goals.lists[r["_term"]][5]) for r in index)  # some bounds fail
    vector = {r["_mark"]: dict(zip(r["_codes"], r["_impacts"])) for r in ordered.collect()}
    for r in index:
        assert all(v[r["_term"]] > 0 for v in map(vector.get, r["_members"])) and len(r["_members"]) <= ranking.BLOCK
        coords = goals.lists[r["_term"]][0].tolist()
        assert r["_summary"] == [max(vector[m].get(c, 0) for m in r["_members"]) for c in coords]
    items = [(1, "needle rarer a bb ccc"), (2, "q z")]
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_ranking(rows, items)


def test_ranking_of_odd_tables(spark, docs, odd_docs, empty_docs, clash, rows):
    items = spark.createDataFrame([(1, "w1 w2 other tail"), (1, "w1 w2 other tail"), (None, "w3")], "item_id long, text string")
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert searched(odd_docs, items) == plain_ranking(odd, [(1, "w1 w2 other tail"), (1, "w1 w2 other tail"), (None, "w3")])
    assert searched(empty_docs, items) == [] and searched(docs, items.limit(0)) == []
    few = passages(rows, 3)
    named = spark.createDataFrame(few, "item_id long, text string").selectExpr("*", "1 AS score", "1 AS rank", "1 AS doc_id")
    assert searched(clash.selectExpr("*", "1 AS item_id", "1 AS rank"), named) == plain_ranking([r[:2] for r in rows], few)
    long = [(i, ("ab " * 50_000) + "x" * 100_000 + f" cd{i}") for i in range(3)]
    assert searched(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame([(1, "cd1 ab cd2")], "item_id long, text string")) == plain_ranking(long, [(1, "cd1 ab cd2")])
    named = spark.createDataFrame([(str(k), t) for k, t in long], "doc_id string, text string")
    assert [r["doc_id"] for r in ranking.rank(named, spark.createDataFrame([("i", "cd1")], "item_id string, text string")).collect()] == ["1"]


# ------------------------------------------------------------------ mixing
def plain_targets(sizes, percent=150):
    """Targets by resharing the excess until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()) * percent / 100, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def mixed(docs, **kw):
    return sorted((tuple(r) for r in mixing.mix(docs, **kw).collect()), key=repr)


def random_docs(seed=1, n=900):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 50 else None, rng.choice(["hot"] * 6 + ["Zoo", "a", "b", "ß", "\U0001F600", "￮", None, "tiny"] if i % 90 else ["one"])) for i in range(n)]


def test_mix_follows_targets(spark):
    rows = random_docs()
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert sorted(r[0] for r in got) == [r[0] for r in rows]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    aims, taken = plain_targets(sizes), Counter()
    for key, source, size, whole, target, took in got:
        assert size == len((rows[key][1] or "").split()) and source == rows[key][2] and whole == sizes[source]
        assert target == pytest.approx(aims[source]) and took in (0, size, 2 * size)
        taken[source] += took
    assert all(abs(taken[s] - aims[s]) <= 40 for s in sizes)
    assert sum(sizes.values()) * 1.5 - 40 <= sum(taken.values()) <= sum(sizes.values()) * 1.5
    assert mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(2)) == got


def test_mix_takes_the_head_of_the_queue(spark):
    rows = random_docs(2, 300)
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    place = {s: i for i, s in enumerate(sorted({r[2] for r in rows if r[2]}, key=lambda s: s.encode("utf-32-be")) + [None])}
    queue, by_source = [], defaultdict(list)
    for r in got:
        by_source[r[1]].append(r)
    for source, some in by_source.items():
        done = 0
        some.sort(key=lambda r: int(__import__("hashlib").md5(f"11:{r[0]}".encode()).hexdigest()[:15], 16))
        for epoch in (0, 1):
            for r in some:
                done += r[2]
                if r[2]:
                    queue.append((done / r[4], place[source], epoch, r[0], r[2]))
    budget, total, taken = sum(r[2] for r in got) * 1.5, 0, Counter()
    for _, _, _, key, size in sorted(queue):
        total += size
        if total <= budget:
            taken[key] += size
    assert {r[0]: r[5] for r in got} == {r[0]: taken[r[0]] for r in got}


def test_mix_of_odd_tables(spark, odd_docs, empty_docs, clash, docs):
    assert mixed(empty_docs) == [] and mixed(clash) == mixed(docs)
    got = mixed(odd_docs)
    assert len(got) == odd_docs.count() and all(r[5] in (0, r[2], 2 * r[2]) for r in got)
    words = spark.createDataFrame([(1, None, "a"), (2, " \n", "b")], "doc_id long, text string, source string")
    assert [r[2:] for r in mixed(words)] == [(0, 0, 0.0, 0)] * 2
    copies = spark.createDataFrame([(7, "x y z", "a")] * 40 + [(None, "x", None)] * 25 + [("8", "p " * 20000, "a")][:0] + [(9, "p " * 20000, "long")], "doc_id long, text string, source string")
    got = mixed(copies)
    assert len(got) == 66 and sum(r[5] for r in got) <= 1.5 * (120 + 25 + 20000) and max(r[5] for r in got if r[0] == 9) in (0, 20000, 40000)
    named = spark.createDataFrame([("d1", "x y", "a"), ("d2", "z", "b")], "doc_id string, text string, source string")
    assert sorted(r[0] for r in mixed(named)) == ["d1", "d2"]


# ------------------------------------------------------------------ hard negatives
def plain_negatives(rows, every=50):
    some = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        mine = (label, [math.floor(256 * float(x)) for x in vector])
        some[key] = min(some.get(key, mine), mine)
    out = []
    for a, (label, v) in some.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in some.items()}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if some[b][0] == label and b != a][:5]:
            hard = [b for b in order if some[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:3]
            out += [(a, p, rank, b, score[p], score[b]) for rank, b in enumerate(hard, 1)]
    return sorted(out)


def mined(df, every=50, **kw):
    return sorted(tuple(r) for r in negatives.mine(negatives.noisy(df), F.col("_id") % every == 0, **kw).collect())


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def random_vectors(seed, n, dims, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * 0.2
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i, [float(np.float32(x)) for x in centres[label] + rng.normal(size=dims) * 0.12], label))
    return rows


@pytest.mark.parametrize("dims", [1, 13, 64])
def test_negatives_equal_brute_force(spark, dims):
    rows = random_vectors(dims, 700, dims)
    rows = [(key, rows[key % 11][1] if key % 3 == 0 else v, 4 if key % 3 == 0 else label) for key, v, label in rows]  # a third are copies
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(4)
    assert mined(df) == plain_negatives(rows) != []
    assert mined(df, anchor_rows=5, candidate_rows=40) == plain_negatives(rows)


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for bits, dims in ((1, 8), (2, 3), (9, 64), (31, 17)):
        a, c = (rng.integers(-(1 << bits - 1), 1 << bits - 1, (n, dims)) for n in (7, 50))
        assert (negatives.scores(negatives.tables(a), negatives.planes(c, bits)) == c @ a.T).all()


def test_negatives_of_odd_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.5], 1), (3, [0.3, 0.3], 2), (4, [0.3, 0.3], 3), (5, [0.3, 0.3], 2), (6, [0.2, 0.9], 2), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2),
            (10, [None, 1.0], 2), (11, None, 2), (12, [0.3, 0.3], None), (None, [0.3, 0.3], 2), (3, [0.3, 0.3], 2), (50, [], 2), (100, [-0.5, -0.5], 1), (150, [0.0], 5), (151, [0.0, 0.0], 5), (15, [0.4], 2)]
    df = spark.createDataFrame(rows, EMBEDDINGS)
    assert mined(df) == plain_negatives(rows) != []
    assert mined(df.selectExpr("*", "1 AS _i", "1 AS _j", "1 AS score", "1 AS rank", "1 AS id", "1 AS _ids")) == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 1")) == [] and mined(df.where("vec_id = 0")) == []
    twice = [(1, [0.9], 1), (1, [0.1], 1), (0, [1.0], 1), (2, [0.6], 3)]
    assert mined(spark.createDataFrame(twice, EMBEDDINGS)) == plain_negatives(twice)
    huge = [(key, [v * 10.0 for v in vector], label) for key, vector, label in random_vectors(3, 120, 200)]
    assert mined(spark.createDataFrame(huge, EMBEDDINGS), every=40) == plain_negatives(huge, 40)
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark.createDataFrame([(0, [1e12, 1e12], 1), (1, [1e12, 1.0], 1)], EMBEDDINGS))
