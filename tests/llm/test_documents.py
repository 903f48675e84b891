"""Operators on documents against brute force, with the odd cases."""
import math
import zlib

import brute as B
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import bpe, decontaminate, quality_rules, simhash, substring, suffix_tree
from touchline.llm.common import components

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_tokenizers_library(docs, rows):
    lib = Tokenizer.from_file(PATH)
    got = by_id(bpe.digests(docs, PATH))
    for key, text, *_ in rows:
        e = lib.encode(text or "", add_special_tokens=False).ids
        r = got[key]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(e), B.sha(",".join(map(str, e))), B.sha(lib.decode(e, skip_special_tokens=False)))


def test_bpe_of_hard_strings():
    lib, own = Tokenizer.from_file(PATH), bpe.Codec(bpe.load(PATH))
    for text in ("a" * 3000, "the" * 999, "աբ กำ ힰx", "    x", "1234567 '' 's'LL", "\r\n\r\n  \n", "\U00030000Ᲊ", "<|endoftext|><|endoftext|> x"):
        ids = [int(i) for i in memoryview(own.encode(text)).cast("i")]
        assert ids == lib.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == text
    assert own.decode([222, 222]) == lib.decode([222, 222], skip_special_tokens=False)


def test_encode_then_decode_is_the_text(docs, rows):
    done = by_id(bpe.decode(bpe.encode(docs, PATH), PATH))
    assert all(done[key]["decoded"] == (text or "") for key, text, *_ in rows)


def test_base_rules(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.verdicts(docs, labels))
    for key, text, *_ in rows:
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == B.base_quality(text), key
        assert r["kept"] is (not r["base_failed"])


def test_binomial_tail(spark):
    def exact(k, n, p):
        return sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
    cases = [(0, 100, 0.05), (3, 400, 0.05), (1, 1000, 0.05), (40, 1000, 0.05)]
    for k, n, p in cases:
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.at_most("k", "n", p)).first()[0]
        assert got == pytest.approx(exact(k, n, p), rel=1e-9)
    assert spark.createDataFrame([(60, 1000)], "k long, n long").select(quality_rules.at_most("k", "n", 0.05)).first()[0] == 1.0
    big = spark.createDataFrame([(400, 10_000_000)], "k long, n long").select(quality_rules.at_most("k", "n", 0.01)).first()[0]
    assert big == 0.0


def test_cutoffs_bound_false_rejections(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(4000)]
    bad = [(i, " ".join(f"w{i}x{j}###" for j in range(30)), "en") for i in range(4000, 4400)]
    some = [(i, " ".join(f"w{i}x{j}#" for j in range(30)), "fr") for i in range(5000, 5200)]
    docs = spark.createDataFrame(good + bad + some, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 4000 or k >= 5000), 0) for k, *_ in good + bad + some], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.verdicts(docs, labels))
    assert not any(got[k]["kept"] for k, *_ in bad)
    assert sum(not got[k]["kept"] for k, *_ in good) <= 40
    assert all(got[k]["kept"] for k, *_ in some)  # too few good documents to prove a cutoff


def test_quality_plan_is_native(docs, spark):
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_rules.select(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_select_keeps_rows_and_columns(docs, clash, spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.select(clash, labels)
    assert kept.columns == clash.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t, *_ in rows if not B.base_quality(t)[5]}


def test_substring(docs, rows):
    want = B.repeats([(k, t) for k, t, *_ in rows])
    got = by_id(substring.digests(docs))
    assert sum(w[1] for w in want) > 500
    for (key, *_), (n, removed, kept) in zip(rows, want):
        assert (got[key]["n_words"], got[key]["n_removed"], got[key]["kept_sha256"]) == (n, removed, B.sha(kept)), key


def test_substring_of_odd_rows(odd_docs):
    got = substring.remove_repeats(odd_docs).collect()
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in got)
    assert removed == [(0, 0), (0, 0), (5, 0), (5, 0), (5, 0), (9, 120)]
    assert next(r["kept"] for r in got if r["doc_id"] == 9) == " tail"


def test_fingerprints_and_groups(docs, rows):
    prints = [B.fingerprint(t) for _, t, *_ in rows]
    tops = B.groups(prints)
    got = by_id(simhash.digests(docs))
    assert len(set(tops)) < len(rows)
    for (key, *_), p, top in zip(rows, prints, tops):
        assert (got[key]["fingerprint"], got[key]["component_id"]) == (f"{p:016x}", rows[top][0])


@pytest.mark.parametrize("blocks,part", [(1, 4096), (1, 7), (2, 4096)])
def test_links_in_a_crowd_of_near_fingerprints(spark, blocks, part):
    import random
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        p = centre if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    tops = B.groups(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), blocks, part)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    for i in range(len(prints)):
        for j in range(i):
            same = root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])
            assert same == (tops[i] == tops[j])


def test_components_of_a_chain(spark):
    edges = spark.range(400).selectExpr("(id * 37) % 401 AS a", "((id + 1) * 37) % 401 AS b")
    assert {r["root"] for r in components(edges).collect()} == {0}
    assert components(edges.where("false")).count() == 0


def test_decontamination(spark, docs, rows):
    taken = " ".join(B.words(rows[6][1])[3:40])
    items = [(1, taken), (2, "never seen anywhere at all in these words ok fine yes"), (3, "changed"), (10, taken), (None, B.words(rows[7][1])[0]), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.digests(docs, bench))
    parts = by_id(decontaminate.hits(docs, bench, part_bytes=200))
    hit_any = 0
    for key, text, *_ in rows:
        n, hit, found = B.contamination(text, items)
        ids = sorted(str(i) for i in found if i is not None)
        r = got[key]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids), B.sha(",".join(ids)), hit > 0), key
        assert (len(parts[key]["hit"]), parts[key]["items"]) == (hit, ids)
        hit_any += hit > 0
    assert hit_any


def test_suffix_tree_base_and_gain(docs, rows):
    got = by_id(suffix_tree.digests(docs))
    want = B.base_scores([(k, t) for k, t, *_ in rows])
    for (key, *_), (held, n, known, train, base) in zip(rows, want):
        r = got[key]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_suffix_tree_states_sum_to_one(spark, docs):
    held = suffix_tree.held_out("doc_id", 5, 1)
    words = suffix_tree.word_counts(docs, held)
    n = words.agg({"n": "sum"}).first()[0]
    v = words.where("n > 0").count()
    tree = suffix_tree.grow(docs, words, held, n, v, "text", 2)
    import numpy as np
    everything = words.where("n > 0").collect()
    base = np.log10(np.array([r["n"] for r in everything] + [0]) + 0.5) - math.log10(n + 0.5 * (v + 1))
    number = tree.number()
    ids = np.array([number[r["word"].encode()] for r in everything] + [-1])
    level = tree.levels[0]
    assert level.retained.any()
    for state in np.flatnonzero(level.retained)[:5]:
        before = int(level.contexts[state])
        total = 0.0
        for i, b in zip(ids, base):
            pair = np.array([before, i])
            total += 10 ** float(tree.score(np.array([0.0, b]), pair, np.array([0]))[1])
        assert total == pytest.approx(1.0, abs=1e-9)


def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(spark):
    """A context seen 40 times is a state beside three million other tokens too, and its next tokens are listed."""
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, "x " * 75_000 + ("alpha beta gamma" if at < 40 else "")) for at, i in enumerate(learnt)] + [(held, "x alpha beta gamma")]
    r = by_id(suffix_tree.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))[held]
    assert r["held_out"] and r["train_tokens"] > 4_000_000
    # beta and gamma are near-certain after alpha and beta; at the root each has a probability of about 1e-5
    assert r["score"] - r["base_score"] > 9


OPERATORS = {
    "bpe": lambda d, s: bpe.digests(d, PATH),
    "quality": lambda d, s: quality_rules.verdicts(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    "substring": lambda d, s: substring.digests(d),
    "simhash": lambda d, s: simhash.digests(d),
    "decontaminate": lambda d, s: decontaminate.digests(d, s.createDataFrame([(1, "a b c")], "item_id long, text string")),
    "suffix_tree": lambda d, s: suffix_tree.digests(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_clashing_and_odd_tables(spark, empty_docs, docs, clash, odd_docs, name):
    run = OPERATORS[name]
    assert run(empty_docs, spark).count() == 0
    assert run(odd_docs, spark).count() == odd_docs.count()
    plain, other = run(docs, spark), run(clash, spark)
    assert plain.columns == other.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.collect()))
