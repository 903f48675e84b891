"""Classifiers by held-out accuracy, archives by round trip, URL rules and the pipeline by brute force."""
import hashlib
import io
import random
import re
import struct
import uuid
import zlib

import brute as B
import pytest
import zstandard

import corpus_pipeline
from touchline.llm import compression, toxicity, urls, warc
from touchline.llm.queries import URL_RULES

SF = "/root/testdata/sf0.01"


def marked_docs(spark, mark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 80))]
        y = rng.random() < 0.4
        if y:
            w = mark(rng, w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, q) for k, q, _ in labels)


def accuracy(got, truth, held):
    some = [(r["predicted"], truth(k)) for k, r in got.items() if r["held_out"]]
    assert all(r["held_out"] == held(k) for k, r in got.items()) and len(some) > 100
    assert all(0 <= r["score"] <= 1 for r in got.values())
    return sum(a == b for a, b in some) / len(some)


def test_compression_learns(spark):
    docs, labels, good = marked_docs(spark, lambda rng, w: [x + "$$&&" for x in w])
    got = {r["doc_id"]: r for r in compression.classify(docs, labels).collect()}
    assert accuracy(got, good.get, lambda k: zlib.crc32(str(k).encode()) % 3 == 1) > 0.97
    flipped = labels.withColumn("quality", labels.quality).where("crc32(cast(doc_id as string)) % 3 <> 1")
    again = {r["doc_id"]: r["score"] for r in compression.classify(docs, flipped).collect()}
    assert all(again[k] == r["score"] for k, r in got.items())  # held-out labels are not read


def test_toxicity_learns(spark):
    docs, labels, good = marked_docs(spark, lambda rng, w: w[:5] + ["zz", rng.choice(["qq", "rr"])] + w[5:])
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert accuracy(got, lambda k: 1 - good[k], lambda k: zlib.crc32(str(k).encode()) % 4 == 2) > 0.95
    model = toxicity.fit([(r["text"], 1 - good[r["doc_id"]]) for r in docs.collect()])
    assert len(model.place) < 200


@pytest.mark.parametrize("module", [compression, toxicity])
def test_classifiers_without_labels_and_on_odd_rows(spark, module, odd_docs, empty_docs, clash):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert module.classify(empty_docs, one).count() == 0
    for labels in (none, one):
        assert module.classify(odd_docs, labels).count() == 6
    assert all(r["score"] == 0.5 for r in module.classify(odd_docs, none).collect())
    assert module.classify(clash, none).count() == clash.count()


def pages_rows():
    big = "<p>" + "é" * 700 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (7, None, big), (3, "u\r\nv", "short"), (4, "x", "short"), (5, "y", None), (6, "z", ""), (None, "q", big), (9, "w", "<b>" + "x" * 300_000 + "</b>"), (10, "w", "a\r\n\r\nb" * 300)]


def test_archives_round_trip(spark, tmp_path):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "bundles")
    warc.write(pages, path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    for key, url, html in rows:
        raw, r = (html or "").encode(), got[key]
        revisit = html == rows[0][2] and key != 7
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
        assert bytes(r["payload"]) == (b"" if revisit else raw)
    index = warc.index(spark, path)
    some = {r["page_id"]: bytes(r["payload"]) for r in warc.fetch(spark, path, index.where("page_id in (4, 9)")).collect()}
    assert some == {4: b"short", 9: rows[8][2].encode()}


def test_bundles_are_seekable_streams(spark, tmp_path):
    path = str(tmp_path / "bundles")
    warc.write(spark.createDataFrame([(i, "u", "x" * 5000 + str(i)) for i in range(300)], "page_id long, url string, html string").repartition(1), path)
    (row,) = warc.bundles(spark, path).collect()
    content = bytes(row["content"])
    assert struct.unpack("<I", content[-4:])[0] == 0x8F92EAB1
    table = warc.seek_table(content)
    assert len(table) > 3 and sum(t[1] for t in table) + 8 + 8 * len(table) + 9 == len(content)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response") == 300 and len(whole) == sum(t[2] for t in table)


def test_archive_of_no_pages_and_of_other_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none).count() == 0
    clash = spark.createDataFrame([(1, "u", "h", "x", 3), (1, "u", "h", "x", 3)], "page_id long, url string, html string, payload string, frame long")
    assert warc.archive(clash).count() == 2


def judged(url):
    url = url or ""
    rest = url[url.find("://") + 3:] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(text), text, verdict) for verdict, text in URL_RULES for h, _, p in [text.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_trees(spark):
    odd = [(1, None), (2, ""), (3, "no scheme/a"), (4, "http://A.EXAMPLE.ORG/en/1?x#y"), (5, "http://com/de/"), (6, "x://org"), (7, "http://notorg/"), (8, "http://é.org/\n/z?://"), (9, "http://b.com/de/x"), (9, "http://b.com/de/x")]
    more = [(100 + i, f"https://h{i}.example.{t}/{p}/{i}.html") for i, (t, p) in enumerate([(t, p) for t in ("com", "net", "org") for p in ("de", "fr", "es", "en")] * 10)]
    pages = spark.createDataFrame(odd + more, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "0D AS probability", "'y' AS html")
    got = urls.judge(pages, URL_RULES).collect()
    assert len(got) == len(odd) + len(more)
    truth = dict(odd + more)
    for r in got:
        host, path, rule, verdict = judged(truth[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_urls_without_labelled_ones(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    assert urls.judge(pages, URL_RULES).first()["verdict"] == "allow"
    assert urls.judge(pages, [("block", "x.net/b")]).first()["verdict"] == "allow"
    both = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://x.net/b")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(both, [("block", "x.net/b")]).collect()} == {"block"}
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0


def test_pipeline_stage_by_stage(spark):
    import duckdb
    from touchline.llm.common import scratch
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        docs = scratch(out, f"test-{uuid.uuid4().hex[:6]}")
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
    before, after = seen["quality rules"]
    assert not any(B.base_quality(r["text"])[5] for r in after.values()) and after.items() <= before.items()
    before, after = seen["SimHash near-dedup"]
    keys = sorted(before)
    tops = B.groups([B.fingerprint(before[k]["text"]) for k in keys])
    assert set(after) == {keys[t] for t in tops} and after.items() <= before.items()
    before, after = seen["substring dedup"]
    keys = sorted(before)
    assert set(keys) == set(after)
    for key, (n, removed, kept) in zip(keys, B.repeats([(k, before[k]["text"]) for k in keys])):
        assert B.words(after[key]["text"]) == B.words(kept)
        assert after[key]["text"] == before[key]["text"] if not removed else after[key]["n_chars"] == len(after[key]["text"])
    before, after = seen["benchmark decontamination"]
    assert set(after) == {k for k, r in before.items() if not B.contamination(r["text"], items)[1]} and after.items() <= before.items()
    before, after = seen["BPE encoding and decoding"]
    assert set(before) == set(after) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in after.values())


def test_near_duplicates_keeps_one_row_of_each_group(spark, odd_docs):
    """Repeated rows, shared ids and null ids: five groups of text, one row each, and a row with an id before one without."""
    from conftest import DOCS
    lone = " ".join(f"lone{i}" for i in range(90))
    extra = [(None, lone, "en", "s", 3), (None, lone, "de", "s", 3), (None, "solo " * 9, "en", "s", 4)]
    got = corpus_pipeline.near_duplicates(spark, odd_docs.unionAll(spark.createDataFrame(extra, DOCS)), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    rows = [(r["doc_id"], (r["text"] or "")[:5]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([(5, "w0 w1"), (5, "other"), (None, ""), (None, "lone0"), (None, "solo ")], key=repr)


def test_pipeline_on_odd_documents(spark, odd_docs, empty_docs):
    for docs in (odd_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
