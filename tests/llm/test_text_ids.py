"""Operators on tables whose ids are text."""
import brute as B
from pyspark.sql import functions as F

from touchline.llm import substring, suffix_tree, warc
from touchline.llm.common import discard, scratch


def test_passages_with_text_ids(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [("b", shared + " tail"), ("a", "head " + shared), ("c", shared[:40] + " short"), ("d", shared.replace("s30", "other") + " " + shared), (None, shared)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = B.repeats([r for r in rows if r[0] is not None])
    assert [got[r[0]][:2] for r in rows[:4]] == [tuple(w[:2]) for w in want]
    assert got["a"][1] == 0 and got["b"][1] == 60 and got["d"][1] == 60 and got[None][1] == 0


def test_archive_with_text_ids(spark):
    big = "x" * 1500
    rows = [("none", "u", big), ("a b/é>", "u", big), ("", None, "small"), (None, "u", None), ("z", "u", "y" * 2000)]
    got = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got["a b/é>"]["refers_to"] == "none" and got["a b/é>"]["record_type"] == "revisit"
    assert all(got[k]["record_type"] == "response" and got[k]["refers_to"] is None for k in ("none", "", None, "z"))


def test_discarded_tables_are_gone(spark):
    table = scratch(spark.range(10), "gone")
    files = table.inputFiles()
    discard(table)
    fs = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.getParent())


def test_suffix_tree_keeps_no_superseded_table(spark, docs, tmp_path, monkeypatch):
    from touchline.llm import common
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    one = {r["doc_id"]: r["score"] for r in suffix_tree.digests(docs).collect()}
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["asked", "asked", "contexts", "numbers", "pairs", "texts", "words"]
    assert len(one) == docs.count() and docs.where(F.col("text").isNull()).count() > 0
