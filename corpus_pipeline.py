"""A training-corpus pipeline over ``documents``: quality rules, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the documents of the next stage.  All stages but the last
return the columns of ``documents``.

Defined results beyond those of the operators: a document that loses words keeps the rest of its text
as it is and gets a new ``n_chars``; the near-duplicate stage keeps one row of each group, whether or not ids repeat or are null.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, decontaminate, quality_rules, simhash, substring
from touchline.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.select(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id (null last), then the smallest hash of its columns; of equal rows one."""
    none = F.col("doc_id").isNull()
    number = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    mark = F.struct(none.alias("none"), number.alias("id"), F.sha2(F.to_json(F.struct(*COLUMNS)), 256).alias("hash"))
    marked = docs.select(*COLUMNS, mark.alias("_mark"))
    first = simhash.groups(marked, key="_mark").where("_mark = component_id").groupBy("_mark").agg(F.count("*").alias("_rows"))
    kept = marked.join(scratch(first, "first"), "_mark")
    return kept.where("_rows = 1").select(COLUMNS).unionAll(kept.where("_rows > 1").dropDuplicates(["_mark"]).select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 or more words that an earlier one holds."""
    cut = substring.remove_repeats(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return found.where(F.size("hit") == 0).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, whose decoding equals the text."""
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=tuple(COLUMNS))
    return done.select(*COLUMNS, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                       F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: Fingerprints and token ids have no SQL form; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
