"""The registered queries of this subpackage, with their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, compression, decontaminate, mixing, negatives, quality_rules, ranking, simhash, substring, suffix_tree, toxicity, urls, warc
from touchline.llm.common import table
from touchline.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.digests(table(spark, sf, "documents"))


@query
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.digests(table(spark, sf, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_compression(spark: SparkSession, sf: str) -> DataFrame:
    return compression.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the URL filter query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op10_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


@query
def op8_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.digests(table(spark, sf, "documents"))


@query
def op11_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query
def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mine(negatives.noisy(table(spark, sf, "embeddings")), F.col("_id") % 50 == 0)
