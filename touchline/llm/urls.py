"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule is (verdict, host and path prefix).  It fits its host and all subdomains if the URL's path starts
with its path; the longest rule that fits decides (the order of equally long ones is that of their text).
URLs with a rule are labelled URLs: the trees are trained on them and judge the others.

Features: lengths of URL, host and path, depth, number of host labels, hyphens and parameters, digit ratio, entropy of the
characters, and suffix statistics: the smoothed share of blocked labelled URLs under the same last host
label and under the same file extension.  All are SQL functions; the trees are Spark's distributed ones,
trained on all labelled URLs, and the suffix statistics are joined on the suffix.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule.  If the
labelled URLs are all of one kind, that is the verdict of the others; without any it is ``allow``.  Repeated
rows are judged alike; other columns are not read.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters counted for the entropy; all others count as one.
COUNTED = LOWER + "0123456789-._/?=&%:#"
#: Labelled URLs that the prior share of blocked ones weighs in a suffix statistic.
PRIOR = 20
TREES, DEPTH, STEP = 20, 4, 0.2
#: Labelled rows of one training partition.
PARTITION_ROWS = 25_000
FEATURES = ["_url_length", "_host_length", "_path_length", "_depth", "_labels", "_hyphens", "_parameters", "_digit_ratio", "_entropy", "_suffix_rate", "_extension_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def ruled(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def count_of(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the features but the suffix statistics, and the two suffixes."""
    url = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    size = F.length(url)
    df = urls.withColumns({f"_c{i}": count_of(url, c) for i, c in enumerate(COUNTED)})
    counts = [F.col(f"_c{i}") for i in range(len(COUNTED))]
    counts.append(size - sum(counts[1:], counts[0]))
    terms = [F.when(c > 0, -(c / size) * F.log2(c / size)).otherwise(0.0) for c in counts]
    at = {c: F.col(f"_c{i}") for i, c in enumerate(COUNTED)}
    digits = sum((at[d] for d in "123456789"), at["0"])
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    df = df.withColumns({
        "_url_length": size, "_host_length": F.length("host"), "_path_length": F.length("path"),
        "_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "_labels": F.size(F.split("host", r"\.")),
        "_hyphens": at["-"], "_parameters": F.when(query == "", 0).otherwise(count_of(query, "&") + 1),
        "_digit_ratio": F.when(size > 0, digits / size).otherwise(0.0), "_entropy": F.when(size > 0, sum(terms[1:], terms[0])).otherwise(0.0),
        "_suffix": F.substring_index("host", ".", -1), "_extension": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1),
    })
    return df.drop(*[f"_c{i}" for i in range(len(COUNTED))])


def with_rates(df: DataFrame, labelled: DataFrame, prior: float) -> DataFrame:
    """Shares of blocked labelled URLs under the same suffix and the same extension."""
    for suffix, rate in (("_suffix", "_suffix_rate"), ("_extension", "_extension_rate")):
        rates = labelled.groupBy(F.col(suffix).alias("_s")).agg(((F.sum("_blocked") + PRIOR * prior) / (F.count("*") + PRIOR)).alias(rate))
        df = df.join(rates, F.col(suffix) == F.col("_s"), "left").drop("_s").withColumn(rate, F.coalesce(rate, F.lit(prior)))
    return df


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and block_probability (null where a rule decides) of every row."""
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = ruled(rules)
    source = source.withColumns({"rule": rule, "_verdict": verdict})
    known = scratch(lexical(source).withColumn("_blocked", (F.col("_verdict") == "block").cast("double")), "urls")
    labelled = known.where("_verdict is not null")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("_blocked"), F.lit(0.0))).first()
    if blocked in (0.0, float(n)):
        rest = F.lit("block" if n and blocked else "allow")
        return known.select(F.col("_id").alias(key), "host", "path", "rule", F.coalesce("_verdict", rest).alias("verdict"),
                            F.when(F.col("_verdict").isNull(), F.lit(1.0 if n and blocked else 0.0)).alias("block_probability"))
    measured = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(with_rates(known, labelled, blocked / n))
    parts = max(1, min(10_000, int(n) // PARTITION_ROWS))
    model = GBTClassifier(featuresCol="_features", labelCol="_blocked", predictionCol="_predicted",
                          maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=1).fit(measured.where("_verdict is not null").select("_features", "_blocked").repartition(parts))
    ruled_ = measured.where("_verdict is not null").select("_id", "host", "path", "rule", F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    free = model.transform(measured.where("_verdict is null")).select(
        "_id", "host", "path", "rule", F.when(F.col("_predicted") == 1, "block").otherwise("allow").alias("verdict"), vector_second("probability").alias("block_probability"))
    return ruled_.unionAll(free).withColumnRenamed("_id", key)


def vector_second(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return F.get(vector_to_array(F.col(column)), F.lit(1))
