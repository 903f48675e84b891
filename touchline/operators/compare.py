"""Compare two result sets by key, and describe distributions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import exact_percentiles


def result_set_verdict(truth: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """truth_rows, got_rows, recall, jaccard, blowup and verdict of ``got`` against ``truth``.

    Both sides meet in one grouped pass with a side flag, so nothing is paired.
    """
    sides = truth.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("g")).unionByName(
        got.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("g")))
    per_key = sides.groupBy(*keys).agg(F.max("t").alias("t"), F.max("g").alias("g"))
    n = per_key.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("truth_rows"), F.coalesce(F.sum("g"), F.lit(0)).alias("got_rows"),
        F.coalesce(F.sum(F.col("t") * F.col("g")), F.lit(0)).alias("both"), F.count(F.lit(1)).alias("either"))
    t, p = F.col("truth_rows"), F.col("got_rows")
    recall = F.try_divide(F.col("both"), t)
    verdict = (
        F.when((p == 0) & (t > 0), "SILENT ZERO")
        .when((recall >= 0.9) & (p <= 1.5 * t), "equivalent")
        .when(recall >= 0.9, "superset").when(recall >= 0.5, "partial").otherwise("misses"))
    return n.select("truth_rows", "got_rows", recall.alias("recall"), F.try_divide(F.col("both"), F.col("either")).alias("jaccard"),
                    F.try_divide(p, t).alias("blowup"), verdict.alias("verdict"))


def top_k(df: DataFrame, value: str, k: int, tiebreak: Sequence[str], descending: bool = True) -> DataFrame:
    """The k best rows; Spark keeps k per task before the final merge."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.orderBy(order, *tiebreak).limit(k)


def seeded_sample(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """n rows chosen by a hash of the key and the seed: the same rows on every run and every cluster."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))), *key).limit(n)


def summary(df: DataFrame, value: str, probs: Mapping[str, float], level_width: float, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact percentiles and max of a measure."""
    by = list(by)
    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    pct = exact_percentiles(df, by, value, probs, level_width).drop("n")
    names = ["count", "mean", "std", "min", *probs, "max"]
    both = stats.unionByName(pct, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])


def band_histogram(df: DataFrame, value: str, bands: Sequence[tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per band; a band runs from its lower edge to the next one."""
    label = F.lit(None).cast("string")
    for name, lower in bands:
        label = F.when(F.col(value) >= lower, F.lit(name)).otherwise(label)
    counts = df.withColumn("band", label).where(F.col("band").isNotNull()).groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n"))
    # one row per group and band is left, so the total is a window over a handful of rows
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
