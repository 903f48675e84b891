"""Join helpers: lookups over nullable keys and absence questions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions over which rows with a null key are spread, at most.
NULL_SALTS = 4096


def left_lookup(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], spread_by: Column) -> DataFrame:
    """Left equi-join whose null keys do not all hash to one task.

    A null key matches nothing, but a plain left join still sends every such row to the same
    partition.  The keys keep their types; a salt that is 0 for whole keys and spread by ``spread_by``
    for null ones joins the key.
    """
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    left = df.withColumn("__salt", F.when(missing, F.pmod(F.hash(spread_by), F.lit(NULL_SALTS)) + 1).otherwise(0))
    right = lookup.withColumnsRenamed({r: f"__rk{i}" for i, r in enumerate(on.values())}).withColumn("__rsalt", F.lit(0))
    cond = F.col("__salt") == F.col("__rsalt")
    for i, key in enumerate(on):
        cond = cond & (F.col(key) == F.col(f"__rk{i}"))
    return left.join(right, cond, "left").drop("__salt", "__rsalt", *[f"__rk{i}" for i in range(len(on))])


def without(rows: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absence: rows whose key has no counterpart.  The present keys are made distinct first."""
    return rows.join(present.select(*keys).distinct(), list(keys), "left_anti")


def without_other(rows: DataFrame, present: DataFrame, keys: Sequence[str], other: str) -> DataFrame:
    """Absence of a counterpart with the same key but a *different* ``other`` value.

    min and max of ``other`` per key decide the inequality, so no pair of rows is ever built:
    somebody else is present iff the smallest or the largest ``other`` differs from the row's own.
    """
    span = present.where(F.col(other).isNotNull()).groupBy(*keys).agg(
        F.min(other).alias("__lo"), F.max(other).alias("__hi")
    )
    joined = rows.join(span, list(keys), "left")
    someone_else = F.col("__lo").isNotNull() & (
        F.col(other).isNull() | (F.col("__lo") != F.col(other)) | (F.col("__hi") != F.col(other))
    )
    return joined.where(~F.coalesce(someone_else, F.lit(False))).drop("__lo", "__hi")
