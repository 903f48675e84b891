"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target: its share, by weight, of ``budget_percent`` of all words, at most
``MAX_EPOCHS`` times its own size; what a source cannot take is shared again among the others by
weight.  The documents of a source are shuffled (by a hash of the id) and queue ``MAX_EPOCHS`` times
over; a document's virtual finish time is the number of words of its source up to its end divided by
the target.  All sources are then sorted together by finish time, and the mix takes the head of that
order up to the total budget, so each source is served in proportion to its target at every moment.

Everything is DataFrame and SQL functions.  Equal units (same source, id and size) are combined before
the first shuffle and stand one behind another in the queue.  Orders are made by ``in_ranges``: range
partitions found by Spark's sampling and written down with their number, so running sums need only the
totals of earlier ranges; no source, however large, meets in one task.

Defined results: a null text has size 0 and a document without words takes nothing.  A null source is a
source of its own and the last in order; sources weigh by their place in code point order.  Rows that
repeat an id queue one behind another; null ids likewise.  Documents are taken whole: the first one that
would exceed the budget and all behind it are left out.  An empty table gives an empty mix; where no
document has words, targets are 0.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import scratch, whole_text
from touchline.operators.ordered import running_sum

WORD = r"[^\x20\x09-\x0D]+"
#: The weights of the sources by their place, repeating, and the budget in percent of all words.
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def shuffled(key: str, seed: int) -> Column:
    """A number of 60 bits from a hash of the id, equal in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def in_ranges(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` range-partitioned in ``order`` and written, each row with the number of its range (``_range``).

    The ranges are written because their bounds are drawn anew whenever a plan runs again.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    return scratch(dealt.withColumn("_range", F.spark_partition_id()), name)


def cumulated(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], name: str) -> DataFrame:
    """Running sums in ``order`` (which begins with ``by``), of any number of rows per ``by``."""
    ranged = in_ranges(df, order, name)
    inner = [F.col(c).asc_nulls_last() for c in order if c not in by]
    return running_sum(ranged, by, [F.col("_range")], inner, sums).drop("_range")


def targets(units: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_none, _source, source_size, target) of each source.

    Sources are ordered by the words they can give per weight: those in front fill up and get all they
    can give, the others share the rest by weight.  A source fills up if its share, were all in front of it
    full, exceeds what it can give; the sums in front of a source decide that without iterating.
    """
    sizes = units.groupBy("_none", "_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    placed = cumulated(sizes, [], ["_none", "_source"], {"_place": F.lit(1)}, "sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights)).cast("int"))
    rated = placed.withColumn("_w", weight.cast("long")).withColumn("_can", F.col("source_size") * max_epochs)
    rated = rated.withColumn("_rate", F.col("_can") / F.col("_w"))
    ordered = cumulated(rated, [], ["_rate", "_place"], {"_can_to": F.col("_can"), "_w_to": F.col("_w")}, "rates")
    weights_all, budget = rated.agg(F.sum("_w")).scalar(), rated.agg(F.sum("source_size") * budget_percent / 100).scalar()
    # the level if this source and all behind it share what those in front leave over
    level = (budget - (F.col("_can_to") - F.col("_can"))) / (weights_all - (F.col("_w_to") - F.col("_w")))
    front = scratch(ordered.withColumn("_level", level), "levels")
    shared = front.where("_level <= _rate").agg(F.min(F.struct("_rate", "_place", "_level"))["_level"]).scalar()
    return front.withColumn("_shared", shared).select(
        "_none", "_source", "_place", "source_size",
        F.when(F.col("_shared").isNull() | (F.col("_rate") < F.col("_shared")), F.col("_can").cast("double")).otherwise(F.col("_w") * F.col("_shared")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, weights: Sequence[int] = WEIGHTS,
        budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row of ``docs``; ``taken`` counts repeats."""
    sized = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_text_source"), n_words(text).alias("_size"))
    named = sized.select("_key", F.col("_text_source").isNull().alias("_none"), F.coalesce("_text_source", F.lit("")).alias("_source"), "_size")
    units = named.groupBy("_none", "_source", "_key", "_size").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shuffle", shuffled("_key", seed))
    units = in_ranges(units, ["_none", "_source", "_shuffle", "_key", "_size"], "units")
    aims = scratch(targets(units, weights, budget_percent, max_epochs), "targets")

    # words of the source up to the end of each unit, in the shuffled order
    ended = running_sum(units, ["_none", "_source"], [F.col("_range")], [F.col(c).asc_nulls_last() for c in ("_shuffle", "_key", "_size")],
                        {"_end": F.col("_size") * F.col("_n")}).drop("_range")
    queued = ended.where("_size > 0").join(aims, ["_none", "_source"]).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    queued = queued.withColumn("_finish", (F.col("_epoch") * F.col("source_size") + F.col("_end")) / F.col("target"))
    queued = queued.select("_finish", "_place", "_epoch", "_shuffle", "_key", "_size", "_n")
    served = cumulated(queued, [], ["_finish", "_place", "_epoch", "_shuffle", "_key", "_size"], {"_total": F.col("_size") * F.col("_n")}, "queue")

    budget = aims.agg(F.sum("source_size") * budget_percent / 100).scalar()
    room = budget - (F.col("_total") - F.col("_size") * F.col("_n"))
    # the unit that is cut counts whole in the running sum, so behind it there is no room
    fits = F.least(F.col("_n"), F.floor(room / F.col("_size"))).cast("long")
    taken = served.withColumn("_fits", fits).where("_fits > 0")
    counts = taken.groupBy("_place", "_shuffle", "_key", "_size").agg(F.collect_list("_fits").alias("_counts"))
    marked = units.drop("_range").join(aims, ["_none", "_source"])
    ids = [F.col("u._place").eqNullSafe(F.col("c._place")), F.col("u._shuffle") == F.col("c._shuffle"), F.col("u._key").eqNullSafe(F.col("c._key")), F.col("u._size") == F.col("c._size")]
    found = marked.alias("u").join(counts.alias("c"), ids, "left").select("u.*", "c._counts")
    # of equal rows, the first ones are taken once more than the others
    rows = found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    times = F.coalesce(F.aggregate("_counts", F.lit(0).cast("long"), lambda total, n: total + (F.col("_i") <= n).cast("long")), F.lit(0).cast("long"))
    return rows.select(F.col("_key").alias(key), F.when(~F.col("_none"), F.col("_source")).alias(source), F.col("_size").alias("size"), "source_size", "target",
                       (times * F.col("_size")).alias("taken"))
