"""Ordered operators that stay parallel when one group holds most of the rows.

A plain ``Window.partitionBy(entity).orderBy(position)`` puts every row of an entity into one task.
The operators here split an entity's axis into *blocks* (order-preserving coarse positions), work
inside a block, and carry a summary of the earlier (or later) blocks into it.  The summary has one
row per block, so the only per-entity window runs over block summaries, never over rows.

Positions are integers (frames), which bounds what one block can hold: a block of ``width`` frames
has at most ``width`` distinct positions, however many rows share them.  Group keys and levels are
expected to be non-null; a row with a null key keeps its place and gets a null result.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import cut_lineage

#: Groups over which rows without a position are spread.
LOST_BLOCKS = 4096
#: Rows of a coarsest block that still meet in one task; only larger ones are split by the finer levels.
CROWD = 1 << 18


def block_of(position: Column | str, width: float) -> Column:
    """Order-preserving coarse position."""
    return F.floor(F.col(position) / F.lit(width) if isinstance(position, str) else position / F.lit(width))


def tie_level(df: DataFrame, tiebreak: str, width: int = 65_536, prefix: int = 8) -> Column:
    """Order-preserving coarse key of a tiebreak column: a range of numbers or the start of a text.

    As the finest level it keeps even a single position that holds most of the rows out of one task.
    """
    kind = df.schema[tiebreak].dataType
    return block_of(tiebreak, width) if isinstance(kind, T.NumericType) else F.substring(F.col(tiebreak).cast("string"), 1, prefix)


def _fine_in_crowds(rows: DataFrame, by: list[str], lv: list[str], crowd: int) -> DataFrame:
    """``rows`` with one finer level for a whole coarsest block, except in blocks of more than ``crowd`` rows.

    Where most finest blocks hold a row or two, their totals are as many as the rows.  What is broadcast are the keys
    of the crowded blocks, at most one for every ``crowd`` rows.
    """
    key = [*by, lv[0]]
    full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowd)
    full = full.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], F.lit(True).alias("__crowded"))
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    told = rows.join(F.broadcast(full), same, "left")
    return told.select(*[F.when(F.col("__crowded"), F.col(c)).otherwise(_some(rows.schema[c].dataType)).alias(c) if c in lv[1:] else F.col(c) for c in rows.columns])


def _some(kind: T.DataType) -> Column:
    """Any one value of a type of levels."""
    return F.lit("1970-01-01" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "0").cast(kind)


# --------------------------------------------------------------------------------------
# running sums
# --------------------------------------------------------------------------------------
def running_sum(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    crowd: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` per ``by`` in the order (``levels``..., ``order``...).

    ``levels`` are order-preserving coarse keys from coarse to fine.  Rows meet only within one
    finest level; everything before it arrives as a carried total.  Give as many levels as it takes
    to make a finest group small (for example frame block, frame, id prefix).  With ``crowd`` only the
    coarsest blocks of more rows than that are split further; ``order`` then names the whole order inside a coarsest block.
    """
    by = list(by)
    lv = [f"__lv{i}" for i in range(len(levels))]
    val = {name: f"__v_{name}" for name in sums}
    rows = df
    for name, expr in zip(lv, levels):
        rows = rows.withColumn(name, expr)
    if crowd is not None:
        rows = _fine_in_crowds(rows, by, lv, crowd)
    for name, expr in sums.items():
        rows = rows.withColumn(val[name], F.coalesce(expr, F.lit(0)))

    # totals per finest block, then the total of everything before each block, level by level
    totals = rows.groupBy(*by, *lv).agg(*[F.sum(v).alias(v) for v in val.values()])
    carry = _carry(totals, by, lv, list(val.values()))

    inside = Window.partitionBy(*by, *lv).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, v in val.items():
        rows = rows.withColumn(name, F.sum(v).over(inside))
    rows = rows.drop(*val.values())
    out = rows.join(carry, [*by, *lv], "left")
    for name, v in val.items():
        out = out.withColumn(name, F.col(name) + F.col(v))
    return out.drop(*lv, *val.values())


def _carry(totals: DataFrame, by: list[str], lv: list[str], vals: list[str]) -> DataFrame:
    """Sum of all earlier blocks for each finest block."""
    before = Window.partitionBy(*by, *lv[:-1]).orderBy(lv[-1]).rowsBetween(Window.unboundedPreceding, -1)
    here = totals.select(*by, *lv, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in vals])
    if len(lv) == 1:
        return here
    upper_totals = totals.groupBy(*by, *lv[:-1]).agg(*[F.sum(v).alias(v) for v in vals])
    upper = _carry(upper_totals, by, lv[:-1], vals)
    upper = upper.select(*by, *lv[:-1], *[F.col(v).alias(v + "_up") for v in vals])
    joined = here.join(upper, [*by, *lv[:-1]])
    return joined.select(*by, *lv, *[(F.col(v) + F.col(v + "_up")).alias(v) for v in vals])


def row_index(df: DataFrame, by: Sequence[str], levels: Sequence[Column], order: Sequence[str | Column], name: str, crowd: int | None = None) -> DataFrame:
    """Dense 1-based row number per ``by`` (a running sum of ones)."""
    return running_sum(df, by, levels, order, {name: F.lit(1)}, crowd)


def previous_row(
    df: DataFrame, by: Sequence[str], levels: Sequence[Column], order: str | Sequence[str], values: Mapping[str, str], crowd: int | None = None
) -> DataFrame:
    """``lag(1)`` per ``by`` in the order (``levels``..., ``order``) with blocks carried like sums.

    ``values`` maps an output column to its source; ``order`` must be unique within a finest level, or, with
    ``crowd``, be the whole order inside a coarsest block (see ``running_sum``).
    """
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    lv = [f"__lv{i}" for i in range(len(levels))]
    rows = df
    for name, expr in zip(lv, levels):
        rows = rows.withColumn(name, expr)
    if crowd is not None:
        rows = _fine_in_crowds(rows, by, lv, crowd)
    rows = rows.withColumn("__row", F.struct(*[F.col(src).alias(out) for out, src in values.items()]))
    last = rows.groupBy(*by, *lv).agg(F.max_by("__row", F.struct(*order)).alias("__row"))
    carry = _carry_last(last, by, lv)
    inside = Window.partitionBy(*by, *lv).orderBy(*order)
    rows = rows.withColumn("__lag", F.lag("__row").over(inside)).drop("__row")
    out = rows.join(carry, [*by, *lv], "left")
    prev = F.coalesce("__lag", "__row")
    return out.select(*df.columns, *[prev[o].alias(o) for o in values])


def _carry_last(last: DataFrame, by: list[str], lv: list[str]) -> DataFrame:
    before = Window.partitionBy(*by, *lv[:-1]).orderBy(lv[-1]).rowsBetween(Window.unboundedPreceding, -1)
    here = last.select(*by, *lv, F.last("__row", ignorenulls=True).over(before).alias("__row"))
    if len(lv) == 1:
        return here
    upper_last = last.groupBy(*by, *lv[:-1]).agg(F.max_by("__row", lv[-1]).alias("__row"))
    upper = _carry_last(upper_last, by, lv[:-1]).withColumnRenamed("__row", "__up")
    joined = here.join(upper, [*by, *lv[:-1]])
    return joined.select(*by, *lv, F.coalesce("__row", "__up").alias("__row"))


# --------------------------------------------------------------------------------------
# as-of lookups
# --------------------------------------------------------------------------------------
def asof(
    df: DataFrame,
    markers: DataFrame,
    by: Sequence[str],
    at: str,
    marker_at: str,
    width: int,
    lookups: Mapping[str, tuple[str, str | None]],
    kind: str | None = None,
    payload: Sequence[str] = (),
    strict: bool = False,
    axis: DataFrame | None = None,
) -> DataFrame:
    """Nearest marker at or before ("since") and at or after ("until") each row.

    Within a block of the axis rows and markers are merged in order, so a row costs the same however
    many markers its block holds; what lies in other blocks comes from one summary row per block.

    ``lookups`` maps an output column to ``(direction, kind)``; markers of several kinds are told
    apart by the ``kind`` column.  Each output is a struct ``(at, <payload>)`` or null.  Ties are
    inclusive in both directions unless ``strict``.  With a payload, markers must be unique on
    (``by``, ``kind``, ``marker_at``); plain positions are made distinct here.  ``axis`` names a
    cheaper table holding the rows' ``by`` and ``at`` values (the untouched source, say), so that
    finding the occupied blocks does not compute ``df`` twice.
    """
    by = list(by)
    kinds = list(dict.fromkeys(k for _, k in lookups.values()))
    cols = [*by, *([kind] if kind else []), marker_at]
    m = markers.where(F.col(marker_at).isNotNull()).dropna(subset=by)
    if not payload:
        m = m.select(*cols).distinct()
    item = F.struct(F.col(marker_at).alias("at"), *[F.col(p) for p in payload])
    mark = {k: f"__m{i}" for i, k in enumerate(kinds)}
    placed = m.select(*by, F.col(marker_at).cast("bigint").alias("__pos"), block_of(marker_at, width).alias("__blk"),
                      *[(item if k is None else F.when(F.col(kind) == k, item)).alias(c) for k, c in mark.items()])

    # inside the block: rows and markers in one order, the nearest marker carried along it in either direction
    apart = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(LOST_BLOCKS))  # rows without a position meet no marker and are spread
    rows = df.withColumn("__row", F.lit(True)).withColumn("__pos", F.col(at).cast("bigint")).withColumn("__blk", block_of(at, width))
    rows = rows.withColumn("__lost", F.when(F.col(at).isNull(), apart))
    merged = rows.unionByName(placed, allowMissingColumns=True)
    group = Window.partitionBy(*by, "__blk", "__lost")
    reach = -1 if strict else Window.currentRow
    order = {"since": group.orderBy("__pos"), "until": group.orderBy(F.col("__pos").desc())}
    near = merged.select("*", *[F.last(mark[k], ignorenulls=True).over(order[way].rangeBetween(Window.unboundedPreceding, reach)).alias("__n_" + out)
                                for out, (way, k) in lookups.items()])
    near = near.where("__row").drop("__row", "__pos", *mark.values())

    # outside: the last marker of an earlier block, the first of a later one
    ends = placed.groupBy(*by, "__blk").agg(*[f(c, F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"{c}_{way}") for c in mark.values() for way, f in (("since", F.max_by), ("until", F.min_by))])
    needed = (df if axis is None else axis).select(*by, block_of(at, width).alias("__blk")).distinct()
    index = needed.unionByName(ends, allowMissingColumns=True).groupBy(*by, "__blk").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ends.columns if c not in (*by, "__blk")])
    blocks = {"since": Window.partitionBy(*by).orderBy("__blk"), "until": Window.partitionBy(*by).orderBy(F.col("__blk").desc())}
    edges = index.select(*by, "__blk", *[F.last(f"{mark[k]}_{way}", ignorenulls=True).over(blocks[way].rowsBetween(Window.unboundedPreceding, -1)).alias("__e_" + out)
                                         for out, (way, k) in lookups.items()])
    found = near.join(edges, [*by, "__blk"], "left")
    return found.select(*df.columns, *[F.when(F.col(at).isNotNull(), F.coalesce("__n_" + out, "__e_" + out)).alias(out) for out in lookups])


# --------------------------------------------------------------------------------------
# marker collapse
# --------------------------------------------------------------------------------------
def greedy_collapse(markers: DataFrame, by: Sequence[str], at: str, gap: int, fold: int = 512, block: int = 4096) -> DataFrame:
    """Keep a marker when it lies more than ``gap`` after the last *kept* one.

    Cells of ``gap + 1`` positions hold at most one kept marker each.  A cell whose predecessor is
    empty, or whose first offset is no smaller than the predecessor's last, keeps its first marker
    whatever came before, so it opens an independent island.  An island of at most ``fold`` markers is folded
    in one row; in a longer one every marker points to the one that is kept after it, and the pointers are
    doubled until the opener has reached the island's end, so no group ever holds a long island.

    Whether there are long islands has to be known, so this runs a job when it is called.
    """
    by = list(by)
    size = gap + 1
    cell = block_of(at, size)
    start = F.col("__cell") * size
    places = markers.where(F.col(at).isNotNull()).select(*by, at).distinct()
    cells = places.groupBy(*by, cell.alias("__cell")).agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumns({"__lo": F.col("__first") - start, "__hi": F.col("__last") - start})
    levels = [block_of("__cell", block)]
    linked = previous_row(cells, by, levels, "__cell", {"__before": "__cell", "__before_hi": "__hi"})
    opens = F.col("__before").isNull() | (F.col("__before") < F.col("__cell") - 1) | (F.col("__lo") >= F.col("__before_hi"))
    numbered = running_sum(linked.withColumn("__opens", opens), by, levels, ["__cell"], {"__island": F.col("__opens").cast("long")})
    sizes = numbered.groupBy(*by, "__island").agg(F.sum("__n").alias("__size"))
    islands = numbered.join(sizes, [*by, "__island"]).select(*by, "__cell", "__island", "__size")
    placed = cut_lineage(places.withColumn("__cell", cell).join(islands, [*by, "__cell"]).drop("__cell"))
    short, long = (placed.where(test).drop("__size") for test in (F.col("__size") <= fold, F.col("__size") > fold))
    kept = F.aggregate(
        F.sort_array(F.collect_list(at)), F.array().cast(f"array<{markers.schema[at].dataType.simpleString()}>"),
        lambda acc, v: F.when((F.size(acc) == 0) | (v - F.try_element_at(acc, F.lit(-1)) > gap), F.array_append(acc, v)).otherwise(acc))
    folded = short.groupBy(*by, "__island").agg(kept.alias("__kept")).select(*by, F.explode("__kept").alias(at))
    if long.isEmpty():
        return folded
    return folded.unionAll(_follow(long, [*by, "__island"], at, gap, size * 64).select(*by, at))


def _follow(places: DataFrame, by: list[str], at: str, gap: int, width: int) -> DataFrame:
    """The places reached from the first of each ``by`` by going to the next place more than ``gap`` ahead, again and again.

    After k rounds the first 2^k steps are taken and each pointer leads 2^k steps on.
    """
    ahead = places.withColumn("__from", F.col(at) + gap + 1)
    found = asof(ahead, places, by, "__from", at, width, {"__next": ("until", None)})
    jump = cut_lineage(found.where(F.col("__next").isNotNull()).select(*by, at, F.col("__next.at").alias("__next")))
    kept = places.groupBy(*by).agg(F.min(at).alias(at))
    while True:
        if jump.isEmpty():
            return kept
        new = kept.join(jump, [*by, at]).select(*by, F.col("__next").alias(at))
        kept = cut_lineage(kept.unionAll(new).repartition(*by, at))
        further = jump.select(*by, F.col(at).alias("__next"), F.col("__next").alias("__then"))
        jump = jump.join(further, [*by, "__next"]).select(*by, at, F.col("__then").alias("__next"))
        jump = cut_lineage(jump.repartition(*by, at))  # dealt anew, or the partitions double with the pointers


# --------------------------------------------------------------------------------------
# interval head-counts
# --------------------------------------------------------------------------------------
def interval_headcount(
    intervals: DataFrame, by: Sequence[str], start: str, end: str, width: int, counts: Mapping[str, Column]
) -> DataFrame:
    """Step function of how many intervals cover each boundary, inclusive at both ends.

    covering(b) = #(start <= b) - #(end < b), so two running sums over distinct boundaries replace
    the boundary x interval join.
    """
    by = list(by)
    ones = {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()}
    flagged = intervals
    for n, c in ones.items():
        flagged = flagged.withColumn(f"__c_{n}", c)
    names = list(ones)
    sides = F.array(
        F.struct(F.col(start).alias("b"), F.lit(True).alias("opens")),
        F.struct(F.col(end).alias("b"), F.lit(False).alias("opens")),
    )
    edges = flagged.select(*by, F.explode(sides).alias("__e"), *[f"__c_{n}" for n in names]).select(
        *by, F.col("__e.b").alias("boundary"), F.col("__e.opens").alias("__o"), *[f"__c_{n}" for n in names]
    )
    steps = edges.groupBy(*by, "boundary").agg(
        *[F.sum(F.when(F.col("__o"), F.col(f"__c_{n}")).otherwise(0)).alias(f"__in_{n}") for n in names],
        *[F.sum(F.when(~F.col("__o"), F.col(f"__c_{n}")).otherwise(0)).alias(f"__out_{n}") for n in names],
    )
    sums = {}
    for n in names:
        sums[f"__ci_{n}"] = F.col(f"__in_{n}")
        sums[f"__co_{n}"] = F.col(f"__out_{n}")
    run = running_sum(steps, by, [block_of("boundary", width)], ["boundary"], sums)
    return run.select(
        *by, "boundary",
        *[(F.col(f"__ci_{n}") - (F.col(f"__co_{n}") - F.col(f"__out_{n}"))).alias(n) for n in names],
    )


# --------------------------------------------------------------------------------------
# ranks and exact quantiles
# --------------------------------------------------------------------------------------
def value_counts(df: DataFrame, by: Sequence[str], value: str, level_width: float, weight: str | None = None) -> DataFrame:
    """Distinct values with their count and the count of smaller-or-equal values, per ``by``; a row counts ``weight`` times."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_sum(counts, by, [block_of(value, level_width)], [value], {"cum": F.col("n")})


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], level_width: float, weight: str | None = None
) -> DataFrame:
    """Linearly interpolated percentiles per ``by`` without holding a group's values in one task.

    A row counts ``weight`` times (once without it), so values that are counted already stay counted.

    Counts per distinct value are combined map-side, accumulated by blocks of ``level_width``, and only
    the two order statistics next to each rank survive to the final aggregate.
    """
    by = list(by)
    cum = value_counts(df, by, value, level_width, weight)
    total = cum.groupBy(*by).agg(F.max("cum").alias("__total"))
    ranked = cum.join(total, by) if by else cum.withColumn("__total", total.scalar())
    aggs = [F.max("__total").alias("n")]
    keep = F.lit(False)
    for name, p in probs.items():
        r = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = F.floor(r), F.ceil(r)
        first, last = F.col("cum") - F.col("n"), F.col("cum") - 1
        at_lo, at_hi = (first <= lo) & (lo <= last), (first <= hi) & (hi <= last)
        keep = keep | at_lo | at_hi
        a, b = F.min(F.when(at_lo, F.col(value))), F.min(F.when(at_hi, F.col(value)))
        share = F.max(r - lo)
        aggs.append((a + (b - a) * share).alias(name))
    return ranked.where(keep).groupBy(*by).agg(*aggs)


def with_median(df: DataFrame, by: Sequence[str], value: str, name: str, n: str) -> DataFrame:
    """Each row with the exact median of ``value`` in its group (``name``) and the number of the group's rows (``n``).

    A group's rows meet in one task, where they are sorted and spilled like those of any window, so this is for groups
    that are bounded by nature (a player's frames in a match); for others see ``exact_percentiles``.  ``value`` is never null.
    Where ``df`` already lies together by some of ``by`` nothing is shuffled.
    """
    group = Window.partitionBy(*by)
    placed = df.withColumns({"__at": F.row_number().over(group.orderBy(value)), n: F.count(F.lit(1)).over(group.orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))})
    rank = (F.col(n) - 1) / 2
    a, b = (F.max(F.when(F.col("__at") == f(rank) + 1, F.col(value))).over(group) for f in (F.floor, F.ceil))
    return placed.withColumn(name, a + (b - a) * (rank - F.floor(rank))).drop("__at")


# --------------------------------------------------------------------------------------
# row-neighbourhood windows
# --------------------------------------------------------------------------------------
def with_halo(df: DataFrame, index: str, block: int, halo: int) -> DataFrame:
    """Copy each row into its block and into a neighbour block it borders on.

    ``index`` is a dense row index.  A window partitioned by the added ``block`` column sees ``halo``
    true neighbours on both sides of every row with ``is_home``; drop the copies afterwards.
    """
    i = F.col(index)
    home = block_of(i, block)
    offset = F.pmod(i, F.lit(block))
    targets = F.array_compact(F.array(
        home,
        F.when(offset < halo, home - 1),
        F.when(offset >= block - halo, home + 1),
    ))
    out = df.withColumn("block", F.explode(targets))
    return out.withColumn("is_home", F.col("block") == home)
