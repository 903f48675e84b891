"""Hard-negative mining: exact integer scores by the method of the four Russians.

Components become integers, kept as bit planes (two's complement): for every plane, each group of eight
dimensions is one byte.  For an anchor, a table per group holds the sums of all 256 subsets of its eight
components.  The score of a candidate is then, plane by plane from the highest (whose weight is negative),
the doubled score so far plus one looked-up sum per group: full exact inner products without a product.

Every row is scored against every anchor, once, in blocks: anchors and candidates are dealt by hash into
blocks of bounded size, and a task gets one block of each.  A first pass scores rows of the anchor's label
and ranks them (positives); a second scores the rows of other labels and ranks those in the score range
that each positive leaves.  Both rank lists are pruned in the task and again in front of each shuffle.

Rows of one label and vector form a class and are scored once.  Of a class only the smallest ids can
be among the first k (its rows have equal scores and order by id), so a class carries k + 1 of them;
this is exact, however many copies there are.

Defined results: rows without an id, with a null label, a null vector, or a null or non-finite component take no
part.  Of rows that share an id, the one with the smallest label, then vector, takes part.  Missing
dimensions of shorter vectors count as 0.  Ties go to the smaller id.  An anchor without positives, or a positive without
negatives in range, returns nothing.  Components whose inner products could exceed 64 bits raise.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from touchline.llm.common import arrow, scratch, small_batches

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LOWEST, HIGHEST = 50, 95
#: Rows of a block of anchors and of a block of candidates (on average; a hash deals them).
ANCHOR_ROWS = 1024
CANDIDATE_ROWS = 4096
#: Candidates scored at once.
STRIP = 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Integer components, or null if a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def participants(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(_id, _label, _v): one row per id, with integer components."""
    read = rows.select(F.col(key).alias("_id"), F.col(label).cast("long").alias("_label"), quantised(F.col(vector)).alias("_v"))
    read = read.where("_id is not null and _label is not null and _v is not null")
    return read.groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("_row")).select("_id", "_row.*")


def noisy(rows: DataFrame, key: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` with the label of every seventh id moved on by one."""
    moved = F.when(F.col(key) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return rows.withColumn(label, moved)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of shape (rows, bits, groups): the planes of two's complement, highest first."""
    levels = np.arange(bits - 1, -1, -1)
    return np.packbits(((values[:, None, :] >> levels[None, :, None]) & 1).astype(np.uint8), axis=2)


def tables(anchors: np.ndarray) -> np.ndarray:
    """Subset sums of shape (groups, 256, anchors): entry s sums the components whose bits are set in byte s."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((n, groups * 8), np.int64)
    padded[:, :dims] = anchors
    by_group = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    sums = np.zeros((groups, 256, n), np.int64)
    for bit in range(8):  # the highest bit of a byte is the first dimension
        step = 1 << (7 - bit)
        for start in range(step, 256, 2 * step):
            sums[:, start:start + step] += by_group[:, None, bit]
    return sums


def scores(tabled: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact scores of shape (candidates, anchors) by look-ups, shifts and additions."""
    total = np.zeros((packed.shape[0], tabled.shape[2]), tabled.dtype)
    for plane in range(packed.shape[1]):
        if plane == 1:
            np.negative(total, out=total)  # the highest plane weighs negatively
        if plane:
            np.left_shift(total, 1, out=total)
        for group in range(tabled.shape[0]):
            total += tabled[group][packed[:, plane, group]]
    return total if packed.shape[1] > 1 else -total


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Integer components as a matrix, shorter vectors filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Cell:
    """One block of anchors against one block of candidates, both ordered by label; candidates by smallest id within a label."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, dims: int, bits: int, reach: int):
        self.anchors = anchors.sort_by([("_label", "ascending"), ("_id", "ascending")])
        first = pa.array([ids[0].as_py() for ids in candidates["_ids"]], candidates["_ids"].type.value_type)
        self.rows = candidates.append_column("_first", first).sort_by([("_label", "ascending"), ("_first", "ascending")])
        self.ids = self.rows["_ids"].to_pylist()
        self.first = self.rows["_first"].to_numpy()
        self.labels = self.rows["_label"].to_numpy()
        self.anchor_ids = self.anchors["_id"].to_pylist()
        self.anchor_labels = self.anchors["_label"].to_numpy()
        groups = -(-dims // 8)
        raw = b"".join(self.rows["_planes"].to_pylist())
        self.packed = np.frombuffer(raw, np.uint8).reshape(len(self.ids), bits, groups)
        kind = np.int32 if reach < 1 << 30 else np.int64
        self.tabled = tables(matrix(self.anchors["_v"], dims)).astype(kind)

    def score(self, some: slice, of: slice) -> np.ndarray:
        """Scores of shape (anchors, candidates)."""
        tabled = np.ascontiguousarray(self.tabled[:, :, of])
        parts = [scores(tabled, self.packed[i:min(i + STRIP, some.stop)]).T for i in range(some.start, some.stop, STRIP)]
        return np.ascontiguousarray(np.concatenate(parts, axis=1))

    def spans(self):
        """(label, its anchors, its candidates) for each label of the anchors."""
        for label in np.unique(self.anchor_labels):
            a = slice(*np.searchsorted(self.anchor_labels, [label, label + 1]).tolist())
            yield a, slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def expand(self, order: np.ndarray, values: np.ndarray, k: int, without=None) -> list[tuple[int, int]]:
        """The first k (score, id) among the rows of the classes in ``order``, which are all that can hold them."""
        found = [(-int(v), i) for c, v in zip(order.tolist(), values.tolist()) for i in self.ids[c] if i != without]
        return [(-v, i) for v, i in sorted(found)[:k]]


def best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, ties by place."""
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        some = np.concatenate([above, np.flatnonzero(values == least)[:k - len(above)]])
    else:
        some = np.arange(len(values))
    return some[np.lexsort((some, -values[some]))][:k]


def rank_positives(anchors: pa.Table, candidates: pa.Table, dims: int, bits: int, reach: int, k: int) -> list[tuple]:
    """(anchor, positive, score): the first k rows of the anchor's label in this cell, without the anchor itself."""
    cell, out = Cell(anchors, candidates, dims, bits, reach), []
    for of, some in cell.spans():
        if some.start == some.stop:
            continue
        for anchor, values in zip(cell.anchor_ids[of], cell.score(some, of)):
            order = best(values, k + 1)  # one of these classes may hold the anchor and nothing else
            out += [(anchor, i, v) for v, i in cell.expand(order + some.start, values[order], k, anchor)]
    return out


def rank_negatives(anchors: pa.Table, candidates: pa.Table, dims: int, bits: int, reach: int, k: int, lowest: int, highest: int) -> list[tuple]:
    """(anchor, positive, positive's score, negative, score): the first k rows of other labels in each positive's range in this cell."""
    cell, out = Cell(anchors, candidates, dims, bits, reach), []
    goals = cell.anchors["_positives"].to_pylist()
    for of, same in cell.spans():
        for some in (slice(0, same.start), slice(same.stop, len(cell.ids))):
            if some.start == some.stop:
                continue
            first = cell.first[some]
            for at, values in zip(range(of.start, of.stop), cell.score(some, of)):
                low = min(-(-lowest * p["score"] // 100) for p in goals[at])
                high = max(highest * p["score"] // 100 for p in goals[at])
                within = np.flatnonzero((values >= low) & (values <= high))
                within = within[np.lexsort((first[within], -values[within]))]
                falling = -values[within]
                for p in goals[at]:
                    start = np.searchsorted(falling, -(highest * p["score"] // 100), "left")
                    stop = np.searchsorted(falling, lowest * -p["score"] // 100, "right")
                    order = within[start:min(start + k, stop)]
                    out += [(cell.anchor_ids[at], p["id"], p["score"], i, v) for v, i in cell.expand(order + some.start, values[order], k)]
    return out


def in_cells(run, schema: str, anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int) -> DataFrame:
    """``run`` over every pair of an anchor block and a candidate block."""
    names = [part.split()[0] for part in schema.split(", ")]
    parts = n_anchors * n_candidates
    left = anchors.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))).repartition(parts, "_i", "_j")
    right = candidates.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).repartition(parts, "_i", "_j")

    def cell(a: pa.Table, c: pa.Table) -> pa.Table:
        rows = run(a, c) if a.num_rows and c.num_rows else []
        return pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(cell, schema)


def ranked(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, anchor_rows: int = ANCHOR_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` holds of the key column."""
    kind = rows.schema[key].dataType.simpleString()
    part = scratch(participants(rows, key, vector, label), "participants")
    facts = part.select(F.count_if(is_anchor).alias("anchors"), F.count("*").alias("rows"), F.max(F.size("_v")).alias("dims"),
                        F.max(F.array_max(F.transform("_v", lambda x: F.greatest(x, -x - 1)))).alias("most"),
                        F.max(F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))).alias("sum")).first()
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not facts["anchors"]:
        return rows.sparkSession.createDataFrame([], schema)
    dims, bits = max(1, facts["dims"]), int(facts["most"] or 0).bit_length() + 1
    reach = int(facts["sum"] or 0) * (int(facts["most"] or 0) + 1)
    if reach >= 1 << 62:
        raise ValueError("the components are too large: inner products could exceed 64 bits")
    keep = max(positives + 1, negatives)
    first = Window.partitionBy("_label", "_v").orderBy("_id")
    few = part.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= keep)
    classes = few.groupBy("_label", "_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))

    def pack(batches):
        for batch in small_batches(batches):
            packed = planes(matrix(batch.column("_v"), dims), bits)
            yield arrow(["_label", "_ids", "_planes"], [batch.column("_label"), batch.column("_ids"), [p.tobytes() for p in packed]])

    n_anchors, n_candidates = -(-facts["anchors"] // anchor_rows), -(-facts["rows"] // candidate_rows)
    candidates = classes.mapInArrow(pack, f"_label long, _ids array<{kind}>, _planes binary")
    candidates = scratch(candidates.withColumn("_j", F.pmod(F.xxhash64("_planes", "_label"), F.lit(n_candidates)).cast("int")), "classes")
    anchors = part.where(is_anchor).withColumn("_i", F.pmod(F.xxhash64("_id"), F.lit(n_anchors)).cast("int"))

    near = in_cells(lambda a, c: rank_positives(a, c, dims, bits, reach, positives), f"_id {kind}, id {kind}, score long", anchors, candidates, n_anchors, n_candidates)
    chosen = ranked(near, ["_id"], "score", "id", positives).groupBy("_id").agg(F.collect_list(F.struct("id", "score")).alias("_positives"))
    goals = scratch(anchors.join(chosen, "_id"), "positives")
    hard = in_cells(lambda a, c: rank_negatives(a, c, dims, bits, reach, negatives, lowest, highest),
                    f"anchor_id {kind}, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long", goals, candidates, n_anchors, n_candidates)
    return ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
