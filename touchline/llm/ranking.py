"""Ranked lexical search: per-term geometric blocking with exact bounds.

The score of a document for an item is the sum, over the item's terms, of a term weight (from the number
of documents that hold it) times an impact (from the term's count and the document's length), all in integers.

Documents become vectors of impacts over the terms of the items, ordered by a similarity key (signs
of random projections of the weighted vector), so alike documents are neighbours.  The posting list of a
term is cut, along that order, into blocks of at most ``BLOCK`` documents.  A block stores its
summary: the greatest impact of any of its documents at every coordinate that counts for a bound.  In a
list, an item looks only for documents that hold none of the item's rarer terms, since the rarer term's own list
has the others; so the coordinates are the terms from the list's own on.  The bound of a block is the
sum of weight times summary.  A block is skipped only if its bound is below a score that ten documents
are known to reach (from scoring the documents of the item's rarest terms first), and a list is not even
blocked if its bound from its own maxima fails that test for every item.  Documents of the
remaining blocks are scored in full, so the ranking is exact.

Scale: nothing but items, in parts of bounded size, and numbers per term of a part reach the driver or a
broadcast.  Blocks are cut where the documents lie, so a term that most documents hold is spread over all tasks, and
blocks, not posting lists, are rows.

Defined results: a null text has no terms and is ranked nowhere.  Every row is a document and every row of
``items`` an item, whether or not ids repeat; equal scores go by id, null last.  An item without terms, or
without a document of positive score, has no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from touchline.llm.common import arrow, scratch, small_batches, whole_text

TOP = 10
#: Documents of a block.
BLOCK = 32
#: Postings that are scored at least to find an item's first threshold.
SEEDS = 400
#: Coordinates of a summary behind the list's own term, for one item; the terms behind them count with their list's maximum.
REACH = 128
#: Bytes of item text that are broadcast at once; more items are searched in several parts.
PART_BYTES = 1 << 20
#: Cells of the matrix in which a task lays out its documents.
CELLS = 1 << 23
PROJECTIONS = 16

#: Bytes to terms: A-Z lower-cased, every other ASCII byte that is no letter or digit to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class Part:
    """The items of one part: distinct terms as numbers, and each item's numbers with their counts."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.ids = [r[0] for r in rows]
        self.code: dict[bytes, int] = {}
        self.codes, self.counts = [], []
        for _, text in rows:
            found: dict[int, int] = {}
            for t in terms(text.encode()):
                c = self.code.setdefault(t, len(self.code))
                found[c] = found.get(c, 0) + 1
            self.codes.append(np.fromiter(found.keys(), np.int64, len(found)))
            self.counts.append(np.fromiter(found.values(), np.int64, len(found)))

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Order each item's terms from rare to frequent; terms of weight 0 add nothing and go."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weight, self.df = w, df
        self.values = []
        for i, (codes, counts) in enumerate(zip(self.codes, self.counts)):
            live = (w[codes] > 0) & (df[codes] > 0)
            codes, counts = codes[live], counts[live]
            order = np.lexsort((codes, df[codes]))
            self.codes[i] = codes[order]
            self.values.append(w[codes[order]] * counts[order])

    def seed(self, k: int) -> list[np.ndarray]:
        """The rarest terms of each item whose lists hold k documents or more for certain."""
        out = []
        for codes in self.codes:
            held = np.cumsum(self.df[codes])
            enough = np.flatnonzero(held >= np.maximum(SEEDS, k * np.arange(1, len(codes) + 1)))
            out.append(codes[:enough[0] + 1] if len(enough) else codes)
        return out


class Goals:
    """What the bounds need: for each list that some item may still need, its coordinates and the items' weights at them."""

    def __init__(self, part: Part, most: np.ndarray, least: np.ndarray):
        wanted: dict[int, list[tuple[int, np.ndarray, np.ndarray, int]]] = {}
        for item, (codes, values) in enumerate(zip(part.codes, part.values)):
            behind = np.cumsum((values * most[codes])[::-1])[::-1]
            behind = np.append(behind, 0)
            for j in np.flatnonzero((behind[:-1] >= least[item]) & (behind[:-1] > 0)).tolist():
                end = min(j + REACH, len(codes))
                wanted.setdefault(int(codes[j]), []).append((item, codes[j:end], values[j:end], int(behind[end])))
        self.least = least
        self.lists = {}
        for code, uses in wanted.items():
            every = np.concatenate([u[1] for u in uses])
            coords, places = np.unique(every, return_inverse=True)
            starts = np.cumsum([0] + [len(u[1]) for u in uses[:-1]])
            self.lists[code] = (coords, places, np.concatenate([u[2] for u in uses]), starts, np.array([u[3] for u in uses]), np.array([u[0] for u in uses]))

    def items(self, code: int, summary: np.ndarray) -> np.ndarray:
        """The items whose bound for a block with this summary reaches their threshold."""
        _, places, values, starts, rest, items = self.lists[code]
        bounds = np.add.reduceat(summary[places] * values, starts) + rest
        return items[(bounds >= self.least[items]) & (bounds > 0)]


def vectors(docs: DataFrame, part: Part, key: str, text: str) -> DataFrame:
    """(_id, _n, _codes, _counts): terms of each document, and the counts of those that some item has."""
    shared = docs.sparkSession.sparkContext.broadcast(part.code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in small_batches(batches):
            lengths, codes, counts = [], [], []
            for t in raw(batch.column("_text")):
                words = terms(t)
                got, n = np.unique(np.fromiter((code[w] for w in words if w in code), np.int32), return_counts=True)
                lengths.append(len(words))
                codes.append(got)
                counts.append(n.astype(np.int32))
            yield arrow(["_id", "_n", "_codes", "_counts"], [batch.column("_id"), pa.array(lengths, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))])

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("_id"), whole_text(text).alias("_text"))
    return read.mapInArrow(count, f"_id {kind}, _n long, _codes array<int>, _counts array<int>").where("_n > 0")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def impacts(counted: DataFrame, part: Part, n_docs: int, n_terms: int) -> DataFrame:
    """(_id, _codes, _impacts, _key): the vector of each document that holds a term of an item, and its similarity key."""
    shared = counted.sparkSession.sparkContext.broadcast(part.weight)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        sides = np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (len(weight), PROJECTIONS))
        powers = 1 << np.arange(PROJECTIONS - 1, -1, -1)
        for batch in small_batches(batches):
            codes, lengths = flat(batch.column("_codes"))
            tf = flat(batch.column("_counts"))[0].astype(np.int64)
            n = batch.column("_n").to_numpy()
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            found = (1000000000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths))
            ends = np.cumsum(lengths)
            moved = (weight[codes] * found)[:, None] / 1e6 * sides[codes]
            sums = np.concatenate([np.zeros((1, PROJECTIONS)), np.cumsum(moved, axis=0)])
            keys = ((sums[ends] - sums[ends - lengths]) > 0) @ powers
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield arrow(["_id", "_codes", "_impacts", "_key"], [batch.column("_id"), pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.array(keys, pa.int64())])

    kind = counted.schema["_id"].dataType.simpleString()
    return counted.where("size(_codes) > 0").mapInArrow(weigh, f"_id {kind}, _codes array<int>, _impacts array<int>, _key long")


def laid_out(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their impacts as a matrix of documents by terms."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            codes, lengths = flat(some.column("_codes"))
            out = np.zeros((some.num_rows, width), np.int32)
            out[np.repeat(np.arange(some.num_rows), lengths), codes] = flat(some.column("_impacts"))[0]
            yield some, out


class Best:
    """The first k documents of each item in one task: by score, then id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            some = np.flatnonzero((scores >= least) & (scores > 0))
        else:
            some = np.flatnonzero(scores > 0)
        found = self.rows.get(item, []) + [(-int(scores[d]), ids[d] is None, ids[d]) for d in some.tolist()]
        found.sort(key=lambda r: r if r[2] is not None else (r[0], True, 0))
        self.rows[item] = found[:self.k]


def seeds(ordered: DataFrame, part: Part, k: int) -> np.ndarray:
    """For each item a score that k documents are known to reach (0 if there are fewer)."""
    shared = ordered.sparkSession.sparkContext.broadcast((part.seed(k), part.codes, part.values))
    width = len(part.code)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, codes, values = shared.value
        best = Best(k)
        for batch, found in laid_out(batches, width):
            for item, few in enumerate(first):
                docs = np.flatnonzero(found[:, few].any(axis=1))
                if len(docs):
                    best.add(item, found[docs][:, codes[item]] @ values[item], [0] * len(docs))
        rows = [(item, -r[0]) for item, some in best.rows.items() for r in some]
        yield arrow(["item", "score"], [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())])

    order = Window.partitionBy("item").orderBy(F.col("score").desc())
    top = ordered.select("_codes", "_impacts").mapInArrow(score, "item int, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = np.zeros(len(part.codes), np.int64)
    for r in top.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
        out[r["item"]] = r["least"]
    return out


def blocks(ordered: DataFrame, goals: Goals, width: int, size: int = BLOCK) -> DataFrame:
    """(_term, _members, _summary): the posting lists that some item may need, in blocks of neighbours."""
    shared = ordered.sparkSession.sparkContext.broadcast({code: entry[0] for code, entry in goals.lists.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for batch, found in laid_out(batches, width):
            marks = batch.column("_mark").to_numpy()
            codes, members, summaries = [], [], []
            for code in np.flatnonzero(found.any(axis=0)).tolist():
                coords = lists.get(code)
                if coords is None:
                    continue
                docs = np.flatnonzero(found[:, code])
                for at in range(0, len(docs), size):
                    some = docs[at:at + size]
                    codes.append(code)
                    members.append(marks[some])
                    summaries.append(found[some[:, None], coords].max(axis=0))
            yield arrow(["_term", "_members", "_summary"], [pa.array(codes, pa.int32()), pa.array(members, pa.list_(pa.int64())), pa.array(summaries, pa.list_(pa.int32()))])

    return ordered.select("_mark", "_codes", "_impacts").mapInArrow(cut, "_term int, _members array<long>, _summary array<int>")


def open_blocks(index: DataFrame, goals: Goals) -> DataFrame:
    """(_item, _members): for each item the blocks whose bound does not fail."""
    shared = index.sparkSession.sparkContext.broadcast(goals)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches):
            rows, items = [], []
            flat_summary, lengths = flat(batch.column("_summary"))
            starts = np.cumsum(lengths) - lengths
            for row, code in enumerate(batch.column("_term").to_pylist()):
                some = known.items(code, flat_summary[starts[row]:starts[row] + lengths[row]].astype(np.int64))
                rows += [row] * len(some)
                items += some.tolist()
            if rows:
                yield arrow(["_item", "_members"], [pa.array(items, pa.int32()), batch.column("_members").take(pa.array(rows))])

    return index.mapInArrow(bound, "_item int, _members array<long>")


def final(candidates: DataFrame, part: Part, k: int, id_kind: str, item_kind: str) -> DataFrame:
    """Score documents (_id, _codes, _impacts) for the items in ``_items``; rank the first k of each item."""
    shared = candidates.sparkSession.sparkContext.broadcast((part.ids, part.codes, part.values))
    width = len(part.code)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, values = shared.value
        best = Best(k)
        for batch, found in laid_out(batches, width):
            items, lengths = flat(batch.column("_items"))
            docs = np.repeat(np.arange(batch.num_rows), lengths)
            names = batch.column("_id").to_pylist()
            order = np.argsort(items, kind="stable")
            items, docs = items[order], docs[order]
            for item in np.unique(items).tolist():
                some = docs[slice(*np.searchsorted(items, [item, item + 1]))]
                best.add(item, found[some][:, codes[item]] @ values[item], [names[d] for d in some.tolist()])
        rows = [(item, ids[item], r[2], -r[0]) for item, some in best.rows.items() for r in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["_item", "item_id", "doc_id", "score"])

    schema = f"_item int, item_id {item_kind}, doc_id {id_kind}, score long"
    types = to_arrow_schema(StructType.fromDDL(schema)).types
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = candidates.mapInArrow(score, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, part: Part, k: int, key: str, text: str, item_kind: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    counted = scratch(vectors(docs, part, key, text), "counted")
    size = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("_n"), F.lit(1)).alias("terms")).first()
    df = np.zeros(len(part.code), np.int64)
    for r in counted.select(F.explode("_codes").alias("code")).groupBy("code").count().collect():
        df[r["code"]] = r["count"]
    part.weigh(df, size["n"])
    near = impacts(counted, part, size["n"], size["terms"])
    dealt = near.repartitionByRange("_key", F.xxhash64("_id")).sortWithinPartitions("_key", F.xxhash64("_id"))
    ordered = scratch(dealt.withColumn("_mark", F.monotonically_increasing_id()), "ordered")
    most = np.zeros(len(part.code), np.int64)
    pairs = ordered.select(F.explode(F.arrays_zip("_codes", "_impacts")).alias("p")).groupBy("p._codes").agg(F.max("p._impacts").alias("most"))
    for r in pairs.collect():
        most[r["_codes"]] = r["most"]
    goals = Goals(part, most, seeds(ordered, part, k))
    index = scratch(blocks(ordered, goals, len(part.code)), "blocks")
    opened = open_blocks(index, goals).select("_item", F.explode("_members").alias("_mark"))
    wanted = scratch(opened.groupBy("_mark").agg(F.collect_set("_item").alias("_items")), "opened")
    return final(ordered.select("_mark", "_id", "_codes", "_impacts").join(wanted, "_mark"), part, k, kind, item_kind)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    item_kind = items.schema[item].dataType.simpleString()
    read = scratch(items.select(F.col(item).alias("_item_id"), whole_text(item_text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "items")
    n_parts = -(-(read.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // PART_BYTES)
    found = []
    for i in range(n_parts):
        rows = read.where(F.pmod(F.xxhash64("_row"), F.lit(n_parts)) == i).orderBy("_row").collect()
        part = Part([(r["_item_id"], r["_text"]) for r in rows])
        if part.code:
            found.append(_search(docs, part, k, key, text, item_kind))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {docs.schema[key].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionAll, found)
