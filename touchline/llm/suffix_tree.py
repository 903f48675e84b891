"""Language-model scores from a probabilistic suffix tree.

Symbols are tokens: words (lower-cased in A-Z) and one end per text, which also stands before the first
word.  The states of the tree are contexts of up to ``DEPTH`` tokens:

* a context is a candidate if the training texts hold it at least ``MIN_COUNT`` times, and a next token is
  listed if it follows that often; both are counts and not shares, so the tree grows with the corpus;
* it is retained if its next tokens diverge from those of the next shorter state: its count times the
  Kullback-Leibler divergence must exceed the description length of its list.

A listed next token is smoothed with the shorter state; what remains of the probability is shared among
the other tokens as the shorter state shares it.  The root is the add-half unigram distribution over
the training vocabulary and one class of unknown words, so every state sums to 1 over the same events.
A token is scored by the longest suffix of its history that is a state: in logarithms, the root's score
and what each state on the way to the longest adds to it, so the lengths are scored one after another.

Words, contexts and next tokens are Parquet tables; no part of the tree is collected or broadcast.
A text is cut into words once; after that it is a row of numbers, in compressed slices of texts.  Blocks are
stretches of a task's rows.  A block asks for its different words, then for each length for its different contexts and (context, token) pairs, and meets the answers in one task of bounded size.
Questions and answers travel packed: pairs are dealt into buckets by hash, and what a block asks of a bucket
is one row of compressed columns, in order.  A bucket gets a pair once from a block, so no pair is hot.
The questions carry the counts of the block's training texts, so their sums are the corpus counts.
A pair is asked only where its context and its own last tokens are frequent enough, which leaves out none that is.
Sums of probabilities are taken in whole numbers, so they do not depend on the order of the rows; what a
state adds to a token's score reaches the block in single precision.

Defined results: a null or empty text is one end token.  Rows that repeat an id are scored each by its own
text.  Without training rows N = V = 0 and both scores are 0.  A row without an id is a training row.
Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm.common import arrow, discard, small_batches, whole_text
from touchline.llm.labelled import held_out

DEPTH = 2
#: Listed next tokens and contexts occur this often at least, whatever the size of the corpus.
MIN_COUNT = 4
#: Weight of the shorter state in the probability of a listed token, in tokens.
SMOOTHING = 2.0
#: Tokens of a block for which questions are put together, and for each bucket of contexts and pairs; about 10 MB of text.
BLOCK_TOKENS = 1_500_000
#: Bytes of text of a block, and for each bucket of words; bytes of a slice of texts that is packed together.
BLOCK_BYTES = 10 << 20
SLICE_BYTES = 1 << 20
#: Multiplier of the place of a tuple when the next column is added to it; tokens are numbered below it.
WIDE = 1 << 31
#: Multipliers of a pair's columns, from the last one back, in the sum that names its bucket.
SPREAD = (1_000_003, 700_001_087, 900_000_011, 800_000_011)
#: Multipliers of a word's bytes by place (arbitrary, odd), in the sum that names its bucket.
MULTIPLIERS = np.random.default_rng(8).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Probabilities are summed in whole multiples of 1 / ``FINE``.
FINE = float(1 << 52)
END = b"\n"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """As in ``common``; the shuffle files of the table are removed when it is written."""
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, None)
    conf.set(cleanup, "true")
    try:
        return common.scratch(df, name)
    finally:
        conf.unset(cleanup) if before is None else conf.set(cleanup, before)


def buckets_of(docs: DataFrame, text: str) -> int:
    """Buckets of words: one for every ``BLOCK_BYTES`` of text."""
    return max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length(whole_text(text))), F.lit(0))).first()[0] // BLOCK_BYTES))


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words of texts one after another, each text between two end tokens; the words; places of the first tokens.

    The end is the last word.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy())
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # before and behind the white space at the ends of a text
    before = np.cumsum(empty)
    ends = ends - np.append(0, before)[ends]
    coded_ = flat.filter(pa.array(~empty)).dictionary_encode()
    words = pa.concat_arrays([coded_.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    at = np.concatenate([ends[:-1], [0], ends]) if len(ends) else ends  # an end token stands before and behind each text
    ids = np.insert(coded_.indices.to_numpy(), np.sort(at), len(words) - 1)
    return ids, words, np.append(0, ends[:-1]) + 2 * np.arange(len(ends))


def lengths_and_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    return np.diff(offsets), np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]


def words_of(packed: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(packed))])


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each word, by a sum of its bytes, each times the multiplier of its place."""
    lengths, values = lengths_and_bytes(words)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(values * MULTIPLIERS[place % len(MULTIPLIERS)], starts)
    return ((sums >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def pieces(docs: DataFrame, held: Column, text: str, key: str | None, buckets: int) -> DataFrame:
    """Every text, read once: slices of texts as numbers of their block's words, and what words each block asks of each bucket.

    A block is a stretch of a task's rows.  A slice has its rows in ``docs`` and their numbers in ``packed``; a question
    has ``_bucket``, the words, and in ``packed`` their numbers in the block, counts in its training texts and in others, and lengths.
    """
    kind = docs.schema[key].dataType.simpleString() if key else "int"
    source = docs.select((F.col(key) if key else F.lit(0)).alias("_id"), held.alias("_held"), whole_text(text).alias("_text"))
    names = ["_block", "_bucket", "words", "packed", "docs"]

    def read(block: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, held_, texts = (pa.concat_arrays([b.column(i) for b in batches]) for i in range(3))
        ids, words, starts = tokens(texts)
        sizes = np.diff(np.append(starts, len(ids)))
        docs_ = pa.StructArray.from_arrays([ids_, held_, pa.array(sizes - 1)], ["_id", "held_out", "n_tokens"])
        at = 0
        for b in batches:
            rows = docs_.slice(at, b.num_rows)
            part = ids[starts[at]:starts[at] + sizes[at:at + b.num_rows].sum()]
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield arrow(names, [np.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([coded(part, part >= 0)], pa.binary()), listed])
            at += b.num_rows
        train = np.repeat(~held_.to_numpy(zero_copy_only=False).astype(bool), sizes)
        counted = np.ones(len(ids), bool)
        counted[starts] = False
        n, other = (np.bincount(ids[some & counted], minlength=len(words)).astype(np.int32) for some in (train, ~train))
        to = word_buckets(words, buckets)
        order = np.argsort(to, kind="stable").astype(np.int32)
        words, to = words.take(pa.array(order)), to[order]
        edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        asked, packed, zipped = [], [], zstandard.ZstdCompressor(level=1)
        for a, b in zip(edges[:-1], edges[1:]):
            lengths, values = lengths_and_bytes(words.slice(a, b - a))
            asked.append(zipped.compress(values.tobytes()))
            packed.append(pack([order[a:b], n[order[a:b]], other[order[a:b]], lengths]))
        yield arrow(names, [np.full(len(asked), block, np.int64), to[edges[:-1]], pa.array(asked, pa.binary()), pa.array(packed, pa.binary()), pa.nulls(len(asked), listed.type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in small_batches(batches, SLICE_BYTES):
            kept.append(batch)
            size += pc.sum(pc.binary_length(batch.column(2))).as_py()
            if size >= BLOCK_BYTES:
                yield from read(block, kept)
                block, kept, size = block + 1, [], 0
        if kept:
            yield from read(block, kept)

    return source.mapInArrow(run, f"_block long, _bucket int, words binary, packed binary, docs array<struct<_id: {kind}, held_out: boolean, n_tokens: bigint>>")


def totals(read: DataFrame) -> DataFrame:
    """word, n (count in training rows) and every (count in all rows), and the word's bucket; the end token is the word of a line feed."""

    def run(some: pa.Table) -> pa.Table:
        words, counts = [], []
        for asked, packed in zip(some.column("words"), some.column("packed")):
            _, *both, lengths = unpack(packed.as_py(), 4)
            words.append(words_of(asked.as_py(), lengths))
            counts.append(both)
        found = pa.concat_arrays(words).dictionary_encode()
        n, other = (np.bincount(found.indices.to_numpy(), np.concatenate(c), len(found.dictionary)).astype(np.int64) for c in zip(*counts))
        return pa.table([found.dictionary.cast(pa.string()), n, n + other, pa.array([some.column("_bucket")[0].as_py()] * len(n), pa.int32())], names=["word", "n", "every", "_bucket"])

    asked = read.where("_bucket IS NOT NULL").select("_bucket", "words", "packed")
    return asked.groupBy("_bucket").applyInArrow(run, "word string, n long, every long, _bucket int")


def word_counts(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """As ``totals``, for a caller that has the texts only."""
    return totals(pieces(docs, held, text, None, buckets_of(docs, text)))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(wanted)  # in order, the search stays in the cache
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For whole numbers from 0 on: a place of each different one, in ascending order, and which of them each one is."""
    bits = int(len(keys)).bit_length()
    if int(keys.max()).bit_length() + bits < 63:  # sorted together with their places, as plain numbers
        both = np.sort((keys << bits) | np.arange(len(keys)))
        order, keys = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[new], code


def different_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``different``, for rows of columns below ``WIDE``."""
    code, top = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for k, column in enumerate(columns[1:], 1):
        if k > 1 or top > 1 << 24:
            first, code = different(code)
            top = len(first)
        code = code * (int(column.max()) + 1) + column
    return different(code)


class Places:
    """Places of different rows of whole-number columns, in sorted order; rows given twice have one place."""

    def __init__(self, columns: list[np.ndarray]):
        self.keys: list[np.ndarray] = []
        self.first = code = np.zeros(len(columns[0]), np.int64)
        for column in columns:
            keys, self.first, code = np.unique(code * WIDE + column, return_index=True, return_inverse=True)
            self.keys.append(keys)
        self.code = code

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.int64)
        for keys, column in zip(self.keys, columns):
            known = (code >= 0) & (column >= 0)
            code = np.where(known, find(keys, np.where(known, code * WIDE + column, -1)), -1)
        return code


class Level:
    """Contexts of one length with their next tokens: all of them, or those that a block asked for.

    The columns are the tokens of the context, then for pairs the next token.  ``others`` is the log10 factor
    of a retained context on the shorter state, ``delta`` what a listed token has more than there.
    """

    def __init__(self, contexts: list[np.ndarray], retained: np.ndarray, others: np.ndarray, pairs: list[np.ndarray], delta: np.ndarray):
        self.length = len(contexts)
        self.places, self.pairs = Places(contexts), Places(pairs)
        self.contexts = self.places.keys[-1]  #: (place of the context without its last token) * WIDE + last token
        self.retained, self.others = retained[self.places.first], others[self.places.first]
        self.delta = delta[self.pairs.first]

    def add(self, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the level adds to the log10 probability of each token, and the marks for the next level."""
        at = after_context(marks, starts)
        columns = histories(ids, at, self.length)
        context = self.places.find(columns)
        pair = np.where(marks[at], self.pairs.find([*columns, ids[at]]), -1)
        added, found = np.zeros(len(ids)), np.zeros(len(ids), bool)
        state = np.flatnonzero(context >= 0)
        state = state[self.retained[context[state]]]
        added[at[state]] = self.others[context[state]]
        listed = np.flatnonzero(pair >= 0)
        added[at[listed]] = self.delta[pair[listed]]
        found[at[listed]] = True
        return added, found


def after_context(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the tokens before which a candidate context ends; texts begin with an end token at ``starts``."""
    follows = np.zeros(len(marks), bool)
    follows[1:] = marks[:-1]
    follows[starts] = False
    return np.flatnonzero(follows)


def histories(ids: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    return [ids[at - length + k] for k in range(length)]


@dataclass
class Tree:
    """A whole tree in memory, for corpora that fit there."""

    words: list[bytes]  #: listed words; a word's number is its place
    levels: list[Level]

    def number(self) -> dict[bytes, int]:
        return Numbers(zip(self.words, range(len(self.words))))

    def score(self, base: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token; ``base`` has that of the root."""
        end = self.words.index(END) if END in self.words else -1
        ids, starts = np.insert(ids, starts, end), starts + np.arange(len(starts))
        marks, added = ids >= 0, np.zeros(len(ids))
        for level in self.levels:
            more, marks = level.add(ids, marks, starts)
            added += more
        return base + np.delete(added, starts)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def coded(ids: np.ndarray, marks: np.ndarray) -> bytes:
    """The token numbers of a slice of texts, each with its mark as lowest bit, compressed."""
    planes = ((ids + 1) * 2 + marks).astype(np.int32).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def decoded(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and marks of a slice."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(planes.T).view(np.int32).ravel()
    return (values >> 1) - 1, (values & 1).astype(bool)


def starts_of(rows: pa.StructArray) -> np.ndarray:
    """Places of the first tokens of a slice's texts."""
    sizes = rows.field("n_tokens").to_numpy() + 1
    return np.cumsum(sizes) - sizes


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with a number from 0 on for those of ``MIN_COUNT``, the most frequent first, and -1 for others."""
    often = words.where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").select("word", F.monotonically_increasing_id().alias("_at"))
    ranked = scratch(often, "ranked")
    part = F.shiftright("_at", 33)
    number, before = F.lit(0).cast("long"), 0
    sizes = ranked.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each task of the sort
    if sizes:
        offsets = []
        for r in sizes:
            offsets += [F.lit(r["part"]).cast("long"), F.lit(before).cast("long")]
            before += r["count"]
        number = F.element_at(F.create_map(*offsets), part.cast("long")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    done = scratch(words.join(ranked.select("word", number.alias("_number")), "word", "left")
                   .select("word", "n", "_bucket", F.coalesce("_number", F.lit(-1)).cast("int").alias("number")), "numbers")
    discard(ranked)
    return done


def encode(read: DataFrame, words: DataFrame, buckets: int, n_train: int, v_train: int) -> DataFrame:
    """The slices with their rows' scores at the root, token numbers and marks on those that have one."""

    def reply(some: pa.Table, found: pa.Table) -> pa.Table:
        known = found.column("word").combine_chunks()
        number, n = found.column("number").to_numpy().astype(np.int32), found.column("n").to_numpy()
        packed = []
        for asked, own in zip(some.column("words"), some.column("packed")):
            place, *_, lengths = unpack(own.as_py(), 4)
            at = pc.index_in(words_of(asked.as_py(), lengths), known).to_numpy()
            packed.append(pack([place, number[at], (n[at] >> 31).astype(np.int32), (n[at] & (WIDE - 1)).astype(np.int32)]))
        return pa.table([some.column("_block"), pa.array(packed, pa.binary())], names=["_block", "packed"])

    def translate(slices: pa.Table, found: pa.Table) -> pa.Table:
        own, number, high, low = (np.concatenate(c) for c in zip(*(unpack(p.as_py(), 4) for p in found.column("packed"))))
        numbers, n = np.empty(len(own), np.int32), np.empty(len(own), np.int64)
        numbers[own], n[own] = number, (high.astype(np.int64) << 31) + low
        base = np.log10((n.astype(float) + 0.5) / (n_train + 0.5 * (v_train + 1)))
        docs, score, codes = [], [], []
        for part, packed in zip(slices.column("docs"), slices.column("packed")):
            rows, where = part.values, decoded(packed.as_py())[0]
            starts = starts_of(rows)
            seen, root = (n > 0)[where], base[where]
            seen[starts], root[starts] = False, 0.0
            ids = numbers[where]
            codes.append(coded(ids, ids >= 0))
            score.append(np.add.reduceat(root, starts))
            docs.append(pa.StructArray.from_arrays([*(rows.field(c) for c in ("_id", "held_out", "n_tokens")), pa.array(np.add.reduceat(seen, starts, dtype=np.int64)), pa.array(score[-1])],
                                                   ["_id", "held_out", "n_tokens", "n_known", "base_score"]))
        ends = pa.array(np.cumsum([0, *map(len, docs)]), pa.int32())
        return pa.table({"_block": slices.column("_block"), "docs": pa.ListArray.from_arrays(ends, pa.concat_arrays(docs)),
                         "score": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(score))), "codes": pa.array(codes, pa.binary())})

    asked = read.where("_bucket IS NOT NULL").select("_block", "_bucket", "words", "packed")
    known = words.select("_bucket", F.col("word").cast("binary").alias("word"), "n", "number")
    replies = asked.groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(reply, "_block long, packed binary")
    slices = read.where("_bucket IS NULL").select("_block", "packed", "docs")
    kind = read.schema["docs"].dataType.elementType["_id"].dataType.simpleString()
    return slices.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(
        translate, f"_block long, docs array<struct<_id: {kind}, held_out: boolean, n_tokens: bigint, n_known: bigint, base_score: double>>, score array<double>, codes binary")


def context(length: int) -> list[str]:
    """The columns of a context's tokens."""
    return [f"w{k}" for k in range(length)]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit numbers, compressed; the first one, in ascending order, as differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = np.stack([first, *columns[1:]]).astype(np.int32).view(np.uint8).reshape(len(columns), -1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def unpack(packed: bytes, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(width, 4, -1)
    columns = list(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int32).reshape(width, -1))
    return [np.cumsum(columns[0], dtype=np.int32), *columns[1:]]


def bucket(columns: list, parts: int):
    """The bucket of each row: a sum of products, of arrays or of Spark columns."""
    return sum(c * m for c, m in zip(columns[::-1], SPREAD)) % parts


def with_bucket(df: DataFrame, names: list[str], parts: int) -> DataFrame:
    return df.withColumn("_bucket", bucket([F.col(c).cast("long") for c in names], parts))


def questions(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """What each block asks of each bucket: its different pairs of a context and the next token, and their counts in training texts."""

    def distinct(block: int, kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, marks, train, begins = (np.concatenate([k[i] for k in kept]) for i in range(4))
        at = after_context(marks, np.flatnonzero(begins)) if length else np.arange(len(ids))
        at = at[marks[at]]
        if not len(at):
            return
        columns = [*histories(ids, at, length), ids[at]]
        first, code = different_rows(columns)
        n = np.bincount(code, train[at], len(first)).astype(np.int32)
        columns = [*(c[first] for c in columns), n]
        to = bucket([c.astype(np.int64) for c in columns[:-1]], parts)
        order = np.argsort(to, kind="stable")
        columns, to = [c[order] for c in columns], to[order]
        edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        packed = [pack([c[a:b] for c in columns]) for a, b in zip(edges[:-1], edges[1:])]
        yield arrow(["_block", "_bucket", "packed"], [np.full(len(packed), block, np.int64), to[edges[:-1]], pa.array(packed, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, size = None, [], 0
        for batch in batches:
            for block, part, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if kept and (block != now or size > BLOCK_TOKENS):
                    yield from distinct(now, kept)
                    kept, size = [], 0
                rows, (ids, marks) = part.values, decoded(packed.as_py())
                begins = np.zeros(len(ids), bool)
                begins[starts_of(rows)] = True
                held = rows.field("held_out").to_numpy(zero_copy_only=False).astype(bool)
                kept.append((ids, marks, np.repeat(~held, rows.field("n_tokens").to_numpy() + 1), begins))
                now, size = block, size + len(ids)
        if kept:
            yield from distinct(now, kept)

    return texts.select("_block", "docs", "codes").mapInArrow(run, "_block long, _bucket long, packed binary")


def frequent(asked: DataFrame, length: int) -> DataFrame:
    """The pairs that the training texts hold often enough, with n, their count there."""
    own = [*context(length), "t"]

    def total(some: pa.Table) -> pa.Table:
        *columns, n = (np.concatenate(c) for c in zip(*(unpack(p.as_py(), len(own) + 1) for p in some.column("packed"))))
        first, code = different_rows(columns)
        sums = np.bincount(code, n, len(first)).astype(np.int64)
        often = np.flatnonzero(sums >= MIN_COUNT)
        return pa.table([*(c[first[often]] for c in columns), sums[often]], names=[*own, "n"])

    return asked.groupBy("_bucket").applyInArrow(total, ", ".join([*(f"{w} int" for w in own), "n long"]))


def answers(asked: DataFrame, values: DataFrame, names: list[str], parts: int) -> DataFrame:
    """For each block the rows of ``values`` (``names`` and value) that it asked for, packed."""

    def run(some: pa.Table, found: pa.Table) -> pa.Table:
        places = Places([found.column(c).to_numpy().astype(np.int64) for c in names])
        value = found.column("value").to_numpy()[places.first].astype(np.float32).view(np.int32)
        to, packed = [], []
        for block, question in zip(some.column("_block").to_pylist(), some.column("packed")):
            columns = unpack(question.as_py(), len(names) + 1)[:-1]
            at = places.find([c.astype(np.int64) for c in columns])
            there = np.flatnonzero(at >= 0)
            if len(there):
                to.append(block)
                packed.append(pack([*(c[there] for c in columns), value[at[there]]]))
        return pa.table([pa.array(to, pa.int64()), pa.array([len(names)] * len(to), pa.int32()), pa.array(packed, pa.binary())], names=["_block", "_width", "packed"])

    values = with_bucket(values, names, parts)
    return asked.groupBy("_bucket").cogroup(values.groupBy("_bucket")).applyInArrow(run, "_block long, _width int, packed binary")


def settle(asked: DataFrame, shorter: DataFrame, length: int, n_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Contexts (retained, others) and pairs (n, state, delta, retained) of a length; ``shorter`` has the pairs of the length before."""
    own = context(length)
    counted = scratch(frequent(asked, length), "counts")
    suffix = shorter.select(*(F.col(w).alias(f"w{k + 1}") for k, w in enumerate(context(length - 1))), "t", F.col("state").alias("up"))
    sizes = shorter.select(*context(length - 1), F.col("t").alias(own[-1]), F.col("n").alias("size"))
    p, up = F.col("p"), F.pow(F.lit(10.0), "up")
    joined = counted.join(suffix, [*own[1:], "t"]).join(sizes, own)
    joined = scratch(joined.withColumn("p", (F.col("n") + SMOOTHING * up) / (F.col("size") + SMOOTHING)), "smoothed")

    def total(part: Column) -> Column:
        return F.sum((part * FINE).cast("long")) / FINE

    sums = joined.groupBy(*own).agg(F.count("*").alias("kinds"), F.first("size").alias("size"), F.greatest(1 - total(p), F.lit(1e-12)).alias("rest"),
                                    F.greatest(1 - total(up), F.lit(1e-12)).alias("rest_up"), total(p * F.log(p / up)).alias("inside"))
    gain = F.col("size") * (F.col("inside") + F.col("rest") * F.log(F.col("rest") / F.col("rest_up")))
    contexts = scratch(sums.select(*own, (gain > 0.5 * (F.col("kinds") + 1) * float(np.log(max(2, n_tokens)))).alias("retained"),
                                   F.log10(F.col("rest") / F.col("rest_up")).alias("others")), "contexts")
    state = F.when(F.col("retained"), F.log10("p")).otherwise(F.col("up"))
    pairs = joined.join(contexts.select(*own, "retained"), own).select(*own, "t", "n", state.alias("state"), (state - F.col("up")).alias("delta"), "retained")
    written = scratch(pairs, "pairs")
    discard(counted, joined)
    return contexts, written


def step(texts: DataFrame, before: DataFrame, asked: DataFrame, contexts: DataFrame, pairs: DataFrame, length: int, last: bool, parts: int) -> DataFrame:
    """``texts`` with the scores of contexts up to ``length``; ``before`` are the questions of the length before, whose pairs are the contexts.

    The last one leaves out the token numbers.
    """
    own = context(length)
    states = contexts.where("retained").select(*own, F.col("others").alias("value"))
    listed = (pairs.where("retained") if last else pairs).select(*own, "t", F.col("delta").alias("value"))
    answered = answers(before, states, own, parts).unionAll(answers(asked, listed, [*own, "t"], parts))
    schema = (texts.drop("codes") if last else texts).schema
    names = schema.names

    def rows(found: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The keys and values of the answers of one kind."""
        packed = [p for w, p in zip(found.column("_width").to_pylist(), found.column("packed")) if w == width]
        columns = [np.concatenate(c) for c in zip(*(unpack(p.as_py(), width + 1) for p in packed))] or [np.zeros(0, np.int32)] * (width + 1)
        return [c.astype(np.int64) for c in columns[:-1]], columns[-1].view(np.float32).astype(float)

    def score(some: pa.Table, found: pa.Table) -> pa.Table:
        (ends, others), (listed_, delta) = rows(found, length), rows(found, length + 1)
        level = Level(ends, np.ones(len(others), bool), others, listed_, delta)
        score, codes = [], []
        for part, before_, packed in zip(some.column("docs"), some.column("score"), some.column("codes")):
            (ids, marks), starts = decoded(packed.as_py()), starts_of(part.values)
            more, marks = level.add(ids.astype(np.int64), marks, starts)
            score.append(before_.values.to_numpy() + np.add.reduceat(more, starts))
            if not last:
                codes.append(coded(ids, marks))
        ends = pa.array(np.cumsum([0, *map(len, score)]), pa.int32())
        scored = some.set_column(some.column_names.index("score"), "score", pa.ListArray.from_arrays(ends, pa.array(np.concatenate(score))))
        if not last:
            scored = scored.set_column(some.column_names.index("codes"), "codes", pa.array(codes, pa.binary()))
        return scored.select(names)

    return texts.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(score, schema)


def learn(read: DataFrame, words: DataFrame, buckets: int, n_train: int, v_train: int, n_every: int, depth: int, keep: bool = False) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Numbered words, contexts and pairs of each length, and the scored slices.

    A table is deleted when the one made from it is written; ``keep`` leaves contexts and pairs, for a caller that reads them.
    """
    words = numbered(words)
    shorter = words.where("number >= 0").select(F.col("number").alias("t"), "n", F.log10((F.col("n") + 0.5) / F.lit(n_train + 0.5 * (v_train + 1))).alias("state"))
    texts = scratch(encode(read, words, buckets, n_train, v_train), "texts")
    discard(read)
    parts = max(1, -(-n_every // BLOCK_TOKENS))
    levels, asked = [], scratch(questions(texts, 0, parts), "asked")
    for length in range(1, depth + 1):
        before, asked = asked, scratch(questions(texts, length, parts), "asked")
        contexts, pairs = settle(asked, shorter, length, n_train)
        if length > 1 and not keep:
            discard(shorter)
        scored = step(texts, before, asked, contexts, pairs, length, length == depth, parts)
        if length < depth:
            scored = scratch(scored, "texts")
            discard(texts, before, *([] if keep else [contexts]))
        texts, shorter = scored, pairs
        levels.append((contexts, pairs))
    return words, levels, texts


def grow(docs: DataFrame, words: DataFrame, held: Column, n_train: int, v_train: int, text: str, depth: int, key: str = "doc_id") -> Tree:
    """The whole tree in memory."""
    n_every = words.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    buckets = buckets_of(docs, text)
    read = scratch(pieces(docs, held, text, key, buckets), "pieces")
    words, levels, _ = learn(read, words, buckets, n_train, v_train, n_every, depth, keep=True)
    tree = Tree([r["word"].encode() for r in words.where("number >= 0").orderBy("number").select("word").collect()], [])
    for length, (contexts, pairs) in enumerate(levels, 1):
        c, p = contexts.toPandas(), pairs.toPandas()
        own = context(length)
        tree.levels.append(Level([c[w].to_numpy(np.int64) for w in own], c["retained"].to_numpy(bool), c["others"].to_numpy(float),
                                 [p[w].to_numpy(np.int64) for w in (*own, "t")], p["delta"].to_numpy(float)))
    return tree


def scores(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    buckets = buckets_of(docs, text)
    read = scratch(pieces(docs, held, text, key, buckets), "pieces")
    words = scratch(totals(read), "words")
    n_train, v_train, n_every = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    *_, texts = learn(read, words, buckets, n_train, v_train, n_every, depth)
    rows = texts.select(F.explode(F.arrays_zip("docs", "score")).alias("_row")).select("_row.docs.*", "_row.score")
    return rows.select(F.col("_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def digests(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    return scores(docs, held_out("doc_id", modulus, remainder))
