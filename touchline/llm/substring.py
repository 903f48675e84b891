"""Removal of long passages that an earlier document also holds, by windows hashed under content-chosen anchors.

This stands in place of a relative Lempel-Ziv parse: a factor here is a run of windows that each occur in some earlier
document; it has no reference position and may join windows of different documents.

The reference of a document is every document with a smaller id.  It is cut into blocks at places
chosen by content: every window of 50 words names one anchor, the 10-word sequence in it with the
smallest hash, and the stretch of all consecutive windows with one anchor is a block.  Equal windows
name equal anchors, wherever they stand, so a document only has to be compared with the blocks indexed
under its own anchors.

1. ``blocks``: every document's blocks, as (anchor, digest of the block's words, place).
2. ``index``: per anchor the smallest and largest document and digest.  An anchor of one document only
   has no reference; one digest means that all its blocks are equal; else the blocks differ somewhere.
3. ``references``: a block equal to an indexed one of a smaller document is a factor as a whole.
   Where blocks differ, their windows are looked up one by one in the same way (smallest document per
   window), because a factor may begin or end inside a block.
4. ``parse``: each document is factored greedily from left to right: a factor starts at the first
   window with a reference and grows while the next window has one.  The windows across the end of a
   factor are among those looked up, so no duplicate is lost at a factor boundary.  The words of
   factors (50 or more) are the duplicate spans.

Both look-ups are minima per key, combined before the shuffle and written, and a join back on the key, which
Spark splits where a key is hot.  A block is known by 128 hash bits, a window by 96.  No group is gathered, no pairs are made: the work follows the number of
blocks, and of windows in blocks with variants.

Defined results: windows are judged on the input.  A null text has no words.  A document without an id
is neither reference nor changed.  Rows that share an id are judged each by its own text and are no
reference to one another.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow, scratch, small_batches, whole_text
from touchline.llm.words import Rolling, numbers

WINDOW = 50
GRAM = 10


def anchors_of(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams the place of its smallest gram, the leftmost of equals."""
    value, place = grams, np.arange(len(grams), dtype=np.int64)
    covered = 1
    while covered < width:
        shift = min(covered, width - covered)
        a, b = value[:-shift], value[shift:]
        later = b < a
        value, place = np.where(later, b, a), np.where(later, place[shift:], place[:-shift])
        covered += shift
    return place


def document_blocks(documents: list[list[bytes]], window: int, gram: int):
    """Arrays (document number, anchor hash, block digest, first window, number of windows) of some documents.

    The documents are hashed as one array; windows and blocks never cross from one to the next.
    """
    sizes = np.array([len(words) for words in documents])
    begins = np.cumsum(sizes) - sizes
    x = numbers([word for words in documents for word in words])
    one, two = Rolling(x[0], 0), Rolling(x[1], 1)
    grams = one.of(np.arange(x.shape[1] - gram + 1), gram)
    mixed = grams * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    place = anchors_of(mixed, window - gram + 1)
    windows = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(begins, windows) + start
    own_place = place[at]
    new = np.flatnonzero(np.concatenate(([True], (own_place[1:] != own_place[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(new, len(owner)))
    digest = two.of(at[new], count + window - 1)
    return owner[new], grams[own_place[new]], digest, start[new], count


def blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, digest, id, row (tells rows that share an id apart), first window and number of windows of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            documents = [text.as_py().encode().split() for text in batch.column(2)]
            long = [i for i, words in enumerate(documents) if len(words) >= window]
            if long:
                owner, anchor, digest, first, count = document_blocks([documents[i] for i in long], window, gram)
                row = pa.array(np.array(long)[owner])
                yield arrow(["anchor", "digest", "id", "row", "first", "windows"],
                            [anchor.view(np.int64), digest.view(np.int64), batch.column(0).take(row), batch.column(1).take(row), first.astype(np.int32), count.astype(np.int32)])

    return (docs.where("_id is not null").select("_id", "_row", "_text")
            .mapInArrow(run, f"anchor long, digest long, id {docs.schema['_id'].dataType.simpleString()}, row long, first int, windows int"))


def references(found: DataFrame) -> DataFrame:
    """Blocks with a reference: all equal (``whole``), or with variants that differ somewhere."""
    index = (found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("digest").alias("a"), F.max("digest").alias("b"))
             .where("least < most").select("anchor", "least", (F.col("a") == F.col("b")).alias("whole")))
    return found.join(scratch(index, "index"), "anchor").where("id > least or not whole").select("id", "row", "first", "windows", "whole")


def window_references(docs: DataFrame, varied: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, row, first, windows) for the windows in ``varied`` blocks that a smaller document also holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            parts = []
            for key, row, text, spans in zip(*(batch.column(i) for i in range(4))):
                words = text.as_py().encode().split()
                x = numbers(words)
                one, two = Rolling(x[0], 0), Rolling(x[1], 1)
                at = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["windows"]) for s in spans.as_py()]))
                parts.append((one.of(at, window).view(np.int64), (two.of(at, window) >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), key.as_py()), np.full(len(at), row.as_py()), at.astype(np.int32)))
            if parts:
                yield arrow(["w1", "w2", "id", "row", "first"], [np.concatenate(c) for c in zip(*parts)])

    spans = varied.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "windows")).alias("_spans"))
    windows = scratch(docs.join(spans, ["_id", "_row"]).select("_id", "_row", "_text", "_spans")
                      .mapInArrow(run, f"w1 long, w2 int, id {docs.schema['_id'].dataType.simpleString()}, row long, first int"), "windows")
    least = scratch(windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"), "least")
    return windows.join(least, ["w1", "w2"]).where("id > least").select("id", "row", "first", F.lit(1).alias("windows"))


def parse(text: bytes, spans: list[tuple[int, int]], window: int):
    """Words, the factors (first word, length) of a greedy left-to-right parse, and a keep mask."""
    words = text.split()
    matched = np.zeros(len(words) + 1, np.int32)
    for first, count in spans:
        matched[first] += 1
        matched[first + count] -= 1
    has = np.concatenate(([False], np.cumsum(matched) > 0, [False]))
    starts, ends = np.flatnonzero(~has[:-1] & has[1:]), np.flatnonzero(has[:-1] & ~has[1:])
    factors = [(int(a), int(b - a + window - 1)) for a, b in zip(starts, ends)]
    keep = np.ones(len(words), bool)
    for first, length in factors:
        keep[first:first + length] = False
    return words, factors, keep


def cut(text: bytes, keep: np.ndarray) -> str:
    """The text without the dropped words and the space in front of them; untouched parts stay as they are."""
    out, at, space = [], 0, 0
    for k, word in zip(keep.tolist(), text.split()):
        begin = text.index(word, at)
        if k:
            out.append(text[space:begin + len(word)])
        at = space = begin + len(word)
    out.append(text[space:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, n_words, factors, kept (text without them), n_removed and kept_sha256 of every document."""
    source = docs.select(F.col(key).alias("_id"), whole_text(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    repeated = source.where("_id is not null").groupBy("_id").count().where("count > 1")
    source = source.withColumn("_row", F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("_text"))
    ref = scratch(references(scratch(blocks(source, window, gram), "blocks")), "references")
    single = window_references(source, ref.where("not whole"), window)
    spans = (ref.where("whole").drop("whole").unionByName(single).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row"))
             .agg(F.collect_set(F.struct("first", "windows")).alias("_spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text_, found in zip(batch.column("_text"), batch.column("_spans")):
                value = text_.as_py()
                raw = value.encode()
                words, factors, mask = parse(raw, [(s["first"], s["windows"]) for s in found.as_py() or []], window)
                left = b" ".join([w for w, k in zip(words, mask.tolist()) if k] if factors else words)
                out.append((len(words), len(words) - int(mask.sum()), hashlib.sha256(left).hexdigest(),
                            [{"first": a, "words": b} for a, b in factors], cut(raw, mask) if factors else value))
            n, removed, digest, factors, kept = zip(*out)
            yield arrow([*kept_names, "n_words", "n_removed", "kept_sha256", "factors", "kept"],
                        [*(batch.column(c) for c in kept_names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                         pa.array(factors, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.string())])

    kept_names = ["_id", *[f"_keep_{c}" for c in keep]]
    joined = source.join(spans, ["_id", "_row"], "left").select(*kept_names, "_text", "_spans")
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept_names), "n_words long, n_removed long, kept_sha256 string, factors array<struct<first:int,words:int>>, kept string"])
    done = joined.mapInArrow(run, schema)
    return done.select(F.col("_id").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep], "n_words", "n_removed", "kept_sha256", "factors", "kept")


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
