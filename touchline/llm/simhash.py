"""Near-duplicate documents by SimHash, linked through the anchor points of a covering code.

``fingerprints``: a bit of the 64-bit fingerprint is 1 if it is set in over half of the XXH64 hashes
(seed 42) of the text's 4-word shingles, repeats included.

``links``: fingerprints at 4 or fewer differing bits.  The 64 bits are three blocks of 23, 23 and 18;
of 4 differing bits, some block holds at most 1.  The anchors of a block are the 4,096 words of the
binary Golay code, which covers all 23-bit words with radius 3.  A fingerprint is at home at the
nearest anchor (distance 3 or less) of each block and is replicated to every anchor within 3 + 1, so a
linked fingerprint meets it at its home: one anchor in the block, or six, five on average.  Every
anchor compares its residents with its members, bits of the whole fingerprint.  ``blocks_per_anchor=2``
uses pairs of blocks (2 differing bits at most in one of the pairs, 2^24 anchors, about 61 replicas a
pair) and suits more than about 10^8 different fingerprints; both give the same links.

Equal fingerprints are one class before anything is compared.  An anchor with many members is cut into
parts by hash, and each pair of parts is a task of bounded size.  A task returns a spanning forest of
the links it found, at most one edge per member, which keeps every connection without listing the
pairs inside a group.  ``touchline.llm.common.components`` then finds the smallest document of each group.

Defined results: null and empty texts have fingerprint zero, linked like any other.  A null id is
ignored when the smallest id is sought; it is the component only where no other id is there.  Repeated
rows stay repeated.  Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow, components, scratch, small_batches, whole_text

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: First bit and width of the three blocks.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
RADIUS = 3
#: Members of an anchor that one task compares with one another.
PART = 4096
#: Different fingerprints from which pairs of blocks make the better anchors.
MANY = 100_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:len(words) - shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield arrow(["_id", "fp"], [batch.column(0), found])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), whole_text(text).alias("_text")).mapInArrow(run, f"_id {kind}, fp long").withColumnRenamed("_id", key)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome tables, and per syndrome the error patterns of weight up to 5 as (pattern, weight above the radius) lists.

    The first pattern of a syndrome leads to the nearest code word, the others to those one or two bits beyond radius 3.
    """
    remainder = []
    for i in range(23):
        r = 1 << i
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        remainder.append(r)

    def fold(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, r in enumerate(bits):
            out[1 << i:2 << i] = out[:1 << i] ^ r
        return out

    low, high = fold(remainder[:12]), fold(remainder[12:])
    patterns: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(RADIUS + 3):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= remainder[p]
            patterns[syndrome].append((sum(1 << p for p in places), max(0, weight - RADIUS)))
    width = max(map(len, patterns))
    pattern, beyond = np.full((2048, width), -1, np.int64), np.full((2048, width), 99, np.int64)
    for s, found in enumerate(patterns):
        for i, (p, over) in enumerate(found):
            pattern[s, i], beyond[s, i] = p, over
    return np.concatenate([low, high]), pattern, beyond


def anchors(fps: np.ndarray, blocks_per_anchor: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for every anchor that each fingerprint goes to."""
    tables, pattern, beyond = golay()
    words, syndromes = [], []
    for first, width in BLOCKS:
        word = (fps.view(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        words.append(word)
        syndromes.append(tables[word & 4095] ^ tables[4096 + (word >> 12)])
    budget = MAX_DISTANCE * blocks_per_anchor // len(BLOCKS)
    rows, keys, homes = [], [], []
    for group, members in enumerate(combinations(range(len(BLOCKS)), blocks_per_anchor)):
        row = np.arange(len(fps))
        key, spent, home = np.full(len(fps), group, np.int64), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for b in members:
            over = beyond[syndromes[b][row]]
            at, choice = np.nonzero(over + spent[:, None] <= budget)
            code = words[b][row[at]] ^ pattern[syndromes[b][row[at]], choice]
            row, key, spent, home = row[at], key[at] << 23 | code, spent[at] + over[at, choice], home[at] & (choice == 0)
        rows.append(row)
        keys.append(key)
        homes.append(home)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(residents: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links between the residents and all members of one anchor, residents included."""
    nodes = np.unique(members)
    label = np.arange(len(nodes))
    values = nodes.view(np.uint64)
    for at in range(0, len(residents), 128):
        some = residents[at:at + 128]
        near = np.bitwise_count(some.view(np.uint64)[:, None] ^ values[None, :]) <= MAX_DISTANCE
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        for i in linked.tolist():
            reached = np.flatnonzero(near[i])
            old = np.unique(label[reached])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, blocks_per_anchor: int = 1, part: int = PART) -> DataFrame:
    """(a, b): edges that connect exactly the linked fingerprints of the column ``fp`` (all different)."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4096):
                some = np.ascontiguousarray(own[at:at + 4096])
                row, key, home = anchors(some, blocks_per_anchor)
                yield arrow(["anchor", "home", "fp"], [key, home, some[row]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task key; a task is complete when the next key begins."""
        rest = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rest = rows if rest is None else [np.concatenate(c) for c in zip(rest, rows)]
            change = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0) | (np.diff(rest[2]) != 0)) + 1
            if len(change):
                yield from tasks([c[:change[-1]] for c in rest], np.concatenate(([0], change)))
                rest = [c[change[-1]:] for c in rest]
        if rest is not None and len(rest[0]):
            yield from tasks(rest, np.array([0, len(rest[0])]))

    def tasks(rows: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            fp, home = rows[4][a:b], rows[3][a:b].astype(bool)
            if b - a > 1 and home.any():
                edges = forest(fp[home], fp)
                if len(edges[0]):
                    found.append(edges)
        if found:
            yield arrow(["a", "b"], [np.concatenate(c) for c in zip(*found)])

    placed = scratch(fps.select("fp").mapInArrow(replicate, "anchor long, home boolean, fp long"), "anchors")
    sizes = scratch(placed.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("settled"))
             .where("n > 1 and settled").select("anchor", F.ceil(F.col("n") / part).cast("int").alias("parts")), "sizes")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    spread = (placed.join(sizes, "anchor").select("anchor", "home", "fp", own.alias("own"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
              .select("anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "home", "fp"))
    return (spread.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
            .mapInArrow(compare, "a long, b long").distinct())


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", blocks_per_anchor: int | None = None, part: int = PART) -> DataFrame:
    """key, fp and component_id (the smallest key that a row reaches over links) of every row."""
    prints = scratch(fingerprints(docs, text, key), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("_least"))
    if blocks_per_anchor is None:
        blocks_per_anchor = 1 if prints.agg(F.approx_count_distinct("fp")).first()[0] < MANY else 2
    roots = components(links(classes, blocks_per_anchor, part)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = scratch(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    named = scratch(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
