"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 10 consecutive words of the benchmark items; an item with fewer words
is one pattern of its own length.  Patterns of one length are searched together: a table over blocks of
two adjacent words tells how far the search may jump when the window ends in that block (a block that no
pattern holds skips the whole pattern but one word); where the jump is zero, the patterns that end in the
block are found by the hash of their last block, then by the hash of their first two words, and direct
comparison confirms an occurrence.

The benchmark is the stated query set.  It is split by hash into parts of at most ``PART_BYTES`` of
text, each broadcast on its own, so what is broadcast has a proven bound; results of several parts are
merged per document.

Defined results: words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; a
null text has no words and is never contaminated, an item without words matches nothing.  Rows that
repeat an item id count as one item; an item without an id makes words hit but is not listed.  Repeated
document rows are judged each by itself.  Other columns are not read.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow, small_batches, whole_text

WINDOW = 10
PART_BYTES = 32 << 20
#: Bytes that end a word become spaces, A-Z become a-z, all others stay.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Patterns:
    """Search tables of all patterns of one length."""

    def __init__(self, length: int, patterns: Iterable[tuple[bytes, ...]]):
        self.length = length
        self.block = min(2, length)
        self.jump_far = length - self.block + 1
        self.jump: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.jump[key] = min(length - end, self.jump.get(key, self.jump_far))
            self.bucket[pattern[-self.block:]][pattern[:self.block]].append(pattern)
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of every occurrence."""
        length, block, far = self.length, self.block, self.jump_far
        jump = self.jump.get
        end, n = length, len(words)
        while end <= n:
            last = tuple(words[end - block:end])
            step = jump(last, far)
            if step:
                end += step
                continue
            first = end - length
            for pattern in self.bucket[last].get(tuple(words[first:first + block]), ()):
                if tuple(words[first:end]) == pattern:
                    yield first, pattern
            end += 1


class Searcher:
    """All patterns of some benchmark items, by length, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(dict)
        for item, text in items:
            words = words_of(text or "")
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                by_length[size].setdefault(tuple(words[at:at + size]), set()).add(item)
        self.items = by_length
        self.tables = [Patterns(size, patterns) for size, patterns in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (first word, length) of all occurrences, and the items found."""
        spans, items = [], set()
        for table in self.tables:
            for first, pattern in table.search(words):
                spans.append((first, table.length))
                items |= self.items[table.length][pattern]
        return spans, items


def covered(spans: list[tuple[int, int]]) -> list[int]:
    return sorted({i for first, length in spans for i in range(first, first + length)})


def parts_of(benchmark: DataFrame, item: str, text: str, part_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``part_bytes`` at most."""
    source = benchmark.select(F.col(item).alias("_item"), whole_text(text).alias("_text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("_text") + 32), F.lit(0))).first()[0]
    if total <= part_bytes:
        return [source]
    parts = -(-int(total) * 2 // part_bytes)
    return [source.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(parts)) == p) for p in range(parts)]


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns ``keep``, n_words, hit (places of hit words) and items (ids as text, sorted) of every document."""
    spark = docs.sparkSession
    source = docs.select(*keep, whole_text(text).alias("_text"))
    names = source.columns[:-1]

    def searched(docs_: DataFrame, part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, window)
            for batch in small_batches(batches):
                n, hit, found = [], [], []
                for value in batch.column("_text"):
                    words = words_of(value.as_py())
                    spans, who = searcher.search(words) if words else ([], set())
                    n.append(len(words))
                    hit.append(covered(spans))
                    found.append(sorted(str(i) for i in who if i is not None))
                own = [c for c in batch.schema.names if c != "_text"]
                yield arrow([*own, "n_words", "hit", "items"], [*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))])

        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs_.schema.fields if f.name != "_text"]
        return docs_.mapInArrow(run, ", ".join([*own, "n_words long, hit array<int>, items array<string>"]))

    parts = parts_of(benchmark, item, item_text, part_bytes)
    if len(parts) == 1:
        return searched(source, parts[0])
    marked = source.withColumn("_row", F.sha2("_text", 256))
    merged = None
    for part in parts:
        one = searched(marked, part)
        merged = one if merged is None else merged.unionAll(one)
    keys = [*names, "_row"]
    sets = merged.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("_times"))
    return sets.withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*names, "n_words", "hit", "items")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(docs, benchmark)
    return found.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))
