"""Byte-pair encoding and decoding with the vocabulary of a public byte-level tokenizer.

A text is cut into pieces by the tokenizer's own split rule.  The bytes of a piece are the nodes of a
doubly linked list; a priority queue holds the rank of every adjacent pair that has a merge rule, the
smallest rank (then the leftmost pair) is merged, and entries whose pair has changed meanwhile are
skipped.  Decoding concatenates the vocabulary strings of the ids.

Defined results: a null text is encoded as the empty text (no ids); repeated rows give repeated
results; other columns of the input are not read, so they may have any name.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import small_batches, whole_text

#: Fixed value: the split rule of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these blocks may be classed differently by another Unicode version.
UNSETTLED = regex.compile(r"[^\x00-ԯ‐-‧一-龥가-힣]")
#: The same rule for texts of ASCII characters only, where the faster standard matcher knows every class.
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: A tokenizer file larger than this is refused: its content is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Bytes of text that a worker handles at a time.
BATCH_BYTES = 4 << 20
#: Pieces in each of the two generations that a worker remembers; its memory does not grow with the corpus.
REMEMBERED = 150_000


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a vocabulary string stands for: printable Latin-1 itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class Codec(dict):
    """Encoder and decoder; as a dict it remembers the ids of pieces, as the bytes of 32-bit numbers.

    When the dict is full it becomes the older generation, and pieces met again move to the new one.
    """

    def __init__(self, spec: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        spec = json.loads(spec)
        model = spec["model"]
        vocab = model["vocab"]
        to_byte = byte_of_character()
        self.split = regex.compile(SPLIT).findall
        self.symbol = [0] * 256
        for character, byte in to_byte.items():
            self.symbol[byte] = vocab[character]
        #: For a left symbol, the rank of its merge with each right symbol.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left]].setdefault(vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.special = {}
        for t in spec.get("added_tokens", []):
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("only plain added tokens are supported")
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"].encode()
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbol, ranks, merged = self.symbol, self.ranks, self.merged
        ids = [symbol[b] for b in piece]
        n = len(ids)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        queue = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            if right in ranks[left]:
                queue.append(ranks[left][right] << bits | i - 1)
            left = right
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & mask, entry >> bits
            j = after[i]
            if j >= n or ids[i] < 0 or ranks[ids[i]].get(ids[j]) != rank:
                continue  # stale: one of the two symbols has been merged away
            ids[i] = new = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if ids[k] in ranks[new]:
                    heappush(queue, ranks[new][ids[k]] << bits | i)
            h = before[i]
            if h >= 0 and new in ranks[ids[h]]:
                heappush(queue, ranks[ids[h]][new] << bits | h)
        return [i for i in ids if i >= 0]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece) or array("i", self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text)
        if UNSETTLED.search(text) is None:
            return self.split(text)
        from tokenizers.pre_tokenizers import ByteLevel
        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as the bytes of 32-bit numbers."""
        if not any(name in text for name in self.special):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        return b"".join(array("i", [self.special[part]]).tobytes() if part in self.special
                        else b"".join(map(self.__getitem__, self.pieces(part))) for part in self.cut(text))

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """One codec per worker and vocabulary."""
    key = hash(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def load(path: str) -> str:
    """The tokenizer file (on the driver); its size is checked because it is broadcast."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _ids(c: Codec, texts: pa.Array) -> pa.ListArray:
    found = [c.encode(value.as_py()) for value in texts]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _texts(c: Codec, lists: pa.ListArray) -> pa.Array:
    return pa.array([c.decode(value.values.to_pylist()) if value.is_valid else None for value in lists], pa.string())


def _map(df: DataFrame, tokenizer_path: str, added: dict[str, str], run) -> DataFrame:
    """``df`` with the columns ``added`` (name to type), which ``run(codec, batch)`` gives as arrays."""
    shared = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in small_batches(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(c, batch)], names=[*batch.schema.names, *added])

    known = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(mapped, ", ".join(f"`{name}` {kind}" for name, kind in (known | added).items()))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` array<int> of every whole text."""
    source = docs.select(*keep, whole_text(text).alias("_text"))
    return _map(source, tokenizer_path, {ids: "array<int>"}, lambda c, batch: [_ids(c, batch.column("_text"))]).drop("_text")


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added; null ids have no text."""
    return _map(encoded, tokenizer_path, {text: "string"}, lambda c, batch: [_texts(c, batch.column(ids))])


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, token_ids of every whole text, and decoded: what these ids decode to, in one pass."""

    def run(c: Codec, batch: pa.RecordBatch) -> list:
        lists = _ids(c, batch.column("_text"))
        return [lists, _texts(c, lists)]

    source = docs.select(*keep, whole_text(text).alias("_text"))
    return _map(source, tokenizer_path, {"token_ids": "array<int>", "decoded": "string"}, run).drop("_text")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = round_trip(docs, tokenizer_path)
    joined = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
