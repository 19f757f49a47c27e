"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: each partition packs its pieces best-fit decreasing, nearly full bins
are final, and underfull bins become items of the next round, in which fewer, larger groups are packed
best-fit again. A bin carries its pieces (never their tokens), so no later join puts them together.
A group has about ``GROUP`` bins, so a task's memory stays bounded; rounds end when one group is left
or a round removes too few bins to matter.

Cases: a null or empty text is its end token alone. Documents longer than a sequence are cut so that
all pieces but the first are full. Repeated rows are packed as often as they occur. A null id is kept.
An empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.shared import written

CAPACITY = 2048
END_ID = 0
#: A bin with at most this many free places is final; one with more is packed again.
SLACK = 4
#: Underfull bins that one task packs in a later round.
GROUP = 50_000
#: Pieces that a task of the first round gathers before it packs them.
LOCAL = 500_000
#: Encodings of chunks of text that a worker keeps.
CACHED = 300_000
#: White space beside a blank: then a blank may not begin a chunk of its own.
_ODD = re.compile(r"\s | \s| $|^ |\x00|<\|endoftext\|>")

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = "bin long, fill int, open boolean, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder(dict):
    """Ids of whole texts, as little-endian 32-bit integers; the dictionary holds those of chunks.

    Single blanks between words always begin a new pre-token, so the ids of a text are those of its
    blank-led chunks in turn. Texts with other blanks are encoded as a whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        letters = byte_letters()
        vocabulary = json.loads(Path(path).read_text())["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks.pop(b"<|endoftext|>", None)
        self.chunk = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.chunk.encode_ordinary(chunk), dtype="<u4").tobytes()
        if len(self) < CACHED and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00")))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Piece number, start, length and ids of each piece of a document."""
    n = len(ids) // 4
    start, end, piece = 0, n % CAPACITY or min(n, CAPACITY), 0
    while start < n:
        yield piece, start, end - start, ids[4 * start : 4 * end]
        start, end, piece = end, end + CAPACITY, piece + 1


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that has room for it; the items of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r places free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - need:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _packed(items: list[tuple[int, list[tuple]]], serial: Iterator[int], last: bool) -> Iterator[pa.RecordBatch]:
    """Bins of (fill, pieces) items, in batches."""
    bins = best_fit([fill for fill, _ in items])
    for a in range(0, len(bins), 5000):
        ids, fills, opens, pieces = [], [], [], []
        for members in bins[a : a + 5000]:
            inside, at = [], 0
            for i in members:
                for p in items[i][1]:
                    inside.append((*p[:5], at))
                    at += p[3]
            ids.append(next(serial))
            fills.append(at)
            opens.append(not last and at < CAPACITY - SLACK)
            pieces.append(inside)
        yield _batch(ids, fills, opens, pieces)


def _batch(ids: list[int], fills: list[int], opens: list[bool], pieces: list[list[tuple]]) -> pa.RecordBatch:
    columns = list(zip(*(p for inside in pieces for p in inside), strict=True)) or [()] * 6
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], fields=list(PIECE))
    ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in pieces]))), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fills, pa.int32()), pa.array(opens, pa.bool_()), pa.ListArray.from_arrays(ends, flat)], names=["bin", "fill", "open", "items"])


def _serial(round_: int) -> Iterator[int]:
    """Numbers that no other task or round gives; a table is written before they are used."""
    base = round_ << 56 | TaskContext.get().partitionId() << 32
    return iter(range(base, base + (1 << 32)))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, codec, full, items = _serial(0), encoder(tokenizer), [], []
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = codec.encode(words or "") + END_ID.to_bytes(4, "little")
                for piece, start, length, own in cut(ids):
                    row = (doc, piece, start, length, zlib.crc32(own), 0)
                    if length == CAPACITY:
                        full.append(row)
                    else:
                        items.append((length, [row]))
            if len(full) > 5000:
                yield _batch([next(serial) for _ in full], [CAPACITY] * len(full), [False] * len(full), [[x] for x in full])
                full = []
            if len(items) > LOCAL:
                yield from _packed(items, serial, False)
                items = []
        if full:
            yield _batch([next(serial) for _ in full], [CAPACITY] * len(full), [False] * len(full), [[x] for x in full])
        yield from _packed(items, serial, False)

    bins = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(first, BIN), "packing-0")
    done, waiting = bins.where(~F.col("open")), bins.where("open")
    left, round_ = waiting.count(), 0
    while left:
        round_ += 1
        groups = -(-left // GROUP)

        def again(batches: Iterator[pa.RecordBatch], round_: int = round_, last: bool = groups == 1) -> Iterator[pa.RecordBatch]:
            items = [(fill, [tuple(p.values()) for p in pieces]) for b in batches for fill, pieces in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield from _packed(items, _serial(round_), last)

        bins = written(waiting.repartition(groups).mapInArrow(again, BIN), f"packing-{round_}")
        still = bins.where("open")
        count = still.count()
        if count > 0.95 * left:  # what is left doesn't combine: it stays as it is
            done, left = done.unionByName(bins), 0
        else:
            done, waiting, left = done.unionByName(bins.where(~F.col("open"))), still, count
    return done.select(F.col("bin").alias("sequence_id"), F.inline("items")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
