"""Benchmark decontamination: MinHash containment search of short items inside long documents.

An item is the set of its five-word shingles. It is found in a document that holds at least
``THRESHOLD`` of them. Items are partitioned by the size of their sets; in a partition of sizes up to u
an item's sketch is its k = u - ceil(THRESHOLD * u) + 1 least hash values (a bottom-k MinHash sketch).
A document that holds enough of the set misses fewer than k shingles, so it must hold one of the
sketch: no document is missed, however long it is, and the sketch of a document is never needed.
Each candidate is verified by exact shingle containment.

The items are the query set. They are taken in blocks of bounded size that are sent to the executors;
each block is held against all documents, in the scan, without a shuffle.

Cases: null and empty texts, and those of fewer than five words, hold no shingle and match nothing.
Repeated items each match; repeated documents each match. Null ids are kept. Empty tables give an
empty result. Very long texts are read in overlapping pieces, so their shingles are complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import textvec
from glyphlake.llm.shared import OWN, written

THRESHOLD = 0.8
#: Shingles of a block of items at most (one larger item makes a block of its own).
BLOCK_SHINGLES = 1_000_000
_FILTER_BITS = 22


@dataclass
class Index:
    """Shingles and the items of each."""

    shingles: np.ndarray  # sorted, each once
    starts: np.ndarray  # of each shingle's stretch of ``items``
    items: np.ndarray
    seen: np.ndarray  # by a hash's leading bits: some shingle has them


@dataclass
class Block:
    """Items of one block: the sketches that find candidates, and the whole sets that decide on them."""

    ids: list[int | None]
    sizes: np.ndarray
    sketches: Index
    sets: Index


def index(sets: list[np.ndarray]) -> Index:
    shingle = np.concatenate([np.zeros(0, np.uint64), *sets])
    item = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64)
    order = np.argsort(shingle, kind="stable")
    each, starts = np.unique(shingle[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[each >> np.uint64(64 - _FILTER_BITS)] = True
    return Index(each, np.append(starts, len(shingle)), item[order], seen)


def sketch_length(size: int, threshold: float = THRESHOLD) -> int:
    """The sketch length of the partition (u/2, u] that a set size lies in; u is a power of two."""
    most = 1 << max(0, size - 1).bit_length()
    return most - ceil(threshold * most - 1e-9) + 1


def block(sets: list[tuple[int | None, np.ndarray]]) -> Block:
    """The items of these (id, sorted shingles); a sketch is the least shingles of a set."""
    own = [s for _, s in sets]
    return Block([i for i, _ in sets], np.array([len(s) for s in own], dtype=np.int64), index([s[: sketch_length(len(s))] for s in own]), index(own))


def blocks(items: DataFrame, text: str, key: str) -> Iterator[Block]:
    """The items' shingle sets, worked out on the executors and fetched block by block."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows, hashes = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.uint64)), *textvec.all_shingles(texts), strict=True))
            parts = [np.unique(hashes[rows == i]).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["id", "set"])

    table = written(items.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(sets, "id long, set binary"), "items")
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in table.where(F.octet_length("set") > 0).orderBy("id").toLocalIterator():
        own = np.frombuffer(bytes(row["set"]), dtype=np.uint64)
        if held and size + len(own) > BLOCK_SHINGLES:
            yield block(held)
            held, size = [], 0
        held.append((row["id"], own))
        size += len(own)
    if held:
        yield block(held)


def _met(shingles: np.ndarray, seen: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, place) once for which the text holds the shingle at that place of a sorted array."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, hashes in textvec.all_shingles(texts):
        maybe = np.flatnonzero(seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(shingles, hashes[maybe])
        hit = (at < len(shingles)) & (shingles[np.minimum(at, len(shingles) - 1)] == hashes[maybe])
        rows.append(row[maybe][hit])
        places.append(at[hit])
    pair = np.unique(np.concatenate(rows) * (len(shingles) + 1) + np.concatenate(places))
    return pair // (len(shingles) + 1), pair % (len(shingles) + 1)


def _pairs(index: Index, items: int, texts: list[str]) -> np.ndarray:
    """row * items + item for each text and each of an index's shingles that it holds, and each of that shingle's items."""
    row, place = _met(index.shingles, index.seen, texts)
    n = index.starts[place + 1] - index.starts[place]
    posting = np.repeat(index.starts[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n) * items + index.items[posting]


def search(query: Block, texts: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of each text that holds enough of an item.

    Sketches alone say which texts are candidates; only those are read again and held against whole sets.
    """
    n = len(query.ids)
    candidates = np.unique(_pairs(query.sketches, n, texts))
    if not len(candidates):
        return []
    rows = np.unique(candidates // n)
    both = _pairs(query.sets, n, [texts[r] for r in rows])
    both = rows[both // n] * n + both % n
    found, shared = np.unique(both[np.isin(both, candidates)], return_counts=True)
    enough = shared >= np.ceil(threshold * query.sizes[found % n] - 1e-9)
    return [(int(f) // n, int(f) % n, int(s)) for f, s in zip(found[enough], shared[enough], strict=True)]


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of each document and item that it holds."""
    schema = "doc_id long, item_id long, item_shingles int, shared int, containment double"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    result = docs.sparkSession.createDataFrame([], schema)
    for query in blocks(items, item_text, item_key):
        sent = docs.sparkSession.sparkContext.broadcast(query)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = search(own, [x or "" for x in batch.column(1).to_pylist()])
                cells = [(ids[r], own.ids[i], int(own.sizes[i]), s, s / int(own.sizes[i])) for r, i, s in found]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        result = result.unionByName(rows.mapInArrow(scan, schema))
    return result


def _holds(sent: Broadcast) -> Callable[[Column], Column]:
    """A test whether a text holds an item of a block."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            mark = np.zeros(len(batch), dtype=bool)
            mark[[r for r, _, _ in search(sent.value, [x or "" for x in batch.tolist()])]] = True
            yield pd.Series(mark)

    return holds


def flag(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", out: str = "contaminated") -> DataFrame:
    """Adds a boolean column: the document holds an item."""
    got = docs.withColumn(f"{OWN}found", F.lit(False))
    for query in blocks(items, item_text, item_key):
        sent = docs.sparkSession.sparkContext.broadcast(query)
        got = got.withColumn(f"{OWN}found", F.col(f"{OWN}found") | _holds(sent)(F.col(text).cast("string")))
    return got.withColumn(out, F.col(f"{OWN}found")).drop(f"{OWN}found")
