"""Near-duplicate documents: BagMinHash signatures, banding, exact weighted Jaccard, connected groups.

A document is the multiset of its five-word shingles; the likeness of two is their weighted Jaccard
(sum of the lesser counts over the sum of the greater). BagMinHash draws, for each shingle, points of
Poisson processes over its weight axis, which is split into dyadic intervals ([0,1), [1,2), [2,4), ...);
a point falls into one of the signature's components and counts if it lies below the weight. The least
time in each component is the signature; two agree in a component with the probability of their
likeness. A process stops once it is later than every component's time, so long texts cost little more
than one point a shingle.

Equal texts form one class by two 64-bit hashes before anything else, and only classes meet in buckets.
With ``BANDS`` bands of ``ROWS`` components a pair at 0.8 shares none with probability (1-0.8**4)**24,
3e-6. Every candidate is verified on the whole texts.

Cases: null and empty texts are equal to each other and form one class. A text of fewer than five words
has no shingle, so only its exact copies join it. Repeated rows are copies. A null id is kept and is
never the smallest id of a class unless all are null. Columns of the answers' names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import textvec
from glyphlake.llm.linking import link
from glyphlake.llm.shared import written

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Bits of the map that says which texts may share a bucket with others: 8 MB.
BITMAP = 1 << 26


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, shingle and count of each different shingle of each row; whole rows, slice by slice."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, hashes = np.concatenate([r for r, _ in held]), np.concatenate([h for _, h in held])
        key = textvec.mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(rows[at], kind="stable")
        return rows[at][order], hashes[at][order], count[order]

    for rows, hashes in textvec.all_shingles(texts):
        if size > textvec.SLICE_CHARS // 8 and len(rows) and held[-1][0][-1] != rows[0]:
            yield counted()
            held, size = [], 0
        if len(rows):
            held.append((rows, hashes))
            size += len(rows)
    if held:
        yield counted()


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, components: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the least time in each component, of weighted sets."""
    names, doc = np.unique(rows, return_inverse=True)
    levels = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)
    share = np.minimum(counts[of] - low, width) / width  # of the interval that lies below the weight
    seed = textvec.mix(hashes[of] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc, time, drawn, block = doc[of], np.zeros(len(of)), 0, 1
    least = np.full(len(names) * components, np.inf)
    while len(doc):
        number = (np.arange(drawn, drawn + block, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = textvec.mix(seed[:, None] + number)
        at = time[:, None] + np.cumsum(-np.log(((x >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0), axis=1) / width[:, None]
        part = (((x & np.uint64(0xFFFFFFFF)) * np.uint64(components)) >> np.uint64(32)).astype(np.int64)
        cell, when = doc[:, None] * components + part, at
        if (share < 1).any():
            below = (textvec.mix(x) >> np.uint64(32)).astype(np.float64) / 4294967296.0 < share[:, None]
            cell, when = cell[below], at[below]
        np.minimum.at(least, cell.ravel(), when.ravel())
        time, drawn = at[:, -1], drawn + block
        block = min(64, 2 * drawn)
        go = time < least.reshape(-1, components).max(axis=1)[doc]
        doc, time, seed, width, share = doc[go], time[go], seed[go], width[go], share[go]
    return names, least.reshape(-1, components)


def band_keys(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = times.view(np.uint64).reshape(len(times), bands, rows)
    key = textvec.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :].repeat(len(times), axis=0)
    for j in range(rows):
        key = textvec.mix(key ^ (bits[:, :, j] * np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


def _bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        texts = [x or "" for x in batch.tolist()]
        found: list[np.ndarray | None] = [None] * len(texts)
        for rows, hashes, counts in bags(texts):
            names, times = signatures(rows, hashes, counts)
            for name, keys in zip(names, band_keys(times), strict=True):
                found[name] = keys
        yield pd.Series(found, dtype=object)


def likeness(a: str, b: str) -> float:
    """The weighted Jaccard of two texts' shingle multisets; 0 if neither has a shingle."""
    sides = []
    for text in (a, b):
        got = [h for _, h in textvec.all_shingles([text])]
        sides.append(np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    (x, n), (y, m) = sides
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    total = int(n.sum() + m.sum()) - least
    return least / total if total else 0.0


def _near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([likeness(x, y) >= THRESHOLD for x, y in zip(a, b, strict=True)], dtype=bool)


def _linked(ids: list[int], roots: list[int], as_x: list[bool], as_y: list[bool], texts: list[str]) -> list[tuple[int, int]]:
    """Links between the x and the y of a block that connect what testing all pairs would connect.

    Each count of a shingle is a token of its own, so the overlap of two multisets is a dot product.
    """
    got = [*bags(texts)]
    rows, hashes, counts = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    size = np.bincount(rows, weights=counts, minlength=len(ids))
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    token = textvec.mix(np.repeat(hashes, counts) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.repeat(rows, counts)
    _, number, often = np.unique(token, return_inverse=True, return_counts=True)
    met = often[number] > 1
    row, number = row[met], np.unique(number[met], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    x, y = np.flatnonzero(as_x), np.flatnonzero(as_y)
    overlap = np.zeros((len(x), len(y)), dtype=np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, (a, a + 4096))
        table = np.zeros((len(ids), min(4096, int(number[-1]) + 1 - a)), dtype=np.float32)
        table[row[lo:hi], number[lo:hi] - a] = 1
        overlap += table[x] @ table[y].T
    union = size[x][:, None] + size[y][None, :] - overlap
    group, links = {r: r for r in roots}, []

    def find(r: int) -> int:
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    for i, j in zip(*np.nonzero((union > 0) & (overlap >= THRESHOLD * union - 1e-9 * union)), strict=True):
        p, q = find(roots[x[i]]), find(roots[y[j]])
        if p != q:
            group[max(p, q)] = min(p, q)
            links.append((min(ids[x[i]], ids[y[j]]), max(ids[x[i]], ids[y[j]])))
    return links


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (cluster, bx, by, node, node_root, as_x, as_y, text), sorted by block; the links of each block."""
    held: list[tuple] = []
    name = None

    def answer() -> pa.RecordBatch:
        _, _, _, ids, roots, as_x, as_y, texts = (list(c) for c in zip(*held, strict=True))
        links = _linked(ids, roots, as_x, as_y, texts)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != name:
                yield answer()
                held = []
            name = row[:3]
            held.append(row)
    if held:
        yield answer()


def _maybe(wanted: DataFrame) -> Callable[[str], Column]:
    """A test whether a 64-bit hash may be among those of a table; its bitmap has ``BITMAP`` bits, whatever the table's size."""
    bit = F.pmod(wanted[0], F.lit(BITMAP)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros((BITMAP // 32768 + 2, 4096), dtype=np.uint8)
    for n, part in parts:
        bits[n] = np.frombuffer(bytes(part), dtype=np.uint8)
    sent = wanted.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def test(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in hashes:
            # Spark's bitmaps of 32,768 bits are numbered from 1, and a value v of 1 or more is bit v - 1 from there on.
            at = batch.to_numpy() % BITMAP + 32768
            yield pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0)

    return test


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", hashes: bool = False) -> DataFrame:
    """One row per document: key, class_id (the class's smallest key), class_size, keep.

    ``keep`` marks one row of each class: the one with the smallest key (of rows with equal keys and
    texts, each).
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bands = F.pandas_udf(_bands, "array<long>")
    near = F.pandas_udf(_near, "boolean")
    hashed = docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("h1"), F.xxhash64(whole, F.lit(1)).alias("h2"), whole.alias("text"))
    signed = written(hashed.select("id", "h1", "h2", bands("text").alias("bands")), "near-signed")
    classes = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    buckets = classes.where("bands is not null").select(F.explode("bands").alias("key"), "node")

    shared = buckets.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    candidates = written(buckets.join(written(shared, "near-keys"), "key"), "near-buckets")
    wanted = written(classes.join(candidates.select("node").distinct(), "node").select("node", "h1", "h2", F.col("rep").alias("id")), "near-wanted")
    # Most texts are in no bucket with others: a hashed bitmap keeps them out of the exchange.
    few = hashed.where(_maybe(wanted.select("h1"))("h1"))
    texts = few.join(wanted.hint("merge"), [few.h1 == wanted.h1, few.h2 == wanted.h2, few.id.eqNullSafe(wanted.id)]).select("node", "text")
    texts = written(texts, "near-texts")
    if texts.count() > wanted.count():  # rows that repeat both id and text
        texts = written(texts.dropDuplicates(["node"]), "near-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").where(near("text_a", "text_b")).select("a", "b")

    def by_blocks(rows: DataFrame) -> DataFrame:
        dealt = rows.join(texts, "node").select("cluster", "bx", "by", "node", "node_root", "as_x", "as_y", "text")
        return dealt.repartition("cluster", "bx", "by").sortWithinPartitions("cluster", "bx", "by").mapInArrow(_blocks, "a long, b long")

    roots = link(candidates, verify, "near", by_blocks)
    named = classes.select("node", "h1", "h2", "rep", "copies").join(roots, "node", "left")
    named = written(named.select("h1", "h2", "rep", "copies", F.coalesce("root", "node").alias("root")), "near-named")
    first = F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "h1", "h2")).alias("first")
    sizes = written(named.groupBy("root").agg(first, F.sum("copies").alias("class_size")), "near-sizes")
    here = (F.col("first.h1") == F.col("h1")) & (F.col("first.h2") == F.col("h2"))
    final = written(named.join(sizes, "root").select("h1", "h2", F.col("first.rep").alias("class_id"), "class_size", here.alias("here")), "near-final")
    got = signed.select("id", "h1", "h2").join(final, ["h1", "h2"])
    keep = F.col("here") & F.col("id").eqNullSafe(F.col("class_id"))
    return got.select(F.col("id").alias(key), "class_id", "class_size", keep.alias("keep"), *(["h1", "h2"] if hashes else []))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents of which one stays in each group, with all their columns: those with the smallest key.

    Of rows that repeat both key and text one stays.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = groups(docs.select(key, text), text, key, hashes=True).where("keep").select(F.col(key).alias("k"), "h1", "h2").distinct()
    kept = written(kept, "near-kept")
    same = docs[key].eqNullSafe(kept["k"]) & (F.xxhash64(whole) == kept["h1"]) & (F.xxhash64(whole, F.lit(1)) == kept["h2"])
    got = docs.join(kept, same, "left_semi")
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return got
    return got.dropDuplicates([key, text])
