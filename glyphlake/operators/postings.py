"""Posting lists: from rows to sorted runs with a dictionary, and the algebra of candidates over them.

A list is stored in segments, one a stretch of ``STRETCH`` values: their deltas at 7 bits a byte, the
first one counted from the stretch's start. So neither a task nor a window ever holds a whole long list,
and lists of common keys take about a byte a value, also on their way through an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.functions.bulk import keyed
from glyphlake.functions.keys import family_of, is_exact, is_exact_column
from glyphlake.functions.params import IndexParams
from glyphlake.sources import files
from glyphlake.sources.manifest import Run

#: Folders by hash of the key that a run is dealt into: a lookup reads only those of its keys.
FOLDERS = 16
#: Values that a segment spans at most.
STRETCH = 1 << 20
#: Bytes of values that are taken apart at once, rows, and values of segments that are merged at once.
BYTES, ROWS, VALUES = 4 << 20, 1 << 18, 1 << 21
#: Bytes of indexed values for which each folder has a file of its own.
FILE_BYTES = 256 << 20
#: A segment on its way, and as a run has it: ``size`` is the bytes of all deltas but the first.
LOOSE, STORED = "key string, at long, first long, vals binary", "key string, at long, n long, size long, first long, last long, vals binary"
DEAD = ""


def folder_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def varbyte(delta: Column) -> Column:
    """Bytes of a number at 7 bits each."""
    size: Column = F.lit(1)
    for bits in range(7, 63, 7):
        size = size + (delta >= F.lit(1 << bits)).cast("int")
    return size


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encoded(keys: pa.Array, starts: np.ndarray, vals: np.ndarray, stretch: int, loose: bool) -> pa.RecordBatch:
    """Segments of lists of rising values: list i begins at ``starts[i]``."""
    at = vals // stretch
    new = np.zeros(len(vals), bool)
    new[starts] = True
    new[1:] |= at[1:] != at[:-1]
    begins = np.flatnonzero(new)
    delta = np.diff(vals, prepend=0)
    delta[begins] = vals[begins] - at[begins] * stretch + 1
    size = np.ones(len(vals), np.int64)
    for bits in range(7, 63, 7):
        more = delta >= 1 << bits
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    data, place = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    data[place] = delta & 127 | (size > 1) << 7
    rest, j = np.flatnonzero(size > 1), 1
    while len(rest):
        data[place[rest] + j] = delta[rest] >> 7 * j & 127 | (size[rest] > j + 1) << 7
        j += 1
        rest = rest[size[rest] > j]
    stops = np.append(begins[1:], len(vals)) - 1
    which = pa.array(np.searchsorted(starts, begins, "right") - 1)
    columns = {"key": keys.take(which), "at": at[begins], "first": vals[begins], "vals": _binary(data, ends[stops])}
    if not loose:
        whole = ends[stops] - np.append(0, ends[stops])[:-1]
        columns = {"key": columns["key"], "at": columns["at"], "n": stops - begins + 1, "size": whole - size[begins], "first": columns["first"], "last": vals[stops], "vals": columns["vals"]}
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})


def decoded(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many values each segment has, and all values."""
    column = batch.column("vals")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts + 1
    delta = (data[starts] & 127).astype(np.int64)
    rest, j = np.flatnonzero(size > 1), 1
    while len(rest):
        delta[rest] |= (data[starts[rest] + j] & 127).astype(np.int64) << 7 * j
        j += 1
        rest = rest[size[rest] > j]
    bounds = np.searchsorted(ends, offsets - offsets[0])
    n, begins = np.diff(bounds), bounds[:-1]
    total = np.cumsum(delta)
    return n, total + np.repeat(np.asarray(batch.column("first")) - total[begins], n)


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a column."""
    sums = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < len(sums):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def segments_of(rows: DataFrame, params: IndexParams) -> DataFrame:
    """Segments of rows (rid, page, value): row ids for exact keys, pages for the others. A key has several of a stretch."""
    stretch = STRETCH

    def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        rid, page = (np.asarray(table.column(c)).astype(np.int64) for c in ("rid", "page"))
        value = table.column("value").combine_chunks()
        for keys, starts, vals in keyed(value, rid, page, params):
            yield encoded(pa.array(keys, pa.string()), starts, vals, stretch, True)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            for piece in _pieces(batch, "value", BYTES):
                own = pc.sum(pc.binary_length(piece.column("value"))).as_py() or 0
                if held and (size + own > BYTES or n + len(piece) > ROWS):
                    yield from flushed(held)
                    held, size, n = [], 0, 0
                held, size, n = [*held, piece], size + own, n + len(piece)
        if held:
            yield from flushed(held)

    return rows.select("rid", "page", "value").mapInArrow(taken, LOOSE)


def _change(keys: pa.Array, at: np.ndarray) -> np.ndarray:
    """Of each segment, the number of its key and stretch among those of the batch, which are next to each other."""
    place = np.asarray(keys.dictionary_encode().indices)
    return np.cumsum(np.append(0, (place[1:] != place[:-1]) | (at[1:] != at[:-1])))


def _exact(keys: pa.Array, params: IndexParams) -> np.ndarray:
    coded = keys.dictionary_encode()
    return np.array([is_exact(k, params) for k in coded.dictionary.to_pylist()], bool)[np.asarray(coded.indices)]


def _merged(params: IndexParams, stretch: int):  # noqa: ANN202
    """One segment of those of a key and stretch, which come next to each other; those of ``DEAD`` come first and are left out of row lists."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, int, np.ndarray] | None = None
        dead = np.zeros(0, np.int64)

        def shown(key: str, vals: np.ndarray) -> pa.RecordBatch:
            return encoded(pa.array([key], pa.string()), np.zeros(1, np.int64), vals, stretch, False)

        for batch in batches:
            for piece in _pieces(batch, "vals", VALUES):
                n, vals = decoded(piece)
                keys, at = piece.column("key"), np.asarray(piece.column("at"))
                gone = np.asarray(pc.equal(keys, DEAD))
                if gone.any() or len(dead):
                    # Those of stretches that are over are no longer needed.
                    dead = np.union1d(dead[dead >= at[0] * stretch], vals[np.repeat(gone, n)])
                    keep = np.repeat(~gone, n)
                    if len(dead):
                        near = np.minimum(np.searchsorted(dead, vals), len(dead) - 1)
                        keep &= ~((dead[near] == vals) & np.repeat(_exact(keys, params), n))
                    owner = np.repeat(np.arange(len(n)), n)[keep]
                    vals, n = vals[keep], np.bincount(owner, minlength=len(n))
                    full = np.flatnonzero(n)
                    keys, at, n = keys.take(pa.array(full)), at[full], n[full]
                if not len(n):
                    continue
                if last is not None:
                    if last[:2] == (keys[0].as_py(), int(at[0])):
                        keys, at = pa.concat_arrays([keys[:1], keys]), np.append(at[0], at)
                        n, vals = np.append(len(last[2]), n), np.concatenate([last[2], vals])
                    else:
                        yield shown(last[0], last[2])
                group = _change(keys, at)
                each = np.repeat(group, n)
                if ((vals[1:] <= vals[:-1]) & (each[1:] == each[:-1])).any():
                    bits = stretch.bit_length()
                    own = at[np.flatnonzero(np.append(True, group[1:] != group[:-1]))] * stretch
                    both = np.unique(each << bits | (vals - own[each]))
                    each = both >> bits
                    vals = (both & ((1 << bits) - 1)) + own[each]
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                begins = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
                last = (keys[int(heads[-1])].as_py(), int(at[heads[-1]]), vals[begins[-1] :].copy())
                if len(begins) > 1:
                    yield encoded(keys.take(pa.array(heads[:-1])), begins[:-1], vals[: begins[-1]], stretch, False)
        if last is not None:
            yield shown(last[0], last[2])

    return merge


def _dealt(segments: DataFrame, buckets: int) -> DataFrame:
    return segments.withColumn("folder", folder_of(F.col("key"))).withColumn("bucket", F.pmod(F.xxhash64("key", "at"), F.lit(buckets)).cast("int"))


def dictionary_of(spans: DataFrame, params: IndexParams, npages: int) -> DataFrame:
    """(key, family, tier, n, bytes, ctype) of each key: 0 for an array, 1 for a bitmap, 2 for a dropped list.

    A segment's first delta counts from the last value of the stretch before it.
    """
    before = F.lag("last").over(Window.partitionBy("key").orderBy("at"))
    sized = spans.withColumn("size", F.col("size") + varbyte(F.col("first") - F.coalesce(before, F.lit(-1))))
    lists = sized.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").cast("long").alias("array"), F.max("last").alias("most"))
    exact = is_exact_column(F.col("key"), params)
    bitmap = F.lit(-(-npages // 8)).cast("long")
    stop = F.lit(False) if not params.stops else ~exact & ~F.col("key").isin("A", "W") & (F.col("n") > F.lit(params.stop_threshold * npages))
    ctype = F.when(stop, 2).when(~exact & (F.col("array") > bitmap) & (F.col("most") < npages), 1).otherwise(0)
    size = F.when(stop, F.lit(0).cast("long")).when(ctype == 1, bitmap).otherwise(F.col("array"))
    return lists.select("key", family_of(F.col("key")).alias("family"), F.when(exact, "exact").otherwise("page").alias("tier"), "n", size.alias("bytes"), ctype.alias("ctype"))


def write_run(segments: DataFrame, stopped: DataFrame | None, params: IndexParams, path: str, run_id: int, rows: int, npages: int, size: int, dead: DataFrame | None = None) -> Run:
    """Writes postings and dictionary, from segments in any order.

    ``size``: about the bytes of what is indexed. ``stopped`` are keys that were dropped before: they stay
    dropped. ``dead`` (val) are row ids that row lists no longer have.
    """
    spark, stretch = segments.sparkSession, STRETCH
    buckets = max(1, -(-size // FILE_BYTES))
    dealt = _dealt(segments.select("key", "at", "first", "vals"), buckets)
    if dead is not None:
        # Each folder's task needs all of them; they are packed as lists are.
        every = spark.range(FOLDERS).select(F.col("id").cast("int").alias("folder")).crossJoin(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")))
        dealt = dealt.unionByName(_packed_rids(dead, stretch).crossJoin(F.broadcast(every)))
    merged = dealt.repartition("folder", "bucket").sortWithinPartitions("folder", "bucket", "at", "key", "first").drop("bucket", "folder").mapInArrow(_merged(params, stretch), STORED)
    merged.withColumn("folder", folder_of(F.col("key"))).sortWithinPartitions("folder", "key", "at").write.partitionBy("folder").parquet(f"{path}/lists")
    spans = spark.read.schema(f"{STORED}, folder int").parquet(f"{path}/lists").select("key", "at", "n", "size", "first", "last") if _written(path) else spark.createDataFrame([], STORED)
    words = dictionary_of(spans, params, npages)
    if stopped is not None:
        words = words.join(stopped.withColumn("was", F.lit(True)), "key", "left")
        words = words.withColumn("bytes", F.when(F.col("was"), F.lit(0).cast("long")).otherwise(F.col("bytes"))).withColumn("ctype", F.when(F.col("was"), 2).otherwise(F.col("ctype"))).drop("was")
        missing = stopped.join(words, "key", "left_anti").select("key", family_of(F.col("key")).alias("family"), F.lit("page").alias("tier"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(2).alias("ctype"))
        words = words.unionByName(missing)
    words.sort("key").write.parquet(f"{path}/dictionary")
    words = spark.read.parquet(f"{path}/dictionary")
    total = words.agg(F.count("*"), F.sum(F.col("bytes") + F.octet_length("key") + 6), F.count_if(F.col("ctype") == 2)).first()
    return Run(run_id, path, rows, total[0], total[1] or 0, total[2], npages)


def _packed_rids(rids: DataFrame, stretch: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals = np.unique(np.asarray(batch.column("val")))
            if len(vals):
                yield encoded(pa.array([DEAD], pa.string()), np.zeros(1, np.int64), vals, stretch, True)

    return rids.select("val").sortWithinPartitions("val").mapInArrow(pack, LOOSE)


def _written(path: str) -> bool:
    found = files.names(path)
    if "all" in found:
        raise ValueError(f"{path} holds posting lists by row, as an older version wrote them: build the index anew")
    return "lists" in found and any(n.startswith("folder=") for n in files.names(f"{path}/lists"))


def dictionary(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """All runs' dictionary rows, with the run's id."""
    schema = "key string, family string, tier string, n long, bytes long, ctype int"
    result = spark.createDataFrame([], schema).withColumn("run", F.lit(0))
    for run in runs:
        result = result.unionByName(spark.read.schema(schema).parquet(f"{run.path}/dictionary").withColumn("run", F.lit(run.id)))
    return result


def segments(spark: SparkSession, runs: list[Run], keys: list[str] | None = None) -> DataFrame:
    """The segments of all runs; with keys: only their folders are read."""
    found = None
    for run in runs:
        if _written(run.path):
            own = spark.read.schema(f"{STORED}, folder int").parquet(f"{run.path}/lists")
            found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], LOOSE)
    if keys is not None:
        # The folders are constants to the optimizer, so they prune the partitions without a job of their own.
        found = found.where(F.col("folder").isin([folder_of(F.lit(k)) for k in keys]) & F.col("key").isin(keys))
    return found.select("key", "at", "first", "vals")


def values(found: DataFrame) -> DataFrame:
    """(val) of segments, as often as a segment has it."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "vals", VALUES):
                yield pa.RecordBatch.from_pydict({"val": pa.array(decoded(piece)[1], pa.int64())})

    return found.select("first", "vals").mapInArrow(unpack, "val long")


def fetched(spark: SparkSession, runs: list[Run], keys: list[str]) -> dict[str, np.ndarray]:
    """The sorted lists of a few keys, on the driver: for lists whose entries are known to be few."""
    if not keys:
        return {}
    got = segments(spark, runs, keys).toArrow()
    n, vals = decoded(got)
    names = np.repeat(np.array(got.column("key").to_pylist(), dtype=object), n)
    return {k: np.unique(vals[names == k]) for k in keys}


def having_all(spark: SparkSession, runs: list[Run], keys: list[str]) -> DataFrame:
    """The values that are in the list of every key: stretch by stretch."""
    found = segments(spark, runs, keys)
    if len(keys) == 1:
        return values(found).distinct() if len(runs) > 1 else values(found)

    def common(table: pa.Table) -> pa.Table:
        result = None
        for key in keys:
            own = np.unique(decoded(table.filter(pc.equal(table.column("key"), key)).combine_chunks())[1])
            result = own if result is None else np.intersect1d(result, own, assume_unique=True)
            if not len(result):
                break
        return pa.table({"val": pa.array(result, pa.int64())})

    return found.groupBy("at").applyInArrow(common, "val long")


def missing(wanted: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """(key, val) that segments ``wanted`` have and those ``held`` lack."""
    stretch = STRETCH

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, int, np.ndarray] | None = None
        for batch in batches:
            for piece in _pieces(batch, "vals", VALUES):
                n, vals = decoded(piece)
                keys, at = piece.column("key"), np.asarray(piece.column("at"))
                asked = np.asarray(piece.column("asked")).astype(bool)
                if last is not None and last[:2] == (keys[0].as_py(), int(at[0])):
                    # What the last one's list holds comes before what is asked of it, maybe in another batch.
                    keys, at, asked = pa.concat_arrays([keys[:1], keys]), np.append(at[0], at), np.append(False, asked)
                    n, vals = np.append(len(last[2]), n), np.concatenate([last[2], vals])
                group = _change(keys, at)
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                each, mine, bits = np.repeat(group, n), np.repeat(asked, n), stretch.bit_length()
                both = each << bits | (vals - at[heads][each] * stretch)
                lost = np.setdiff1d(both[mine], both[~mine])
                last = (keys[int(heads[-1])].as_py(), int(at[heads[-1]]), np.unique(vals[(each == group[-1]) & ~mine]))
                if len(lost):
                    own = heads[lost >> bits]
                    yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(own)), "val": pa.array((lost & ((1 << bits) - 1)) + at[own] * stretch, pa.int64())})

    both = wanted.withColumn("asked", F.lit(True)).unionByName(held.withColumn("asked", F.lit(False)))
    dealt = _dealt(both, max(1, -(-size // FILE_BYTES))).repartition("folder", "bucket")
    return dealt.sortWithinPartitions("at", "key", "asked", "first").drop("folder", "bucket").mapInArrow(compare, "key string, val long")
