"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The driver knows how many rows each partition has and how many each cell (a stretch of a shard's slots)
shall get. It draws how many rows go from each partition to each cell: exactly the law that a uniform
permutation of all rows would give. Each partition then permutes its rows and deals them out by its row
of the matrix, rows move once, and each cell permutes what it got. Only counts reach the driver.

Cases: a null key or null values are shuffled like others. Repeated rows each get a place of their own.
An empty table gives an empty result. Columns named ``shard`` or ``slot`` are replaced; others are kept.
"""

from __future__ import annotations

from math import e, floor, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.llm.shared import OWN, written

#: Rows of a cell, at most: what one task permutes.
CELL_ROWS = 200_000


def cell_sizes(rows: int, shards: int, most: int = CELL_ROWS) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each cell; shard sizes differ by one at most."""
    cells = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        parts = max(1, -(-size // most))
        at = 0
        for i in range(parts):
            n = size // parts + (i < size % parts)
            cells.append((shard, at, n))
            at += n
    return cells


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Rows sent from each source to each target: margins are exact, the law that of a uniform shuffle."""
    random, left = np.random.default_rng(seed), np.array(targets, dtype=np.int64)
    matrix = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, n in enumerate(sources):
        # Target by target, a univariate draw for what is left: exact at any size.
        rest, room = int(n), int(left.sum())
        for j, free in enumerate(left):
            room -= int(free)
            got = rest if room == 0 else _hypergeometric(random, int(free), room, rest)
            matrix[i, j] = got
            rest -= got
        left -= matrix[i]
    return matrix


def _hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among the draws. numpy's sampler ends at 10**9; larger urns take Stadlober's ratio-of-uniforms rejection."""
    if not draws or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, draws))
    total, low, high = good + bad, max(0, draws - bad), min(draws, good)
    share = good / total
    spread = sqrt(draws * share * (1 - share) * (total - draws) / (total - 1) + 0.5)
    centre, width = draws * share + 0.5, 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
    weight = lambda k: lgamma(k + 1) + lgamma(good - k + 1) + lgamma(draws - k + 1) + lgamma(bad - draws + k + 1)
    best = weight(min(high, max(low, (draws + 1) * (good + 1) // (total + 2))))
    while True:
        u, v = 1 - random.random(), random.random()
        k = floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= best - weight(k):
            return k


def _permuted(table: pa.Table, seed: list[int]) -> pa.Table:
    """In random order; the rows are sorted first, so that the result doesn't hang on their arrival."""
    simple = [(f.name, "ascending") for f in table.schema if not pa.types.is_nested(f.type)]
    if simple:
        table = table.take(pc.sort_indices(table, sort_keys=simple))
    return table.take(pa.array(np.random.default_rng(seed).permutation(len(table))))


def shuffle(df: DataFrame, shards: int = 16, seed: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    own, cell = f"{OWN}source", f"{OWN}cell"
    base = written(df.withColumn(own, F.spark_partition_id()), "shards")
    counts = sorted((r[0], r[1]) for r in base.groupBy(own).count().collect())
    cells = cell_sizes(sum(n for _, n in counts), shards, cell_rows)
    matrix = communication_matrix([n for _, n in counts], [n for _, _, n in cells], seed)
    rows = df.sparkSession.sparkContext.broadcast({pid: matrix[i] for i, (pid, _) in enumerate(counts)})

    def deal(table: pa.Table) -> pa.Table:
        pid = table.column(own)[0].as_py()
        table = _permuted(table, [seed, 1, pid])
        return table.set_column(table.schema.get_field_index(own), cell, pa.array(np.repeat(np.arange(len(cells), dtype=np.int32), rows.value[pid])))

    def place(table: pa.Table) -> pa.Table:
        number = table.column(cell)[0].as_py()
        shard, first, size = cells[number]
        table = _permuted(table, [seed, 2, number]).drop_columns([cell])
        table = table.append_column("shard", pa.array(np.full(size, shard, dtype=np.int32)))
        return table.append_column("slot", pa.array(np.arange(first, first + size, dtype=np.int64)))

    dealt = T.StructType([T.StructField(cell, T.IntegerType()) if f.name == own else f for f in base.schema])
    placed = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return base.groupBy(own).applyInArrow(deal, dealt).groupBy(cell).applyInArrow(place, placed)
