"""Which runs a merge takes."""

from __future__ import annotations

from glyphlake.sources.manifest import MOST_RUNS, PAGE_BYTES, Run

#: A run is taken while it is at most so many times what is merged; inline merges leave larger ones alone.
GROWTH = 4
INLINE_BYTES = 8 << 20
#: Fixed value: runs up to this size are purged for any dead row, larger ones from a tenth on.
SMALL_RUN = 1 << 20
INLINE, NORMAL, FULL = "inline", "normal", "full"


def taken(runs: list[Run], frozen_bytes: int, mode: str, pending_limit_kb: int) -> int:
    """How many of the newest runs are merged with the frozen rows; 0 without frozen rows if fewer than two qualify."""
    pages = -(-frozen_bytes // PAGE_BYTES)
    gathered = pages * PAGE_BYTES * 2 if frozen_bytes else runs[-1].size if runs else 0
    after = len(runs) + (1 if frozen_bytes else 0)
    count = 0
    for run in reversed(runs):
        # With the merge's own run there may be no more than the most.
        must = after - count > MOST_RUNS
        if not (mode == FULL or must or run.size <= GROWTH * gathered):
            break
        if mode == INLINE and not must and run.size > max(INLINE_BYTES, GROWTH * pending_limit_kb * 1024):
            break
        gathered += run.size
        count += 1
    return count if frozen_bytes or count >= 2 else 0


def purged(runs: list[Run], dead: list[int]) -> int:
    """The place of the oldest run that is worth a rewrite (it and all newer ones are); -1 if none is."""
    for i, (run, n) in enumerate(zip(runs, dead, strict=True)):
        if n and (n * 10 >= run.rows or run.size <= SMALL_RUN):
            return i
    return -1
