"""The keys of many values at once, with NumPy: what ``keys_of`` gives for each, as lists of targets by key.

Values are one line of code points, each followed by the end mark. A key is a number made of its
characters' places in the alphabet of these values, so that lists come from one sort of numbers, or one
table of them, for each family of keys. Where values repeat much, equal ones are taken apart once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphlake.functions.keys import END, MOST, is_exact, keys_of
from glyphlake.functions.params import IndexParams

#: Bits that a number of key and target has; alphabets of more bits than a key's characters leave room for are done value by value.
WIDTH, ALPHABET = 62, 15
#: Bits of numbers up to which a table finds the different ones, and not a sort, if there are many.
TABLE = 25


@dataclass
class Targets:
    """What the values' keys lead to: a sorted table of row ids or of pages, and the places in it of each value."""

    table: np.ndarray
    one: np.ndarray | None  # of each value, if all have one only
    starts: np.ndarray | None = None
    counts: np.ndarray | None = None
    places: np.ndarray | None = None

    @property
    def bits(self) -> int:
        return max(1, int(len(self.table)).bit_length())

    @classmethod
    def of(cls, own: np.ndarray, value: np.ndarray, n: int) -> Targets:
        """``own``: row ids or pages of the rows; ``value``: the number of each row's value, of n."""
        table, place = np.unique(own, return_inverse=True)
        pairs = np.unique(value.astype(np.int64) * len(table) + place)
        value, place = pairs // len(table), pairs % len(table)
        if len(pairs) == n:
            return cls(table, place)
        counts = np.bincount(value, minlength=n)
        return cls(table, None, np.cumsum(counts) - counts, counts, place)


Lists = tuple[list[str], np.ndarray, np.ndarray]


def _distinct(numbers: np.ndarray, bits: int) -> np.ndarray:
    if bits <= TABLE and len(numbers) << 4 >= 1 << bits:
        there = np.zeros(1 << bits, bool)
        there[numbers] = True
        return np.flatnonzero(there)
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def lists_of(code: np.ndarray, bits: int, value: np.ndarray, targets: Targets, named: Callable[[np.ndarray], list[str]]) -> Lists:
    """Of (code, value) pairs: the keys in the codes' order, where each one's list begins, and all lists' targets in order."""
    wide = targets.bits
    deep = 0 if targets.counts is None else len(targets.counts).bit_length()
    code, names = code.astype(np.int64), None
    if bits + max(wide, deep) > WIDTH:
        names, code = np.unique(code, return_inverse=True)
        bits = len(names).bit_length()
    if targets.one is not None:
        pairs = _distinct(code << wide | targets.one[value], bits + wide)
    else:
        held = _distinct(code << deep | value, bits + deep)
        code, value = held >> deep, held & ((1 << deep) - 1)
        n = targets.counts[value]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(targets.starts[value], n)
        pairs = _distinct(np.repeat(code, n) << wide | targets.places[at], bits + wide)
    return _listed(pairs, targets, named if names is None else lambda codes: named(names[codes]))


def _listed(pairs: np.ndarray, targets: Targets, named: Callable[[np.ndarray], list[str]]) -> Lists:
    wide = targets.bits
    code = pairs >> wide
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return named(code[starts]), starts, targets.table[pairs & ((1 << wide) - 1)]


def _running(code: np.ndarray, bits: int, ends: np.ndarray, before: int, n: np.ndarray, targets: Targets, named: Callable[[np.ndarray], list[str]]) -> Lists:
    """``lists_of`` for a code at each character of the line; it doesn't count with an end among the ``before`` ones from its place on."""
    counts = np.ones(len(code), bool)
    over = (ends[:, None] - np.arange(before)).ravel()
    over = over[(over >= 0) & (over < len(code))]
    counts[over] = False
    some = int(counts.argmax()) if len(code) else 0
    if not len(code) or not counts[some]:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = targets.bits
    if targets.one is None or bits + wide > WIDTH:
        return lists_of(code[counts], bits, np.repeat(np.arange(len(n)), n + 1)[: len(code)][counts], targets, named)
    kind = np.int32 if bits + wide < 32 else np.int64
    pairs = code.astype(kind) << wide
    pairs |= np.repeat(targets.one.astype(kind), n + 1)[: len(code)]
    pairs[over] = pairs[some]
    return _listed(_distinct(pairs, bits + wide).astype(np.int64), targets, named)


def _slowly(values: list[str], params: IndexParams, rows: Targets, pages: Targets) -> Iterator[Lists]:
    keys: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        for k in keys_of(v, params):
            keys.setdefault(k, []).append(i)
    for targets, exact in ((rows, True), (pages, False)):
        own = [k for k in keys if is_exact(k, params) == exact]
        if own:
            code = np.repeat(np.arange(len(own)), [len(keys[k]) for k in own])
            yield lists_of(code, len(own).bit_length(), np.concatenate([np.array(keys[k]) for k in own]), targets, lambda ids, own=own: [own[i] for i in ids.tolist()])


def _families(values: list[str], params: IndexParams, rows: Targets, pages: Targets) -> Iterator[Lists]:
    """The lists of values that are all different and hold no end mark."""
    p = params
    raw = np.frombuffer((END.join(values) + END).encode("utf-32-le"), np.int32)
    there = np.zeros(0x110000, bool)
    there[raw] = True
    there[97:123] |= there[65:91]
    there[65:91] = False
    alphabet = np.flatnonzero(there)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if bits > ALPHABET:
        yield from _slowly(values, params, rows, pages)
        return
    letters = [chr(x) for x in alphabet.tolist()]
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    place[65:91] = place[97:123]
    line = place[raw]
    ends = np.flatnonzero(line == letters.index(END))
    del raw, there, place
    starts = np.append(0, ends[:-1] + 1)
    n = ends - starts
    mask, everyone = (1 << bits) - 1, np.arange(len(values))

    def text(codes: np.ndarray, size: int) -> list[str]:
        """The last ``size`` characters of each code."""
        columns = [[letters[x] for x in ((codes >> (bits * (size - 1 - j))) & mask).tolist()] for j in range(size)]
        return columns[0] if size == 1 else ["".join(x) for x in zip(*columns, strict=True)]

    def target(exact: bool) -> Targets:
        return rows if exact and p.exact else pages

    def simple(tag: str, size: int) -> Callable[[np.ndarray], list[str]]:
        return lambda codes: [f"{tag}:{x}" for x in text(codes, size)]

    def segmented(tag: str, size: int) -> Callable[[np.ndarray], list[str]]:
        return lambda codes: [f"{tag}:{s}:{x}" for s, x in zip((codes >> (bits * size)).tolist(), text(codes, size), strict=True)]

    def composite(tag: str, a: int, b: int) -> Callable[[np.ndarray], list[str]]:
        return lambda codes: [f"{tag}:{x[:a]},{x[a:]}" for x in text(codes, a + b)]

    def sized(tag: str) -> Callable[[np.ndarray], list[str]]:
        return lambda codes: [f"{tag}:{x}:{s}" for x, s in zip(text(codes >> 16, 1), (codes & MOST).tolist(), strict=True)]

    code = np.zeros(len(line), np.int32)
    for g in range(1, min(p.rollup, len(line)) + 1):
        # The gram before, with one character more.
        code = code[: len(line) - g + 1].astype(np.int32 if g * bits < 32 else np.int64) << bits
        code |= line[g - 1 :]
        yield _running(code, g * bits, ends, g - 1, n, target(g >= 3 or g == 2 and p.exact_bigrams), simple(f"G{g}", g))
    del code
    for gap in range(2, p.skip_depth + 1):
        yield _running((line[: max(0, len(line) - gap)] << bits) | line[gap:], 2 * bits, ends, gap, n, pages, simple(f"S{gap}", 2))
    line = line.astype(np.int64)
    for d in "FR":
        limit = p.limit(d)
        stop = np.minimum(n + 1, max(limit, p.anchor_len))
        who = np.repeat(everyone, stop)
        i = np.arange(len(who)) - np.repeat(np.cumsum(stop) - stop, stop)
        at = starts[who] + i if d == "F" else np.where(i == n[who], ends[who], ends[who] - 1 - i)
        c, near = line[at], i < limit
        yield lists_of(((i // p.k) << bits | c)[near], 7 + bits, who[near], pages, segmented(f"U:{d}", 1))
        for exact in (True, False):
            own = near & (i < p.k) & ((i == 0) == exact)
            yield lists_of((i << bits | c)[own], 7 + bits, who[own], target(exact), segmented(f"P:{d}", 1))
        if len(c) > 1:
            pair = np.append((who[1:] == who[:-1]) & near[1:], False)
            both = (i // p.k) << (2 * bits) | c << bits | np.append(c[1:], 0)
            within = i // p.k == (i + 1) // p.k
            yield lists_of(both[pair & within], 7 + 2 * bits, who[pair & within], pages, segmented(f"T:{d}", 2))
            if p.cross_edges:
                yield lists_of(both[pair & ~within], 7 + 2 * bits, who[pair & ~within], pages, segmented(f"C:{d}", 2))
        first = np.cumsum(stop) - stop
        for size in range(2, p.anchor_len + 1):
            own = np.flatnonzero(n + 1 >= size)
            code = np.zeros(len(own), np.int64)
            for j in range(size):
                code = code << bits | c[first[own] + j]
            yield lists_of(code, size * bits, own, target(True), simple(f"H:{d}", size))
    segments = np.minimum(n // p.k, MOST)
    far = np.flatnonzero(n + 1 > p.limit("F"))
    yield lists_of(segments[far], 16, far, pages, lambda codes: [f"U:F:{s}:{END}" for s in codes.tolist()])
    if p.composite:
        some, two = np.flatnonzero(n > 0), np.flatnonzero(n > 1)
        h, t = line[starts[some]], line[ends[some] - 1]
        yield lists_of(h << bits | t, 2 * bits, some, pages, composite("X.ht", 1, 1))
        yield lists_of(h << 16 | segments[some], bits + 16, some, pages, sized("X.HL"))
        yield lists_of(t << 16 | segments[some], bits + 16, some, pages, sized("X.TL"))
        h, t = line[starts[two]], line[ends[two] - 1]
        hh, tt = h << bits | line[starts[two] + 1], line[ends[two] - 2] << bits | t
        yield lists_of(hh << (2 * bits) | tt, 4 * bits, two, pages, composite("X.HT", 2, 2))
        yield lists_of(hh << bits | t, 3 * bits, two, pages, composite("X.Ht", 2, 1))
        yield lists_of(h << (2 * bits) | tt, 3 * bits, two, pages, composite("X.hT", 1, 2))


def keyed(values: pa.Array, rids: np.ndarray, pages: np.ndarray, params: IndexParams) -> Iterator[Lists]:
    """The lists of rows with these values, ids and pages: row ids for exact keys, pages for the others. Null values have none."""
    there = np.asarray(pc.is_valid(values))
    values, rids, pages = values.filter(pa.array(there)), rids[there], pages[there]
    whole = np.asarray(pc.match_substring(values, END), dtype=bool) if len(values) else np.zeros(0, bool)
    if params.long_value_limit and len(values):
        whole |= np.asarray(pc.binary_length(values)) > params.long_value_limit
    if whole.any():
        yield ["A"], np.zeros(1, np.int64), np.unique(rids[whole])
        values, rids, pages = values.filter(pa.array(~whole)), rids[~whole], pages[~whole]
    if not len(values):
        return
    encoded = values.dictionary_encode()
    distinct, number = encoded.dictionary, np.asarray(encoded.indices)
    if 2 * len(distinct) > len(values):  # a few repeats cost less than the way over values
        distinct, number = values, np.arange(len(values))
    odd = ~np.asarray(pc.string_is_ascii(distinct), dtype=bool)[number]
    if odd.any():
        yield ["N"], np.zeros(1, np.int64), np.unique(rids[odd])
    texts = distinct.to_pylist()
    rows_, pages_ = (Targets.of(own, number, len(texts)) for own in (rids, pages))
    yield from (x for x in _families(texts, params, rows_, pages_) if len(x[0]))
