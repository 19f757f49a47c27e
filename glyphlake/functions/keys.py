"""The keys of a value: as a Column of array<string>, and as a Python set for single values.

A value is the sequence of its characters with A-Z folded, followed by an end mark. A key is text:
``tag:...`` as it is shown, except that the end mark is a code point that no text holds. A value that
does hold it gets the key ``A`` alone, which makes it a candidate of every pattern.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.params import IndexParams

END = "\uffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
MOST = 0xFFFF
#: The families of composite keys as statistics name them.
COMPOSITES = {"X.ht": "X.a", "X.HT": "X.b", "X.HL": "X.c", "X.TL": "X.d", "X.Ht": "X.e", "X.hT": "X.f"}


def fold(value: str) -> str:
    return value.translate(_FOLD)


def shown(key: str) -> str:
    """A key as it is displayed."""
    return key.replace(END, "\\0")


def shown_column(key: Column) -> Column:
    return F.replace(key, F.lit(END), F.lit("\\0"))


def keys_of(value: str, params: IndexParams) -> set[str]:
    """The keys of one value."""
    if END in value:
        return {"A"}
    p, text = params, fold(value)
    n, keys = len(text), set()
    if not value.isascii():
        keys.add("N")
    for d, line in (("F", text + END), ("R", text[::-1] + END)):
        stop = min(len(line), p.limit(d))
        for i in range(stop):
            keys.add(f"U:{d}:{i // p.k}:{line[i]}")
            if i < min(p.k, p.limit(d)):
                keys.add(f"P:{d}:{i}:{line[i]}")
            if i + 1 < stop:
                if i // p.k == (i + 1) // p.k:
                    keys.add(f"T:{d}:{i // p.k}:{line[i : i + 2]}")
                elif p.cross_edges:
                    keys.add(f"C:{d}:{i // p.k}:{line[i : i + 2]}")
        keys.update(f"H:{d}:{line[:size]}" for size in range(2, min(p.anchor_len, n + 1) + 1))
    if n + 1 > p.limit("F"):
        keys.add(f"U:F:{min(n // p.k, MOST)}:{END}")
    line = text + END
    for g in range(1, p.rollup + 1):
        keys.update(f"G{g}:{line[i : i + g]}" for i in range(n + 2 - g))
    for gap in range(2, p.skip_depth + 1):
        keys.update(f"S{gap}:{line[i]}{line[i + gap]}" for i in range(n + 1 - gap))
    if p.composite and n:
        size = min(n // p.k, MOST)
        keys |= {f"X.ht:{text[0]},{text[-1]}", f"X.HL:{text[0]}:{size}", f"X.TL:{text[-1]}:{size}"}
        if n >= 2:
            keys |= {f"X.HT:{text[:2]},{text[-2:]}", f"X.Ht:{text[:2]},{text[-1]}", f"X.hT:{text[0]},{text[-2:]}"}
    return keys


def value_keys(value: Column, params: IndexParams, tags: Collection[str] | None = None) -> Column:
    """The keys of a text column, as an array without repeats; null for null. Built-in functions only.

    With ``tags``, what stands before a key's first colon or point, only keys with these.
    """
    p = params
    text = F.translate(value, UPPER, LOWER)
    n = F.length(text)
    front, back = F.concat(text, F.lit(END)), F.concat(F.reverse(text), F.lit(END))
    lit, text_of = F.lit, lambda i: i.cast("string")
    part = lambda line, i, size: F.substring(line, i + 1, lit(size) if isinstance(size, int) else size)
    upto = lambda stop: F.filter(F.sequence(lit(0), F.greatest(stop - 1, lit(0))), lambda i: i < stop)
    none = F.array().cast("array<string>")
    wanted = lambda *of: tags is None or not {*of}.isdisjoint(tags)

    def positions(d: str, line: Column) -> list[Column]:
        limit, segment = p.limit(d), lambda i: text_of(F.floor(i / p.k).cast("int"))
        at = upto(F.least(n + 1, lit(limit)))
        pairs = upto(F.least(n + 1, lit(limit)) - 1)
        if not p.cross_edges or not wanted("C"):
            pairs = F.filter(pairs, lambda i: F.floor(i / p.k) == F.floor((i + 1) / p.k))
        if not wanted("T"):
            pairs = F.filter(pairs, lambda i: F.floor(i / p.k) != F.floor((i + 1) / p.k))
        tag = lambda i: F.when(F.floor(i / p.k) == F.floor((i + 1) / p.k), "T").otherwise("C")
        made = {
            "U": F.transform(at, lambda i: F.concat(lit(f"U:{d}:"), segment(i), lit(":"), part(line, i, 1))),
            "P": F.transform(F.filter(at, lambda i: i < min(p.k, limit)), lambda i: F.concat(lit(f"P:{d}:"), text_of(i), lit(":"), part(line, i, 1))),
            "TC": F.transform(pairs, lambda i: F.concat(tag(i), lit(f":{d}:"), segment(i), lit(":"), part(line, i, 2))),
        }
        return [x for of, x in made.items() if wanted(*of)]

    def grams(g: int) -> Column:
        return F.transform(upto(n + 2 - g), lambda i: F.concat(lit(f"G{g}:"), part(front, i, g)))

    def skips(gap: int) -> Column:
        return F.transform(upto(n + 1 - gap), lambda i: F.concat(lit(f"S{gap}:"), part(front, i, 1), part(front, i + gap, 1)))

    sets: list[Column] = [F.when(value.rlike("[^\\x00-\\x7F]"), F.array(lit("N"))).otherwise(none)] if wanted("N") else [none]
    for d, line in (("F", front), ("R", back)):
        if p.limit(d):
            sets += positions(d, line)
        sets += [F.when(n + 1 >= size, F.array(F.concat(lit(f"H:{d}:"), F.substring(line, 1, size)))).otherwise(none) for size in range(2, p.anchor_len + 1) if wanted("H")]
    size = text_of(F.least(F.floor(n / p.k).cast("int"), lit(MOST)))
    if wanted("U"):
        sets.append(F.when(n + 1 > p.limit("F"), F.array(F.concat(lit("U:F:"), size, lit(f":{END}")))).otherwise(none))
    sets += [grams(g) for g in range(1, p.rollup + 1) if wanted(f"G{g}")]
    sets += [skips(gap) for gap in range(2, p.skip_depth + 1) if wanted(f"S{gap}")]
    if p.composite and wanted("X"):
        h, t, hh, tt = F.left(text, lit(1)), F.right(text, lit(1)), F.left(text, lit(2)), F.right(text, lit(2))
        pair = lambda tag, a, b: F.concat(lit(f"{tag}:"), a, lit(","), b)
        length = lambda tag, c: F.concat(lit(f"{tag}:"), c, lit(":"), size)
        sets.append(F.when(n > 0, F.array(pair("X.ht", h, t), length("X.HL", h), length("X.TL", t))).otherwise(none))
        sets.append(F.when(n > 1, F.array(pair("X.HT", hh, tt), pair("X.Ht", hh, t), pair("X.hT", h, tt))).otherwise(none))
    every = F.array_distinct(F.concat(*sets))
    return F.when(F.contains(value, lit(END)), F.array(lit("A")) if wanted("A") else none).when(value.isNotNull(), every)


#: Values of more bytes are taken apart by an Arrow function: built-in ones go through the text anew for each key.
SHORT = 256


def keys_column(value: Column, params: IndexParams, longest: int) -> Column:
    """``value_keys`` for a column whose longest value is known."""
    if longest <= SHORT:
        return value_keys(value, params)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if v is None else list(keys_of(v, params)) for v in batch.tolist()], dtype=object)

    short = F.octet_length(value) <= SHORT
    return F.when(short, value_keys(F.when(short, value), params)).otherwise(split(F.when(~short, value)))


def family_of(key: Column) -> Column:
    """The family under which statistics count a key."""
    tag = F.substring_index(key, ":", 1)
    named = F.substring_index(key, ":", 2)
    composite = F.create_map(*(F.lit(x) for pair in COMPOSITES.items() for x in pair))
    plain = tag.isin("A", "W", "N") | tag.rlike("^[GS]")
    return F.when(plain, tag).when(tag.startswith("X."), F.element_at(composite, tag)).when(key.startswith("P:F:0:"), "P:F0").when(key.startswith("P:R:0:"), "P:R0").otherwise(named)


def is_exact(key: str, params: IndexParams) -> bool:
    """The key's list holds rows, not pages."""
    if key in ("A", "N"):
        return True
    tag = key.split(":", 1)[0]
    rows = tag in ("G3", "G4", "H") or tag == "G2" and params.exact_bigrams or key.startswith(("P:F:0:", "P:R:0:"))
    return params.exact and rows


def is_exact_column(key: Column, params: IndexParams) -> Column:
    """``is_exact`` of a column. ``A`` and ``N`` lists always hold rows, so that they are never too coarse."""
    always = key.isin("A", "N")
    if not params.exact:
        return always
    rows = key.startswith("G3:") | key.startswith("G4:") | key.startswith("H:") | key.startswith("P:F:0:") | key.startswith("P:R:0:")
    return always | rows | (key.startswith("G2:") if params.exact_bigrams else F.lit(False))
