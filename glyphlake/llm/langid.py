"""Language identification by cross-parsing entropy.

Of each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
greedily against every automaton: each phrase is the longest match of what is left of the text in the
language's sample. The estimate of the cross entropy is phrases * log2(sample length) / characters,
and the language that needs least wins.

The automata become dense transition tables in which a failed step leads straight back to the start
state and counts a phrase, so one table look-up is done per character and language, for thousands of
text windows at once. Steps by characters that are rare in all samples together are sorted lists instead,
found by binary search, so every automaton keeps every character of its sample.

Cases: a null text or one without a letter is ``und`` with score 0. Repeated rows get equal answers.
An empty table gives an empty result. Columns named like the answers are replaced; others are kept.
Null and repeated keys do no harm when fitting. Without any labelled text everything is ``und``. Ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import textvec
from glyphlake.llm.shared import OWN

UNDETERMINED = "und"
#: Bounds of the fitting sample, for each language: labelled rows, and characters of their texts.
SAMPLE_ROWS = 64
SAMPLE_CHARS = 20_000
#: More languages than this are refused, which bounds the model that is sent to the executors.
MOST_LANGUAGES = 256
#: Phrases end at the borders of windows of this many characters, which bounds the steps of a batch.
WINDOW = 512
#: Different characters, commonest first, that have columns in the dense tables; steps by the others are sparse.
MOST_SYMBOLS = 127


@dataclass
class LanguageModel:
    languages: list[str]
    symbols: np.ndarray  # of each code point: 0 for one that never matches
    steps: np.ndarray  # of all automata: 4 * (offset of the next state's row) + phrases that end here
    width: int  # of a row; steps by symbols from here on are sparse
    rare: np.ndarray  # sorted: offset of a state's row << 21 | symbol
    rare_steps: np.ndarray  # the step of each, as in steps
    starts: np.ndarray  # offset of each automaton's start state
    bits: np.ndarray  # log2 of each sample's length


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in lower case, each run of other characters than letters as one blank; and each text's count.

    So numbers, marks, layout and case have no say in the language.
    """
    lowered = [t.lower() for t in texts]
    flat = textvec.codes("\n".join(lowered) + "\n")
    letter = textvec.alpha_table()[flat]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(texts)))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[ends - 1] = False
    kept = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(keep)))
    return np.where(letter, flat, 32)[keep], np.diff(kept[np.concatenate((np.zeros(1, dtype=np.int64), ends))])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def build(samples: dict[str, str]) -> LanguageModel:
    """The automata of the samples, as one dense table."""
    languages = sorted(samples)
    texts = [folded([samples[x]])[0] for x in languages]
    found, count = np.unique(np.concatenate([*texts, np.zeros(0, np.int64)]), return_counts=True)
    known = found[np.lexsort((found, -count))].astype(np.int64)
    symbols = np.zeros(0x110000, dtype=np.int32)
    symbols[known] = np.arange(1, len(known) + 1)
    width, tables, starts, base = min(len(known), MOST_SYMBOLS) + 1, [], [], 0
    sparse: dict[int, int] = {}
    for text in texts:
        moves = suffix_automaton(symbols[text.astype(np.int64)].tolist())
        root = np.array([base + moves[0].get(c, 0) * width for c in range(width)], dtype=np.int64)
        known_at_root = np.array([c in moves[0] for c in range(width)])
        # A failed step ends one phrase and starts anew with this character; one that never matches is a phrase too.
        failed = root * 4 + np.where(known_at_root, 1, 2)
        dense = np.tile(failed, (len(moves), 1))
        for state, row in enumerate(moves):
            for c, to in row.items():
                if c < width:
                    dense[state, c] = (base + to * width) * 4
                else:
                    sparse[base + state * width << 21 | c] = (base + to * width) * 4
        dense[0, ~known_at_root] = base * 4 + 1
        starts.append(base)
        base += len(moves) * width
        tables.append(dense.ravel())
    steps = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int64)
    bits = np.array([log2(max(2, len(t))) for t in texts])
    rare = np.array(sorted(sparse), dtype=np.int64)
    rare_steps = np.array([sparse[x] for x in rare.tolist()], dtype=np.int64)
    return LanguageModel(languages, symbols, steps.astype(np.int32 if base < 1 << 28 else np.int64), width, rare, rare_steps, np.array(starts, dtype=np.int64), bits)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn: Column | None = None) -> LanguageModel:
    """Learns from a bounded sample of labelled rows: of each language the rows whose hashed key is lowest."""
    use = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.lit(True) if learn is None else learn))
    # Rows without a key are told apart by their texts; of rows that repeat a key one is taken.
    place = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(F.col(text))).bitwiseAND(F.lit((1 << 40) - 1))
    counts = {r[0]: r[1] for r in use.groupBy(lang).agg(F.approx_count_distinct(place)).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(lang) == name, min(1.0, 2 * SAMPLE_ROWS / n)).otherwise(share)
    picked = use.where(place < share * float(1 << 40)).groupBy(lang, place.alias("place")).agg(F.min(F.left(text, F.lit(SAMPLE_CHARS))).alias("x")).select(lang, "x", "place").collect()
    samples: dict[str, str] = {}
    for name in counts:
        rows = sorted((r[2], r[1]) for r in picked if r[0] == name)[:SAMPLE_ROWS]
        most = max(1, SAMPLE_CHARS // max(1, min(16, len(rows))))
        if joined := "\n".join(x[:most] for _, x in rows)[:SAMPLE_CHARS]:
            samples[name] = joined
    return build(samples)


def rare_steps(model: LanguageModel, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The steps of each automaton's states by symbols that have no column."""

    def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = at.astype(np.int64) << 21 | symbol
        place = np.minimum(np.searchsorted(model.rare, wanted), len(model.rare) - 1)
        return model.rare[place] == wanted, model.rare_steps[place]

    start = np.broadcast_to(model.starts[:, None], state.shape)
    (goes, to), (begins, anew) = look(state), look(start)
    return np.where(goes, to, np.where(begins, anew + 1, start * 4 + np.where(state == start, 1, 2)))


def entropies(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: bits a character by each language; whether it has a letter."""
    flat, lengths = folded(texts)
    ends = np.cumsum(lengths)
    lettered = lengths > 0
    symbols = model.symbols[flat.astype(np.int64)].astype(np.int64)
    sparse = bool((symbols >= model.width).any())
    windows = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(texts)), windows)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    size = np.minimum(lengths[of] - first, WINDOW)
    first = first + (ends - lengths)[of]
    order = np.argsort(-size, kind="stable")
    first, size, of = first[order], size[order], of[order]
    active = np.searchsorted(-size, -np.arange(WINDOW), side="left")  # windows longer than each step
    state = np.repeat(model.starts[:, None], len(of), axis=1)
    phrases = np.ones(state.shape, dtype=np.int64)  # the last phrase of each window ends with it
    for at in range(int(size[0]) if len(size) else 0):
        n = active[at]
        symbol = symbols[first[:n] + at]
        if sparse:
            step = model.steps[state[:, :n] + np.where(symbol < model.width, symbol, 0)]
            some = np.flatnonzero(symbol >= model.width)
            step[:, some] = rare_steps(model, state[:, some], symbol[some])
        else:
            step = model.steps[state[:, :n] + symbol]
        phrases[:, :n] += step & 3
        state[:, :n] = step >> 2
    total = np.array([np.bincount(of, weights=row, minlength=len(texts)) for row in phrases]).reshape(len(model.languages), len(texts))
    return total * model.bits[:, None] / np.maximum(lengths, 1), lettered


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score (second least entropy over the sum of the two least) and least entropy."""
    whole = [t or "" for t in texts]
    langs, scores, bits = [UNDETERMINED] * len(whole), [0.0] * len(whole), [0.0] * len(whole)
    for a, b in textvec.slices(whole) if model.languages else ():
        got, lettered = entropies(model, whole[a:b])
        best = np.argmin(got, axis=0)
        two = np.sort(got, axis=0)[:2]
        score = two[1] / np.maximum(two[0] + two[1], 1e-12) if len(two) > 1 else np.ones(b - a)
        for i in np.flatnonzero(lettered):
            langs[a + i], scores[a + i], bits[a + i] = model.languages[best[i]], float(score[i]), float(two[0][i])
    return langs, scores, bits


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``lang_bits`` (least cross entropy, bits a character) to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_bits double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores, bits = predict(sent.value, batch.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "lang_bits": bits})

    got = docs.withColumn(f"{OWN}p", judge(F.col(text).cast("string")))
    for name in ("lang_pred", "score", "lang_bits"):
        got = got.withColumn(name, F.col(f"{OWN}p.{name}"))
    return got.drop(f"{OWN}p")
