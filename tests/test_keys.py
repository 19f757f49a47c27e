from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions.bulk import keyed
from glyphlake.functions.keys import END, is_exact, keys_of, shown, value_keys
from glyphlake.functions.params import IndexParams
from glyphlake.plans.pattern import ANY, ONE, PatternError, normal, parse, pattern_keys
from glyphlake.queries import GOLDEN_KEYS, QUERIES
from tests.conftest import SF

#: The keys of ``hello``.
HELLO = """G1:\\0 G1:e G1:h G1:l G1:o G2:el G2:he G2:ll G2:lo G2:o\\0 G3:ell G3:hel G3:llo G3:lo\\0 H:F:he H:F:hel H:F:hell
H:R:ol H:R:oll H:R:olle P:F:0:h P:F:1:e P:F:2:l P:R:0:o P:R:1:l P:R:2:l S2:el S2:hl S2:l\\0 S2:lo S3:eo S3:hl S3:l\\0 S4:e\\0
S4:ho T:F:0:el T:F:0:he T:F:1:lo T:F:1:o\\0 T:R:0:ll T:R:0:ol U:F:0:e U:F:0:h U:F:0:l U:F:1:\\0 U:F:1:l U:F:1:o U:R:0:l U:R:0:o
X.HL:h:1 X.HT:he,lo X.Ht:he,o X.TL:o:1 X.hT:h,lo X.ht:h,o""".split()

params = st.builds(
    IndexParams,
    k=st.integers(1, 8),
    cap=st.integers(1, 5),
    rollup=st.integers(0, 4),
    reverse_depth=st.integers(0, 5),
    composite=st.booleans(),
    cross_edges=st.booleans(),
    anchor_len=st.integers(0, 4),
    skip_depth=st.integers(0, 8),
)
letters = st.text(alphabet="abAB\\_%é\n" + END, max_size=14)


def matches(value: str, tokens: list) -> bool:
    return re.fullmatch("".join("." if t is ONE else ".*" if t is ANY else re.escape(t) for t in tokens), value, re.DOTALL) is not None


def test_known_keys():
    p = IndexParams()
    assert {shown(k) for k in keys_of("hello", p)} == set(HELLO)
    assert keys_of("HeLLo", p) == keys_of("hello", p)
    assert len(keys_of("", p)) == 5
    assert len(keys_of("hello", IndexParams(k=1, cap=8))) == 44
    assert len(keys_of("hello", IndexParams(rollup=0, composite=False))) == 35
    assert {k for k in keys_of("abcdef", IndexParams(cross_edges=True)) if k[0] == "C"} == {"C:F:0:cd"}
    for (pattern, ilike), keys in GOLDEN_KEYS.items():
        assert {shown(k) for k in pattern_keys(pattern, p, ilike)} == set(keys.split())
    assert not any(pattern_keys(x, p) for x in ("%", "%%", "_%", "abc\\"))


@settings(max_examples=1500, deadline=None)
@given(letters, st.lists(st.integers(0, 9), max_size=14), params, st.booleans())
def test_a_match_has_the_patterns_keys(value, choices, p, ilike):
    pattern = ""
    for i, c in enumerate(value):
        pick = choices[i] if i < len(choices) else 0
        pattern += "_" if pick == 1 else "%" if pick == 2 else "%\\" + c if pick == 3 else c.upper() if pick == 4 and ilike and c in "abAB" else "\\" + c
    tokens = parse(pattern)
    folded = [t.lower() if isinstance(t, str) else t for t in tokens]
    if matches(value.lower() if ilike else value, folded if ilike else tokens):
        own, needed = keys_of(value, p), pattern_keys(pattern, p, ilike)
        assert needed <= own or own == {"A"} or ilike and "N" in own


def test_value_keys_column_equals_python(spark):
    values = ["", "a", "ab", "hello", "Hello World", "café", "日本語テキスト", "a\\b", "100%", "x" * 70, "😀b", f"q{END}", None, "line\nbreak", " lead"]
    for p in (IndexParams(), IndexParams(k=1, cap=8, cross_edges=True, reverse_depth=3, rollup=4), IndexParams(k=8, cap=1, rollup=0, anchor_len=0, skip_depth=8, composite=False, reverse_depth=0)):
        rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", value_keys(F.col("v"), p).alias("k")).collect()
        for row in rows:
            assert (row["k"] is None) if row["v"] is None else (set(row["k"]) == keys_of(row["v"], p) and len(set(row["k"])) == len(row["k"])), row["v"]


def test_escapes():
    assert normal(parse("a!%b!!c_%", "!")) == "a\\%b!c_%"
    assert normal(parse("a\\b\\%", "\\")) == "ab\\%"
    assert normal(parse("a\\_", "")) == "a\\\\_"
    assert parse("a%%%b") == ["a", ANY, "b"]
    with pytest.raises(PatternError):
        parse("abc\\")
    with pytest.raises(PatternError):
        parse("abc", "xy")


def test_options_are_checked():
    for bad in ({"k": 9}, {"k": 0}, {"rollup": 5}, {"cap": 65}, {"anchor_len": 5}, {"skip_depth": 9}, {"stop_threshold": 1.5}, {"exact": 1}, {"unknown": 1}):
        with pytest.raises(ValueError):
            IndexParams.of(**bad)
    assert IndexParams(cap=2, reverse_depth=9).reverse_depth == 2


def test_keys_of_many_values_at_once():
    rng = random.Random(5)
    mixed = [None, "", "a", "café", "日本語テキスト", "a\\b", "x" * 70, "😀b", f"q{END}", "line\nbreak"] + ["".join(rng.choice("abAB_é日😀x ") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    letters_ = ["".join(chr(0x3400 + (i * 7 + j * 131) % 40000) for j in range(80)) for i in range(500)]  # more than a key's number has room for
    for p in (IndexParams(), IndexParams(exact=False, rollup=2, skip_depth=0), IndexParams(k=1, cap=8, cross_edges=True, reverse_depth=3, rollup=4, exact_bigrams=True), IndexParams(k=8, cap=1, rollup=0, anchor_len=0, skip_depth=8, composite=False, reverse_depth=0), IndexParams(long_value_limit=9)):
        for values in (mixed, letters_, [""], ["a"]):
            rids = np.arange(len(values)) * 3 + 1000
            pages, want = rids // p.rows_per_page, set()
            for v, rid, page in zip(values, rids.tolist(), pages.tolist(), strict=True):
                own = set() if v is None else {"A"} if p.long_value_limit and len(v.encode()) > p.long_value_limit else keys_of(v, p)
                want |= {(k, rid if is_exact(k, p) else page) for k in own}
            got = []
            for keys, starts, vals in keyed(pa.array(values, pa.string()), rids, pages, p):
                for key, a, z in zip(keys, starts, [*starts[1:], len(vals)], strict=True):
                    got += [(key, v) for v in vals[a:z].tolist()]
                    assert (np.diff(vals[a:z]) > 0).all()
            assert set(got) == want


def test_keys_of_some_families(spark):
    """Only the wanted ones are made, and each different name is taken apart once, however many rows have it."""
    p = IndexParams(cross_edges=True, reverse_depth=2, rollup=4)
    values = ["", "a", "hello", "Hello World", "café", f"q{END}", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for tags in (("G1", "G2", "G3", "G4"), ("S2", "S4"), ("U", "P", "T", "C"), ("C",), ("H",), ("X",), ("N", "A")):
        for row in df.select("v", value_keys(F.col("v"), p, tags).alias("k")).collect():
            want = None if row["v"] is None else {k for k in keys_of(row["v"], p) if re.split("[:.]", k)[0] in tags}
            assert row["k"] == want if want is None else set(row["k"]) == want
    plan = QUERIES["value_keys_anchors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "S2:" not in plan and plan.index("Generate") < plan.index("Aggregate [p_name")
