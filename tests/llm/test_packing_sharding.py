from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphlake.llm import catalog, packing, sharding
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", " lead", "two  blanks", "tail ", "line\n break", "tab\t x", "<|endoftext|> x", "it's don't", "日本 語", "😀 😀", "x" * 300, "a \x00b", "nbsp \xa0 x", "12 34 !! ..", "\n\n", "A  \n B"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_encoder_equals_the_library(text):
    whole = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_the_library, "t") else test_encoder_equals_the_library.t
    test_encoder_equals_the_library.t = whole
    for t in (text, *(x or "" for x in ODD)):
        assert np.frombuffer(packing.encoder(PATH).encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_holds_the_bounds(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= np.ceil(11 / 9 * max(1, -(-sum(lengths) // 50))) + 1 + sum(x > 25 for x in lengths)


def check_packed(rows: list, docs: list[tuple]) -> None:
    whole = Tokenizer.from_file(PATH)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for doc, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for i, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert r["piece"] == i and r["start"] == at and (i == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_round_trip(spark):
    rows = catalog.op3_best_fit_packing(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packed(rows, docs)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * total / 2048 + 1


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    docs = list(enumerate([*ODD, "word " * 2047, "word " * 2048, "word " * 9000]))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int").repartition(4)
    check_packed(packing.pack(df, PATH).collect(), docs)
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.where("doc_id = 2 or doc_id = 2").union(df.where("doc_id = 2")).selectExpr("cast(null as long) doc_id", "text"), PATH).collect()
    assert len(twice) == 2 and {r["sequence_id"] for r in twice} == {twice[0]["sequence_id"]} and sorted(r["offset"] for r in twice) == [0, twice[0]["length"]]


def test_matrix_margins_and_law():
    rows, cells = [7, 0, 13, 5], [6, 6, 6, 7]
    total = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(rows, cells, seed)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == cells and (m >= 0).all()
        total += m
    expected = np.outer(rows, cells) / 25
    assert np.abs(total / 400 - expected).max() < 0.3
    big = sharding.communication_matrix([3_000_000_000, 1_000_000_000], [2_000_000_000, 2_000_000_000], 1)
    assert big.sum(0).tolist() == [2_000_000_000] * 2 and abs(big[0, 0] - 1_500_000_000) < 10**6


def check_shards(rows: list, n: int, shards: int = 16) -> None:
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == n and set(slots) <= set(range(shards))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding(spark):
    rows = catalog.op7_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_shards(rows, len(docs))
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_sharding_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, [1], 9)] * 5 + [(i, "x", None, i) for i in range(30)], "doc_id long, text string, nested array<int>, shard int").repartition(5)
    got = sharding.shuffle(df, 4, cell_rows=3)
    check_shards(got.collect(), 35, 4)
    assert got.columns == ["doc_id", "text", "nested", "shard", "slot"]
    again = sharding.shuffle(df, 4, cell_rows=3).collect()
    key = lambda r: (r["shard"], r["slot"], str(r["doc_id"]))
    assert sorted(map(key, again)) == sorted(map(key, got.collect()))
    assert sharding.shuffle(df.limit(0), 4).count() == 0
