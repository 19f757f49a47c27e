from __future__ import annotations

import random
import re
import shutil
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.keys import is_exact, keys_of
from glyphlake.operators import postings
from glyphlake.operators.index import PAGE_ROWS, PatternIndex, ilike, like
from glyphlake.plans import estimate as costs
from glyphlake.plans import merging
from glyphlake.sources.manifest import Manifest, Run
from glyphlake.streaming.ingest import ingest

ODD = [None, "", " ", "q", "qr", "qrs", "__", "%%", "50%_off", "c:\\dir", "Grün", "ΣΊΣΥΦΟΣ", "ﬁnal", "naïve", "上海市浦东", "tab\tline\n", "UPPER lower", "z" * 2500, "start" + "m" * 200 + "End", "odd\uffffone", "ı dotless", "abab"]
PATTERNS = ["%", "", "q%", "%s", "%a%", "q_s", "st%nd", "%END", "%p%r%", "___", "_r%", "\\%%", "50\\%%", "%\\_%", "gr_n", "上%东", "%mEnd", "z%z", "kk%", "%aBa%", "ab%ab", "%\uffff%", "odd_one", "% %", "%σ%"]


@pytest.fixture(scope="module")
def words(spark):
    random.seed(3)
    values = [*ODD] + ["".join(random.choice("aeilnorstAE_%") for _ in range(random.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, w string").cache()
    return df


@pytest.mark.parametrize("options", [{}, {"exact": False}, {"stop_threshold": 0.2, "exact": False, "rows_per_page": 16}, {"k": 1, "cap": 8, "cross_edges": True, "exact_bigrams": True}, {"rollup": 0, "composite": False, "anchor_len": 0, "skip_depth": 0}])
def test_search_equals_a_plain_filter(spark, words, tmp_path, options):
    index = PatternIndex.create(words, f"file://{tmp_path}/i", "w", ["id"], **options)
    # All patterns in one job for each side: (number of the clause, id).
    clauses = [c for p in PATTERNS for c in (like(p), ilike(p))]
    number = lambda df, i: df.select(F.lit(i).alias("i"), "id")
    found = reduce(DataFrame.union, (number(index.where(c, plan="index"), i) for i, c in enumerate(clauses)))
    truth = reduce(DataFrame.union, (number(words.where(c.condition(F.col("w"))), i) for i, c in enumerate(clauses)))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in truth.collect()}
    assert index.where(like("%a%"), plan="scan").count() == words.where("w like '%a%'").count()
    assert index.verify() == 0


def test_changes(spark, words, tmp_path):
    index = PatternIndex.create(words.where("id < 200"), f"file://{tmp_path}/i", "w", ["id"], rows_per_page=16)
    assert index.insert(words.where("id >= 200 and id < 300")) == 100
    assert index.delete("id % 2 = 0") == 150
    index.update("id = 201", {"w": F.lit("changed%")})
    truth = {r[0]: r[1] for r in words.where("id < 300 and id % 2 = 1").collect()} | {201: "changed%"}
    reader = PatternIndex.open(spark, index.root)

    def check(which):
        for p in ("%a%", "ch%d\\%", "%", "%e_%"):
            got = {(r[0], r[1]) for r in which.where(like(p), plan="index").collect()}
            want = spark.createDataFrame([(k, v) for k, v in truth.items()], "id long, w string").where(like(p).condition(F.col("w")))
            assert got == {(r[0], r[1]) for r in want.collect()}
        assert which.verify() == 0

    check(index)
    assert index.info().first()["pending_records"] == 101
    assert index.merge_pending() == 101
    check(index)
    assert index.vacuum() == 0
    check(index)
    index.insert(words.where("id >= 300").limit(0))
    assert index.compact() == 0
    check(index)
    # A compacted index has the dictionary of a fresh one over the same rows where lists hold rows.
    assert len(index.manifest.runs) <= 2
    check(reader)  # still reads the generation it began with
    assert index.recycle() > 0
    check(index)


def test_odd_inputs(spark, words, tmp_path):
    empty = PatternIndex.create(words.limit(0), f"file://{tmp_path}/e", "w", ["id"])
    assert empty.where(like("a%"), plan="index").count() == 0 and empty.where(like("%"), plan="index").count() == 0
    empty.insert(words.where("w = 'qrs'"))
    assert empty.where(like("qr%"), plan="index").count() == 1
    with pytest.raises(ValueError):
        PatternIndex.create(words, f"file://{tmp_path}/n", "id", ["id"])
    with pytest.raises(ValueError):
        PatternIndex.create(words, f"file://{tmp_path}/n", "w", ["id"], k=9)
    with pytest.raises(ValueError):
        PatternIndex.open(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        empty.where(like("abc\\"), plan="index")
    with pytest.raises(FileExistsError):  # two writers of one generation
        other = PatternIndex.open(spark, empty.root)
        other.insert(words.limit(1))
        empty.insert(words.limit(1))


def test_estimates(spark, tmp_path):
    towns = ["oslo", "lima", "quito", "cairo", "delhi"]
    values = [f"{towns[i * i % 5]}/{i * 6151 % 30011}" for i in range(12_000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, w string")
    index = PatternIndex.create(df, f"file://{tmp_path}/c", "w", ["id"])
    counts = {"lima/7%": sum(v.startswith("lima/7") for v in values), "%lo/12%": sum("lo/12" in v for v in values), "%/99999": 0, "%zzz%": 0}
    for pattern, n in counts.items():
        e = index.estimate(pattern).first()
        assert (e["tids"], e["lossy_pages"], e["exact"]) == (n, 0, True)
    e = index.estimate("%l%").first()
    assert (e["tids"], e["lossy_pages"], e["exact"]) == (0, index.manifest.npages, True)
    for pattern in ("lima/7%", "%lo/12%"):
        e = index.estimate(pattern, budget=0).first()
        assert not e["exact"] and e["tids"] >= counts[pattern] / 10
    stats = {r["key"]: r["entries"] for r in index.pattern_stats("oslo/1%").collect()}
    assert stats["G3:o/1"] == sum("o/1" in v for v in values) and stats["H:F:oslo"] == sum(v.startswith("oslo") for v in values)
    assert index.candidate_pages("%zzz%").first()[0] == 0


def test_a_search_reads_only_where_candidates_are(spark, tmp_path, monkeypatch):
    """Rows that the scan gives are counted: whole pages of the stored rows are skipped, and whole parts."""
    df = spark.range(6000, numPartitions=1).select("id", F.concat(F.lit("row "), F.format_string("%06d", "id")).alias("w"))
    index = PatternIndex.create(df, f"file://{tmp_path}/s", "w", ["id"])
    index.insert(df.select((F.col("id") + 6000).alias("id"), F.lit("late").alias("w")).limit(50))
    index.merge_pending()
    found = index.where(like("row 0031%"), plan="index")
    assert sorted(r["id"] for r in found.collect()) == list(range(3100, 3200))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and re.search(r"PushedFilters: \[.*__place", plan)
    spans = index._spans([[like("row 0031%")]])
    assert any(low <= 3100 and high >= 3199 for low, high in spans) and sum(high - low + 1 for low, high in spans) < 600
    assert index._spans([[like("%")]]) is None
    stored = index._stretches(index.manifest.parts, spans).select("id")
    assert stored.count() == sum(high - low + 1 for low, high in spans)
    scans = stored._jdf.queryExecution().executedPlan().collectLeaves()
    rows = [scans.apply(i).metrics().apply("numOutputRows") for i in range(scans.size())]
    stored._jdf.queryExecution().toRdd().count()
    assert sum(r.value() for r in rows) <= 2 * PAGE_ROWS
    # Lists beyond the budget are joined on the executors, with the same result.
    monkeypatch.setattr(costs, "BUDGET", 10)
    assert index._spans([[like("row 0031%")]]) is None
    assert index.where(like("row 0031%"), plan="index").count() == 100


def test_spans():
    got = costs.spans(np.array([5, 0, 9, 40]), np.array([6, 3, 9, 50]), 1)
    assert got == [(0, 3), (5, 6), (9, 9), (40, 50)]
    assert costs.spans(np.array([5, 0, 9, 40]), np.array([6, 3, 9, 50]), 3) == [(0, 9), (40, 50)]
    assert costs.spans(np.array([5, 0, 9, 40]), np.array([6, 3, 9, 50]), 1, 2) == [(0, 9), (40, 50)]
    assert costs.spans(np.zeros(0), np.zeros(0)) == []


def test_a_batch_is_added_once(spark, words, tmp_path):
    """Also by a handle that is opened after a restart, and when the stream's own record of it is lost."""
    index = PatternIndex.create(words.limit(0), f"file://{tmp_path}/i", "w", ["id"])
    assert index.insert(words.limit(50), ("stream", 0)) == 50 and index.insert(words.limit(50), ("stream", 0)) == 0
    again = PatternIndex.open(spark, index.root)
    assert again.insert(words.limit(50), ("stream", 0)) == 0 and again.insert(words.limit(5), ("other", 0)) == 5
    words.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long, w string").parquet(f"file://{tmp_path}/in")
        ingest(stream, again, f"file://{tmp_path}/ck", available_now=True).awaitTermination()
        shutil.rmtree(tmp_path / "ck" / "commits")
        again = PatternIndex.open(spark, index.root)
    assert again.rows().count() == 55 + words.count()


def test_an_update_is_one_generation(spark, words, tmp_path):
    index = PatternIndex.create(words, f"file://{tmp_path}/i", "w", ["id"])
    before = index.manifest.generation
    assert index.update("id < 3", {"w": F.lit("new")}) == 3
    assert index.manifest.generation == before + 1 and index.rows().count() == words.count()


def test_merge_policy():
    run = lambda size, rows=100: Run(0, "", rows, 0, size, 0, 0)
    assert merging.taken([], 0, merging.FULL, 4096) == 0
    assert merging.taken([run(10**9)], 100, merging.NORMAL, 4096) == 0
    assert merging.taken([run(10**9), run(30000)], 8000, merging.NORMAL, 4096) == 1
    assert merging.taken([run(10**9), run(30000)], 8000, merging.FULL, 4096) == 2
    assert merging.taken([run(10**9)] * 16, 100, merging.INLINE, 4096) == 1
    assert merging.taken([run(100), run(100)], 0, merging.NORMAL, 4096) == 2
    assert merging.purged([run(10 << 20), run(10)], [1, 0]) == -1
    assert merging.purged([run(10 << 20), run(10)], [10, 0]) == 0
    assert merging.purged([run(10 << 20), run(10)], [1, 1]) == 1


def test_manifest_round_trip(tmp_path):
    m = Manifest(0, "w", ["id"], None, None, "{}", {"k": 3}, runs=[Run(1, "p", 1, 1, 1, 0, 1)])
    m.write(f"file://{tmp_path}/m")
    assert Manifest.read(f"file://{tmp_path}/m") == m


def test_a_list_counts_as_one_beyond_a_stretch(spark, tmp_path, monkeypatch):
    """A list's bytes are those of all deltas, also of the first ones of later stretches."""
    monkeypatch.setattr(postings, "STRETCH", 1000)
    rare = [5, 900, 1950, 1951, 7000]
    df = spark.range(8000).select("id", F.when(F.col("id").isin(rare), "qqq").otherwise("abc").alias("w"))
    index = PatternIndex.create(df, f"file://{tmp_path}/i", "w", ["id"])
    got = {r["key"]: (r["n"], r["bytes"]) for r in index.keys().collect()}
    size = lambda vals: sum(1 if b - a < 128 else 2 for a, b in zip([-1, *vals], vals, strict=False))
    assert got["G3:qqq"] == (5, size(rare))
    assert got["G3:abc"] == (7995, size([i for i in range(8000) if i not in rare]))


def lists(index):
    """All lists, from the stored segments."""
    found = postings.segments(index.spark, index.manifest.runs).toArrow()
    n, vals = postings.decoded(found)
    return sorted(zip(np.repeat(found.column("key").to_pylist(), n).tolist(), vals.tolist(), strict=True))


def test_lists_are_stored_by_stretch(spark, words, tmp_path, monkeypatch):
    """A run has one row a key and stretch, however many rows the key is in; also after merges, vacuums and updates."""
    monkeypatch.setattr(postings, "STRETCH", 256)
    monkeypatch.setattr(postings, "FILE_BYTES", 1000)
    many = words.select("id", "w").union(words.select(F.col("id") + 1000, "w")).union(words.select(F.col("id") + 2000, "w"))
    index = PatternIndex.create(many, f"file://{tmp_path}/i", "w", ["id"], rows_per_page=16)
    index.insert(many.select((F.col("id") + 5000).alias("id"), "w").where("id < 5300"))
    index.delete("id % 3 = 0")
    index.compact()
    index.vacuum()
    own = lists(index)
    assert len(own) == len(set(own))
    [run] = index.manifest.runs
    stored = postings.segments(spark, [run])
    assert stored.count() == stored.select("key", "at").distinct().count() == len({(k, v // 256) for k, v in own})
    live = index._live(index._heap(index.manifest.parts)).select("w", "__rid", "__page").collect()
    p = index.params
    truth = {(k, r["__rid"] if is_exact(k, p) else r["__page"]) for r in live if r["w"] is not None for k in keys_of(r["w"], p)}
    assert {x for x in own if is_exact(x[0], p)} == {x for x in truth if is_exact(x[0], p)}
    assert truth <= set(own) and index.verify() == 0


def test_verify_finds_what_lists_lack(spark, words, tmp_path):
    index = PatternIndex.create(words, f"file://{tmp_path}/i", "w", ["id"], rows_per_page=16)
    [run] = index.manifest.runs
    have = lambda key: {r["id"] for r in words.collect() if r["w"] is not None and key in keys_of(r["w"], index.params)}
    for i, gone in enumerate((["G3:ail"], ["G2:ae"], ["G3:ail", "G2:ae", "N"])):
        left = postings.segments(spark, [run]).where(~F.col("key").isin(gone))
        index.manifest.runs = [postings.write_run(left, None, index.params, f"file://{tmp_path}/r{i}", 1, run.rows, run.npages, 1)]
        assert index.verify() == len(set().union(*map(have, gone)))


def test_a_broad_search_exchanges_no_rows(spark, words, tmp_path, monkeypatch):
    monkeypatch.setattr(costs, "BUDGET", 10)
    index = PatternIndex.create(words, f"file://{tmp_path}/i", "w", ["id"], rows_per_page=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for one in (index.where(like("%ai%"), plan="index"), index.where(like("%ail%"), plan="index"), index.where_any(ilike("%ail%"), like("_a_"), plan="index")):
            assert "SortMergeJoin" not in one._jdf.queryExecution().executedPlan().toString()
        assert index.where_any(ilike("%ail%"), like("_a_"), plan="index").count() == words.where("w ilike '%ail%' or w like '_a_'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
