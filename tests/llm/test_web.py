"""WARC archives, URL filters and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

from pyspark.sql import functions as F

from glyphlake.llm import catalog, urls, warc
from glyphlake.sources.files import new_path
from tests.conftest import SF, same


def test_warc_equals_sql(spark, duck):
    same(catalog.op2_warc(spark, SF), duck, catalog.OP2_SQL)


def test_warc_of_odd_rows(spark):
    pages = [(3, "http://a/", "x"), (1, None, "x"), (None, "u", "x"), (2, "u\r\nX: y", None), (4, "u", ""), (5, "u", "é\r\n\r\n"), (5, "u", "é\r\n\r\n"), (6, "u", "z" * 300_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string").repartition(3)
    rows = Counter(tuple(r) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min(j for j, _, k in pages if (k or "") == (h or "") and j is not None)
        revisit = i != first
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert rows == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.archive(df, path, min_bytes=5)
    kinds = {r["record_id"]: r["record_type"] for r in warc.read(spark, path).where("record_type <> 'warcinfo'").collect()}
    assert [kinds[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


def test_pushdown_and_other_writers(spark):
    path = new_path(spark, "warc-push")
    df = spark.createDataFrame([(i, f"http://h{i % 3}/p", f"text {i % 5}") for i in range(20)], "page_id long, url string, html string")
    warc.archive(df, path)
    got = warc.read(spark, path)
    plan = got.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter isnotnull(record_type" in plan and "= revisit" not in plan  # the reader does the rest
    assert got.where("record_type = 'response'").count() == 5 and got.where("record_type in ('revisit', 'warcinfo') and payload is not null").count() > 14
    assert got.where("target_uri like 'http://h1/%' and record_type <> 'warcinfo'").count() == 7
    assert warc.read(spark, path, payload=False).where("record_type = 'response' and payload is null").count() == 5
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    none = warc.Wanted({}, {})
    for raw in (record * 2, gzip.compress(record) * 2):
        found = list(warc.records(io.BytesIO(raw), none, True))
        assert [(h["WARC-Type"], p) for h, p in found] == [("resource", b"hello")] * 2
    assert list(warc.records(io.BytesIO(record + gzip.compress(record)), warc.Wanted({"WARC-Type": {"response"}}, {}), True)) == []
    own = warc.member([("WARC-Type", "resource")], b"body")
    assert gzip.decompress(own).endswith(b"\r\n\r\nbody\r\n\r\n")


def test_two_archives_in_one_folder(spark):
    path = new_path(spark, "warc-two")
    pages = lambda a: spark.createDataFrame([(a + i, "u", f"text {a + i}") for i in range(10)], "page_id long, url string, html string")
    warc.archive(pages(0), path)
    warc.archive(pages(100), path)
    ids = [r[0] for r in warc.read(spark, path).where("record_type = 'response'").select(warc.page_id(F.col("record_id"))).collect()]
    assert sorted(ids) == [*range(10), *range(100, 110)]


def test_headers_in_any_case_and_chunks():
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:x>\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5\r\nhello\r\n3;x=y\r\n\r\nz\r\n0\r\n\r\n"
    odd = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nnot chunked"
    raw = record % (len(http), http) + record % (len(odd), odd)
    for data in (raw, gzip.compress(raw)):
        found = [(h["WARC-Type"], h["WARC-Record-ID"], p) for h, p in warc.records(io.BytesIO(data), warc.Wanted({}, {}), True)]
        assert found == [("response", "<urn:x>", b"hello\r\nz"), ("response", "<urn:x>", b"not chunked")]


def test_a_member_of_many_records():
    """A file compressed as a whole gives all its records, and so do members after it."""
    record = lambda i, n: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    raw = gzip.compress(record(0, 5) + record(1, 0) + record(2, 300_000)) + gzip.compress(record(3, 7))
    found = [(h["WARC-Record-ID"], len(p)) for h, p in warc.records(io.BytesIO(raw), warc.Wanted({}, {}), True)]
    assert found == [("<urn:0>", 5), ("<urn:1>", 0), ("<urn:2>", 300_000), ("<urn:3>", 7)]
    some = warc.Wanted({"WARC-Record-ID": {"<urn:2>", "<urn:3>"}}, {})
    assert [h["WARC-Record-ID"] for h, _ in warc.records(io.BytesIO(raw), some, False)] == ["<urn:2>", "<urn:3>"]


def test_urls_equal_sql(spark, duck):
    same(urls.judge(spark.read.parquet(f"{SF}/pages.parquet")), duck, urls.judge_sql())


def test_urls_of_odd_rows(spark, duck):
    odd = [None, "", "no scheme", "http://", "http://NET", "http://a.Net/", "x://example.com/de/", "x://badexample.com/de/x", "x://a.example.com/de", "//x", "http://h?q", "http://h#f://z/", "a://b://c/d", "http://ÄB.org/fr/é", "http://x.org/fr", "s://h\n.net/\n/x"]
    odd += [f"http://slug.com/a/word{c}/x" for c in "abcdefgh" * 3] + [f"http://big.com/{w}/deep/er/and/more" for w in ("p", "q", "r")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)], "page_id long, url string, host string")
    con = duck.cursor()
    con.register("odd", df.toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW pages AS SELECT page_id, url FROM odd")
    same(urls.judge(df), con, urls.judge_sql())
    rows = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert (rows[5]["host"], rows[5]["rule"], rows[5]["verdict"]) == ("a.net", "net/", "block")
    assert (rows[6]["rule"], rows[7]["rule"], rows[8]["rule"], rows[12]["host"]) == ("example.com/de/", None, None, "b:")
    assert rows[0]["host"] == rows[0]["path"] == "" and rows[11]["path"] == ""
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_are_rejected_by_labels(spark):
    rows = [(i, f"http://s.test/buy/{i}", 1) for i in range(40)] + [(100 + i, f"http://s.test/read/{i}.html", 0) for i in range(40)] + [(200 + i, f"http://s.test/{kind}/{i}x", None) for i, kind in enumerate(["buy"] * 5 + ["read"] * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, y int")
    said = {r["page_id"]: r["verdict"] for r in urls.judge(df, rules=(), label="y").collect()}
    assert said[0] == "block" and said[100] == "allow" and said[205] == "allow"
    assert {r["template"] for r in urls.judge(df, rules=(), label="y").where("page_id < 40").collect()} == {"/{*//}/*//"}


def test_sections_of_many_siblings_keep_their_labels(spark):
    """Of 100 sections of 1 % each: a bad one is rejected, a clean one is not, and an unlabelled one has no other's labels."""
    rows = [(1000 * k + i, f"http://s.test/sec{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}", 1 if k == 0 else 0 if k < 50 else None) for k in range(100) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, y int")
    said = {r["page_id"]: r["verdict"] for r in urls.judge(df, rules=(), label="y").collect()}
    assert {k for k in range(100) if said[1000 * k] == "block"} == {0}
    few = spark.createDataFrame([(i, u, y) for i, u, y in rows if i % 1000 < 30], "page_id long, url string, y int")
    said = {r["page_id"]: r["verdict"] for r in urls.judge(few, rules=(), label="y").collect()}
    assert {k for k in range(100) if said[1000 * k] == "block"} == {0}
    hot = [(i, f"http://hot.example.com/{'de' if i % 100 == 0 else 'sec' + chr(97 + i % 25) + chr(97 + i // 25 % 4)}/x", None) for i in range(12_000)]
    hot += [(20_000 + i, "http://a.org/fr/x", None) for i in range(300)]
    said = Counter(r["verdict"] for r in urls.judge(spark.createDataFrame(hot, "page_id long, url string, y int")).collect())
    assert said == Counter(block=120, allow=12_180)


def test_branches_without_labels_are_left_alone(spark):
    """Only /de/ is labelled, as bad; its siblings have the same shape and no labels."""
    rows = [(100 * k + i, f"http://m.example.com/{s}/{i}", None) for k, s in enumerate(("de", "en", "es", "fr")) for i in range(40)]
    said = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, y int")).collect()}
    assert {i // 100 for i, v in said.items() if v == "block"} == {0} and sum(v == "block" for v in said.values()) == 40


def test_language_stage_rejects_what_fits_no_language(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400))
    rows = [(-1, noise, None, "s", 400), (-2, "Это предложение на языке, которого модель не знает. " * 3, None, "s", 150), (-3, "zq", None, "s", 2), (-4, "12 !", None, "s", 4), (-5, None, None, "s", 0)]
    odd = spark.createDataFrame(rows, docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(odd), SF)
    assert {r["doc_id"] for r in kept.where("doc_id < 0").collect()} == {-3}
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.where("doc_id >= 0").count() >= 0.99 * lettered
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, SF).collect()} == {-1, -2, -3}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, f"test-{name}")
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0] and sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    odd = spark.createDataFrame([(1, None, None, "s", None), (2, "", "en", None, 0), (3, "the same line of five words", "en", "s", 27), (3, "the same line of five words", "en", "s", 27)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 4
        assert stage(spark, odd.limit(0), SF).count() == 0
