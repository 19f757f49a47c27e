"""Near-duplicates, lines, decontamination and fingerprints against brute force; odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import catalog, decontam, lines, linking, neardup, spotsigs, textvec
from tests.conftest import SF, same

WORDS = [f"w{i}" for i in range(400)]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(text: str | None, k: int = 5) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard(a: Counter, b: Counter) -> float:
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def roots(pairs: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    up = {n: n for n in nodes}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def edited(rng: random.Random, base: list[str], n: int) -> list[str]:
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(WORDS)
    return out


@pytest.fixture(scope="module")
def copies():
    """Texts with exact and near copies of every degree, repeated passages and texts of few words."""
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "one two three", "one two three", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice((20, 60, 150)))
        texts += [" ".join(base)] * 2
        texts += [" ".join(edited(rng, base, n)) for n in (1, 1, 2, 3, 5, 8)]
        texts.append(" ".join(base + base[:10]))
    texts += [" ".join(rng.choices(WORDS, k=80)) for _ in range(30)]
    hot = rng.choices(WORDS, k=100)
    texts += [" ".join(edited(rng, hot, 1 + i % 3)) for i in range(40)]
    return list(enumerate(texts))


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((40, 25), (40, 60), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r["node"]: r["root"] for r in linking.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
        want = roots(edges, list(range(n)))
        assert all(got.get(i, i) == want[i] for i in range(n))
    chain = [(i, i + 1) for i in range(60)]
    assert {r["root"] for r in linking.components(spark.createDataFrame(chain, "a long, b long"), "t").collect()} == {0}


def test_links_equal_all_pairs(spark):
    """A bucket whose members are linked in a chain only: every pair that matters is tested."""
    members = [(1, i) for i in range(0, 40)] + [(2, i) for i in range(35, 50)] + [(3, 99)]
    buckets = spark.createDataFrame(members, "key long, node long")
    near = lambda pairs: pairs.where(F.abs(F.col("a") - F.col("b")) == 2)
    got = linking.link(buckets, near, "t")
    pairs = [(a, b) for k in (1, 2) for a, b in itertools.combinations([n for q, n in members if q == k], 2) if b - a == 2]
    want = roots(pairs, sorted({n for _, n in members}))
    found = {r["node"]: r["root"] for r in got.collect()}
    assert all(found.get(n, n) == r for n, r in want.items())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(1, 1 << 60, 60).astype(np.uint64), rng.integers(1, 1 << 60, 40).astype(np.uint64)
    counts = np.concatenate([rng.integers(1, 9, 60), rng.integers(1, 40, 10)])
    a = (np.zeros(70, int), np.concatenate([shared, own[:10]]), counts)
    other = np.concatenate([np.maximum(1, counts[:60] // 2), rng.integers(1, 5, 30)])
    b = (np.zeros(90, int), np.concatenate([shared, own[10:]]), other)
    true = np.minimum(counts[:60], other[:60]).sum() / (counts.sum() + other.sum() - np.minimum(counts[:60], other[:60]).sum())
    x, y = (neardup.signatures(*s, 4096)[1][0] for s in (a, b))
    assert abs((x == y).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert np.isfinite(x).all()


def test_near_groups_equal_brute_force(spark, copies):
    df = spark.createDataFrame([(i, t, i) for i, t in copies], "doc_id long, text string, keep int").repartition(5)
    rows = {r["doc_id"]: r for r in neardup.groups(df).collect()}
    bags = {i: bag(t) for i, t in copies}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(copies, 2) if (x or "") == (y or "") or jaccard(bags[a], bags[b]) >= 0.8]
    want = roots(pairs, [i for i, _ in copies])
    assert {i: r["class_id"] for i, r in rows.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[i]] and r["keep"] == (want[i] == i) for i, r in rows.items())
    kept = {r["doc_id"] for r in neardup.one_of_each(df).collect()}
    assert kept == set(want.values())


def test_near_groups_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, None), (9, ""), (None, "q r s t u v w")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h1 string")
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.groups(df).collect())
    assert got == Counter({(None, 7, 3): 2, (7, 7, 3): 1, (8, 8, 3): 2, (9, 8, 3): 1, (None, None, 1): 1})
    assert sorted(str(r["doc_id"]) for r in neardup.one_of_each(df).collect()) == ["7", "8", "None"]
    assert neardup.groups(df.limit(0)).count() == 0 and neardup.one_of_each(df.limit(0)).count() == 0


def similarity(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def normal(line: str) -> list[str]:
    return words(line.translate(str.maketrans("123456789", "0" * 9)))


def test_simhash_equals_a_loop(spark):
    rng = random.Random(2)
    arrays = [rng.choices(WORDS, k=n) for n in (1, 5, 40, 511, 512, 700)]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, w array<string>").select("i", lines.simhash(F.col("w")).alias("s"), F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect()
    for r in got:
        want = sum(1 << b for b in range(63) if 2 * sum((h >> b) & 1 for h in r["h"]) > len(r["h"]))
        assert r["s"] == want


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choices(WORDS, k=n)) for n in (5, 9, 30, 60)]
    docs = []
    for i in range(60):
        own = [" ".join(rng.choices(WORDS, k=rng.choice((3, 6, 30)))) for _ in range(3)]
        own += rng.sample(shared, 2) + [" ".join(edited(rng, shared[3].split(), 1)), "Page 1 of 20 pages here", "x", ""]
        rng.shuffle(own)
        docs.append((i, "\n".join(own)))
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, n_lines int").repartition(6)
    rows = lines.deduplicate(df).collect()
    places = [(i, p, " ".join(normal(x))) for i, t in docs for p, x in enumerate(t.split("\n")) if len(normal(x)) >= 5]
    distinct = sorted({x for _, _, x in places})
    hashed = spark.createDataFrame([(i, x.split()) for i, x in enumerate(distinct)], "i int, w array<string>").select("i", lines.block_keys(lines.simhash(lines.features(F.col("w"), lines.long_words(F.col("w"))))).alias("k")).collect()
    keys = {r["i"]: set(r["k"]) for r in hashed}
    pairs = [(a, b) for a, b in itertools.combinations(range(len(distinct)), 2) if keys[a] & keys[b] and similarity(distinct[a], distinct[b]) >= 0.8 - 1e-9]
    assert pairs
    group = roots(pairs, list(range(len(distinct))))
    number, first = {x: group[i] for i, x in enumerate(distinct)}, {}
    for i, p, x in sorted(places):
        first.setdefault(number[x], (i, p))
    gone = {(i, p) for i, p, x in places if first[number[x]] != (i, p)}
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}
    assert {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_removed"] == sum(d == r["doc_id"] for d, _ in gone) and r["n_lines"] == dict(docs)[r["doc_id"]].count("\n") + 1 for r in rows)


def test_lines_with_changed_words_are_found(spark):
    """Pairs of edit similarity 0.8 and more by one to a fifth of changed words; each document is one line."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    docs, pairs = [], []
    for n, changed in [(5, 1), (10, 1), (20, 1), (50, 1), (20, 3), (50, 8)] * 40:
        base = other = [word() for _ in range(n)]
        while base == other or similarity(" ".join(base), " ".join(other)) < 0.8:
            base = [word() for _ in range(n)]
            other = list(base)
            for i in rng.sample(range(n), changed):
                other[i] = word()
        pairs.append((n, changed, len(docs) + 1))
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(other))]
    gone = {r["doc_id"] for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), every_line=True).where("n_removed = 1").collect()}
    found = Counter((n, changed) for n, changed, i in pairs if i in gone)
    assert gone <= {i for _, _, i in pairs}
    assert all(found[x] == 40 for x in ((5, 1), (10, 1), (20, 1), (50, 1))) and found[20, 3] + found[50, 8] >= 76, found


def test_lines_that_share_a_key_are_all_tested(spark, monkeypatch):
    """The groups of lines are those of all pairs that share a key, also where a bucket's smallest line is unlike both."""
    monkeypatch.setattr(linking, "DEALT", 16)
    random = np.random.default_rng(5)
    words = ["".join(random.choice(list("abcdefghijklmnop"), random.integers(3, 11))) for _ in range(400)]
    passage = [str(w) for w in random.choice(words, 14)]
    docs = []
    for i in range(160):
        own = [str(w) for w in random.choice(words, 10)]
        for _ in range(1 + i % 3):
            line = own[:5] + passage + own[5:]
            for _ in range(random.integers(0, 4)):
                line[random.integers(0, len(line))] = str(random.choice(words))
            docs.append((len(docs), " ".join(line)))
    docs += [(len(docs) + i, "语言" * 12 + "行文" * (i % 9) + chr(0x4E00 + i)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = sorted({t for _, t in docs})
    table = lines.with_sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string").withColumn("w", F.split("line", " ")), "w", "line", "keys")
    keys = {r["i"]: set(r["keys"]) for r in table.select("i", "keys").collect()}
    pairs = [(i, j, texts[i], texts[j]) for i, j in itertools.combinations(range(len(texts)), 2) if keys[i] & keys[j]]
    near = spark.createDataFrame(pairs, "i int, j int, a string, b string")
    signs = {x: F.struct(F.length(x).alias("size"), lines.sign(F.col(x)).alias("sign")) for x in "ab"}
    linked = lines.similar(near.where(lines.overlap(F.col("a"), F.col("b"))).withColumn("x", F.col("a")).withColumn("y", F.col("b")), "x", "y")
    told = linked.withColumn("p", signs["a"]).withColumn("q", signs["b"]).select("i", "j", lines.may_be_similar(*({"size": F.col(f"{s}.size"), "sign": F.col(f"{s}.sign")} for s in "pq")).alias("may")).collect()
    assert len(told) > 100 and all(r["may"] for r in told)
    root = list(range(len(texts)))
    for r in told:
        a, b = root[r["i"]], root[r["j"]]
        root = [a if x == b else x for x in root]
    first = {}
    for _, t in docs:
        first.setdefault(root[texts.index(t)], t)
    gone = lines.deduplicate(frame, every_line=True).where("n_removed = 1").count()
    assert gone == len(docs) - len(first)


def test_bounds_of_edits_hold(spark):
    """The bound by words is never below the distance, and far enough from the limit to decide on lines with a few changed words."""
    rng = random.Random(13)
    rows = [("", ""), ("", "a b"), ("a b", ""), (" a", "a "), ("x" * 30, "x" * 20)]
    for n, changed in ((6, 1), (20, 3), (60, 4), (60, 60)):
        for _ in range(15):
            base = rng.choices(WORDS, k=n)
            other = edited(rng, base, changed)
            del other[rng.randrange(n)]
            other.insert(rng.randrange(n), rng.choice(WORDS))
            rows.append((" ".join(base), " ".join(other)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("true"), lines._most_edits(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(r["most"] >= r["true"] for r in got)
    near = [r for r in got if r["true"] <= 0.1 * len(r["a"]) and len(r["a"]) > 200]
    assert len(near) >= 10 and sum(r["most"] <= 0.2 * len(r["a"]) for r in near) >= 0.8 * len(near)
    both = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    kept = [{r["i"] for r in lines.similar(both, "a", "b", likely).select("i").collect()} for likely in (True, False)]
    assert kept[0] == kept[1] == {i for i, (a, b) in enumerate(rows) if similarity(a, b) >= 0.8 - 1e-9}


def test_each_pair_of_a_bucket_is_made_once(spark, monkeypatch):
    """Unconnected nodes that share many buckets become one row, without a distinct over rows made once a bucket."""
    monkeypatch.setattr(linking, "DEALT", 4)
    rng = random.Random(14)
    members = sorted({(key, rng.randrange(40)) for key in range(12) for _ in range(14)} | {(20, i) for i in range(15)} | {(21, i) for i in range(15)})
    root = {i: i // 3 * 3 for i in range(40)}
    centre = {k: min(n for q, n in members if q == k) for k, _ in members}
    marked = spark.createDataFrame([(k, n, 10, root[n], root[centre[k]]) for k, n in members], "key long, node long, size int, node_root long, centre_root long")
    signs = spark.createDataFrame([(i, i) for i in range(40)], "node long, sign long")
    keys = marked.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("node_root") != F.col("centre_root")).alias("u")).where("u > 0")
    pairs = linking._dealt(linking._signed(marked, keys, signs, "t"), lambda a, b: F.lit(True), 0.8)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    buckets = defaultdict(set)
    for k, n in members:
        buckets[k].add(n)
    want = {(a, b) for ns in buckets.values() for a, b in itertools.combinations(sorted(ns), 2) if root[a] != root[b]}
    assert sorted(got) == sorted(want) and want
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_unlike_lines_of_a_bucket_make_no_rows_of_pairs(spark, monkeypatch):
    """Lines that share a passage are all tested within a join, of which only links come out."""
    monkeypatch.setattr(linking, "DEALT", 32)
    rng = random.Random(16)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = [word(8) for _ in range(48)]
    docs = []
    for i in range(100):
        own = [word(6) for _ in range(32)]
        docs.append((len(docs), " ".join(own[:16] + passage + own[16:])))
        if i % 10 == 0:
            docs.append((len(docs), " ".join([word(6), *own[1:16], *passage, *own[16:]])))
    made, real = Counter(), linking.written

    def counted(df, label):
        out = real(df, label)
        made[label] = max(made[label], out.count())
        return out

    monkeypatch.setattr(linking, "written", counted)
    gone = {r["doc_id"] for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), every_line=True).where("n_removed = 1").collect()}
    assert gone == {i for i in range(1, len(docs)) if docs[i][1].split()[1:] == docs[i - 1][1].split()[1:]} and len(gone) == 10
    buckets = made.pop("lines-rows")
    assert made["lines-signed"] > 100 and max(made.values()) <= buckets < 100 * 99 / 2, made


def test_linked_within_a_join_is_as_before(spark):
    """What decides within the join agrees with what decides on rows, also on lines of few and of very long words."""
    rng = random.Random(17)
    rows = [("", ""), ("", "a b"), ("a b c d", "a b c e"), ("x" * 30, "x" * 27 + "yyy"), ("x" * 30, "x" * 20), ("é" * 25 + "ab", "é" * 25 + "ba")]
    for n, changed in ((6, 1), (20, 3), (20, 5), (60, 4), (60, 20), (60, 60), (400, 40)):
        for _ in range(6):
            base = rng.choices(WORDS, k=n)
            rows.append((" ".join(base), " ".join(edited(rng, base, changed))))
    rows += [(b + " a", a) for a, b in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    told = {r["i"] for r in lines.similar(df.where(lines.overlap(F.col("a"), F.col("b"))), "a", "b").select("i").collect()}
    side = lambda x: {"size": F.length(x), "sign": F.struct(F.col(x).alias("line"))}
    assert {r["i"] for r in df.where(lines.linked(side("a"), side("b"))).select("i").collect()} == told
    assert 10 < len(told) < len(rows) - 10


def test_lines_of_like_simhash_are_found(spark):
    """Lines whose SimHashes agree in enough blocks are candidates, also if they share no run of words."""
    rng = random.Random(15)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3000)]
    rank = {r["w"]: r["r"] for r in spark.createDataFrame([(w,) for w in pool], "w string").select("w", lines._rank(F.col("w")).alias("r")).collect()}
    pool.sort(key=rank.__getitem__)
    docs = []
    for _ in range(30):
        base = rng.sample(pool[:2500], 150)
        least = sorted(base, key=rank.__getitem__)[: lines.SKETCH + 2 * lines.RUN]
        swap = {w: rng.choice(pool[2500:]) for w in least[lines.RUN - 1 :: lines.RUN]}
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(swap.get(w, w) for w in base))]
    sims = spark.createDataFrame([(i, t.split()) for i, t in docs], "i long, w array<string>").select("i", lines.block_keys(lines.simhash(lines.features(F.col("w"), lines.long_words(F.col("w"))))).alias("k")).collect()
    keys = {r["i"]: set(r["k"]) for r in sims}
    want = {i for i in range(1, len(docs), 2) if keys[i] & keys[i - 1]}
    gone = {r["doc_id"] for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), every_line=True).where("n_removed = 1").collect()}
    assert len(want) >= 5 and want <= gone


def test_short_lines_and_lines_without_blanks(spark):
    """Equal lines go however short they are; near ones of one long word go too; lines without a word stay."""
    rng = random.Random(12)
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(40))
    near = han[:20] + "々" + han[21:]
    docs = [(1, "Share\n\nRead more\n--"), (2, "share!\n\nRead  more\n--\nMore"), (2, "share!\n\nRead  more\n--\nMore"), (3, han), (4, near), (5, "Read mere")]
    got = Counter(tuple(r) for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), every_line=True).select("doc_id", "text", "n_removed").collect())
    assert got == Counter({(1, docs[0][1], 0): 1, (2, "\n--\nMore", 2): 1, (2, "\n--", 3): 1, (3, han, 0): 1, (4, "", 1): 1, (5, "Read mere", 0): 1})


def test_lines_of_odd_rows(spark):
    line = "these are five words here"
    docs = [(2, line + "\nshort"), (1, line), (1, line), (3, None), (4, ""), (None, line + "\nno"), (5, "the " * 70_000)]
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter({(2, "short", 1): 1, (1, line, 0): 1, (1, "", 1): 1, (3, None, 0): 1, (4, "", 0): 1, (None, "no", 1): 1, (5, "the " * 70_000, 0): 1})
    assert lines.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate((5, 6, 9, 20, 40, 90, 4, 0))] + [(8, None), (9, "")]
    docs: list[tuple[int | None, str | None]] = [(None, None), (1, ""), (2, items[0][1]), (2, items[0][1])]
    for i in range(40):
        w = rng.choices(WORDS, k=rng.choice((10, 300, 3000)))
        part = items[rng.randrange(7)][1].split()
        at = rng.randrange(len(w))
        docs.append((10 + i, " ".join(w[:at] + edited(rng, part, rng.choice((0, 0, 1, 2))) + w[at:])))
    sets = {i: set(bag(t)) for i, t in items}
    want = Counter((d, i) for d, t in docs for i, s in sets.items() if s and len(s & set(bag(t))) >= 0.8 * len(s) - 1e-9)
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("own"))
    right = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.matches(left, right).collect())
    assert got == want and len(want) > 15
    flags = Counter((r["doc_id"], r["contaminated"]) for r in decontam.flag(left, right).collect())
    assert flags == Counter((d, any(k[0] == d for k in want)) for d, _ in docs)
    assert decontam.matches(left.limit(0), right).count() == 0 and decontam.matches(left, right.limit(0)).count() == 0


def test_contamination_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 20)
    monkeypatch.setattr(textvec, "SLICE_CHARS", 400)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=15))) for i in range(8)]
    text = " ".join(" ".join(rng.choices(WORDS, k=50)) + " " + t for _, t in items[:5])
    queries = list(decontam.blocks(spark.createDataFrame(items, "item_id long, text string"), "text", "item_id"))
    assert len(queries) > 3
    found = {q.ids[i] for q in queries for r, i, _ in decontam.search(q, ["nothing here", text]) if r == 1}
    assert found == set(range(5))


def test_fingerprints_equal_sql(spark, duck):
    same(catalog.op9_fingerprints(spark, SF), duck, spotsigs.edits_sql())


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "STRETCH_ROWS", 2)
    docs = [(5, "the cat sat on the mat by the door"), (1, None), (2, ""), (3, "xyz"), (3, "xyz"), (9, "the cat sat on the mat by the door"), (None, "a b"), (7, "é😀" * 5)]
    rows = spotsigs.edits(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, stretch int").repartition(3)).collect()
    assert len(rows) == len(docs)
    prints = defaultdict(set)
    for r in rows:
        prints[(dict((str(i), t) for i, t in docs)[str(r["doc_id"])] or "")].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in prints.values()) and len({next(iter(x)) for x in prints.values()}) == len(prints)
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    import hashlib

    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        want[(i, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in rows) == want
    assert spotsigs.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spotsigs.edits(spark.createDataFrame([(1, "the cat sat there")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_fingerprint_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    anchors = ["the", "of", "and"]
    docs = []
    for i in range(12):
        base = [x for w in rng.choices(WORDS, k=60) for x in (rng.choice(anchors), w)]
        docs += [(10 * i + j, " ".join(edited(rng, base, n))) for j, n in enumerate((0, 0, 1, 2, 6, 12))]
    found, member = spotsigs.pairs(spark.createDataFrame(docs, "doc_id long, text string"))
    node = {r["doc_id"]: r["node"] for r in member.collect()}
    sets = {r["id"]: frozenset(r["s"]) for r in spotsigs.with_signatures(spark.createDataFrame(docs, "id long, text string"), "text", "s").collect()}
    want = {tuple(sorted((node[a], node[b]))) for a, b in itertools.combinations(sets, 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and want
    assert all((node[a] == node[b]) == (sets[a] == sets[b]) for a, b in itertools.combinations(sets, 2))
