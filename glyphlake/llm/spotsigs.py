"""SpotSigs fingerprints with DataFrame functions only.

A spot signature is an anchor (a very common word) with the chain of the next two content words, that
is words that are no anchors. A text's fingerprint is the set of its signatures, each as 8 hex digits,
sorted and joined. The likeness of two fingerprints is the Jaccard coefficient of the sets.

Pairs of a whole table are found by partitions of set length: two sets of likeness t or more have
lengths within a factor of t, so a set meets only its own partition and the next; in there, sets meet
on the signatures of their prefix (one of the rarest n - ceil(t * n) + 1 must be shared), and each
candidate's Jaccard coefficient is worked out unless the lengths alone rule it out.

Cases: a null text counts as empty. A text without a signature has one made of the whole text, so equal
texts always have equal fingerprints and different ones of this kind are unlike. Repeated rows follow
each other in the order. Rows with a null id come last. An empty table gives an empty result. Other
columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.llm.shared import frame, written

#: Very common words of English, French, German and Spanish (a parameter; case folded).
ANCHORS = tuple(
    sorted(
        set(
            "a an and are as at be by for from in is it of on or that the this to was with you "
            "au avec dans de des du en est et la le les ne pas par pour que qui sur un une "
            "das dem den der des die ein eine für im in ist mit nicht sich und von zu "
            "al con de del el en es la las lo los no para por que se su un una y".split()
        )
    )
)
#: Rows of one stretch of the id order, which one task holds in turn (it spills); and how many stretches at most.
STRETCH_ROWS, MOST_STRETCHES = 2_000, 65_536


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Adds the sorted set of a text column's signatures, each 8 hex digits.

    Each step is a column of its own that the next one uses more than once, so that no step is worked out
    again for each element of another.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    before = lambda i: F.get(out, i - 1)
    # Content words in order, each as ``anchor:word``; no anchor if another content word stands before it.
    spot = lambda w, i: F.when(~w.isin(*anchors), F.concat(F.when((i > 0) & before(i).isin(*anchors), before(i)).otherwise(""), F.lit(":"), w))
    chain = lambda w, i: F.when(~w.startswith(":"), F.concat(w, F.lit(":"), F.substring_index(F.get(out, i + 1), ":", -1)))
    digest = lambda s: F.left(F.md5(s.cast("binary")), F.lit(8))
    df = df.withColumn(out, words)
    df = df.withColumn(out, F.filter(F.transform(out, spot), lambda w: w.isNotNull()))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(out, chain), lambda s: s.isNotNull()), digest))))
    own = F.array(F.concat(F.lit("="), F.left(F.md5(F.col(text).cast("binary")), F.lit(7))))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(own))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard coefficient of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both).cast("double")


def _stretch(n: int, lo: list[int]) -> Column:
    """The place of an id among sorted cut points, as a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("id") < lo[m], tree(a, m)).otherwise(tree(m + 1, b))

    return tree(0, n)


def with_next(docs: DataFrame) -> DataFrame:
    """Of (id, text) rows: adds ``stretch``, ``ahead`` and ``place``, which order a row and its successor side by side.

    The ids are cut into stretches of about ``STRETCH_ROWS`` rows. The first row of each stretch is also
    copied to the end of the one before (of the first one: to the end of the last), so a lead over
    (stretch order by ahead, place) gives each row its successor. Only the stretches' first ids, of a
    bounded number, reach the driver.
    """
    n, low = docs.agg(F.count("*"), F.min("id")).first()
    cells = max(1, min(256, -(-n // STRETCH_ROWS)))
    cuts = docs.agg(F.percentile_approx("id", [i / cells for i in range(1, cells)], 10_000)).first()[0] if cells > 1 and low is not None else []
    cuts = sorted(set(cuts or []))
    parts = max(1, min(MOST_STRETCHES // 256, -(-n // (STRETCH_ROWS * 256))))
    cell = _stretch(len(cuts), cuts)
    if parts > 1:
        high = docs.agg(F.max("id")).first()[0]
        edges = [low, *cuts, high + 1]
        start, size = (F.element_at(F.array(*(F.lit(x) for x in xs)), cell + 1) for xs in (edges[:-1], [max(1, b - a) for a, b in zip(edges, edges[1:], strict=False)]))
        cell = cell * parts + F.least(F.lit(parts - 1), F.floor((F.col("id") - start) * parts / size).cast("int"))
    placed = docs.withColumn("stretch", F.coalesce(F.when(F.col("id").isNotNull(), cell), F.lit(MOST_STRETCHES))).withColumn("place", F.struct(F.col("id").isNull().alias("no"), "id", F.xxhash64("text").alias("h")))
    firsts = sorted(((r[0], r[1]) for r in placed.groupBy("stretch").agg(F.min("id")).collect()))
    before = [(b, a, int(i == 0)) for i, ((a, _), (_, b)) in enumerate(zip([firsts[-1], *firsts], firsts, strict=False))] if firsts else []
    # At most MOST_STRETCHES + 1 rows.
    look = F.broadcast(frame(docs.sparkSession, before, "first_id long, into int, wraps int"))
    joined = placed.join(look, placed.id.eqNullSafe(look.first_id), "left")
    copies = F.array(F.struct("stretch", F.lit(0).alias("ahead")), F.struct(F.col("into").alias("stretch"), F.lit(1).alias("ahead")))
    copies = F.when(F.col("wraps").isNull(), F.slice(copies, 1, 1)).otherwise(copies)
    return joined.select("id", "text", "place", F.explode(copies).alias("c")).select("id", "text", "place", "c.stretch", "c.ahead")


def edits(docs: DataFrame, text: str = "text", key: str = "doc_id", anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likenesses (see the query's contract)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("stretch").orderBy("ahead", "place")
    seen = with_signatures(with_next(rows).withColumn("next_text", F.lead("text").over(order)), "text", "own", anchors)
    seen = seen.withColumn("next", F.lead("own").over(order)).where("ahead = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    seen = seen.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    seen = with_signatures(seen, "edited", "changed", anchors)
    return seen.select(
        F.col("id").alias(key),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def pairs(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id", anchors: tuple[str, ...] = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate pairs (a, b, likeness) of different fingerprints, and each document's fingerprint class.

    Classes are numbered by ``node``; documents of equal fingerprints share one, so no copies are paired.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    member = with_signatures(rows, "text", "set", anchors).select("id", "set", F.md5(F.array_join("set", "").cast("binary")).alias("print"))
    member = written(member, "spots")
    classes = written(member.groupBy("print").agg(F.first("set").alias("set")).withColumn("node", F.monotonically_increasing_id()), "spot-classes")
    rare = written(classes.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n")), "spot-counts")
    spots = written(classes.select("node", F.size("set").alias("size"), F.explode("set").alias("s")), "spot-rows").join(rare, "s")
    ranked = spots.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("all"))
    prefix = F.slice("all", 1, F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1)
    part = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    keys = written(ranked.select("node", "size", part.alias("part"), F.explode(prefix).alias("p")).select("node", "size", "part", "p.s"), "spot-keys")
    a = keys.toDF("a", "size_a", "part_a", "s")
    b = keys.withColumn("part_a", F.explode(F.array(F.col("part"), F.col("part") - 1))).toDF("b", "size_b", "part_b", "s", "part_a")
    fits = (F.col("a") != F.col("b")) & (F.col("size_b") * threshold <= F.col("size_a") + 1e-9) & ((F.col("part_a") != F.col("part_b")) | (F.col("a") < F.col("b")))
    met = written(a.join(b, ["s", "part_a"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "spot-met")
    sets = classes.select("node", "set")
    near = met.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", likeness(F.col("set_a"), F.col("set_b")).alias("likeness"))
    return near.where(F.col("likeness") >= threshold), member.join(classes.select("print", "node"), "print").select(F.col("id").alias(key), "node")


def edits_sql() -> str:
    """DuckDB SQL for ``edits`` over ``documents``."""
    anchors = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"

    words = r"list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d
      WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM o),
t AS (SELECT doc_id, 'own' AS kind, text AS t FROM e UNION ALL SELECT doc_id, 'changed', edited FROM e),
w AS (SELECT doc_id, kind, t, {words} AS w FROM t),
c AS (SELECT doc_id, kind, t, list_filter(list_transform(w, lambda x, i:
        CASE WHEN NOT list_contains({anchors}, x) THEN (CASE WHEN i > 1 AND list_contains({anchors}, w[i - 1]) THEN w[i - 1] ELSE '' END) || ':' || x END),
        lambda x: x IS NOT NULL) AS c FROM w),
s AS (SELECT doc_id, kind, t, list_sort(list_distinct(list_transform(list_filter(list_transform(c, lambda x, i:
        CASE WHEN NOT starts_with(x, ':') AND i < len(c) THEN x || ':' || split_part(c[i + 1], ':', 2) END),
        lambda x: x IS NOT NULL), lambda x: left(md5(x), 8)))) AS s FROM c),
f AS (SELECT doc_id, kind, CASE WHEN len(s) > 0 THEN s ELSE ['=' || left(md5(t), 7)] END AS s FROM s),
p AS (SELECT a.doc_id, a.s AS own, b.s AS changed FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.kind = 'own' AND b.kind = 'changed'),
n AS (SELECT p.*, coalesce(lead(own) OVER w, first_value(own) OVER w) AS nxt FROM p
      WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256,
       array_to_string(n.own, '') AS fingerprint, array_to_string(n.changed, '') AS edited_fingerprint,
       len(list_intersect(own, changed))::DOUBLE / (len(own) + len(changed) - len(list_intersect(own, changed)))::DOUBLE AS near_edited,
       len(list_intersect(own, nxt))::DOUBLE / (len(own) + len(nxt) - len(list_intersect(own, nxt)))::DOUBLE AS near_next
FROM e JOIN n ON e.doc_id = n.doc_id
"""
