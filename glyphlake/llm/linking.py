"""Groups of linked nodes, from buckets of candidates and an exact test of pairs.

No bucket is expanded into all its pairs. Each member is first tested against the bucket's smallest
node; members that join its group need no further test there. Those that don't are tested against
every member of their bucket that is in another group: by blocks, which hold the members themselves and
never rows of pairs, or, where no Python may run, against further members of the centre's group, one a
round, and then as pairs. So each pair of a bucket is either tested or known to be connected: the
groups are those that testing every pair would give. ``link_sized`` tests them within a join, of which
only links come out.

All tables have narrow rows of 64-bit numbers. Nothing but counts reaches the driver. Joins stand
directly over the exchanges of written tables, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.shared import discard, release, written

#: Whether two nodes, each given as columns ``size`` and ``sign``, may be linked.
Maybe = Callable[[dict[str, Column], dict[str, Column]], Column]

#: Pairs that remain, for each row of the buckets that hold them, below which all of them are tested.
FEW = 8.0
#: Nodes of a block.
BLOCK = 256
#: Rounds of single probes before all remaining pairs are tested, however many.
ROUNDS = 6
#: Nodes of one side of a block of a bucket of sized nodes. Up to its square of them are tested in one task.
DEALT = 128


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of each node of the edges (a, b); the root is the smallest node of the component.

    Each round maps every node to its smallest neighbour's smallest neighbour and contracts the edges,
    which at least halves a chain, so the rounds grow with the logarithm of the longest path.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    left = written(edges.select(a.alias("hi"), b.alias("lo")).where("hi > lo").distinct(), f"{label}-edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        to = left.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), "lo"), F.struct(F.col("lo").alias("node"), "lo"))).alias("x"))
        first = written(to.groupBy("x.node").agg(F.min("x.lo").alias("parent")), f"{label}-first")
        jump = first.alias("p").join(first.alias("q"), F.col("p.parent") == F.col("q.node")).select("p.node", "q.parent")
        jump = written(jump, f"{label}-jump")
        hi, lo = jump.toDF("hi", "rhi"), jump.toDF("lo", "rlo")
        moved = left.join(hi, "hi").select("lo", "rhi").join(lo, "lo")
        before, left = left, written(moved.select(F.greatest("rhi", "rlo").alias("hi"), F.least("rhi", "rlo").alias("lo")).where("hi > lo").distinct(), f"{label}-edges")
        discard(before, first)
        if found is None:
            found = written(jump.toDF("node", "root"), f"{label}-roots")
        else:
            on = jump.toDF("root", "next")
            before, found = found, written(found.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{label}-roots")
            discard(before)
        discard(jump)
    discard(left)
    return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0) if found is None else found


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], label: str, by_blocks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components (node, root) of the linked nodes, from buckets (key, node).

    ``verify`` takes different pairs (a, b) and keeps those that are linked. ``by_blocks`` takes what
    ``blocks`` gives and returns links (a, b) that connect all linked nodes of a block.
    """
    centres = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other")
    centres = written(centres.select("key", "centre"), f"{label}-centres")
    rows = written(buckets.join(centres, "key"), f"{label}-buckets")
    edges = written(verify(_ordered(rows.select(F.col("centre").alias("a"), F.col("node").alias("b")))), f"{label}-links")
    roots = components(edges, label)
    before = None
    for round_ in range(ROUNDS + 1):
        marked = written(_rooted(_rooted(rows, roots, "node"), roots, "centre"), f"{label}-marked")
        unlike: Column = F.col("node_root") != F.col("centre_root")
        probe = F.min_by("node", F.when(~unlike, F.xxhash64("node", F.lit(round_)))).alias("probe")
        sums = marked.groupBy("key").agg(F.count("*").alias("n"), F.count_if(unlike).alias("u"), probe).where("u > 0 and n > 2")
        sums = written(sums, f"{label}-mixed")
        size = sums.agg(F.sum(F.col("n") * F.col("u")), F.sum("n")).first()
        if not size[0]:
            break
        if by_blocks:
            more = written(by_blocks(blocks(marked.join(sums.select("key"), "key", "left_semi"), label)), f"{label}-links")
            return roots if more.isEmpty() else components(edges.unionByName(more), label)
        mixed = marked.where(unlike).join(sums.select("key", "probe"), "key")
        last = round_ == ROUNDS or size[0] <= FEW * size[1] or before is not None and size[0] > 0.9 * before
        if last:
            mixed = written(mixed, f"{label}-unlike")
            every = marked.join(sums.select("key"), "key", "left_semi").select("key", F.col("node").alias("b"), F.col("node_root").alias("b_root"))
            both = mixed.select("key", F.col("node").alias("a"), F.col("node_root").alias("a_root")).join(written(every, f"{label}-every"), "key")
            pairs = both.where("a_root != b_root").select("a", "b")
        else:
            pairs = mixed.select(F.col("probe").alias("a"), F.col("node").alias("b"))
        before = size[0]
        more = written(verify(_ordered(pairs)), f"{label}-links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = components(edges, label)
        if last:
            break
    return roots


def _alike(a: Column, b: Column, ratio: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(ratio) - 1


def _star(buckets: DataFrame, ratio: float, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets with their centre, the smallest node; and the pairs (a, b) of nodes with centres of like size."""
    centres = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.min_by("size", "node").alias("centre_size")).where("centre < other")
    centres = written(centres.select("key", "centre", "centre_size"), f"{label}-centres")
    rows = written(buckets.join(centres, "key"), f"{label}-rows")
    discard(centres)
    return rows, _ordered(rows.where(_alike(F.col("size"), F.col("centre_size"), ratio)).select(F.col("centre").alias("a"), F.col("node").alias("b")))


def _mixed(rows: DataFrame, roots: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the roots of node and centre, and the keys of buckets in which some (u of n) differ."""
    marked = written(_rooted(_rooted(rows, roots, "node"), roots, "centre"), f"{label}-marked")
    unlike = F.col("node_root") != F.col("centre_root")
    keys = marked.groupBy("key").agg(F.count("*").alias("n"), F.count_if(unlike).alias("u")).where("u > 0 and n > 2")
    return marked, written(keys, f"{label}-mixed")


def _signed(marked: DataFrame, keys: DataFrame, signs: DataFrame, label: str) -> DataFrame:
    """The rows of the buckets of these keys, each with its sign, all of its node's keys in order, and the blocks that its bucket's nodes are dealt into."""
    mixed = marked.join(keys, "key", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    mine = written(signs.join(mixed, "node"), f"{label}-signs")
    some = marked.join(keys, "key").join(mine, "node").withColumn("unlike", F.col("node_root") != F.col("centre_root"))
    some = written(some.select("key", "node", "node_root", "size", "sign", "keys", "unlike", *(F.ceil(F.col(n) / DEALT).cast("int").alias(f"n{n}") for n in ("u", "n"))), f"{label}-signed")
    discard(mine)
    return some


def _side(x: str) -> list[Column]:
    return [F.col(c).alias(f"{x}_{c}") for c in ("node", "node_root", "size", "sign", "keys", "unlike")]


def _unconnected(pairs: DataFrame, maybe: Maybe, ratio: float, linked: Maybe | None) -> DataFrame:
    """The pairs (a, b) of like size whose signs don't rule them out and that are ``linked``, each once.

    Nodes of different groups meet in every bucket that both are in, as one of them is not in its centre's
    group; they become a row in one of these only, picked by hash, so that buckets with the same nodes share
    the work. Two that are both not in it meet there twice.
    """
    once = (F.col("a_node") < F.col("b_node")) | ~F.col("b_unlike")
    # In a lambda, as Spark computes for all pairs what a condition holds twice, also behind an `and`.
    nth = F.xxhash64(F.least("a_node", "b_node"), F.greatest("a_node", "b_node"))
    shared = F.transform(F.array(F.array_intersect("a_keys", "b_keys")), lambda x: F.element_at(x, (F.pmod(nth, F.size(x)) + 1).cast("int")))
    here = F.col("key") == F.element_at(shared, 1)
    both = [{"size": F.col(f"{x}_size"), "sign": F.col(f"{x}_sign")} for x in ("a", "b")]
    test = (F.col("a_node_root") != F.col("b_node_root")) & once & _alike(F.col("a_size"), F.col("b_size"), ratio) & maybe(*both) & here
    # The dear test is last: only what passes all others reaches it.
    found = pairs.where(test & linked(*both) if linked else test)
    return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _dealt(some: DataFrame, maybe: Maybe, ratio: float, linked: Maybe | None = None) -> DataFrame:
    """Pairs of the nodes that are not in their centre's group with all others of their bucket.

    Both are dealt into blocks of about ``DEALT`` nodes. Each meets each once, and what can't be alike, or isn't ``linked``, is left out within the join.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asked = some.where("unlike").select("key", own("nu").alias("bx"), every("nn").alias("by"), *_side("a"))
    answering = some.select("key", own("nn").alias("by"), every("nu").alias("bx"), *_side("b"))
    # A count of its own keeps adaptive execution from joining tasks by their bytes, which say little of their time.
    dealt = ["key", "bx", "by"]
    tasks = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _unconnected(asked.repartition(tasks, *dealt).join(answering.repartition(tasks, *dealt), dealt), maybe, ratio, linked)


def link_sized(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], label: str, ratio: float, signs: DataFrame, maybe: Maybe, linked: Maybe) -> DataFrame:
    """Components (node, root), from buckets (key, node, size) of nodes that have several keys each.

    Nodes whose sizes differ by more than ``ratio`` are never linked. Each node is tested against the
    smallest of each of its buckets. In buckets with nodes that are not in its group, each of those is then
    held against all others: so all linked nodes that share a key are connected. ``signs`` (node, sign)
    describe nodes; ``linked`` decides on two of them as ``verify`` does, so only links become rows, however
    many pairs a bucket has. The pairs compared still grow with its square. ``maybe`` is a cheap test that
    never refuses a link.
    """
    rows, pairs = _star(buckets, ratio, label)
    edges = written(verify(pairs), f"{label}-links")
    roots = components(edges, label)
    marked, keys = _mixed(rows, roots, label)
    discard(rows)
    if keys.isEmpty():
        discard(edges, marked, keys)
        return roots
    some = _signed(marked, keys, signs, label)
    discard(marked, keys)
    release(buckets.sparkSession)
    more = written(_dealt(some, maybe, ratio, linked), f"{label}-links")
    discard(some)
    if not more.isEmpty():
        before, roots = roots, components(edges.unionByName(more), label)
        discard(before)
    discard(edges, more)
    return roots


def blocks(marked: DataFrame, label: str) -> DataFrame:
    """Rows (cluster, bx, by, node, node_root, as_x, as_y): which nodes to test against which.

    Buckets that share nodes make a cluster. Its nodes that didn't join their centre's group (x) are dealt
    into blocks, as are all its nodes (y); each x block meets each y block once.
    """
    marked = written(marked.withColumn("unlike", F.col("node_root") != F.col("centre_root")), f"{label}-left")
    cluster = components(marked.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), f"{label}-cluster")
    members = marked.groupBy("node").agg(F.min("node_root").alias("node_root"), F.max("unlike").alias("x"))
    members = written(members.join(cluster.withColumnRenamed("root", "cluster"), "node"), f"{label}-members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count_if("x") / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"))
    rows = members.join(written(sizes, f"{label}-sizes"), "cluster")
    bx, by = (F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for n in ("nx", "ny"))
    place = lambda bx, by, x, y: F.struct(bx.alias("bx"), by.alias("by"), x.alias("as_x"), y.alias("as_y"))
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    every = lambda n: F.sequence(zero, F.col(n) - 1)
    asked = F.when(F.col("x"), F.transform(every("ny"), lambda i: place(bx, i, yes, no))).otherwise(F.array().cast("array<struct<bx:int,by:int,as_x:boolean,as_y:boolean>>"))
    answering = F.transform(every("nx"), lambda i: place(i, by, no, yes))
    small = (F.col("nx") == 1) & (F.col("ny") == 1)
    places = F.when(small, F.array(place(zero, zero, F.col("x"), yes))).otherwise(F.concat(asked, answering))
    return rows.select("cluster", "node", "node_root", F.explode(places).alias("p")).select("cluster", "p.bx", "p.by", "node", "node_root", "p.as_x", "p.as_y")


def _rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Adds the root of a column's node; a node without links is its own."""
    own = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(own, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))
