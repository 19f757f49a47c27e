"""A pattern index over one text column: built, searched, changed and inspected.

The index narrows the rows that can match; Spark's own LIKE or ILIKE decides on each of them. So a
search always gives what a plain filter would. Rows live in parts, posting lists in immutable runs, and
a manifest per generation says which of both are current: a reader keeps the one it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from glyphlake.functions.keys import is_exact, is_exact_column, keys_column, shown, shown_column
from glyphlake.functions.params import IndexParams
from glyphlake.operators import postings
from glyphlake.plans import estimate as costs
from glyphlake.plans import merging
from glyphlake.plans.pattern import Clause
from glyphlake.sources import files
from glyphlake.sources.manifest import FORMAT_VERSION, PAGE_BYTES, Manifest, Part, Run

RID, PAGE, TASK, PLACE = "__rid", "__page", "__task", "__place"
#: Lists that a search intersects; more would cost more than the rechecks they spare.
LISTS = 3
#: Rows of a Parquet page of the stored rows: what a search can skip at least.
PAGE_ROWS = 1000


def like(pattern: str | None, escape: str | None = "\\") -> Clause:
    return Clause(pattern, False, escape)


def ilike(pattern: str | None, escape: str | None = "\\") -> Clause:
    return Clause(pattern, True, escape)


class PatternIndex:
    def __init__(self, spark: SparkSession, root: str, manifest: Manifest):
        self.spark, self.root, self.manifest = spark, root, manifest
        self._stats: dict[str, costs.KeyStat] = {}

    # Building and opening

    @classmethod
    def create(cls, df: DataFrame, root: str, column: str, order: Iterable[str], expression: str | None = None, predicate: str | None = None, **options: object) -> PatternIndex:
        """Builds an index of a text column, or of a text ``expression``, of the rows that ``predicate`` picks.

        ``order`` names the columns that number the rows.
        """
        params = IndexParams.of(**options)
        kind = df.select(F.expr(expression) if expression else F.col(column)).schema[0].dataType
        if kind.simpleString() != "string":
            raise ValueError(f"a pattern index takes text, not {kind.simpleString()}")
        chosen = df.where(predicate) if predicate else df
        manifest = Manifest(0, column, list(order), expression, predicate, df.schema.json(), params.as_dict())
        index = cls(df.sparkSession, root, manifest)
        part = index._store(chosen, "part-0", 0)
        manifest.parts, manifest.next_rid = [part], part.rows
        manifest.npages = -(-part.rows // params.rows_per_page)
        if part.rows:
            found = postings.segments_of(index._rows(index._heap([part])), params)
            manifest.runs = [postings.write_run(found, None, params, index._folder("run-1"), 1, part.rows, manifest.npages, part.size)]
            manifest.next_run = 2
        manifest.write(root)
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> PatternIndex:
        return cls(spark, root, Manifest.read(root))

    @property
    def params(self) -> IndexParams:
        return self.manifest.options

    @property
    def value(self) -> Column:
        return F.expr(self.manifest.expression) if self.manifest.expression else F.col(self.manifest.column)

    @property
    def columns(self) -> list[str]:
        return [f["name"] for f in json.loads(self.manifest.schema)["fields"]]

    def _folder(self, name: str) -> str:
        """A new folder of the index: writers of one generation never share one, the manifest decides between them."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    def _store(self, df: DataFrame, name: str, first_rid: int) -> Part:
        """Writes rows in order; their ids follow from the task that wrote them and their place in it."""
        path = self._folder(name)
        number = F.monotonically_increasing_id()
        ordered = df.repartitionByRange(*self.manifest.order).sortWithinPartitions(*self.manifest.order)
        ordered = ordered.withColumn(TASK, number)
        ordered.withColumn(PLACE, F.col(TASK).bitwiseAND(F.lit((1 << 33) - 1))).withColumn(TASK, F.shiftright(TASK, 33).cast("int")).write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
        size = F.octet_length(self.value)
        sums = self.spark.read.parquet(path).groupBy(TASK).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0)))
        counts = sorted(tuple(r) for r in sums.collect())
        first, at = {}, first_rid
        for task, n, _, _ in counts:
            first[str(task)] = at
            at += n
        return Part(path, first, at - first_rid, sum(c[2] for c in counts), max((c[3] for c in counts), default=0))

    def _heap(self, parts: list[Part], within: Column | None = None) -> DataFrame:
        """The parts' rows with their ids and pages; ``within`` is a condition on where they are stored."""
        found: DataFrame | None = None
        schema = StructType.fromJson(json.loads(self.manifest.schema)).add(TASK, IntegerType()).add(PLACE, LongType())
        for part in parts:
            if not part.rows:
                continue
            first = F.array(*(F.lit(part.first.get(str(task))).cast("long") for task in range(max(map(int, part.first)) + 1)))
            stored = self.spark.read.schema(schema).parquet(part.path)
            stored = stored if within is None else stored.where(within)
            own = stored.withColumn(RID, F.element_at(first, F.col(TASK) + 1) + F.col(PLACE)).drop(TASK, PLACE)
            found = own if found is None else found.unionByName(own)
        if found is None:
            empty = self.spark.createDataFrame([], StructType.fromJson(json.loads(self.manifest.schema)))
            found = empty.withColumn(RID, F.lit(0).cast("long")).limit(0)
        return found.withColumn(PAGE, F.floor(F.col(RID) / self.params.rows_per_page))

    def _stretches(self, parts: list[Part], spans: list[tuple[int, int]]) -> DataFrame:
        """The parts' rows whose ids lie in the spans, and only those parts and pages of them that hold any.

        The ids of a part rise with the task that wrote a row and its place, and both are stored in that
        order, so a span is a filter on them that Parquet answers from its statistics.
        """
        found: DataFrame | None = None
        for part in parts:
            tasks = sorted((rid, int(task)) for task, rid in part.first.items())
            begins = np.array([rid for rid, _ in tasks], dtype=np.int64)
            texts = []
            for low, high in spans:
                low, high = max(low, int(begins[0])) if tasks else 0, min(high, int(begins[0]) + part.rows - 1) if tasks else -1
                if low > high:
                    continue
                a, b = (int(np.searchsorted(begins, x, "right")) - 1 for x in (low, high))
                (first_a, task_a), (first_b, task_b) = tasks[a], tasks[b]
                if a == b:
                    texts.append(f"{TASK} = {task_a} AND {PLACE} >= {low - first_a} AND {PLACE} <= {high - first_b}")
                    continue
                texts += [f"{TASK} = {task_a} AND {PLACE} >= {low - first_a}", f"{TASK} = {task_b} AND {PLACE} <= {high - first_b}"]
                if b > a + 1:
                    texts.append(f"{TASK} > {task_a} AND {TASK} < {task_b}")
            if texts:
                own = self._heap([part], F.expr(" OR ".join(f"({t})" for t in texts)))
                found = own if found is None else found.unionByName(own)
        return self._heap([]) if found is None else found

    def _rows(self, heap: DataFrame) -> DataFrame:
        return heap.select(F.col(RID).alias("rid"), F.col(PAGE).alias("page"), self.value.alias("value"))

    def _dead(self) -> DataFrame | None:
        found: DataFrame | None = None
        for path in self.manifest.tombstones:
            own = self.spark.read.schema("val long").parquet(path)
            found = own if found is None else found.unionByName(own)
        return found

    def _live(self, heap: DataFrame) -> DataFrame:
        dead = self._dead()
        return heap if dead is None else heap.join(dead, F.col(RID) == F.col("val"), "left_anti")

    def rows(self) -> DataFrame:
        """All live rows, with their columns only."""
        m = self.manifest
        return self._live(self._heap(m.parts + m.frozen + m.pending)).select(*self.columns)

    # Searching

    def stats(self, keys: Iterable[str]) -> dict[str, costs.KeyStat]:
        """Statistics of keys, from the dictionaries; fetched once a generation."""
        new = [k for k in keys if k not in self._stats]
        if new:
            for k in new:
                self._stats[k] = costs.KeyStat(k, is_exact(k, self.params))
            for r in postings.dictionary(self.spark, self.manifest.runs).where(F.col("key").isin(new)).collect():
                s = self._stats[r["key"]]
                s.runs, s.entries, s.size, s.stopped = s.runs + 1, s.entries + r["n"], s.size + r["bytes"], s.stopped or r["ctype"] == 2
        return {k: self._stats[k] for k in keys}

    def _conjunction(self, clauses: list[Clause]) -> costs.Conjunction:
        for c in clauses:
            c.tokens()  # a bad pattern fails here, whatever the index holds
        every, _ = costs.keys_of_clauses(clauses, self.params)
        return costs.conjunction(clauses, self.params, self.stats(every | {"A", "N"}))

    def _all(self, keys: list[str]) -> DataFrame:
        return postings.having_all(self.spark, self.manifest.runs, keys)

    def _narrowed(self, exact: list[str], coarse: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """Candidate rows, or candidate pages if no key holds rows."""
        pages = self._all(coarse) if coarse else None
        if not exact:
            return None, pages
        rids = self._all(exact)
        if pages is not None:
            page = pages.select(F.col("val").alias("p"))
            rids = rids.join(page, F.floor(F.col("val") / self.params.rows_per_page) == F.col("p"), "left_semi")
        return rids, None

    def _candidates(self, clauses: list[Clause], thorough: bool) -> tuple[bool, DataFrame | None, DataFrame | None]:
        """Whether all rows are candidates; else candidate rows and candidate pages of the runs."""
        got = self._conjunction(clauses)
        if any(c.pattern is None for c in clauses):
            return False, None, None
        if not got.keys or got.full and not got.impossible:
            return True, None, None
        pick = lambda stats: [s.key for s in (stats if thorough else stats[:LISTS])]
        rids = pages = None
        if not got.impossible:
            coarse = got.coarse if thorough or not got.exact else []
            rids, pages = self._narrowed(pick(got.exact), pick(coarse))
        extra: list[DataFrame] = []
        special = self.stats(["A", "N"])
        if got.ilike and special["N"].entries:
            # Rows that are not ASCII fold by other rules: only the LIKE conditions' keys bind them.
            own = [self.stats([k])[k] for k in sorted(got.like_only)]
            if all(s.entries or s.stopped for s in own):
                exact = sorted((s for s in own if s.exact and not s.stopped), key=lambda s: s.entries)
                coarse = sorted((s for s in own if not s.exact and not s.stopped), key=lambda s: s.entries) if thorough else []
                extra.append(self._narrowed(["N", *pick(exact)], pick(coarse))[0])
        if special["A"].entries:
            extra.append(self._all(["A"]))
        for one in extra:
            rids = one if rids is None else rids.unionByName(one)
        return False, rids.distinct() if extra and rids is not None else rids, pages

    def _spans(self, any_of: list[list[Clause]]) -> list[tuple[int, int]] | None:
        """Stretches of row ids that hold all candidates; none if the lists to read are beyond the budget.

        The dictionary tells the lengths before a list is read, so what comes to the driver is bounded.
        The stretches may hold other rows too: the conditions themselves decide on each row.
        """
        wanted: list[tuple[list[str], bool]] = []
        for clauses in any_of:
            got, special = self._conjunction(clauses), self.stats(["A", "N"])
            if any(c.pattern is None for c in clauses):
                continue
            if not got.keys or got.full and not got.impossible:
                return None
            if not got.impossible:
                exact = bool(got.exact)
                own = costs.readable(got.exact if exact else got.coarse, costs.BUDGET)[:LISTS]
                if not own:
                    return None
                wanted.append(([s.key for s in own], exact))
            wanted += [([k], True) for k in ("A", *("N" if got.ilike else "")) if special[k].entries]
        keys = sorted({k for own, _ in wanted for k in own})
        if sum(s.entries for s in self.stats(keys).values()) > costs.BUDGET:
            return None
        lists, size = postings.fetched(self.spark, self.manifest.runs, keys), self.params.rows_per_page
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, exact in wanted:
            values = lists[own[0]]
            for k in own[1:]:
                values = np.intersect1d(values, lists[k], assume_unique=True)
            starts.append(values if exact else values * size)
            ends.append(values if exact else values * size + size - 1)
        return costs.spans(np.concatenate(starts), np.concatenate(ends), PAGE_ROWS)

    def _granules(self, any_of: list[list[Clause]]) -> DataFrame | None:
        """The stretches of ``PAGE_ROWS`` row ids that hold candidates, by number; none if all rows are candidates."""
        size, found = self.params.rows_per_page, self._frame([], "granule long")
        at = lambda val: F.floor(val / PAGE_ROWS)
        for clauses in any_of:
            everything, rids, pages = self._candidates(clauses, False)
            if everything:
                return None
            if rids is not None:
                found = found.unionByName(rids.select(at(F.col("val")).alias("granule")))
            if pages is not None:
                within = F.sequence(at(F.col("val") * size), at(F.col("val") * size + (size - 1)))
                found = found.unionByName(pages.select(F.explode(within).alias("granule")))
        return found.distinct()

    def search(self, any_of: list[list[Clause]], plan: str = "auto") -> DataFrame:
        """The rows for which all conditions of one of the lists hold. ``plan``: auto, index or scan."""
        m = self.manifest
        condition = F.lit(False)
        for clauses in any_of:
            own = F.lit(True)
            for c in clauses:
                own = own & c.condition(self.value)
            condition = condition | own
        if plan == "auto":
            plan = "index" if self._pays(any_of) else "scan"
        spans = self._spans(any_of) if plan == "index" else None
        heap = self._heap(m.parts) if spans is None else self._stretches(m.parts, spans)
        if plan == "index" and spans is None:
            granules = self._granules(any_of)
            if granules is not None:
                # As many as the table has rows by PAGE_ROWS at most, so the rows themselves need no exchange.
                heap = heap.join(F.broadcast(granules), F.floor(F.col(RID) / PAGE_ROWS) == F.col("granule"), "left_semi")
        late = m.frozen + m.pending
        if late:
            heap = heap.unionByName(self._heap(late))
        return self._live(heap).where(condition).select(*self.columns)

    def where(self, *clauses: Clause, plan: str = "auto") -> DataFrame:
        """The rows for which all conditions hold."""
        return self.search([list(clauses)], plan)

    def where_any(self, *clauses: Clause, plan: str = "auto") -> DataFrame:
        """The rows for which one of the conditions holds."""
        return self.search([[c] for c in clauses], plan)

    def where_like_any(self, patterns: Iterable[str | None], plan: str = "auto") -> DataFrame:
        """``LIKE ANY``: null patterns are skipped."""
        return self.search([[like(p)] for p in patterns if p is not None], plan)

    def where_like_all(self, patterns: Iterable[str | None], plan: str = "auto") -> DataFrame:
        """``LIKE ALL``, as one conjunction."""
        return self.search([[like(p) for p in patterns]], plan)

    def where_not(self, *clauses: Clause) -> DataFrame:
        """The rows for which none of the conditions holds: no index helps there."""
        condition = F.lit(True)
        for c in clauses:
            condition = condition & ~c.condition(self.value)
        return self.rows().where(condition)

    def _pays(self, any_of: list[list[Clause]]) -> bool:
        size = sum(p.size for p in self.manifest.parts)
        if size < costs.SCAN_BYTES:
            return False
        return all(costs.use_index(self.estimate_of(clauses, 0), size, self.params.rows_per_page) for clauses in any_of)

    # Changing

    def _next(self, **changes: object) -> None:
        """A new generation; a writer that lost the race fails here and has changed nothing."""
        new = replace(self.manifest, generation=self.manifest.generation + 1, **changes)
        new.write(self.root)
        self.manifest, self._stats = new, {}

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows to the pending list; merges when it passes the limit. Returns the rows added.

        ``batch``: a stream and its number; one that is in the index already is not added again.
        """
        if batch and self.manifest.batches.get(batch[0], -1) >= batch[1]:
            return 0
        return self._add(df, self.manifest.tombstones, dict([batch]) if batch else {})

    def _add(self, df: DataFrame, tombstones: list[str], batches: dict[str, int]) -> int:
        """One generation with rows added, and with what else goes with them."""
        m = self.manifest
        schema = StructType.fromJson(json.loads(m.schema))
        chosen = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        if m.predicate:
            chosen = chosen.where(m.predicate)
        part = self._store(chosen, f"part-{m.generation + 1}", m.next_rid)
        self._next(pending=[*m.pending, part], next_rid=m.next_rid + part.rows, tombstones=tombstones, batches=m.batches | batches)
        limit = self.params.pending_limit * 1024
        if limit and sum(p.size for p in self.manifest.pending) > limit:
            self._merge(merging.INLINE)
        return part.rows

    def delete(self, condition: Column | str) -> int:
        """Removes the live rows that a condition picks; returns their number."""
        path, n = self._picked(condition)
        self._next(tombstones=[*self.manifest.tombstones, path] if n else self.manifest.tombstones)
        return n

    def _picked(self, condition: Column | str) -> tuple[str, int]:
        """A new folder with the ids of the live rows that a condition picks; and their number."""
        m = self.manifest
        path = self._folder("dead")
        gone = self._live(self._heap(m.parts + m.frozen + m.pending)).where(condition).select(F.col(RID).alias("val"))
        gone.write.parquet(path)
        return path, self.spark.read.schema("val long").parquet(path).count()

    def update(self, condition: Column | str, changes: dict[str, Column]) -> int:
        """Changes rows: they are removed and added again with new ids, in one generation."""
        old = self.rows().where(condition)
        new = old.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in self.columns))
        path = self._folder("changed")
        new.write.parquet(path)
        dead, n = self._picked(condition)
        return self._add(self.spark.read.parquet(path), [*self.manifest.tombstones, *([dead] if n else [])], {})

    def merge_pending(self) -> int:
        """Folds the pending rows into a run and merges runs of like size; returns the rows folded in."""
        return self._merge(merging.NORMAL)

    def compact(self) -> int:
        """Folds the pending rows in and merges all runs into one."""
        return self._merge(merging.FULL)

    def _merge(self, mode: str) -> int:
        m = self.manifest
        if m.pending:
            # Frozen rows are still searched as they are until their run is there.
            self._next(frozen=[*m.frozen, *m.pending], pending=[])
            m = self.manifest
        count = merging.taken(m.runs, sum(p.size for p in m.frozen), mode, self.params.pending_limit)
        if not m.frozen and not count:
            return 0
        chosen = m.runs[len(m.runs) - count :]
        npages = max(m.npages, -(-m.next_rid // self.params.rows_per_page))
        folded = sum(p.rows for p in m.frozen)
        run = self._combined(chosen, m.frozen, folded + sum(r.rows for r in chosen), npages, None)
        kept = m.runs[: len(m.runs) - count]
        self._next(runs=[*kept, run], parts=[*m.parts, *m.frozen], frozen=[], npages=npages, next_run=m.next_run + 1)
        return folded

    def _combined(self, runs: list[Run], parts: list[Part], rows: int, npages: int, dead: DataFrame | None) -> Run:
        """One run of several and of rows that are in none yet; dropped lists stay dropped."""
        every = postings.segments(self.spark, runs)
        size = sum(r.size for r in runs) + sum(p.size for p in parts)
        if parts:
            every = every.unionByName(postings.segments_of(self._rows(self._heap(parts)), self.params))
        stopped = postings.dictionary(self.spark, runs).where("ctype = 2").select("key").distinct() if self.params.stops and runs else None
        number = self.manifest.next_run
        return postings.write_run(every, stopped, self.params, self._folder(f"run-{number}"), number, rows, npages, size, dead)

    def vacuum(self) -> int:
        """Drops dead rows from the runs that hold many, then folds the pending rows in; returns those folded."""
        m, dead = self.manifest, self._dead()
        if dead is not None and m.runs and self.params.exact:
            counts = []
            for run in m.runs:
                own = postings.values(postings.segments(self.spark, [run]).where(F.col("key").startswith("P:F:0:")))
                counts.append(own.join(dead, "val", "left_semi").count())
            at = merging.purged(m.runs, counts)
            if at >= 0:
                chosen = m.runs[at:]
                run = self._combined(chosen, [], max(0, sum(r.rows for r in chosen) - sum(counts[at:])), m.npages, dead)
                self._next(runs=[*m.runs[:at], run], next_run=m.next_run + 1)
        return self._merge(merging.NORMAL)

    def recycle(self, keep: int = 1) -> int:
        """Deletes the files that the latest ``keep`` generations don't use; returns the folders deleted."""
        names = files.names(self.root)
        kept = [n for n in names if n.startswith("manifest-")][-keep:]
        used: set[str] = set()
        for name in kept:
            m = Manifest.read(self.root, int(name[9:19]))
            used |= {p.path for p in (*m.parts, *m.pending, *m.frozen)} | {r.path for r in m.runs} | set(m.tombstones)
        gone = [n for n in names if n.startswith(("part-", "run-", "dead-", "changed-", "lost-")) and f"{self.root}/{n}" not in used]
        for name in gone:
            files.remove(f"{self.root}/{name}")
        return len(gone)

    # Inspecting

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def info(self) -> DataFrame:
        """One row about the whole index."""
        m, p = self.manifest, self.params
        blob = sum(r.size for r in m.runs)
        late = m.pending + m.frozen
        late_pages = sum(-(-x.size // PAGE_BYTES) for x in late)
        blob_pages = sum(-(-r.size // PAGE_BYTES) for r in m.runs)
        row = (m.generation, m.npages, len(m.runs), sum(r.keys for r in m.runs), sum(r.stopped for r in m.runs), blob_pages, blob, sum(x.rows for x in late), late_pages, blob_pages + late_pages + 1,
               p.k, p.cap, p.rollup, p.reverse_depth, p.composite, p.cross_edges, float(p.stop_threshold), p.pending_limit, p.anchor_len, p.skip_depth, p.exact, p.exact_bigrams, FORMAT_VERSION)
        return self._frame([row], "generation long, heap_pages long, runs int, keys long, stopped_keys long, blob_pages long, blob_bytes long, pending_records long, pending_pages long, index_pages long, k int, cap int, rollup int, reverse_depth int, composite boolean, cross_edges boolean, stop_threshold float, pending_limit int, anchor_len int, skip_depth int, exact boolean, exact_bigrams boolean, format_version int")

    def runs(self) -> DataFrame:
        """The runs, oldest first."""
        rows = [(i + 1, r.id, r.rows, r.keys, -(-r.size // PAGE_BYTES), r.size, r.npages) for i, r in enumerate(self.manifest.runs)]
        return self._frame(rows, "run int, run_id long, rows long, keys long, pages long, bytes long, heap_pages long")

    def key_stats(self) -> DataFrame:
        """Keys, lists and bytes by family and tier; a key counts once a run."""
        words = postings.dictionary(self.spark, self.manifest.runs)
        return words.groupBy("family", "tier").agg(
            F.count("*").alias("keys"), F.count_if(F.col("ctype") == 0).alias("array_lists"), F.count_if(F.col("ctype") == 1).alias("bitmap_lists"),
            F.count_if(F.col("ctype") == 2).alias("stop_keys"), F.sum(F.col("bytes") + F.octet_length("key") + 6).alias("bytes"),
        )

    def candidate_pages(self, pattern: str, is_ilike: bool = False) -> DataFrame:
        """The number of pages that a search would touch."""
        m, clause = self.manifest, Clause(pattern, is_ilike)
        everything, rids, pages = self._candidates([clause], True)
        if everything:
            total = max(m.npages, -(-m.next_rid // self.params.rows_per_page))
            return self._frame([(total,)], "pages long")
        found = self._frame([], "page long")
        if rids is not None:
            found = found.unionByName(rids.select(F.floor(F.col("val") / self.params.rows_per_page).alias("page")))
        if pages is not None:
            found = found.unionByName(pages.select(F.col("val").alias("page")))
        if late := m.frozen + m.pending:
            found = found.unionByName(self._heap(late).where(clause.condition(self.value)).select(F.col(PAGE).alias("page")))
        return found.agg(F.count_distinct("page").alias("pages"))

    def pattern_stats(self, pattern: str, is_ilike: bool = False) -> DataFrame:
        """The keys that a pattern needs, and what the lists of each hold."""
        keys, _ = costs.keys_of_clauses([Clause(pattern, is_ilike)], self.params)
        rows = [(shown(s.key), "exact" if s.exact else "page", s.runs, s.stopped, None if s.stopped else s.entries, s.size) for s in self.stats(sorted(keys)).values()]
        return self._frame(rows, "key string, tier string, runs int, stopped boolean, entries long, bytes long")

    def estimate_of(self, clauses: list[Clause], budget: int = costs.BUDGET) -> costs.Estimate:
        """Candidate rows and pages of a conjunction: counted if the lists fit the budget, else bounded."""
        m = self.manifest
        got = self._conjunction(clauses)
        decoded, read = costs.work(got, m.npages)
        nrows = sum(r.rows for r in m.runs)
        est = costs.Estimate(0.0, 0.0, True, len(got.keys), decoded, read, float(nrows), float(m.npages))
        if any(c.pattern is None for c in clauses):
            return est
        if not got.keys or got.full and not got.impossible:
            est.lossy_pages = float(m.npages)
        elif got.impossible:
            pass
        elif not got.exact:
            est.lossy_pages = float(self._all([s.key for s in got.coarse]).count()) if budget else float(got.coarse[0].entries)
            est.exact = bool(budget)
        else:
            chosen = costs.readable(got.exact, budget)
            bound = min(nrows * costs.fractions(clauses, self.params, got, nrows, m.npages), got.exact[0].entries)
            if not chosen:
                est.tids, est.exact = max(bound, 0.0), False
            else:
                rids, _ = self._narrowed([s.key for s in chosen], [s.key for s in got.coarse])
                n = rids.count()
                est.exact = len(chosen) == len(got.exact) or not n
                est.tids = float(n if est.exact else min(n, max(bound, 1.0)))
        special = self.stats(["A", "N"])
        est.tids += special["A"].entries + (special["N"].entries if got.ilike else 0)
        est.tids, est.lossy_pages = min(est.tids, float(max(nrows, 0))), min(est.lossy_pages, float(m.npages))
        return est

    def estimate(self, pattern: str, is_ilike: bool = False, budget: int = costs.BUDGET) -> DataFrame:
        e = self.estimate_of([Clause(pattern, is_ilike)], budget)
        row = (e.tids, e.lossy_pages, e.exact, e.keys, e.values_decoded, e.index_pages, e.rows, e.heap_pages)
        return self._frame([row], "tids double, lossy_pages double, exact boolean, keys int, values_decoded double, index_pages double, rows double, heap_pages double")

    def uncovered(self) -> DataFrame:
        """Row ids that some list should hold and doesn't; none if the index is sound. Pending rows are covered as such."""
        m, params = self.manifest, self.params
        rows = self._rows(self._live(self._heap(m.parts)))
        missing = postings.missing(postings.segments_of(rows, params), postings.segments(self.spark, m.runs), sum(p.size for p in m.parts))
        if params.stops:
            stopped = postings.dictionary(self.spark, m.runs).where("ctype = 2").select("key").distinct()
            missing = missing.join(stopped, "key", "left_anti")
        path = self._folder("lost")
        missing.withColumn("exact", is_exact_column(F.col("key"), params)).write.parquet(path)
        missing = self.spark.read.schema("key string, val long, exact boolean").parquet(path)
        found = missing.where("exact").select(F.col("val").alias("rid"))
        coarse = missing.where("not exact")
        if not coarse.isEmpty():
            # Of a page that a list lacks, only the rows that have the key are lost.
            near = rows.join(coarse.select(F.col("val").alias("page")).distinct(), "page", "left_semi")
            keys = near.select("rid", F.col("page").alias("val"), F.explode(keys_column(F.col("value"), params, max(p.longest for p in m.parts))).alias("key"))
            found = found.unionByName(keys.join(coarse, ["key", "val"], "left_semi").select("rid"))
        return found.distinct()

    def verify(self) -> int:
        """How many live rows the index fails to cover."""
        return self.uncovered().count()

    def keys(self) -> DataFrame:
        """The dictionary as it is shown: key, family, tier, n, bytes, ctype, run."""
        return postings.dictionary(self.spark, self.manifest.runs).withColumn("key", shown_column(F.col("key")))
