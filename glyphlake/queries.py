"""The library's queries over the test tables, by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.keys import END, is_exact, shown_column, value_keys
from glyphlake.functions.params import IndexParams
from glyphlake.functions.sql import pattern_keys_frame, register
from glyphlake.operators.index import Clause, PatternIndex, ilike, like
from glyphlake.plans.pattern import pattern_keys
from glyphlake.sources.files import new_path
from glyphlake.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
_built: dict[tuple, PatternIndex] = {}
DEFAULTS = IndexParams()

#: Of each indexed table: the columns that order it, and those that queries return.
TABLES = {
    "part": (["p_partkey"], ["p_partkey", "p_name"]),
    "events": (["event_id"], ["event_id", "props"]),
    "nation": (["n_nationkey"], ["n_nationkey", "n_name"]),
    "customer": (["c_custkey"], ["c_custkey", "c_name"]),
    "documents": (["doc_id"], ["doc_id", "lang"]),
    "pages": (["page_id"], ["page_id", "url"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str, name: str, column: str, **options: object) -> PatternIndex:
    """The index of a table's column, built at its first use in a session."""
    spec = (spark.sparkContext.applicationId, sf_dir, name, column, *sorted(options.items()))
    if spec not in _built:
        _built[spec] = fresh(spark, sf_dir, name, column, **options)
    return _built[spec]


def fresh(spark: SparkSession, sf_dir: str, name: str, column: str, **options: object) -> PatternIndex:
    return PatternIndex.create(table(spark, sf_dir, name), new_path(spark, f"index-{name}"), column, TABLES[name][0], **options)


def _search(name: str, column: str, *clauses: Clause, any_: bool = False, **options: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = index_of(spark, sf_dir, name, column, **options)
        found = index.where_any(*clauses, plan="index") if any_ else index.where(*clauses, plan="index")
        return found.select(*TABLES[name][1])

    return run


def _select(name: str, condition: str) -> str:
    return f"SELECT {', '.join(TABLES[name][1])} FROM {name} WHERE {condition}"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _like(column: str, pattern: str, op: str = "LIKE") -> str:
    return f"{column} {op} {_text(pattern)} ESCAPE '\\'"


#: One LIKE or ILIKE each: query, table, column, operator, pattern.
SINGLE = [
    ("like_prefix", "part", "p_name", "LIKE", "la%"),
    ("like_suffix", "part", "p_name", "LIKE", "%anvil"),
    ("like_infix3", "part", "p_name", "LIKE", "%ing%"),
    ("like_infix2", "part", "p_name", "LIKE", "%ol%"),
    ("like_infix1", "part", "p_name", "LIKE", "%z%"),
    ("like_prefix_suffix", "part", "p_name", "LIKE", "la%bolt"),
    ("like_multi_piece", "part", "p_name", "LIKE", "%ar%e%"),
    ("like_exact", "part", "p_name", "LIKE", "old anvil"),
    ("like_miss", "part", "p_name", "LIKE", "zzz%"),
    ("like_empty", "part", "p_name", "LIKE", ""),
    ("like_full_scan", "part", "p_name", "LIKE", "%"),
    ("like_underscore_mid", "part", "p_name", "LIKE", "l_rge%"),
    ("like_underscore_lead", "part", "p_name", "LIKE", "_ed ring"),
    ("like_underscore_trail", "part", "p_name", "LIKE", "%rin_"),
    ("like_underscore_only", "part", "p_name", "LIKE", "________"),
    ("like_skip", "part", "p_name", "LIKE", "%l_r_e%"),
    ("like_escape_underscore", "nation", "n_name", "LIKE", "NATION\\_1%"),
    ("like_escape_json", "events", "props", "LIKE", '{"k": 3_}'),
    ("like_percent_literal", "events", "props", "LIKE", "%\\%%"),
    ("like_url_long", "pages", "url", "LIKE", "https://%.example.org/en/%"),
    ("like_customer_number", "customer", "c_name", "LIKE", "%00012%"),
    ("ilike_prefix", "part", "p_name", "ILIKE", "LA%"),
    ("ilike_suffix", "part", "p_name", "ILIKE", "%ANVIL"),
    ("ilike_infix", "part", "p_name", "ILIKE", "%RIN%"),
    ("ilike_underscore", "part", "p_name", "ILIKE", "L_RGE%"),
    ("ilike_nonascii", "documents", "text", "ILIKE", "%ÉÇ%"),
    ("like_document_word", "documents", "text", "LIKE", "%erstthe%"),
]


def _not_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").where_not(like("%a%"), ilike("%RING")).select("p_partkey", "p_name")


def _like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").where_like_any(["old%", None, "%bolt", "la%bolt"], plan="index").select("p_partkey", "p_name")


def _like_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").where_like_all(["%l%", "%a%", "%r%"], plan="index").select("p_partkey", "p_name")


def _parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that comes from a query of its own, as a bound parameter does."""
    pattern = table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return index_of(spark, sf_dir, "part", "p_name").where(like(pattern[:3] + "%"), plan="index").select("p_partkey", "p_name")


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name", predicate="p_size > 10").where(like("la%"), plan="index").select("p_partkey", "p_name")


def _expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name", expression="lower(p_brand)").where(like("brand#1%"), plan="index").select("p_partkey", "p_name")


def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index_of(spark, sf_dir, "customer", "c_name").where(like("%0001_"), plan="index")
    orders = table(spark, sf_dir, "orders")
    return found.join(orders, found.c_custkey == orders.o_custkey).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n_orders"))


def _aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index_of(spark, sf_dir, "part", "p_name").where(like("%ing%"), plan="index")
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))


# Keys, statistics and estimates


def _key_counts(*families: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Equal names have equal keys, so each name is taken apart once.
        names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
        keys = names.select("n", F.explode(value_keys(F.col("p_name"), CROSSED, families)).alias("key"))
        return keys.groupBy(shown_column(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))

    return run


#: With keys across segment borders, and a second segment from the back.
CROSSED = IndexParams(cross_edges=True, reverse_depth=2, rollup=4)


def postings_sql(p: IndexParams, table_: str = "part", key: str = "p_partkey", column: str = "p_name", where: str = "true") -> str:
    """SQL for (rid, key) of all keys of a short text column that holds no ``~``."""
    fwd, rev = "f", "r"
    out = []
    for d, line in (("F", fwd), ("R", rev)):
        limit = p.limit(d)
        at = f"unnest(range(0, least(n + 1, {limit})::BIGINT)) AS u(i)"
        out.append(f"SELECT rid, 'U:{d}:' || (i // {p.k}) || ':' || substr({line}, i + 1, 1) AS key FROM v, {at}")
        out.append(f"SELECT rid, 'P:{d}:' || i || ':' || substr({line}, i + 1, 1) FROM v, {at} WHERE i < {min(p.k, limit)}")
        tag = f"CASE WHEN i // {p.k} = (i + 1) // {p.k} THEN 'T' ELSE 'C' END"
        cross = "true" if p.cross_edges else f"i // {p.k} = (i + 1) // {p.k}"
        out.append(f"SELECT rid, {tag} || ':{d}:' || (i // {p.k}) || ':' || substr({line}, i + 1, 2) FROM v, {at} WHERE i + 1 < least(n + 1, {limit}) AND {cross}")
        out += [f"SELECT rid, 'H:{d}:' || substr({line}, 1, {size}) FROM v WHERE n + 1 >= {size}" for size in range(2, p.anchor_len + 1)]
    out.append(f"SELECT rid, 'U:F:' || (n // {p.k}) || ':~' FROM v WHERE n + 1 > {p.limit('F')}")
    out += [f"SELECT rid, 'G{g}:' || substr(f, i + 1, {g}) FROM v, unnest(range(0, greatest(n + 2 - {g}, 0)::BIGINT)) AS u(i)" for g in range(1, p.rollup + 1)]
    out += [f"SELECT rid, 'S{s}:' || substr(f, i + 1, 1) || substr(f, i + 1 + {s}, 1) FROM v, unnest(range(0, greatest(n + 1 - {s}, 0)::BIGINT)) AS u(i)" for s in range(2, p.skip_depth + 1)]
    if p.composite:
        h, t, hh, tt, size = "left(x, 1)", "right(x, 1)", "left(x, 2)", "right(x, 2)", f"(n // {p.k})"
        out += [f"SELECT rid, 'X.ht:' || {h} || ',' || {t} FROM v WHERE n > 0", f"SELECT rid, 'X.HL:' || {h} || ':' || {size} FROM v WHERE n > 0", f"SELECT rid, 'X.TL:' || {t} || ':' || {size} FROM v WHERE n > 0"]
        out += [f"SELECT rid, 'X.HT:' || {hh} || ',' || {tt} FROM v WHERE n > 1", f"SELECT rid, 'X.Ht:' || {hh} || ',' || {t} FROM v WHERE n > 1", f"SELECT rid, 'X.hT:' || {h} || ',' || {tt} FROM v WHERE n > 1"]
    union = " UNION ".join(out)
    return f"""v AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS rid, lower({column}) AS x, lower({column}) || '~' AS f, reverse(lower({column})) || '~' AS r, length({column}) AS n FROM {table_} WHERE {where}),
k AS (SELECT DISTINCT rid, key FROM ({union}))"""


def _exact_sql(p: IndexParams) -> str:
    starts = ["G3:", "G4:", "H:", "P:F:0:", "P:R:0:"] + (["G2:"] if p.exact_bigrams else [])
    return "(" + " OR ".join(f"starts_with(key, '{s}')" for s in starts) + ")"


def _family_sql() -> str:
    composites = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("X.ht", "X.a"), ("X.HT", "X.b"), ("X.HL", "X.c"), ("X.TL", "X.d"), ("X.Ht", "X.e"), ("X.hT", "X.f")))
    return f"CASE WHEN key[1] IN ('G', 'S') THEN split_part(key, ':', 1) WHEN key[1] = 'X' THEN CASE split_part(key, ':', 1) {composites} END WHEN starts_with(key, 'P:F:0:') THEN 'P:F0' WHEN starts_with(key, 'P:R:0:') THEN 'P:R0' ELSE split_part(key, ':', 1) || ':' || split_part(key, ':', 2) END"


def _key_counts_sql(*families: str) -> str:
    wanted = ", ".join(f"'{f}'" for f in families)
    return f"WITH {postings_sql(CROSSED)} SELECT replace(key, '~', '\\0') AS key, count(*) AS n FROM k WHERE regexp_extract(key, '^[^:.]*') IN ({wanted}) GROUP BY ALL"


def _lists_sql(p: IndexParams) -> str:
    """SQL for the dictionary: key, family, tier, n, bytes, ctype."""
    sizes = " + ".join(f"(d >= {1 << b})::INT" for b in range(7, 63, 7))
    return f"""{postings_sql(p)},
np AS (SELECT ceil(count(*) / {p.rows_per_page}.0)::BIGINT AS npages FROM v),
l AS (SELECT DISTINCT key, {_exact_sql(p)} AS exact, CASE WHEN {_exact_sql(p)} THEN rid ELSE rid // {p.rows_per_page} END AS val FROM k),
s AS (SELECT *, val - coalesce(lag(val) OVER (PARTITION BY key ORDER BY val), -1) AS d FROM l),
g AS (SELECT key, exact, count(*) AS n, sum(1 + {sizes})::BIGINT AS arr FROM s GROUP BY key, exact),
dict AS (SELECT key, {_family_sql()} AS family, CASE WHEN exact THEN 'exact' ELSE 'page' END AS tier, n,
    CASE WHEN NOT exact AND arr > ceil(npages / 8.0) THEN ceil(npages / 8.0)::BIGINT ELSE arr END AS bytes,
    CASE WHEN NOT exact AND arr > ceil(npages / 8.0) THEN 1 ELSE 0 END AS ctype FROM g, np)"""


def _pages_sql(pattern: str, p: IndexParams) -> str:
    """SQL for the candidate rows (``rids``) and pages of a pattern whose keys include one that holds rows."""
    keys = sorted(pattern_keys(pattern, p))
    exact, coarse = [k for k in keys if is_exact(k, p)], [k for k in keys if not is_exact(k, p)]
    names = lambda ks: ", ".join(_text(k.replace(END, "~")) for k in ks) or "NULL"
    page = f"rid // {p.rows_per_page}"
    ok = f"{page} IN (SELECT {page} FROM k WHERE key IN ({names(coarse)}) GROUP BY {page} HAVING count(DISTINCT key) = {len(coarse)})" if coarse else "true"
    rows = f"SELECT rid FROM k WHERE key IN ({names(exact)}) AND {ok} GROUP BY rid HAVING count(*) = {len(exact)}" if exact else f"SELECT rid FROM v WHERE {ok}"
    return f"{postings_sql(p)}, rids AS ({rows})"


GOLDEN = [("hel%", False), ("%lo", False), ("h___o", False), ("%el%", False), ("ab%cd%ef", False), ("HeL%", True), ("", False), ("%", False)]
#: The keys of those patterns.
GOLDEN_KEYS = {
    ("hel%", False): "G3:hel H:F:hel P:F:0:h P:F:1:e P:F:2:l S2:hl T:F:0:el T:F:0:he",
    ("%lo", False): "G3:lo\\0 H:R:ol P:R:0:o P:R:1:l S2:l\\0 T:R:0:ol",
    ("h___o", False): "G1:h G2:o\\0 P:F:0:h P:R:0:o S4:ho T:F:1:o\\0 U:F:1:\\0 U:F:1:o X.HL:h:1 X.TL:o:1 X.ht:h,o",
    ("%el%", False): "G2:el",
    ("ab%cd%ef", False): "G2:ab G2:cd G3:ef\\0 H:F:ab H:R:fe P:F:0:a P:F:1:b P:R:0:f P:R:1:e S2:e\\0 T:F:0:ab T:R:0:fe X.HT:ab,ef X.Ht:ab,f X.hT:a,ef X.ht:a,f",
    ("HeL%", True): "G3:hel H:F:hel P:F:0:h P:F:1:e P:F:2:l S2:hl T:F:0:el T:F:0:he",
    ("", False): "G1:\\0 P:F:0:\\0 P:R:0:\\0",
    ("%", False): "",
}


def _pattern_keys_sql() -> str:
    rows = [f"({_text(p)}, {str(i).lower()}, {_text(k)})" for (p, i), keys in GOLDEN_KEYS.items() for k in keys.split()]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(pattern, is_ilike, key)"


def _udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("glyphlake_nation")
    return spark.sql("SELECT n_nationkey, k.key FROM glyphlake_nation, LATERAL value_keys(n_name, 3, 2, 3, 0, false, false, 0, 0) k")


def _key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").key_stats()


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").keys().select("key", "family", "tier", "n", "bytes", "ctype")


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").info().select("heap_pages", "runs", "keys", "stopped_keys", "pending_records", "k", "cap", "format_version")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").runs().select("run", "run_id", "rows", "keys", "heap_pages")


COUNTED = ("%ing%", "la%anvil", "old%", "%l_r_e%")


def _candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, "part", "p_name")
    found = [index.candidate_pages(p).select(F.lit(p).alias("pattern"), "pages") for p in COUNTED]
    result = found[0]
    for one in found[1:]:
        result = result.unionByName(one)
    return result


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, "part", "p_name")
    rows = [(p, index.estimate_of([like(p)], 1 << 40)) for p in COUNTED]
    return spark.createDataFrame([(p, e.tids, e.lossy_pages, e.exact, e.keys) for p, e in rows], "pattern string, tids double, lossy_pages double, exact boolean, keys int")


def _estimates_sql() -> str:
    parts = []
    for p in COUNTED:
        keys = pattern_keys(p, DEFAULTS)
        coarse = not any(is_exact(k, DEFAULTS) for k in keys)
        rows = f"WITH {_pages_sql(p, DEFAULTS)} SELECT "
        rows += f"0::DOUBLE AS tids, count(DISTINCT rid // {DEFAULTS.rows_per_page})::DOUBLE AS lossy_pages" if coarse else "count(*)::DOUBLE AS tids, 0::DOUBLE AS lossy_pages"
        parts.append(f"SELECT {_text(p)} AS pattern, tids, lossy_pages, true AS exact, {len(keys)} AS keys FROM ({rows} FROM rids)")
    return " UNION ALL ".join(parts)


def _pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name").pattern_stats("la%anvil").select("key", "tier", "runs", "stopped", "entries", "bytes")


def _pattern_stats_sql() -> str:
    keys = ", ".join(_text(k.replace(END, "~")) for k in sorted(pattern_keys("la%anvil", DEFAULTS)))
    return f"WITH {_lists_sql(DEFAULTS)} SELECT replace(key, '~', '\\0') AS key, tier, 1 AS runs, false AS stopped, n AS entries, bytes FROM dict WHERE key IN ({keys})"


# Changes: each query has an index of its own


def _changed(spark: SparkSession, sf_dir: str, **options: object) -> PatternIndex:
    """The part table without every seventh row, with copies of every fifth added under new keys and names."""
    index = fresh(spark, sf_dir, "part", "p_name", **options)
    index.delete("p_partkey % 7 = 0")
    part = table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    index.insert(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000).withColumn("p_name", F.concat(F.col("p_name"), F.lit(" Extra"))))
    return index


CHANGED_SQL = """(SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey + 1000000, p_name || ' Extra' FROM part WHERE p_partkey % 5 = 0)"""


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).where_any(like("la%"), ilike("%EXTRA"), plan="index").select("p_partkey", "p_name")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _changed(spark, sf_dir)
    index.merge_pending()
    return index.where_any(like("la%"), ilike("%EXTRA"), plan="index").select("p_partkey", "p_name")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _changed(spark, sf_dir, exact_bigrams=True)
    index.compact()
    return index.where_any(like("la%"), ilike("%EXTRA"), plan="index").select("p_partkey", "p_name")


def _vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _changed(spark, sf_dir)
    index.vacuum()
    index.recycle()
    return index.where_any(like("la%"), ilike("%EXTRA"), plan="index").select("p_partkey", "p_name")


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh(spark, sf_dir, "part", "p_name", pending_limit=1)
    index.update("p_partkey % 3 = 0", {"p_name": F.concat(F.lit("new "), F.col("p_name"))})
    return index.where(like("new l%"), plan="index").select("p_partkey", "p_name")


def _inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small inserts with a small pending limit: the runs stay few and every row is found."""
    index = fresh(spark, sf_dir, "nation", "n_name", pending_limit=1)
    for i in range(1, 4):
        index.insert(table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 100 * i).withColumn("n_name", F.repeat("n_name", F.lit(8))))
    return index.where(like("%NATION\\_1%"), plan="index").select("n_nationkey", "n_name")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _changed(spark, sf_dir)
    index.merge_pending()
    return spark.createDataFrame([(index.verify(),)], "uncovered long")


def _stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "part", "p_name", stop_threshold=0.5, exact=False).where(like("%a_v%"), plan="index").select("p_partkey", "p_name")


def _coarse_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "documents", "text", exact=False, rollup=2, skip_depth=0).where(ilike("%ÉAU%"), plan="index").select("doc_id", "lang")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from no rows and takes all of them from a stream."""
    part = table(spark, sf_dir, "part")
    index = PatternIndex.create(part.limit(0), new_path(spark, "index-stream"), "p_name", ["p_partkey"])
    stream = spark.readStream.schema(part.schema).option("pathGlobFilter", "part.parquet*").parquet(sf_dir)
    ingest(stream, index, new_path(spark, "stream"), available_now=True).awaitTermination()
    index.merge_pending()
    return index.where(like("%an%"), plan="index").select("p_partkey", "p_name")


QUERIES: dict[str, Query] = {name: _search(t, c, Clause(p, op == "ILIKE")) for name, t, c, op, p in SINGLE} | {
    "like_and": _search("part", "p_name", like("%a%"), like("l%"), like("%g%")),
    "like_ilike_and": _search("part", "p_name", like("l%"), ilike("%RING%")),
    "like_or": _search("part", "p_name", like("old%"), ilike("%BOLT"), any_=True),
    "like_any": _like_any,
    "like_all": _like_all,
    "like_escape_clause": _search("nation", "n_name", like("%!_1%", "!")),
    "like_no_escape": _search("nation", "n_name", like("%N_1", "")),
    "like_null_pattern": _search("part", "p_name", like(None)),
    "like_parameter": _parameter,
    "not_like": _not_like,
    "like_partial_index": _partial,
    "like_expression_index": _expression,
    "like_then_join": _join,
    "like_then_agg": _aggregate,
    "like_stop_keys": _stopped,
    "ilike_page_tier": _coarse_ilike,
    "value_keys_grams": _key_counts("G1", "G2", "G3", "G4"),
    "value_keys_skips": _key_counts("S2", "S3", "S4"),
    "value_keys_positions": _key_counts("U", "P", "T", "C"),
    "value_keys_anchors": _key_counts("H"),
    "value_keys_composites": _key_counts("X"),
    "value_keys_udtf": _udtf,
    "pattern_keys": lambda spark, _: pattern_keys_frame(spark, GOLDEN),
    "key_stats": _key_stats,
    "dictionary": _dictionary,
    "index_info": _info,
    "index_runs": _runs,
    "candidate_pages": _candidate_pages,
    "estimate_exact": _estimates,
    "pattern_stats": _pattern_stats,
    "pending_visible": _pending,
    "after_merge": _merged,
    "after_compact": _compacted,
    "after_vacuum": _vacuumed,
    "after_update": _updated,
    "after_inline_merges": _inline,
    "verify_sound": _verified,
    "stream_ingest": _streamed,
}

_EITHER = "(p_name LIKE 'la%' OR p_name ILIKE '%EXTRA')"
_NATION_KEYS = " UNION ALL ".join(
    f"SELECT n_nationkey, {key} AS key FROM n, unnest(range(0, {stop})) AS u(i)"
    for key, stop in (
        ("'U:F:' || (i // 3) || ':' || replace(substr(f, i + 1, 1), '~', '\\0')", "least(m + 1, 6)"),
        ("'P:F:' || i || ':' || replace(substr(f, i + 1, 1), '~', '\\0')", "least(m + 1, 3)"),
        ("CASE WHEN i % 3 < 2 THEN 'T:F:' || (i // 3) || ':' || replace(substr(f, i + 1, 2), '~', '\\0') END", "least(m, 5)"),
        ("CASE WHEN m + 1 > 6 THEN 'U:F:' || (m // 3) || ':\\0' END", "1"),
        ("'G1:' || replace(substr(f, i + 1, 1), '~', '\\0')", "m + 1"),
        ("'G2:' || replace(substr(f, i + 1, 2), '~', '\\0')", "m"),
        ("'G3:' || replace(substr(f, i + 1, 3), '~', '\\0')", "m - 1"),
    )
)

ORACLE_SQL: dict[str, str] = {name: _select(t, _like(c, p, op)) for name, t, c, op, p in SINGLE} | {
    "like_and": _select("part", "p_name LIKE '%a%' AND p_name LIKE 'l%' AND p_name LIKE '%g%'"),
    "like_ilike_and": _select("part", "p_name LIKE 'l%' AND p_name ILIKE '%RING%'"),
    "like_or": _select("part", "p_name LIKE 'old%' OR p_name ILIKE '%BOLT'"),
    "like_any": _select("part", "p_name LIKE 'old%' OR p_name LIKE '%bolt' OR p_name LIKE 'la%bolt'"),
    "like_all": _select("part", "p_name LIKE '%l%' AND p_name LIKE '%a%' AND p_name LIKE '%r%'"),
    "like_escape_clause": _select("nation", "n_name LIKE '%!_1%' ESCAPE '!'"),
    "like_no_escape": _select("nation", "n_name LIKE '%N_1'"),
    "like_null_pattern": _select("part", "p_name LIKE NULL"),
    "like_parameter": _select("part", "p_name LIKE (SELECT left(min(p_name), 3) || '%' FROM part)"),
    "not_like": _select("part", "p_name NOT LIKE '%a%' AND p_name NOT ILIKE '%RING'"),
    "like_partial_index": _select("part", "p_size > 10 AND p_name LIKE 'la%'"),
    "like_expression_index": _select("part", "lower(p_brand) LIKE 'brand#1%'"),
    "like_then_join": "SELECT c_custkey, c_name, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_name LIKE '%0001_' GROUP BY ALL",
    "like_then_agg": "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part WHERE p_name LIKE '%ing%' GROUP BY ALL",
    "like_stop_keys": _select("part", "p_name LIKE '%a_v%'"),
    "ilike_page_tier": _select("documents", "text ILIKE '%ÉAU%'"),
    "value_keys_grams": _key_counts_sql("G1", "G2", "G3", "G4"),
    "value_keys_skips": _key_counts_sql("S2", "S3", "S4"),
    "value_keys_positions": _key_counts_sql("U", "P", "T", "C"),
    "value_keys_anchors": _key_counts_sql("H"),
    "value_keys_composites": _key_counts_sql("X"),
    "value_keys_udtf": f"WITH n AS (SELECT n_nationkey, lower(n_name) || '~' AS f, length(n_name) AS m FROM nation) SELECT DISTINCT n_nationkey, key FROM ({_NATION_KEYS}) WHERE key IS NOT NULL",
    "pattern_keys": _pattern_keys_sql(),
    "key_stats": f"""WITH {_lists_sql(DEFAULTS)} SELECT family, tier, count(*) AS keys, count(*) FILTER (ctype = 0) AS array_lists,
count(*) FILTER (ctype = 1) AS bitmap_lists, 0::BIGINT AS stop_keys, sum(bytes + strlen(replace(key, '~', chr(65535))) + 6)::BIGINT AS bytes FROM dict GROUP BY ALL""",
    "dictionary": f"WITH {_lists_sql(DEFAULTS)} SELECT replace(key, '~', '\\0') AS key, family, tier, n, bytes, ctype FROM dict",
    "index_info": f"WITH {_lists_sql(DEFAULTS)} SELECT npages AS heap_pages, 1 AS runs, (SELECT count(*) FROM dict) AS keys, 0::BIGINT AS stopped_keys, 0::BIGINT AS pending_records, 3 AS k, 2 AS cap, 1 AS format_version FROM np",
    "index_runs": f"WITH {_lists_sql(DEFAULTS)} SELECT 1 AS run, 1::BIGINT AS run_id, (SELECT count(*) FROM v) AS rows, (SELECT count(*) FROM dict) AS keys, npages AS heap_pages FROM np",
    "candidate_pages": " UNION ALL ".join(f"SELECT {_text(p)} AS pattern, pages FROM (WITH {_pages_sql(p, DEFAULTS)} SELECT count(DISTINCT rid // {DEFAULTS.rows_per_page}) AS pages FROM rids)" for p in COUNTED),
    "estimate_exact": _estimates_sql(),
    "pattern_stats": _pattern_stats_sql(),
    "pending_visible": f"SELECT * FROM {CHANGED_SQL} WHERE {_EITHER}",
    "after_merge": f"SELECT * FROM {CHANGED_SQL} WHERE {_EITHER}",
    "after_compact": f"SELECT * FROM {CHANGED_SQL} WHERE {_EITHER}",
    "after_vacuum": f"SELECT * FROM {CHANGED_SQL} WHERE {_EITHER}",
    "after_update": "SELECT p_partkey, 'new ' || p_name AS p_name FROM part WHERE p_partkey % 3 = 0 AND p_name LIKE 'l%'",
    "after_inline_merges": "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%NATION\\_1%' ESCAPE '\\' UNION ALL SELECT n_nationkey + 100 * i, repeat(n_name, 8) FROM nation, unnest([1, 2, 3]) u(i) WHERE n_name LIKE '%NATION\\_1%' ESCAPE '\\'",
    "verify_sound": "SELECT 0::BIGINT AS uncovered",
    "stream_ingest": _select("part", "p_name LIKE '%an%'"),
}
