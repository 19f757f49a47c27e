"""URL filters: host and path rules, and a path-template tree per host, with DataFrame functions only.

Rules decide first: a rule (action, host, path) fits a url on its host or a subdomain whose path starts
with the rule's; the longest wins. What no rule fits is judged by the method:

1. Per host, each path segment is generalised: one with a digit becomes ``*`` with its extension, and,
   level by level, a literal that is rare becomes ``*`` too (``LEVELS`` levels; deeper segments together
   are ``**``). One stays that has ``SUPPORT`` rows, or a share of its siblings' rows, or labels unlike
   theirs, so a section keeps its own labels however many siblings it has.
2. Statistically similar branches (first segments) of a host are merged: those whose commonest template
   is the same and whose smoothed share of blocked labels does not differ significantly from the pooled.
   A branch without labels shows no likeness and is never merged.
3. A template is rejected if its branch has labels and its share of blocked ones, smoothed towards its
   branch's and that towards the whole table's, reaches ``PURITY``.

The labels are the verdicts of the rules unless a column of labels is given (1: block, 0: allow).

Urls are counted by (host, generalised path) before anything is shuffled, so a host that holds a third
of all rows is a few rows in the tree; the rows meet their template in a join over written tables.

Cases: a null url or one without ``://`` has an empty host and path; no rule fits it, and it is judged
as the template of empty segments of the empty host. Rows are judged one by one, so repeated rows and
null ids get answers too. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.llm.shared import written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: More rules than this are refused: each is a branch of one expression.
MOST_RULES = 1000
LEVELS = 3
#: A literal segment stays if at least so many rows, and so large a share of its parent's, have it.
LEAST_ROWS, LEAST_SHARE = 3, 0.02
#: So many rows keep a literal whatever its share, as do labels that differ significantly from its parent's.
SUPPORT = 100
#: Rows that the smoothing counts as seen, the significance of a difference, and the share that rejects.
PRIOR, SIGNIFICANT, PURITY = 10.0, 1.96, 0.8


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_length(rules: tuple[tuple[str, str, str], ...]) -> list[tuple[str, str, str]]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; both null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in reversed(_by_length(rules)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text, action = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, what).otherwise(action)
    return text, action


def _rate(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + F.lit(PRIOR) * towards) / (labelled + F.lit(PRIOR))


def _unlike(b: str, l: str, pb: str, pl: str, base: Column) -> Column:  # noqa: E741
    """The smoothed share of blocked labels, b of l, differs significantly from the pooled, pb of pl."""
    r, p = _rate(F.col(b), F.col(l), base), _rate(F.col(pb), F.col(pl), base)
    spread = F.sqrt(r * (F.lit(1.0) - r) / (F.col(l) + F.lit(PRIOR)) + p * (F.lit(1.0) - p) / (F.col(pl) + F.lit(PRIOR)))
    return F.abs(r - p) > F.lit(SIGNIFICANT) * spread


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[tuple[str, str, str], ...] = RULES, label: str | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), (F.col(label) if label else F.lit(None)).cast("int").alias("given"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "given")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    marked = F.col("given") if label else F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    segments = F.split("path", "/", -1)
    for i in range(1, LEVELS + 1):
        own = F.coalesce(F.get(segments, F.lit(i)), F.lit(""))
        general = F.when(own.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(own, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(own)
        rows = rows.withColumn(f"s{i}", general)
    rows = rows.withColumn("deep", F.when(F.size(segments) > LEVELS + 1, "**").otherwise("")).withColumn("label", marked)
    shape = ["host", *(f"s{i}" for i in range(1, LEVELS + 1)), "deep"]

    tree = rows.groupBy(*shape).agg(F.count("*").alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    tree = written(tree, "url-shapes")
    whole = tree.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    base = F.lit(((whole["b"] or 0) + 1.0) / ((whole["l"] or 0) + 2.0))
    kept = ["host"]
    for i in range(1, LEVELS + 1):
        child = tree.groupBy(*kept, f"s{i}").agg(F.sum("n").alias("c"), F.sum("l").alias("l"), F.sum("b").alias("b"))
        total = child.groupBy(*kept).agg(F.sum("c").alias("total"), F.sum("l").alias("tl"), F.sum("b").alias("tb"))
        enough = (F.col("c") >= SUPPORT) | (F.col("c") >= F.col("total") * F.lit(LEAST_SHARE)) | _unlike("b", "l", "tb", "tl", base)
        stay = child.where(F.col("c") >= LEAST_ROWS).join(total, kept).where(enough)
        stay = written(stay.select(*kept, f"s{i}", F.lit(True).alias("stays")), f"url-level-{i}")
        tree = tree.join(stay, [*kept, f"s{i}"], "left")
        literal = (F.col(f"s{i}") == "") | F.col(f"s{i}").startswith("*") | F.col("stays").isNotNull()
        tree = written(tree.withColumn(f"g{i}", F.when(literal, F.col(f"s{i}")).otherwise("*")).drop("stays"), f"url-tree-{i}")
        kept.append(f"g{i}")
    rest = F.concat_ws("/", *(f"g{i}" for i in range(2, LEVELS + 1)), "deep")
    tree = tree.withColumn("rest", rest)

    # From here on: one row per host and template.
    child = written(tree.groupBy("host", "g1", "rest").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b")), "url-templates")
    branch = child.groupBy("host", "g1").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.max(F.struct("n", "rest"))["rest"].alias("common"))
    alike = Window.partitionBy("host", "common")
    branch = branch.withColumn("pl", F.sum("l").over(alike)).withColumn("pb", F.sum("b").over(alike))
    merged = (F.col("l") > 0) & ~_unlike("b", "l", "pb", "pl", base)  # a branch without labels is like no other
    branch = branch.select("host", "g1", F.when(merged, F.concat(F.lit("{"), "common", F.lit("}"))).otherwise(F.col("g1")).alias("m1"))
    top, leaf = Window.partitionBy("host", "m1"), Window.partitionBy("host", "m1", "rest")
    own = _rate(F.sum("b").over(leaf), F.sum("l").over(leaf), _rate(F.sum("b").over(top), F.sum("l").over(top), base))
    said = F.when((own >= PURITY) & (F.sum("l").over(top) > 0), "block").otherwise("allow").alias("said")
    judged = child.join(branch, ["host", "g1"]).select("host", "g1", "rest", F.concat_ws("/", F.lit(""), "m1", "rest").alias("template"), said)
    judged = written(judged, "url-judged")
    judged = written(tree.join(judged, ["host", "g1", "rest"]).select(*shape, "template", "said"), "url-answers")
    rows = rows.drop("label", "given").join(judged, shape)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", "said").alias("verdict"), "template")


def judge_sql(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""
    fits = [(what, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p) for what, h, p in _by_length(rules)]
    rule = "CASE " + " ".join(f"WHEN {cond} THEN '{text}'" for _, cond, text in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {cond} THEN '{what}'" for what, cond, _ in fits) + " END"
    levels = range(1, LEVELS + 1)
    seg = lambda i: f"coalesce(string_split(path, '/')[{i + 1}], '')"
    general = ", ".join(f"CASE WHEN regexp_matches({seg(i)}, '[0-9]') THEN '*' || regexp_extract({seg(i)}, '(\\.[A-Za-z]{{1,5}})$', 1) ELSE {seg(i)} END AS s{i}" for i in levels)
    shape = ", ".join(["host", *(f"s{i}" for i in levels), "deep"])
    steps, kept = [], ["host"]
    for i in levels:
        steps.append(
            f"t{i} AS (SELECT *, CASE WHEN s{i} = '' OR starts_with(s{i}, '*') OR (sum(n) OVER (PARTITION BY {', '.join(kept)}, s{i}) >= {LEAST_ROWS} AND "
            f"sum(n) OVER (PARTITION BY {', '.join(kept)}, s{i})::DOUBLE >= sum(n) OVER (PARTITION BY {', '.join(kept)})::DOUBLE * {LEAST_SHARE}::DOUBLE) THEN s{i} ELSE '*' END AS g{i} FROM t{i - 1})"
        )
        kept.append(f"g{i}")
    rest = " || '/' || ".join([*(f"g{i}" for i in levels if i > 1), "deep"])
    rate = lambda b, n, to: f"(({b})::DOUBLE + {PRIOR}::DOUBLE * {to}) / (({n})::DOUBLE + {PRIOR}::DOUBLE)"
    var = lambda r, n: f"{r} * (1.0::DOUBLE - {r}) / ({n}::DOUBLE + {PRIOR}::DOUBLE)"
    return f"""
WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {action} AS action, {general}, CASE WHEN len(string_split(path, '/')) > {LEVELS + 1} THEN '**' ELSE '' END AS deep FROM h),
t0 AS (SELECT {shape}, count(*) AS n, count(action) AS l, count(*) FILTER (action = 'block') AS b FROM r GROUP BY ALL),
{", ".join(steps)},
t AS (SELECT *, {rest} AS rest FROM t{LEVELS}),
base AS (SELECT (coalesce(sum(b), 0)::DOUBLE + 1.0) / (coalesce(sum(l), 0)::DOUBLE + 2.0) AS p0 FROM t),
c AS (SELECT host, g1, rest, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM t GROUP BY ALL),
g AS (SELECT host, g1, sum(l) AS l, sum(b) AS b, max({{'n': n, 'rest': rest}}).rest AS common FROM c GROUP BY host, g1),
g2 AS (SELECT *, sum(l) OVER w AS pl, sum(b) OVER w AS pb FROM g WINDOW w AS (PARTITION BY host, common)),
g3 AS (SELECT *, {rate("b", "l", "p0")} AS r, {rate("pb", "pl", "p0")} AS p FROM g2, base),
g4 AS (SELECT host, g1, CASE WHEN l > 0 AND abs(r - p) <= {SIGNIFICANT}::DOUBLE * sqrt({var("r", "l")} + {var("p", "pl")}) THEN '{{' || common || '}}' ELSE g1 END AS m1 FROM g3),
j AS (SELECT t.*, m1, p0, sum(b) OVER (PARTITION BY host, m1) AS tb, sum(l) OVER (PARTITION BY host, m1) AS tl,
    sum(b) OVER (PARTITION BY host, m1, rest) AS lb, sum(l) OVER (PARTITION BY host, m1, rest) AS ll FROM t JOIN g4 USING (host, g1), base),
k AS (SELECT {shape}, '/' || m1 || '/' || rest AS template, CASE WHEN tl > 0 AND {rate("lb", "ll", rate("tb", "tl", "p0"))} >= {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END AS said FROM j)
SELECT page_id, host, path, rule, coalesce(action, said) AS verdict, template FROM r JOIN k USING ({shape})
"""
