"""URL filters: host-suffix and path-prefix expressions, matched by hash.

Each URL is expanded into the host and its suffixes, times the path with its query, the path and
its leading folders: suffixes and folders as deep as any rule goes, which is computed from the rules, so
no rule is too deep to match, and a long URL has no more expressions than the rules can meet.
Expressions meet the rules on 4 bytes of their SHA-256 in an equi-join; the full
digest then confirms the match. Of several rules that match, the highest priority
decides, then the longest expression, then ``allow`` before ``block``, then the
smallest rule id. Distinct URLs are decided once, and every row gets its URL's decision.

The rules are broadcast while they are below ``BROADCAST_RULES`` rows (counted);
beyond it the join shuffles both sides on the hash prefix.

Defined results: a null URL, or one without a host, matches no rule and gets action
``none``. Repeated rows all stay. A rule whose expression, action or id is null is
left out; a null priority counts as 0; of repeated rules one has effect. Empty tables
give empty results. A very long URL is read whole. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
HASH_CHARS = 8
RULES = [
    (1, "example.net/", "block", 10),
    (2, "example.net/en/", "allow", 10),
    (3, "example.com/fr/", "block", 5),
    (4, "m.ththth.example.net/", "block", 20),
    (5, "example.org/de/", "block", 5),
    (6, "example.org/", "allow", 1),
    (7, "thther.example.org/", "block", 10),
    (8, "example.com/", "allow", 0),
    (9, "example.com/es/", "block", 5),
    (10, "example.com/fr/825", "allow", 5),
    (11, "ththre.example.com/", "block", 5),
]
RULE_SCHEMA = "rule_id bigint, expression string, action string, priority int"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower case, without user, port and final dots), path and query."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    found = F.regexp_extract(bare, "^//([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(found), "^.*@", ""), ":[0-9]*$", ""), "^[.]+|[.]+$", "")
    rest = F.regexp_replace(bare, "^//[^/?]*", "")
    path = F.regexp_extract(rest, "^([^?]*)", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/")
    return host, path, F.regexp_extract(rest, "([?].*)$", 1)


def expressions(url: Column, labels_deep: int, folders_deep: int) -> Column:
    """Array of the URL's expressions, with suffixes of at most so many labels and so many folders (the root is one); empty without a host."""
    host, path, query = _parts(url)
    labels = F.split(host, "[.]")
    n = F.size(labels)
    suffixes = F.when(host.rlike("^[0-9]+([.][0-9]+){3}$") | (n < 3) | F.lit(labels_deep < 2), F.array(host)).otherwise(
        F.array_distinct(F.concat(F.array(host), F.transform(F.sequence(F.greatest(n - (labels_deep - 1), F.lit(2)), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))))
    )
    folders = F.split(path, "/")
    depth = F.least(F.size(folders) - 1, F.lit(max(1, folders_deep)))
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(folders, 1, i), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(F.array(F.concat(path, query), path), prefixes))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    )


def _depths(expression: Column) -> tuple[Column, Column]:
    """Labels of an expression's host, and slashes of its path."""
    return F.size(F.split(F.split(expression, "/")[0], "[.]")), F.size(F.split(expression, "/")) - 1


def decide(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``(page_id, url, action, rule_id, expression)`` for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    known = (
        rules.where("rule_id IS NOT NULL AND expression IS NOT NULL AND action IS NOT NULL")
        .select("rule_id", "expression", "action", F.coalesce("priority", F.lit(0)).alias("priority"), F.sha2("expression", 256).alias("digest"))
        .withColumn("start", F.substring("digest", 1, HASH_CHARS))
    )
    deep = known.agg(F.count("*"), *(F.coalesce(F.max(x), F.lit(0)) for x in _depths(F.col("expression")))).first()
    if deep[0] <= broadcast_rules:
        known = F.broadcast(known)
    asked = rows.where("url IS NOT NULL").select("url").distinct().select("url", F.explode(expressions(F.col("url"), deep[1], deep[2])).alias("asked"))
    asked = asked.withColumn("full", F.sha2("asked", 256)).withColumn("start", F.substring("full", 1, HASH_CHARS))
    hits = asked.join(known, "start").where("full = digest AND asked = expression")
    order = F.struct("priority", F.length("expression").alias("size"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("mild"), (-F.col("rule_id")).alias("back"))
    verdicts = hits.groupBy("url").agg(F.max_by(F.struct("rule_id", "action", "expression"), order).alias("v"))
    return rows.join(verdicts.select(F.col("url").alias("known_url"), "v"), F.col("url") == F.col("known_url"), "left").select(
        "page_id", "url", F.coalesce("v.action", F.lit("none")).alias("action"), F.col("v.rule_id").alias("rule_id"), F.col("v.expression").alias("expression")
    )


_LABELS, _FOLDERS = max(e.split("/")[0].count(".") + 1 for _, e, _, _ in RULES), max(e.count("/") for _, e, _, _ in RULES)
ORACLE_SQL = f"""
WITH rules(rule_id, expression, action, priority) AS (VALUES {", ".join(f"({a}::BIGINT, '{b}', '{c}', {d})" for a, b, c, d in RULES)}),
u AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS bare FROM pages WHERE url IS NOT NULL),
p AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^//([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^[.]+|[.]+$', '', 'g') AS host,
  regexp_replace(bare, '^//[^/?]*', '') AS rest FROM u),
q AS (SELECT url, host, regexp_replace(CASE WHEN split_part(rest, '?', 1) = '' THEN '/' ELSE split_part(rest, '?', 1) END, '/{{2,}}', '/', 'g') AS path, regexp_extract(rest, '[?].*$') AS query FROM p WHERE host <> ''),
h AS (SELECT url, unnest(list_distinct(list_concat([host], CASE WHEN regexp_full_match(host, '[0-9]+([.][0-9]+){{3}}') OR len(string_split(host, '.')) < 3 THEN []
    ELSE list_transform(range(greatest(len(string_split(host, '.')) - {_LABELS - 1}, 2), len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END))) AS suffix FROM q),
f AS (SELECT url, unnest(list_distinct(list_concat([path || query, path], list_transform(range(1, least(len(string_split(path, '/')) - 1, {_FOLDERS}) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/') || '/')))) AS prefix FROM q),
m AS (SELECT DISTINCT h.url, r.* FROM h JOIN f ON h.url = f.url JOIN rules r ON r.expression = h.suffix || f.prefix),
best AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority DESC, length(expression) DESC, (action = 'allow') DESC, rule_id) AS n FROM m)
SELECT p.page_id, p.url, coalesce(b.action, 'none') AS action, b.rule_id, b.expression FROM pages p LEFT JOIN best b ON b.url = p.url AND b.n = 1
"""
