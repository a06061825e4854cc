"""Queries over the bound tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.extract import extracts
from relgraph.functions import text as tx
from relgraph.functions import weights as wt
from relgraph.operators import graph, propagate, resolve, retrieve, scoring, slicing, sync
from relgraph.plans import bindings as b
from relgraph.storage import cut, table

QUESTIONS = [(1, "where is the blue gear of Brand 12"), (2, "trace every cold anvil supplier"), (3, "test the hot widget"), (4, "zebra quantum"), (5, "economy parts")]
TEXT_QUERY = "which LargeScale text about trash and the Licensed Apache code should I read"
CUTOFF = 0.066


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL of the bindings and functions

_FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text, strlen(text)::BIGINT AS size FROM documents)"
_PAGES = "modules AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, html FROM pages)"
_PART = "'parts/' || lpad(p_partkey::VARCHAR, 8, '0') || '_' || replace(p_name, ' ', '_')"
_SUPPLIER = "'suppliers/' || lpad(s_suppkey::VARCHAR, 8, '0')"
_NODES = f"""nodes AS (SELECT {_PART} AS path, [p_brand] AS symbols, p_type AS description, 'part' AS file_type, (p_size * 100)::BIGINT AS size, false AS always_include FROM part
 UNION ALL SELECT {_SUPPLIER}, []::VARCHAR[], s_name, 'supplier', floor(abs(s_acctbal))::BIGINT, s_acctbal > 9000 FROM supplier)"""
_RELS = f"""links AS (SELECT {_PART} AS src, {_SUPPLIER} AS dst, 1 AS symbols, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS usage, l_returnflag = 'R' AS inherits, l_discount > 0.09 AS reexports, s_acctbal > 9000 AS to_config, l_linestatus = 'F' AS exact
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
rels AS (SELECT src, dst, count(*) AS import_count, sum(symbols)::INT AS symbol_count, sum(usage)::INT AS usage, bool_or(inherits) AS inherits, bool_or(reexports) AS reexports, bool_or(to_config) AS to_config, bool_and(exact) AS exact FROM links WHERE src <> dst GROUP BY 1, 2)"""


def _weight_sql(symbols: str, usage: str, inherits: str, reexports: str, config: str) -> str:
    score = f"(3.0::DOUBLE + CASE WHEN {inherits} THEN 4 ELSE 0 END + CASE WHEN {symbols} >= 1 THEN 1 ELSE 0 END + CASE WHEN {symbols} > 1 THEN least(2.0::DOUBLE, 0.5::DOUBLE * ({symbols} - 1)) ELSE 0 END + CASE WHEN {usage} >= 1 THEN least(2.5::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * ({usage} - 1)) ELSE 0 END + CASE WHEN {reexports} THEN 1 ELSE 0 END)"
    return f"greatest(1, least(10, round_even(CASE WHEN {config} THEN least({score}, 6.0) ELSE {score} END, 0)::INT))"


_EDGES = f"""edges AS (SELECT src, dst, {_weight_sql("symbol_count", "usage", "inherits", "reexports", "to_config")} AS weight,
  list_filter([CASE WHEN inherits THEN 'inherits' END, CASE WHEN usage > 0 THEN 'calls' END, CASE WHEN reexports THEN 'reexports' END, CASE WHEN to_config THEN 'config' END, 'imports'], lambda x: x IS NOT NULL) AS relations,
  CASE WHEN exact THEN 'extracted' ELSE 'inferred' END AS confidence, symbol_count, usage FROM rels)"""
_GRAPH = f"{_NODES}, {_RELS}, {_EDGES}"


_PIECES = "[A-Z]?[0-9a-z]+|[A-Z]+"


def _terms_sql(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda r: list_concat([lower(r)], list_transform(regexp_extract_all(regexp_replace(r, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '{_PIECES}'), lambda p: lower(p)))))"


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _query_terms_sql(x: str) -> str:
    every = f"list_distinct({_terms_sql(x)})"
    return f"CASE WHEN len(list_filter({every}, lambda t: NOT list_contains({_STOP}, t))) = 0 THEN {every} ELSE list_filter({every}, lambda t: NOT list_contains({_STOP}, t)) END"


_ASKED = "queries(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + f"), asked AS (SELECT query_id, unnest({_query_terms_sql('query')}) AS term FROM queries)"
_SCORES = f"""fields AS (SELECT path, 'filename' AS field, 3.0 AS fw, path AS value FROM nodes UNION ALL SELECT path, 'symbols', 2.0, array_to_string(symbols, ' ') FROM nodes UNION ALL SELECT path, 'description', 1.0, description FROM nodes UNION ALL SELECT path, 'type', 1.0, file_type FROM nodes),
node_terms AS (SELECT path, field, any_value(fw) AS fw, term, count(*) AS tf FROM (SELECT path, field, fw, unnest({_terms_sql("value")}) AS term FROM fields) GROUP BY path, field, term),
term_df AS (SELECT term, count(DISTINCT path) AS df FROM node_terms GROUP BY term),
weighed AS (SELECT a.query_id, a.term, ln(1 + (SELECT greatest(1, count(*)) FROM nodes) / (1 + coalesce(d.df, 0))) AS idf FROM asked a LEFT JOIN term_df d USING (term)),
parts_ AS (SELECT query_id, path, field, w.term, fw * tf * idf AS part FROM node_terms n JOIN weighed w ON n.term = w.term
 UNION ALL SELECT DISTINCT query_id, path, 'partial', w.term, 1.2 * idf FROM node_terms n JOIN weighed w ON n.field = 'filename' AND contains(n.term, w.term)
  WHERE NOT EXISTS (SELECT 1 FROM node_terms m WHERE m.path = n.path AND m.field = 'filename' AND m.term = w.term)),
summed AS (SELECT query_id, path, round(sum(part), 9) AS score FROM parts_ GROUP BY 1, 2),
scores AS (SELECT query_id, path, CASE WHEN n.file_type = 'test' AND NOT contains(lower(q.query), 'test') AND NOT contains(lower(q.query), 'spec') THEN round(score * 0.3, 9) ELSE score END AS score FROM summed JOIN nodes n USING (path) JOIN queries q USING (query_id) WHERE score > 0)"""
_SEEDS = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS seed_rank FROM scores), seeds AS (SELECT query_id, path, score / max(score) OVER (PARTITION BY query_id) AS relevance, seed_rank::INT AS seed_rank FROM top WHERE seed_rank <= 10)"
_ROUNDS = 9


def _spread_sql(cutoff: str) -> str:
    out = "adj AS MATERIALIZED (SELECT a, b, max(least(0.95::DOUBLE, weight / 10.0::DOUBLE)) AS factor FROM (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1, 2), best0 AS MATERIALIZED (SELECT query_id, path, relevance FROM seeds)"
    for i in range(_ROUNDS):
        out += f", best{i + 1} AS MATERIALIZED (SELECT query_id, path, max(relevance) AS relevance FROM (SELECT * FROM best{i} UNION ALL SELECT query_id, b, relevance * factor FROM best{i} JOIN adj ON path = a WHERE relevance * factor >= {cutoff}) GROUP BY 1, 2)"
    return out + f", best AS (SELECT * FROM best{_ROUNDS})"


_CUTOFF_SQL = "(SELECT CASE WHEN count(*) <= 200 THEN 0.12::DOUBLE ELSE least(0.28::DOUBLE, 0.12::DOUBLE + 0.035::DOUBLE * log2(count(*) / 200.0::DOUBLE)) END FROM nodes) * 0.55::DOUBLE"
_REASONS = """came AS (SELECT e.*, m.relevance AS came, b.relevance AS got, b.query_id, row_number() OVER (PARTITION BY b.query_id, b.path ORDER BY m.relevance DESC, e.a, e.direction DESC) AS n
 FROM best b JOIN (SELECT src AS a, dst AS path, 'out' AS direction, weight, relations FROM edges UNION ALL SELECT dst, src, 'in', weight, relations FROM edges) e USING (path) JOIN best m ON m.query_id = b.query_id AND m.path = e.a
 WHERE abs(m.relevance * least(0.95::DOUBLE, weight / 10.0::DOUBLE) - b.relevance) <= 1e-9),
told AS (SELECT b.query_id, b.path, b.relevance, s.seed_rank, CASE WHEN b.relevance <= s.relevance + 1e-9 THEN 'direct metadata match' ELSE 'linked ' || CASE WHEN c.direction = 'out' THEN '→' ELSE '←' END || ' ' || c.a || ' (w=' || c.weight || ', ' || array_to_string(c.relations, ',') || ')' END AS reason
 FROM best b LEFT JOIN seeds s USING (query_id, path) LEFT JOIN came c ON c.query_id = b.query_id AND c.path = b.path AND c.n = 1)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, seed_rank ASC NULLS LAST, path) AS rank FROM told), drops AS (SELECT *, relevance < 0.6::DOUBLE * lag(relevance) OVER (PARTITION BY query_id ORDER BY rank) AS fell FROM ranked)"
_BROAD = " OR ".join(f"contains(lower(query), '{k}')" for k in tx.BROAD)
_COUNTS = f"""knees AS (SELECT query_id, coalesce(min(CASE WHEN fell THEN rank - 1 END), count(*))::INT AS knee, count(*) FILTER (relevance >= 0.15)::INT AS qualified, count(seed_rank) AS seeds FROM drops GROUP BY 1),
counts AS (SELECT query_id, knee, qualified, least(CASE WHEN {_BROAD} OR seeds >= 8 THEN least(greatest(2, knee) + 3, 8) ELSE greatest(2, knee) END, greatest(2, qualified), 15)::INT AS files FROM knees JOIN queries USING (query_id))"""
_CHOSEN = """chosen AS (SELECT r.*, c.files FROM ranked r JOIN counts c USING (query_id) WHERE rank <= files),
near AS (SELECT c.query_id, e.b AS path, min(c.rank * 2 + CASE WHEN direction = 'out' THEN 0 ELSE 1 END) AS f FROM chosen c JOIN (SELECT src AS a, dst AS b, 'out' AS direction FROM edges UNION ALL SELECT dst, src, 'in' FROM edges) e ON e.a = c.path
 JOIN nodes n ON n.path = e.b AND n.always_include WHERE NOT EXISTS (SELECT 1 FROM chosen k WHERE k.query_id = c.query_id AND k.path = e.b) GROUP BY 1, 2),
extra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, path) AS n FROM near)"""
_RETRIEVE = f"WITH {_GRAPH}, {_ASKED}, {_SCORES}, {_SEEDS}, {_spread_sql(_CUTOFF_SQL)}, {_REASONS}, {_RANKED}, {_COUNTS}, {_CHOSEN}"
_SELECTED = """picked AS (SELECT query_id, path, relevance, reason, rank FROM chosen UNION ALL SELECT x.query_id, x.path, coalesce(t.relevance, 0), coalesce(t.reason, 'cross-cutting config (always included)'), c.files + x.n FROM extra x JOIN counts c USING (query_id) LEFT JOIN told t ON t.query_id = x.query_id AND t.path = x.path WHERE x.n <= 3),
selected AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS position, p.path, round(relevance, 3) AS score, CASE WHEN greatest(1, n.size // 4) > 800 THEN reason || '  ⚠ large file (~' || format('{:,}', greatest(1, n.size // 4)) || ' tok) — search within it rather than reading in full' ELSE reason END AS reason, n.file_type, n.description, greatest(1, n.size // 4)::BIGINT AS tokens FROM picked p JOIN nodes n USING (path))"""


# Files and text


@query(f"WITH {_FILES} SELECT 'doc' AS language, count(*) AS files, sum(size) AS bytes FROM files")
def scan_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the language of their extension."""
    return b.files(spark, sf_dir).groupBy(tx.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that more than one file has."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("WITH e AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE lang = 'en'), f AS (SELECT lang, sha256(text) AS sha FROM documents) SELECT lang, count(*) FILTER (e.sha IS NOT NULL) AS hits, count(*) FILTER (e.sha IS NULL) AS misses FROM f LEFT JOIN e USING (sha) GROUP BY lang")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content has been extracted before (here: that of English files) or not."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha256"))
    hits, misses = sync.cached_extracts(d, d.where("lang = 'en'").select("sha256"))
    both = hits.select("lang", F.lit(1).alias("hit")).unionByName(misses.select("lang", F.lit(0).alias("hit")))
    return both.groupBy("lang").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def _role_sql(path: str) -> str:
    low, name = f"lower({path})", f"regexp_extract(lower({path}), '[^/]*$')"
    ext = f"regexp_extract({name}, '\\.([^.]*)$', 1)"
    cases = [f"starts_with({name}, '.env') OR {ext} IN ({', '.join(repr(e) for e in tx.CONFIG_EXTENSIONS)}) OR regexp_matches({name}, 'config|settings|constants|env|secrets|credentials')", f"regexp_matches({name}, '^test_|_test\\.py$|\\.test\\.|\\.spec\\.') OR regexp_matches('/' || {low}, '/tests/|/__tests__/')"]
    labels = ["config", "test"]
    for label, markers in tx.MARKERS:
        cases.append(" OR ".join(f"contains({name}, '{m}') OR contains('/' || {low}, '/{m}') OR contains({low}, '{m}s/')" for m in markers.split(",")))
        labels.append(label)
    cases += [f"{name} IN ({', '.join(repr(e) for e in tx.ENTRYPOINTS)})", f"{ext} IN ('md', 'rst', 'txt')"]
    labels += ["entrypoint", "doc"]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in zip(cases, labels, strict=True)) + " ELSE 'other' END"


@query(f"WITH {_FILES}, {_PAGES}, p AS (SELECT path FROM files UNION ALL SELECT path FROM modules UNION ALL SELECT 'src/' || p_name || '/' || p_type || '_' || replace(lower(p_brand), 'brand#1', 'test_') || '.py' FROM part), r AS (SELECT {_role_sql('path')} AS file_type FROM p) SELECT file_type, count(*) AS files FROM r GROUP BY 1")
def classify_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of document, page and part paths."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_name", F.lit("/"), "p_type", F.lit("_"), F.replace(F.lower("p_brand"), F.lit("brand#1"), F.lit("test_")), F.lit(".py")).alias("path"))
    paths = b.files(spark, sf_dir).select("path").unionByName(b.page_modules(spark, sf_dir).select("path")).unionByName(parts)
    return paths.select(tx.role(F.col("path"))[0].alias("file_type")).groupBy("file_type").agg(F.count("*").alias("files"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^.+?[.!?](\\s|$)') THEN regexp_extract(t, '^(.+?[.!?])(\\s|$)', 1) ELSE t END AS s FROM f) SELECT doc_id, CASE WHEN length(s) > 140 THEN rtrim(substr(s, 1, 139)) || '…' ELSE s END AS description FROM s")
def describe_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("description"))


@query(f"WITH {_FILES} SELECT doc_id, list_sort({_query_terms_sql('text')}) AS terms FROM files")
def stopword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling terms of each document."""
    return b.files(spark, sf_dir).select("doc_id", F.sort_array(tx.query_terms(F.col("text"))).alias("terms"))


@query(f"SELECT doc_id, len({_terms_sql('text')})::INT AS terms, len(list_distinct({_terms_sql('text')}))::INT AS distinct_terms FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """terms of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.term_counts(F.col("text")).alias("t")).select("doc_id", F.aggregate("t.tf", F.lit(0), lambda n, tf: n + tf.cast("int")).alias("terms"), F.size("t").alias("distinct_terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: in how many documents each term is."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.explode(tx.term_set(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


_DOC_NODES = f"WITH {_FILES}, nodes AS (SELECT path, []::VARCHAR[] AS symbols, text AS description, {_role_sql('path')} AS file_type FROM files), queries(query_id, query) AS (VALUES (1, '{TEXT_QUERY}')), asked AS (SELECT query_id, unnest({_query_terms_sql('query')}) AS term FROM queries), {_SCORES}"


def _doc_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = b.files(spark, sf_dir)
    return f.select("path", F.array().cast("array<string>").alias("symbols"), F.col("text").alias("description"), tx.role(F.col("path"))[0].alias("file_type")), spark.createDataFrame([(1, TEXT_QUERY)], "query_id int, query string")


@query(f"{_DOC_NODES} SELECT query_id, path, round(score, 6) AS score FROM scores")
def tf_idf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their relevance to a query."""
    return scoring.scores(*_doc_nodes(spark, sf_dir)).select("query_id", "path", F.round("score", 6).alias("score"))


@query(f"WITH {_NODES}, {_ASKED}, {_SCORES} SELECT query_id, term, count(DISTINCT path) AS nodes FROM parts_ WHERE field = 'partial' GROUP BY 1, 2")
def substring_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that have a query term only as part of a filename term."""
    hits = scoring.partial_terms(b.nodes(spark, sf_dir), cut(scoring.asked_terms(questions(spark))))
    return hits.groupBy("query_id", "term").agg(F.count("*").alias("nodes"))


_TESTS = "nodes AS (SELECT 'src/' || replace(p_name, ' ', '/') || '/' || p_partkey || CASE WHEN p_size > 25 THEN '.spec.ts' ELSE '.ts' END AS path, [p_brand] AS symbols, p_type AS description, CASE WHEN p_size > 25 THEN 'test' ELSE 'other' END AS file_type FROM part)"


@query(f"WITH {_TESTS}, {_ASKED}, {_SCORES} SELECT query_id, path, round(score, 6) AS score FROM scores")
def test_downweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tests count less unless the query is about them."""
    p = b.part_rows(spark, sf_dir)
    path = F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".spec.ts").otherwise(".ts"))
    nodes = p.select(path.alias("path"), F.array("p_brand").alias("symbols"), F.col("p_type").alias("description"), F.when(F.col("p_size") > 25, "test").otherwise("other").alias("file_type"))
    return scoring.scores(nodes, questions(spark)).select("query_id", "path", F.round("score", 6).alias("score"))


# Graph


@query(f"WITH {_RELS} SELECT * FROM rels")
def relationship_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: links by pair."""
    return graph.relationships(b.links(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT weight, confidence, count(*) AS edges, sum(symbol_count) AS symbols, sum(usage) AS usage FROM edges GROUP BY 1, 2")
def edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges by weight and confidence."""
    return b.edges(spark, sf_dir).groupBy("weight", "confidence").agg(F.count("*").alias("edges"), F.sum("symbol_count").alias("symbols"), F.sum("usage").alias("usage"))


@query(f"WITH {_GRAPH}, capped AS (SELECT CASE WHEN dst LIKE '%0' THEN replace(dst, 'suppliers/', 'pkg/') || '/__init__.py' ELSE dst END AS dst, weight FROM edges) SELECT dst, sum(CASE WHEN dst LIKE '%__init__.py' THEN least(weight, 1) ELSE weight END)::BIGINT AS weight, count(*) AS edges FROM capped GROUP BY dst")
def edge_weight_init_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges at a package's entry file weigh 1 at most."""
    dst = F.when(F.col("dst").endswith("0"), F.concat(F.replace(F.col("dst"), F.lit("suppliers/"), F.lit("pkg/")), F.lit("/__init__.py"))).otherwise(F.col("dst"))
    e = b.edges(spark, sf_dir).withColumn("dst", dst)
    return e.select("dst", wt.package_cap(F.col("weight"), F.col("src"), F.col("dst")).alias("weight")).groupBy("dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))


@query(f"WITH {_GRAPH} SELECT array_to_string(relations, ',') AS relations, count(*) AS edges FROM edges GROUP BY 1")
def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges by their labels."""
    return b.edges(spark, sf_dir).groupBy(F.array_join("relations", ",").alias("relations")).agg(F.count("*").alias("edges"))


_DEGREE = "ends AS (SELECT src AS path FROM edges UNION ALL SELECT dst FROM edges), degrees AS (SELECT n.path, count(e.path) AS degree FROM nodes n LEFT JOIN ends e USING (path) GROUP BY 1)"


@query(f"WITH {_GRAPH}, {_DEGREE} SELECT * FROM degrees")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: edges at each node."""
    return graph.degrees(b.nodes(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"WITH {_GRAPH}, {_DEGREE} SELECT * FROM degrees ORDER BY degree DESC, path LIMIT 10")
def hub_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes with most edges."""
    return graph.hubs(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), 10)


@query(f"WITH {_NODES} SELECT file_type, count(*) AS nodes, count(*) FILTER (description <> '') AS described FROM nodes GROUP BY 1")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type."""
    return b.nodes(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("nodes"), F.count_if(F.col("description") != "").alias("described"))


@query(f"WITH {_GRAPH} SELECT confidence, count(*) AS edges FROM edges GROUP BY 1")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by confidence."""
    return b.edges(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("edges"))


@query(f"WITH {_NODES}, n AS (SELECT count(*) AS nodes FROM nodes UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM supplier) SELECT nodes, round(CASE WHEN nodes <= 200 THEN 0.12 ELSE least(0.28, 0.12 + 0.035 * log2(nodes / 200.0)) END, 6)::DOUBLE AS cutoff FROM n")
def adaptive_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the cutoff for graphs of several sizes."""
    n = b.nodes(spark, sf_dir).agg(F.count("*").alias("nodes"))
    for name in ("lineitem", "supplier"):
        n = n.unionByName(table(spark, sf_dir, name).agg(F.count("*").alias("nodes")))
    return n.select("nodes", F.round(tx.adaptive_cutoff(F.col("nodes")), 6).alias("cutoff"))


@query(f"WITH {_NODES}, {_ASKED}, {_SCORES}, {_SEEDS} SELECT query_id, path, round(relevance, 6) AS relevance, seed_rank FROM seeds")
def seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten nodes of each query."""
    return retrieve.seeds(scoring.scores(b.nodes(spark, sf_dir), questions(spark)), 10).select("query_id", "path", F.round("relevance", 6).alias("relevance"), "seed_rank")


def _spread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = cut(b.edges(spark, sf_dir))
    seeds = cut(retrieve.seeds(scoring.scores(b.nodes(spark, sf_dir), questions(spark)), 10))
    return e, seeds, propagate.spread(e, seeds, questions(spark).select("query_id", F.lit(CUTOFF).alias("cutoff")))


_FIXED = f"WITH {_GRAPH}, {_ASKED}, {_SCORES}, {_SEEDS}, {_spread_sql(str(CUTOFF) + '::DOUBLE')}"


@query(f"{_FIXED} SELECT query_id, path, round(relevance, 6) AS relevance FROM best")
def propagate_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance that spreads from the seeds."""
    return _spread(spark, sf_dir)[2].select("query_id", "path", F.round("relevance", 6).alias("relevance"))


@query(f"{_FIXED}, {_REASONS} SELECT query_id, path, reason FROM told")
def propagate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each node is relevant."""
    e, seeds, best = _spread(spark, sf_dir)
    return propagate.reasons(e, best, seeds).select("query_id", "path", "reason")


@query(f"{_FIXED}, {_REASONS}, {_RANKED}, {_COUNTS} SELECT query_id, knee, qualified, files FROM counts")
def knee_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each query gets."""
    _, seeds, best = _spread(spark, sf_dir)
    return retrieve.file_counts(retrieve.knees(best), questions(spark), seeds.groupBy("query_id").agg(F.count("*").alias("seeds")), 8)


@query(f"{_RETRIEVE}, {_SELECTED} SELECT * FROM selected")
def retrieve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection for each query."""
    return retrieve.retrieve(cut(b.nodes(spark, sf_dir)), cut(b.edges(spark, sf_dir)), questions(spark))[0]


@query(f"{_RETRIEVE} SELECT query_id, path, n::INT AS n FROM extra WHERE n <= 3")
def always_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always-included neighbours of the selection."""
    nodes, e = cut(b.nodes(spark, sf_dir)), cut(b.edges(spark, sf_dir))
    chosen, *_ = retrieve.choose(nodes, e, questions(spark))
    return retrieve.config_neighbours(chosen, nodes, e)


_TOTALS = "totals AS (SELECT count(*) AS total_files, sum(greatest(1, size // 4))::BIGINT AS total_tokens, sum(greatest(1, (length(path) + length(description)) // 4))::BIGINT AS metadata_tokens FROM nodes)"


@query(f"{_RETRIEVE}, {_SELECTED}, {_TOTALS} SELECT q.query_id, q.query, t.*, round({_CUTOFF_SQL}, 6) AS cutoff, coalesce(sum(s.tokens), 0)::BIGINT AS selected_tokens, round(100.0 * (1 - coalesce(sum(s.tokens), 0) / any_value(t.total_tokens)), 6) AS savings_pct FROM queries q CROSS JOIN totals t LEFT JOIN selected s ON s.query_id = q.query_id GROUP BY ALL")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selection saves."""
    summary = retrieve.retrieve(cut(b.nodes(spark, sf_dir)), cut(b.edges(spark, sf_dir)), questions(spark))[1]
    return summary.withColumns({"cutoff": F.round("cutoff", 6), "savings_pct": F.round("savings_pct", 6)})


# Resolution of links


@query(f"WITH {_PAGES} SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS href FROM modules")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: links of each page."""
    return b.page_modules(spark, sf_dir).select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))


_INDEXED = "indexed AS (SELECT DISTINCT path, regexp_replace(path, '^(.+)\\.[^.]*$', '\\1') AS noext FROM modules WHERE path <> '')"


@query(f"WITH {_PAGES}, {_INDEXED}, s AS (SELECT path, unnest(list_transform(range(1, len(string_split(noext, '/')) + 1), lambda i: array_to_string(string_split(noext, '/')[i:], '/'))) AS suffix FROM indexed) SELECT suffix, count(*) AS paths, min(path) AS first_path FROM s WHERE suffix <> '' GROUP BY suffix")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-index: every path suffix, with its first path."""
    paths = b.page_modules(spark, sf_dir).where("path <> ''").select("path").distinct()
    return resolve.suffixes(paths).where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query(f"WITH {_PAGES}, d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir, path FROM modules WHERE path LIKE '/%/%'), h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM modules), n AS (SELECT h.page_id, h.href, d.path, row_number() OVER (PARTITION BY h.page_id, h.href ORDER BY d.path) AS n FROM h JOIN d ON d.dir = h.href JOIN modules m ON m.page_id = h.page_id AND m.path <> d.path) SELECT page_id, href, path FROM n WHERE n <= 12")
def package_dir_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link to a directory stands for its files, twelve at most."""
    m = b.page_modules(spark, sf_dir)
    hrefs = m.select("page_id", F.col("path").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))
    return resolve.directory_files(hrefs, m.where("path LIKE '/%/%'").select("path").distinct())


@query(f"WITH {_PAGES}, {_INDEXED}, h AS (SELECT DISTINCT page_id, m.path AS own, unnest(list_concat(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), [path, path || '.html', '/x' || path])) AS href FROM modules m), c AS (SELECT page_id, own, href, unnest([{{p: 1, c: href}}, {{p: 2, c: href || '.html'}}, {{p: 3, c: regexp_replace(href, '^/[^/]*', '')}}], recursive := true) FROM h), f AS (SELECT page_id, href, p AS priority, i.path AS target, row_number() OVER (PARTITION BY page_id, href ORDER BY p, i.path) AS n FROM c JOIN indexed i ON i.path = c.c AND i.path <> own) SELECT page_id, href, priority, target FROM f WHERE n = 1")
def candidate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several candidates for a link the first that exists wins."""
    m = b.page_modules(spark, sf_dir)
    hrefs = m.select("page_id", F.col("path").alias("own"), F.explode(F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), F.array("path", F.concat("path", F.lit(".html")), F.concat(F.lit("/x"), "path"))))).alias("href"))
    asked = hrefs.withColumn("candidates", F.array("href", F.concat("href", F.lit(".html")), F.regexp_replace("href", "^/[^/]*", "")))
    known = m.where("path <> ''").select(F.col("path").alias("key"), F.col("path").alias("target")).distinct()
    return resolve.first_match(asked, known, ["page_id", "href"]).select("page_id", "href", "priority", "target")


def _route_sql(x: str) -> str:
    named = f"regexp_replace({x}, '/\\{{[^}}]+\\}}|/:[a-zA-Z_][a-zA-Z0-9_]*', '/*', 'g')"
    for _ in range(2):
        named = f"regexp_replace({named}, '/[0-9]+(/|$)', '/*\\1', 'g')"
    return f"coalesce(nullif(rtrim({named}, '/'), ''), '/')"


@query(f"WITH {_PAGES} SELECT {_route_sql('path')} AS route, count(*) AS pages FROM modules GROUP BY 1")
def route_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages by normalised route."""
    return b.page_modules(spark, sf_dir).groupBy(tx.normal_route(F.col("path")).alias("route")).agg(F.count("*").alias("pages"))


@query(f"WITH {_PAGES}, r AS (SELECT DISTINCT {_route_sql('path')} AS route FROM modules), c AS (SELECT page_id, {_route_sql('path')} AS call FROM modules), s AS (SELECT route, string_split(route, '/') AS s FROM r), k AS (SELECT page_id, call, string_split(call, '/') AS k FROM c) SELECT page_id, call, route FROM s, k WHERE len(s) >= 2 AND len(k) >= len(s) AND len(list_filter(range(1, len(s) + 1), lambda i: s[i] <> '*' AND s[i] <> k[i])) = 0")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path begins with a route."""
    m = b.page_modules(spark, sf_dir).select("page_id", tx.normal_route(F.col("path")).alias("call"))
    return resolve.matching_routes(m, m.select(F.col("call").alias("route")).distinct())


# Currency

_STATE = "'user/' || user_id || '/' || event_type || '/' || hour(ts) AS path, count(*) AS size, max(day(ts) % 10)::DOUBLE AS mtime, sha256(array_to_string(list_sort(list_distinct(list(floor(value)::BIGINT::VARCHAR))), ',')) AS sha256 FROM events"
_SNAP = f"""old AS (SELECT {_STATE} WHERE ts < TIMESTAMP '{b.CUT_DATE}' GROUP BY 1), new AS (SELECT {_STATE} WHERE ts >= TIMESTAMP '{b.CUT_DATE}' GROUP BY 1),
changes AS (SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.size = n.size AND abs(o.mtime - n.mtime) <= 1e-6 THEN NULL WHEN o.sha256 = n.sha256 THEN 'touched' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (path))"""


@query(f"WITH {_SNAP} SELECT * FROM changes WHERE change IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots."""
    return sync.changes(*b.snapshots(spark, sf_dir))


@query(f"WITH {_SNAP} SELECT o.* FROM old o WHERE path NOT IN (SELECT path FROM changes WHERE change IS NOT NULL) UNION ALL SELECT n.* FROM new n WHERE path IN (SELECT path FROM changes WHERE change IN ('added', 'changed', 'touched'))")
def node_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old snapshot, patched."""
    old, new = b.snapshots(spark, sf_dir)
    return sync.patch_nodes(old, new, sync.changes(old, new))


@query(f"WITH e AS (SELECT 'user/' || user_id AS src, 'type/' || event_type AS dst, ts < TIMESTAMP '{b.CUT_DATE}' AS old FROM events), o AS (SELECT src, dst, least(10, count(*))::INT AS before FROM e WHERE old GROUP BY 1, 2), n AS (SELECT src, dst, least(10, count(*))::INT AS after FROM e WHERE NOT old GROUP BY 1, 2) SELECT src, dst, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'reweighted' ELSE 'kept' END AS change, before, after FROM o FULL JOIN n USING (src, dst)")
def edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two sets of edges."""
    return sync.edge_delta(*b.snapshot_edges(spark, sf_dir))


@query("WITH o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), n AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT 'both' AS part, count(*) AS users FROM (SELECT * FROM o INTERSECT SELECT * FROM n) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM o UNION SELECT * FROM n)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, intersection and union of node sets."""
    e = table(spark, sf_dir, "events")
    o, n = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in ("purchase", "error"))
    parts = {"both": o.join(n, "user_id", "left_semi"), "first": o.join(n, "user_id", "left_anti"), "second": n.join(o, "user_id", "left_anti"), "either": o.union(n).distinct()}
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("users")).select(F.lit(name).alias("part"), "users")
        out = row if out is None else out.unionByName(row)
    return out


# Reports


@query(f"WITH {_NODES}, n AS (SELECT count(*) AS nodes FROM nodes) SELECT CASE WHEN nodes < 80 THEN 'small' WHEN nodes <= 500 THEN 'medium' ELSE 'large' END AS tier, nodes, least(50, greatest(20, nodes // 20))::INT AS hubs FROM n")
def repo_map_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the size class of the graph and how many hubs its map shows."""
    n = b.nodes(spark, sf_dir).agg(F.count("*").alias("nodes"))
    return n.select(F.when(F.col("nodes") < 80, "small").when(F.col("nodes") <= 500, "medium").otherwise("large").alias("tier"), "nodes", F.least(F.lit(50), F.greatest(F.lit(20), F.expr("nodes div 20"))).cast("int").alias("hubs"))


@query(f"{_DOC_NODES}, {_SEEDS}, sel AS (SELECT path, row_number() OVER (ORDER BY relevance DESC, path) AS n FROM seeds) SELECT f.path, '- ' || f.path || ' [doc] ' || f.size || ' bytes' AS line, CASE WHEN s.path IS NOT NULL AND s.n <= 5 THEN text END AS content FROM files f LEFT JOIN sel s USING (path)")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: a line for every file, and the content of the five that matter to a query."""
    f = b.files(spark, sf_dir)
    top = retrieve.seeds(scoring.scores(*_doc_nodes(spark, sf_dir)), 5).select("path", F.lit(True).alias("chosen"))
    line = F.concat(F.lit("- "), "path", F.lit(" [doc] "), F.col("size").cast("string"), F.lit(" bytes"))
    return f.join(top, "path", "left").select("path", line.alias("line"), F.when(F.col("chosen"), F.col("text")).alias("content"))


# Source files made of parts


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    body = F.concat(F.lit('"""'), F.col("p_type"), F.lit(' part. More."""\nfrom shop.'), name, F.lit(" import Base, item as thing\n\n\nclass Part"), F.col("p_partkey").cast("string"), F.lit("(Base):\n    def run(self):\n        return thing.run()\n\n\n@app.get('/parts/"), F.col("p_partkey").cast("string"), F.lit("')\ndef "), name, F.lit("():\n    return thing\n"))
    return b.part_rows(spark, sf_dir).select(F.concat(F.lit("shop/"), name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), body.alias("text"))


@query("SELECT 'shop/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path, p_type || ' part. More.' AS docstring, 'shop.' || replace(p_name, ' ', '_') AS module, 'Base,item' AS symbols, 3 AS usage, 1 AS bases, 'Part' || p_partkey || ',' || replace(p_name, ' ', '_') AS defined, '/parts/' || p_partkey AS routes FROM part")
def python_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of Python files, one for each part."""
    e = extracts(_python_files(spark, sf_dir)).withColumn("i", F.col("imports")[0])
    return e.select("path", "docstring", F.col("i.module").alias("module"), F.array_join("i.symbols", ",").alias("symbols"), F.col("usage_counts")["thing"].alias("usage"), F.size("i.base_classes").alias("bases"), F.array_join("defined_symbols", ",").alias("defined"), F.array_join("http_routes", ",").alias("routes"))


@query("SELECT p_partkey || '.ts' AS path, n.name, n.kind, n.s AS start, n.e AS end_ FROM part, (VALUES ('Part', 'class', 2, 6), ('make', 'fn', 7, 9)) n(name, kind, s, e)")
def brace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: symbols of TypeScript files, one for each part."""
    text = F.concat(F.lit("// "), F.col("p_name"), F.lit("\nexport class Part {\n  run() {\n    return 1;\n  }\n}\nexport const make = (a) => {\n  return a;\n};\nif (x) {\n}\n"))
    files = b.part_rows(spark, sf_dir).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), text.alias("text"))
    return slicing.all_symbols(files).withColumnRenamed("end", "end_")


@query()
def slice_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the files that a query selects, within its budget."""
    f = _python_files(spark, sf_dir)
    nodes = f.select("path", F.array().cast("array<string>").alias("symbols"), F.lit("").alias("description"), F.lit("other").alias("file_type"))
    asked = questions(spark)
    top = retrieve.seeds(scoring.scores(nodes, asked), 10).select("query_id", F.col("seed_rank").alias("position"), "path")
    return slicing.pack(top, f, asked)
