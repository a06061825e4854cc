"""A graph from a source tree, kept current by snapshot difference; questions to it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph import schemas
from relgraph.extract import extracts
from relgraph.functions import text as tx
from relgraph.operators import graph, resolve, retrieve, slicing, sync
from relgraph.sources.tree import read_tree
from relgraph.storage import cut

SYMBOLS_KEPT = 12
KNOWLEDGE = ["best practices", "define ", "difference between ", "explain ", "how do i learn", "what are ", "what does ", "what is ", "when should i use", "why does "]
REPOSITORY = ["codebase", "here ", "our ", "repo", "this ", ".js", ".py", ".ts", "_"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    extracts: DataFrame
    contents: DataFrame


def make_nodes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Node rows (see schemas) of ``files(path, language, size, mtime, sha256)`` and their extracts."""
    kind, always = tx.role(F.col("path"))
    rows = files.select("path", "language", "size", "mtime", "sha256", kind.alias("file_type"), always.alias("always_include")).join(facts, "path")
    return rows.select(
        "path", "language", "file_type", "size", "mtime", "sha256",
        tx.describe(F.col("docstring"), F.col("file_type"), F.col("language"), F.col("defined_symbols")).alias("description"),
        "always_include", F.slice("defined_symbols", 1, SYMBOLS_KEPT).alias("symbols"), "http_routes", "http_calls",
    )


def make_edges(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    rels = graph.relationships(resolve.links(facts, nodes))
    return graph.with_routes(graph.edges(rels), graph.route_links(nodes))


def build(files: DataFrame) -> Graph:
    """Graph of ``files`` with their ``text``. Extraction runs once for equal contents."""
    once = files.where("sha256 <> ''").groupBy("sha256", "language").agg(F.min("path").alias("first"), F.min_by("text", "path").alias("text"))
    by_content = extracts(once.select(F.col("first").alias("path"), "language", "text")).join(once.select(F.col("first").alias("path"), "sha256", "language"), "path").drop("path")
    hashed = files.where("sha256 <> ''").select("path", "sha256", "language").join(by_content, ["sha256", "language"]).drop("sha256", "language")
    facts = cut(hashed.unionByName(extracts(files.where("sha256 = ''"))))
    nodes = cut(make_nodes(files, facts))
    return Graph(nodes, cut(make_edges(nodes, facts)), facts, files.select("path", "text"))


def build_tree(spark: SparkSession, root: str, docs: bool = False) -> Graph:
    return build(cut(read_tree(spark, root, docs=docs)))


def update(spark: SparkSession, old: Graph, root: str, docs: bool = False) -> tuple[Graph, DataFrame]:
    """The graph as of now, and a one-row report. Only files whose size or time changed are read; only changed ones extracted."""
    stat = cut(read_tree(spark, root, content=False, docs=docs))
    maybe = cut(sync.candidates(old.nodes, stat))
    if maybe.isEmpty():
        return old, sync.report(maybe, sync.edge_delta(old.edges, old.edges))
    fresh = read_tree(spark, root, docs=docs).join(maybe.where("change <> 'deleted'").select("path"), "path", "left_semi")
    fresh = cut(fresh)
    unread = old.nodes.join(maybe.select("path"), "path", "left_anti")
    now = unread.select("path", "size", "mtime", "sha256").unionByName(fresh.select("path", "size", "mtime", "sha256"))
    changes = cut(sync.changes(old.nodes, now))
    facts = cut(old.extracts.join(changes.where("change <> 'touched'").select("path"), "path", "left_anti").unionByName(extracts(fresh.join(changes.where("change IN ('added', 'changed')").select("path"), "path", "left_semi"))))
    nodes = cut(sync.patch_nodes(old.nodes, make_nodes(fresh, facts), changes))
    edges = cut(make_edges(nodes, facts))
    contents = old.contents.join(maybe.select("path"), "path", "left_anti").unionByName(fresh.select("path", "text"))
    return Graph(nodes, edges, facts, contents), sync.report(changes, sync.edge_delta(old.edges, edges))


def knowledge_question(query: Column) -> Column:
    """Whether a question is about the world rather than about this code."""
    low = F.lower(query)
    some = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return some(KNOWLEDGE) & ~some(REPOSITORY)


def answer(g: Graph, question: str, depth: str = retrieve.DEFAULT_DEPTH, max_files: int | None = None) -> str:
    """Text with what the question selects: a header, why each file is there, and slices within the depth's budget."""
    spark = g.nodes.sparkSession
    if g.nodes.count() < retrieve.SMALL_GRAPH:
        depth = "focused"
    asked = spark.createDataFrame([(1, question)], "query_id int, query string")
    selected, summary = retrieve.retrieve(g.nodes, g.edges, asked, depth, max_files=max_files)
    rows = selected.orderBy("position").collect()  # fifteen and three at most
    if not rows:
        world = asked.select(knowledge_question(F.col("query")).alias("k")).first()["k"]
        return "This looks like a general question; nothing here answers it." if world else "Nothing here matches. Try names of files or symbols."
    total = summary.first()
    lines = [f"{question}: {len(rows)} of {total['total_files']} files, {total['selected_tokens']:,} of {total['total_tokens']:,} tokens ({total['savings_pct']:.0f} % less)"]
    for r in rows:
        words = r["description"].split()[:5]
        hint = " ".join(words).rstrip(":;,.")
        lines.append(f"{r['position']}. {r['path']} ({r['score']}) {hint} - {r['reason']}")
    packed = slicing.pack(selected, g.contents, asked, slicing.BUDGETS.get(depth, slicing.BUDGETS["balanced"]))
    lines += [f"## {r['path']} [{r['mode']}]\n{r['block']}" for r in packed.orderBy("position").collect()]
    return "\n".join(lines)


def empty_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.NODES)
