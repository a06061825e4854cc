"""Where a graph goes: Parquet tables, one JSON document, Markdown maps and a self-contained viewer."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.build import Graph
from relgraph.operators import graph

TABLES = ("nodes", "edges", "extracts", "contents")
STRONG, CONFIGS_SHOWN = 7, 20


def save(g: Graph, folder: str) -> None:
    for name in TABLES:
        getattr(g, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))


def append_extracts(extracts: DataFrame, cache: str) -> None:
    """Adds extracts, by ``sha256``, that the cache doesn't have yet."""
    spark = extracts.sparkSession
    fresh = extracts.where("sha256 <> ''").dropDuplicates(["sha256"])
    if os.path.isdir(cache):
        fresh = fresh.join(spark.read.parquet(cache).select("sha256"), "sha256", "left_anti")
    fresh.write.mode("append").parquet(cache)


def node_link(g: Graph) -> DataFrame:
    """``(kind, json)``: one JSON object a row, nodes and links of the node-link form."""
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("path").alias("id"), *(c for c in g.nodes.columns if c != "path"))).alias("json"))
    links = g.edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *(c for c in g.edges.columns if c not in ("src", "dst")))).alias("json"))
    return nodes.unionByName(links)


def summary(g: Graph) -> DataFrame:
    """One row: counts and languages."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("description") != "").alias("described"), F.sort_array(F.collect_set("language")).alias("languages"))
    return n.crossJoin(g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") == "inferred").alias("inferred")))


def repo_map(g: Graph) -> str:
    """A map of the tree in Markdown: size class, languages, entry points, shallow configuration, hubs."""
    s = summary(g).first()
    tier = "small" if s["nodes"] < 80 else "medium" if s["nodes"] <= 500 else "large"
    depth = F.size(F.split("path", "/"))
    entries = [r["path"] for r in g.nodes.where("file_type = 'entrypoint'").orderBy("path").select("path").collect()]
    configs = [r["path"] for r in g.nodes.where("file_type = 'config'").orderBy(depth, "path").limit(CONFIGS_SHOWN).select("path").collect()]
    rest = g.nodes.where("file_type <> 'test'").where(~F.col("path").isin(entries + configs))
    hubs = graph.hubs(rest, g.edges, min(50, max(20, s["nodes"] // 20))).collect()
    lines = ["# Map", f"{s['nodes']} files ({tier}), {s['edges']} links, languages: {', '.join(s['languages'])}"]
    for title, rows in (("Entry points", entries), ("Configuration", configs), ("Hubs", [f"{r['path']} ({r['degree']})" for r in hubs])):
        lines += [f"\n## {title}", *(f"- {r}" for r in rows)]
    return "\n".join(lines) + "\n"


def report(g: Graph) -> str:
    s = summary(g).first()
    hubs = [f"- {r['path']} ({r['degree']})" for r in graph.hubs(g.nodes, g.edges, 10).collect()]
    always = [f"- {r['path']}" for r in g.nodes.where("always_include").orderBy("path").select("path").collect()]
    return "\n".join(["# Report", f"{s['nodes']} nodes, {s['described']} described, {s['edges']} edges, {s['inferred']} inferred", "\n## Most linked", *hubs, "\n## Always included", *always]) + "\n"


_PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><input id=q placeholder=filter><ul id=l></ul><script>const g={data},l=document.getElementById('l'),q=document.getElementById('q');function draw(){{l.textContent='';for(const n of g.nodes)if(n.id.includes(q.value)){{const e=document.createElement('li');e.textContent=n.id+' ['+n.type+'] '+g.edges.filter(x=>x.from==n.id).map(x=>x.to+' '+x.weight+(x.strong?'*':'')).join(', ');l.append(e)}}}}q.oninput=draw;draw()</script>"


def viewer(g: Graph, title: str) -> str:
    """A page that lists nodes and their links; for graphs that a browser can hold."""
    sizes = graph.degrees(g.nodes, g.edges)
    nodes = [{"id": r["path"], "type": r["file_type"], "value": 1 + r["degree"]} for r in g.nodes.select("path", "file_type").join(sizes, "path").orderBy("path").collect()]
    edges = [{"from": r["src"], "to": r["dst"], "weight": r["weight"], "strong": r["weight"] >= STRONG} for r in g.edges.orderBy("src", "dst").collect()]
    data = json.dumps({"types": sorted({n["type"] for n in nodes}), "edges": edges, "nodes": nodes}).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(title), data=data)
