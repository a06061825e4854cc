"""The graph's tables, made of relational ones.

Documents are files, pages are modules that link to each other, and parts and suppliers are
the nodes of a dependency graph whose links are the lines of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators import graph
from relgraph.storage import spread_out, table

CUT_DATE = "2024-01-20"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("bigint").alias("size"))


def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), "html")


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "part"), "p_partkey")


def part_path() -> Column:
    return F.concat(F.lit("parts/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers; the richest suppliers are always included."""
    p, s = part_rows(spark, sf_dir), spread_out(table(spark, sf_dir, "supplier"), "s_suppkey")
    parts = p.select(part_path().alias("path"), F.array("p_brand").alias("symbols"), F.col("p_type").alias("description"), F.lit("part").alias("file_type"), (F.col("p_size") * 100).cast("bigint").alias("size"), F.lit(False).alias("always_include"))
    suppliers = s.select(F.concat(F.lit("suppliers/"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("path"), F.array().cast("array<string>").alias("symbols"), F.col("s_name").alias("description"), F.lit("supplier").alias("file_type"), F.floor(F.abs("s_acctbal")).cast("bigint").alias("size"), (F.col("s_acctbal") > 9000).alias("always_include"))
    return parts.unionByName(suppliers)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link from part to supplier for each line of an order."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 9000).alias("to_config"))
    c = F.col
    return li.join(p, c("l_partkey") == c("p_partkey")).join(s, c("l_suppkey") == c("s_suppkey")).select(
        "src",
        F.concat(F.lit("suppliers/"), F.lpad(c("l_suppkey").cast("string"), 8, "0")).alias("dst"),
        F.lit(1).alias("symbols"),
        F.when(c("l_quantity") > 25, 2).otherwise(1).alias("usage"),
        (c("l_returnflag") == "R").alias("inherits"),
        (c("l_discount") > 0.09).alias("reexports"),
        "to_config",
        (c("l_linestatus") == "F").alias("exact"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(graph.relationships(links(spark, sf_dir)))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of each user, type and hour before the cut date, and after it: two states of one file."""
    e = table(spark, sf_dir, "events")
    path = F.concat_ws("/", F.lit("user"), F.col("user_id").cast("string"), "event_type", F.hour("ts").cast("string"))
    state = [F.count("*").alias("size"), F.max(F.dayofmonth("ts") % 10).cast("double").alias("mtime"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.floor("value").cast("string"))), ","), 256).alias("sha256")]
    early = F.col("ts") < F.lit(CUT_DATE).cast("timestamp_ntz")
    return e.where(early).groupBy(path.alias("path")).agg(*state), e.where(~early).groupBy(path.alias("path")).agg(*state)


def snapshot_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges of user to event type in both periods, weighted by how many events there were."""
    e = table(spark, sf_dir, "events")
    row = e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("type/"), "event_type").alias("dst"), (F.col("ts") < F.lit(CUT_DATE).cast("timestamp_ntz")).alias("old"))
    make = lambda d: d.groupBy("src", "dst").agg(F.least(F.lit(10), F.count("*")).cast("int").alias("weight"))
    return make(row.where("old")), make(row.where("NOT old"))
