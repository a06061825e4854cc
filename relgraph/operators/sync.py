"""Keeping a graph current: snapshot and edge differences, and patches.

Snapshots and edges are compared by one full outer join each; what didn't change is reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MTIME_TOLERANCE = 1e-6


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` by size and time alone: ``added``, ``deleted`` or ``candidate``."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    n = new.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"))
    moved = (F.col("old_size") != F.col("new_size")) | (F.abs(F.col("old_mtime") - F.col("new_mtime")) > MTIME_TOLERANCE)
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "deleted").when(moved, "candidate")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)``: ``added``, ``deleted``, ``changed`` (other content) or ``touched`` (the same content)."""
    hashes = old.select("path", F.col("sha256").alias("old_sha")).join(new.select("path", F.col("sha256").alias("new_sha")), "path")
    found = candidates(old, new).join(hashes, "path", "left")
    return found.select("path", F.when(F.col("change") != "candidate", F.col("change")).when(F.col("old_sha") == F.col("new_sha"), "touched").otherwise("changed").alias("change"))


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(src, dst, change)``: ``added``, ``removed``, ``reweighted`` or ``kept``."""
    o, n = old.select("src", "dst", F.col("weight").alias("before")), new.select("src", "dst", F.col("weight").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "reweighted").otherwise("kept")
    return o.join(n, ["src", "dst"], "full_outer").select("src", "dst", change.alias("change"), "before", "after")


def patch_nodes(old: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """Old nodes without the deleted and dirty ones, and the dirty ones anew; touched ones get their new time."""
    dirty = found.where("change IN ('added', 'changed', 'touched')").select("path")
    return old.join(found.select("path"), "path", "left_anti").unionByName(new.join(dirty, "path", "left_semi"))


def cached_extracts(nodes: DataFrame, extracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (nodes with the extract of their content) and misses (nodes without), by hash."""
    known = extracts.where("sha256 <> ''").dropDuplicates(["sha256"])
    return nodes.where("sha256 <> ''").join(known, "sha256"), nodes.join(known.select("sha256"), "sha256", "left_anti")


def report(found: DataFrame, delta: DataFrame) -> DataFrame:
    """One row of counts."""
    n = found.agg(*(F.count_if(F.col("change") == c).alias(f"nodes_{c}") for c in ("added", "changed", "deleted", "touched")))
    return n.crossJoin(delta.agg(*(F.count_if(F.col("change") == c).alias(f"edges_{c}") for c in ("added", "removed"))))
