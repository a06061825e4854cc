"""Beyond the reference's pull-based sync: a stream of snapshot rows that patches a node table.

Each micro-batch holds the newest state of some files; ``deleted`` marks those that are gone.
The table is versioned: a batch reads the newest version before its own, and writes its own whole or,
if it is repeated, again; so a repeated batch is harmless. Versions are numbered by batch, so a folder belongs to one checkpoint.
Of several states of a file with the same time the one that is greatest by deletion, digest and size counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, size bigint, mtime double, sha256 string, deleted boolean"


def apply_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    spark = batch.sparkSession
    newest = batch.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("mtime", "deleted", "sha256", "size")).alias("s")).select("path", "s.size", "s.mtime", "s.sha256", "s.deleted")
    if batch_id > 0:
        old = spark.read.parquet(f"{folder}/v{batch_id - 1}").join(newest.select("path"), "path", "left_anti")
        now = old.unionByName(newest.where("NOT coalesce(deleted, false)").drop("deleted"))
    else:
        now = newest.where("NOT coalesce(deleted, false)").drop("deleted")
    now.write.mode("overwrite").parquet(f"{folder}/v{batch_id}")


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda b, i: apply_batch(b, i, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
