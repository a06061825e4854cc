"""Tables, and the folder where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 50_000


def spread_out(df: DataFrame, column: str, rows: int = ROWS) -> DataFrame:
    """``df``, about so many rows a task: a small file is read by one task, however much is made of each of its rows.
    For rows that are narrow as they are read."""
    n = df.count()
    return df if n <= rows else df.repartition(-(-n // rows), column)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back: later steps neither
    recompute it nor depend on the executors that made it. Where the setting is absent a
    folder is made in local mode; on a cluster, whose executors have disks of their own, that is an error."""
    spark = df.sparkSession
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        known = tempfile.mkdtemp(prefix="relgraph-")
        spark.sparkContext.setCheckpointDir(known)
    path = f"{known}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
