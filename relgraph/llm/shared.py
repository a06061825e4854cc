"""Reading tables and cutting lineage, for all operators of the subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: ``spark.checkpoint.dir`` as the
    cluster sets it. Only where it is unset, in local mode, is one made; on a cluster that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        known = tempfile.mkdtemp(prefix="relgraph-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later
    steps neither recompute it nor depend on the executors that made it. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` made, which nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, _paths.pop(df)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
