"""Work tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only a local session
that leaves it unset (tests) gets a folder of its own; elsewhere that is an error,
because executors on other machines could not read it.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    return path


def table(df: DataFrame, name: str, made: list | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut there
    and a lost executor costs no recomputation of what came before. The files go
    when the driver's JVM ends, as a result that is still lazy may read them, or
    with drop(made) where a list is given."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    if made is not None:
        made.append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, made: list) -> DataFrame:
    """As table(), with the rows of a key in one of spark.sql.shuffle.partitions
    buckets: joins on the key then move only their other side. The files are
    known to the session catalogue under a name of their own until drop(made)."""
    spark = df.sparkSession
    known = f"loomgraph_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{known}"
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(known)
    made.append((spark, path, known))
    return spark.table(known)


def drop(made: list) -> None:
    """Removes work tables that nothing lazy reads any more."""
    while made:
        spark, path, known = made.pop()
        if known:
            spark.sql(f"drop table if exists {known}")
        files, where = _place(spark, path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


@contextmanager
def work():
    """A list for table() and bucketed(); its tables go at the end of the block."""
    made: list = []
    try:
        yield made
    finally:
        drop(made)
