"""Tables between jobs, in the folder that every machine sees."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a folder of this machine serves local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'tessella-scratch')}"
    return root.rstrip("/")


_OWNED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place for a table in this application's folder, which goes when the application ends."""
    own = f"{scratch_root(spark)}/tessella-{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)  # asks for a folder that is there
        _OWNED.add(own)
    return f"{own}/{uuid.uuid4().hex[:12]}/{name}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The files outlive any executor, so later jobs don't repeat earlier ones.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 500_000) -> DataFrame:
    """df, of so many rows, dealt by keys to partitions of about `each` rows, where the session's number of shuffle
    partitions would make larger ones; so a task's memory stays as it is when tables grow."""
    parts = -(-rows // each)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan will read again."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t.scratch).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
