"""A chunk store on files: rows in folders by a hash of their key, changed folder by folder.

A change has a version. It reads and rewrites the folders that hold its keys and no others; when all are written the
version is noted, and a change whose version is noted does nothing. So a batch that is sent again after a crash,
whole or half done, leaves the store as one run would have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialise


class ChunkStore:
    """keys: columns that name a row; folders: how many there are, for the whole life of the store."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], folders: int = 64):
        self.spark, self.path, self.keys, self.folders = spark, path.rstrip("/"), keys, folders

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int").alias("folder")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def noted(self, version: int) -> bool:
        fs, where = self._at(f"versions/v{version}")
        return fs.exists(where)

    def _note(self, version: int) -> None:
        fs, where = self._at(f"versions/v{version}")
        fs.create(where, True).close()

    def read(self) -> DataFrame | None:
        """All rows; None while there is no table."""
        fs, where = self._at("rows")
        if not fs.exists(where):
            return None
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.where("not _gone").drop("folder", "_version", "_gone")

    def get(self, key: dict) -> DataFrame | None:
        """Rows of one key: one folder is read."""
        rows = self.read()
        if rows is None:
            return None
        test = F.lit(True)
        for c in self.keys:
            test = test & (F.col(c) == F.lit(key[c]).cast(rows.schema[c].dataType))
        folder = self.spark.range(1).select(*(F.lit(key[c]).cast(rows.schema[c].dataType).alias(c) for c in self.keys)).select(self._folder()).first()[0]
        return self.spark.read.parquet(f"{self.path}/rows").where((F.col("folder") == folder) & ~F.col("_gone") & test).drop("folder", "_version", "_gone")

    def _rewrite(self, touched: list[int], make: Callable[[DataFrame | None], DataFrame]) -> None:
        fs, where = self._at("rows")
        old = self.spark.read.parquet(f"{self.path}/rows").where(F.col("folder").isin(touched)) if fs.exists(where) else None
        ready = materialise(make(old), "folders")  # what is rewritten can't be read in the same job
        dealt = ready.repartition(max(1, len(touched)), "folder").sortWithinPartitions("folder", *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{self.path}/rows")
        discard(ready)

    def upsert(self, rows: DataFrame, version: int, newest: str | None = None) -> int:
        """Rows take the place of those of the same key; of several in the batch the one with the largest `newest`, or any
        one where it is not given, stays. How many folders were written comes back."""
        if self.noted(version):
            return 0
        new = rows.withColumns({"folder": self._folder(), "_version": F.lit(version).cast("long"), "_gone": F.lit(False)})
        order = F.col(newest).desc() if newest else F.lit(0)
        new = materialise(new.withColumn("_r", F.row_number().over(Window.partitionBy(*self.keys).orderBy(order))).where("_r = 1").drop("_r"), "batch")
        touched = sorted(r[0] for r in new.select("folder").distinct().collect())  # numbers of folders
        if touched:
            self._rewrite(touched, lambda old: new if old is None else old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new, allowMissingColumns=True))
        self._note(version)
        return len(touched)

    def change(self, hit: Column, version: int, new: dict[str, Column] | None = None) -> int:
        """Rows that fit get new values of columns, or go where none are given. How many rows were hit comes back.

        A folder whose rows all go keeps them marked, so that it is overwritten and not left as it was.
        """
        fs, where = self._at("rows")
        if self.noted(version) or not fs.exists(where):
            return 0
        fits = F.coalesce(hit, F.lit(False)) & ~F.col("_gone") & (F.col("_version") < version)
        counts = self.spark.read.parquet(f"{self.path}/rows").where(fits).groupBy("folder").agg(F.count("*").alias("n")).collect()
        if counts:
            values = {**(new or {}), "_version": F.lit(version).cast("long"), "_gone": F.lit(new is None)}
            self._rewrite(sorted(r["folder"] for r in counts), lambda old: old.select(*(F.when(fits, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns)))
        self._note(version)
        return sum(r["n"] for r in counts)
