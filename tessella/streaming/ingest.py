"""Documents that are waiting to be chunked, as a queue: priorities, bounded batches, no loss and no double after a crash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import ChunkStore


class Queue:
    """Tasks(id, priority, ...) of a stream, done `capacity` at a time, those of higher priority first.

    A batch has three steps: the tasks that wait are the ones left by the batch before and the new ones; the first
    of them are chunked and put into the store under the batch's number; what is left is written for the next batch.
    A batch that is run again after a crash finds the same waiting tasks, so it takes the same ones, and the store
    knows its number. `fail` is called after each step (tests end a batch there).
    """

    def __init__(self, spark: SparkSession, path: str, store: ChunkStore, work: Callable[[DataFrame], DataFrame], capacity: int, fail: Callable[[int, str], None] = lambda batch, step: None):
        self.spark, self.path, self.store, self.work, self.capacity, self.fail = spark, path.rstrip("/"), store, work, capacity, fail

    def _left(self, batch: int) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/left/b{batch}/_SUCCESS")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(f"{self.path}/left/b{batch}") if there else None

    def step(self, new: DataFrame | None, batch: int) -> int:
        """One batch; how many tasks are still waiting comes back."""
        before = self._left(batch - 1)
        arrived = new.withColumn("batch", F.lit(batch)) if new is not None else None
        waiting = arrived if before is None else before if arrived is None else before.unionByName(arrived)
        first = Window.partitionBy("id").orderBy("batch", F.desc("priority"))
        waiting = waiting.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")  # a task that is sent twice is one
        path = f"{self.path}/waiting/b{batch}"
        waiting.write.mode("overwrite").parquet(path)
        waiting = self.spark.read.parquet(path)
        taken = waiting.orderBy(F.desc("priority"), "batch", "id").limit(self.capacity)
        self.fail(batch, "taken")
        self.store.upsert(self.work(taken).withColumn("done_in", F.lit(batch)), batch)
        self.fail(batch, "stored")
        left = waiting.join(F.broadcast(taken.select("id")), "id", "left_anti")  # at most `capacity` ids
        left.write.mode("overwrite").parquet(f"{self.path}/left/b{batch}")
        self.fail(batch, "left")
        return self._left(batch).count()

    def run(self, tasks: DataFrame) -> None:
        """All tasks of a stream to its end, and then what is still waiting."""
        stream = tasks.writeStream.foreachBatch(lambda df, n: self.step(df, n) and None).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
        batch = self._last()
        while (left := self._left(batch)) is not None and left.limit(1).count():
            batch += 1
            self.step(None, batch)

    def _last(self) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/left")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(where)), default=-1) if fs.exists(where) else -1
