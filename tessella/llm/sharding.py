"""Sharding by longest-processing-time: groups of equal texts, largest first, each to the shard with
the least bytes so far.

The heap works on size classes, not on rows: a class holds all groups of nearly one size (exact below
4096 bytes, else equal in the leading 12 bits, so at most 213,000 classes for any corpus), and a class
of many groups is dealt at once by filling the shards to one level. Which group of a class goes where
follows from its rank, counted in buckets so that no task holds a whole class.

Law `bytes`: sizes of shards are as near equal as whole groups allow; a group larger than an even
share fills a shard by itself. Edges: a null text counts as an empty one (size 16); a null doc_id is a
row like any other; repeated rows are one group; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import collect_bounded, materialise

EXACT_BITS = 12


def size_class(size: Column) -> Column:
    """The size itself below 2**12, else the size with all but its 12 leading bits cleared."""
    bits = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    drop = F.greatest(bits - (EXACT_BITS - 1), F.lit(0))
    return F.when(drop > 0, (size / F.pow(F.lit(2.0), drop)).cast("long") * F.pow(F.lit(2.0), drop).cast("long")).otherwise(size)


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """classes: (class, groups, bytes), in any order. -> (class, first rank, last rank + 1, shard).

    Takes classes from the largest mean size on. While a class has more groups than shards, it fills
    the least-loaded shards to a common level; the rest go one at a time through the heap.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for cls, groups, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        mean, rank = total / groups, 0
        if groups > 2 * shards:
            loads = sorted(heap)
            level, filled = 0.0, 0.0
            for i, (load, _) in enumerate(loads):
                filled += load
                level = (filled + total) / (i + 1)
                if i + 1 == shards or level <= loads[i + 1][0]:
                    break
            heap = []
            for load, s in loads:
                n = min(max(0, int((level - load) // mean)), groups - rank)
                if n:
                    out.append((cls, rank, rank + n, s))
                rank += n
                heap.append((load + n * mean, s))
            heapq.heapify(heap)
        for r in range(rank, groups):
            load, s = heapq.heappop(heap)
            out.append((cls, r, r + 1, s))
            heapq.heappush(heap, (load + mean, s))
    return out


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Adds column `name`: 0, 1, 2 ... within the keys. Rows are counted in `buckets` parts of each key by
    a hash of the order columns; ranks run on from part to part, so a large key is no single task."""
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = cut.withColumn("_inside", inside).join(before.drop("_n"), [*keys, "_part"])
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def shard(docs: DataFrame, shards: int = 40, text: str = "text", ident: str = "doc_id", rows_per_part: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(F.col(ident).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("same")),
        "rows",
    )
    groups = materialise(rows.groupBy("same").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"))), "groups")
    total = groups.agg(F.count("*"), F.sum("copies")).first()
    parts = max(1, -(-(total[0] or 0) // rows_per_part))
    per_class = groups.groupBy("class").agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes"))
    dealt = deal([(r[0], r[1], r[2]) for r in collect_bounded(per_class, 260_000, "the table of size classes")], shards)
    plan = spark.createDataFrame(dealt or [(-1, 0, 0, 0)], "class long, first long, last long, shard int")
    at = ranked(groups, ["class"], ["same"], "rank", parts)
    placed = materialise(_placed(at, plan).select("same", "shard", "copies"), "placed")
    # A group with over 1/2000 of the rows: fewer than 2000 of them whatever the corpus, so they are sent to
    # every task; all other groups are small enough to meet their rows in a shuffle.
    hot = placed.filter(F.col("copies") * 2000 > (total[1] or 0)).select("same", F.col("shard").alias("hot_shard"))
    marked = rows.join(F.broadcast(hot), "same", "left")
    cold = marked.filter(F.col("hot_shard").isNull()).drop("hot_shard").join(placed.select("same", "shard"), "same")
    sharded = marked.filter(F.col("hot_shard").isNotNull()).withColumnRenamed("hot_shard", "shard").select(cold.columns).unionByName(cold)
    out = ranked(sharded.drop("same"), ["shard"], ["doc_id", "text_crc32"], "slot", max(1, -(-(total[1] or 0) // (rows_per_part * shards))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """Shard of each (class, rank): ranges of a class are joined by equal class and by containment of the rank.

    Classes of few groups have a range for each; of many, one for each shard plus under `shards` single ones,
    so a row meets at most 2 * shards ranges.
    """
    hit = (F.col("groups.class") == F.col("plan.class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return groups.alias("groups").join(plan.alias("plan"), hit).select("groups.*", "plan.shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
