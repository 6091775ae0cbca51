"""Streaming versions: each query runs a stream over files to its end and gives the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pack
from ..operators.store import ChunkStore
from ..plans.registry import query
from ..plans.retrieval import CHUNKS
from ..scratch import scratch_path
from . import state
from .ingest import Queue


def source(spark: SparkSession, sf_dir: str, name: str, files: int | None = 4) -> DataFrame:
    """A table, one file or a folder of them, as a stream of so many files a batch (None: all that are there); event
    times get a time zone, as watermarks ask."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parquet*")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input; every batch is a folder of its own in the shared folder, so a repeated
    batch overwrites itself. In complete and update mode the caller picks the last state of a key."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/rows/e{epoch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/rows")


@query("stream_daily_usage", "select date_trunc('day', ts)::timestamp as day, count(*) n, round(sum(value),2) tokens from events group by 1")
def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = source(spark, sf_dir, "events").withWatermark("ts", "31 days").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("tokens"))
    rows = drained(e.select(F.col("window.start").alias("day"), "n", "tokens"), "update")
    last = rows.groupBy("day").agg(F.max(F.struct("_epoch", "n", "tokens")).alias("r"))
    return last.select("day", "r.n", F.round("r.tokens", 2).alias("tokens"))


@query("stream_counters", "select user_id, event_type, count(*) n from events group by 1,2")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(source(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "update")
    return rows.groupBy("user_id", "event_type").agg(F.max(F.struct("_epoch", "n")).alias("r")).select("user_id", "event_type", "r.n")


@query("stream_dedup", "select user_id, event_type, min(ts) first from events group by 1,2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest counts once. Within the watermark all its repeats are known; the first time is that of the earliest."""
    digest = F.md5(F.concat_ws(":", "user_id", "event_type"))
    e = source(spark, sf_dir, "events").withColumn("digest", digest).withWatermark("ts", "60 days").groupBy("digest", "user_id", "event_type").agg(F.min("ts").alias("first"))
    rows = drained(e, "update")
    return rows.groupBy("user_id", "event_type").agg(F.min("first").alias("first"))


@query("stream_cancel", "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_custkey%3=0)")
def stream_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return drained(source(spark, sf_dir, "events").select("event_id", "user_id").join(gone, "user_id", "left_anti")).select("event_id", "user_id")


@query("stream_ingest", r"select doc_id, count(*) n from (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) l from documents) where trim(l)<>'' group by 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to line chunks as they arrive; a repeated batch writes the same rows again."""
    d = source(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "l")).where(F.trim("l") != "")
    rows = drained(d.select("doc_id", "pos", F.md5("l").alias("id")))
    return rows.dropDuplicates(["doc_id", "pos"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("stream_liveness", """with x as (select user_id, ts, case when ts-lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end f from events), y as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from x)
select user_id, min(ts) first, count(*) beats from y group by user_id, s""")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a worker: a gap of six hours or more ends one."""
    e = source(spark, sf_dir, "events").withWatermark("ts", "60 days").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("beats"))
    rows = drained(e.select("user_id", F.col("w.start").alias("first"), "beats"), "complete")
    last = rows.agg(F.max("_epoch").alias("_epoch"))
    return rows.join(F.broadcast(last), "_epoch").select("user_id", "first", "beats")


@query("stream_cache", """with recursive req as materialized (select event_id, ts, user_id||':'||event_type k, case when event_type='view' then interval 600 seconds else interval 86400 seconds end ttl from events),
nxt as materialized (select a.k, a.ts, b.ts n from (select k, ts, ts+ttl e from req) a asof left join req b on a.k=b.k and a.e <= b.ts),
miss as (select k, min(ts) s from req group by k union select nxt.k, nxt.n from miss join nxt on nxt.k=miss.k and nxt.ts=miss.s where nxt.n is not null)
select event_id, s <> req.ts hit, s stored from req asof join miss on miss.k=req.k and req.ts >= miss.s""")
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept for 24 hours, those of one kind (tags) for 10 minutes: which requests find one, and when it was stored."""
    ttl = F.when(F.col("event_type") == "view", 600).otherwise(86_400)
    requests = source(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", ttl.alias("ttl"))
    return drained(state.cached(requests, ["user_id", "event_type"], "event_id")).select("event_id", "hit", "stored")


@query("worker_departures", """with b as (select user_id%10 worker, ts from events), x as (select *, case when ts-lag(ts) over (partition by worker order by ts) <= interval 120 seconds then 0 else 1 end f from b),
y as (select *, sum(f) over (partition by worker order by ts rows unbounded preceding) s from x), z as (select *, max(ts) over (partition by worker, s) last from y),
g as (select worker, s, min(ts) joined, max(last) + interval 120 seconds as left_at, count(case when ts > last - interval 1800 seconds then 1 end) beats, max(s) over (partition by worker) top from z group by worker, s)
select worker, joined, left_at as "left", beats from g where s < top or left_at < (select max(ts) - interval 10 minutes from events)""")
def worker_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers (users by their last digit) that fell silent for 120 seconds, with their beats of the half hour before."""
    beats = source(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("worker"), "ts")
    return drained(state.departures(beats, "worker")).select("worker", "joined", "left", "beats")


@query("stream_queue", "with recursive " + CHUNKS.lstrip() + """, t as (select doc_id, (row_number() over (order by case when doc_id%4=0 then 1 else 0 end desc, doc_id) - 1) // greatest(1, (select count(*) from documents)//4) done_in from documents)
select doc_id, done_in::int done_in, count(pos) n from t left join chunks using (doc_id) group by 1, 2 having count(pos) > 0""")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks of two priorities, a quarter of them in a batch: in which batch each was chunked, and its chunks.
    All wait from the start, however many files hold them, so that none of low priority is done before one of high priority."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = source(spark, sf_dir, "documents", files=None).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("priority"))
    path = scratch_path(spark, "queue")
    store = ChunkStore(spark, f"{path}/chunks", ["doc_id", "pos"])
    work = lambda taken: pack.greedy(docs.join(taken.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), limit=128)
    Queue(spark, path, store, work, capacity=max(1, docs.count() // 4)).run(tasks)
    return store.read().groupBy("doc_id", "done_in").agg(F.count("*").alias("n"))
