"""Streams in many batches and after crashes, and the store on files, give what one clean run gives."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.store import ChunkStore
from tessella.streaming import state
from tessella.streaming.ingest import Queue
from tessella.streaming.queries import drained

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    """A stream with one batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:03}"))
        for f in (tmp_path / "in" / f"b{k:03}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))


def test_cache_over_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(4)), int(rng.choice([50, 200])), T0 + dt.timedelta(seconds=int(s))) for k, s in enumerate(np.sort(rng.choice(5000, 300, replace=False)))]
    batches = [rows[k : k + 30] for k in range(0, 300, 30)]
    got = {r["id"]: (r["hit"], r["stored"]) for r in drained(state.cached(stream_of(spark, tmp_path, batches, "id long, key int, ttl int, ts timestamp"), ["key"], "id", delay="1 second")).collect()}
    stored, want = {}, {}
    for i, key, ttl, ts in rows:
        hit = key in stored and ts < stored[key][1]
        if not hit:
            stored[key] = (ts, ts + dt.timedelta(seconds=ttl))
        want[i] = (hit, stored[key][0])
    assert got == want and any(h for h, _ in got.values())


def test_departures_over_batches(spark, tmp_path):
    beats, late = [], T0 + dt.timedelta(hours=10)
    for worker, spans in {"a": [(0, 4000), (5000, 5400)], "b": [(100, 300)], "c": [(0, 30)]}.items():
        beats += [(worker, T0 + dt.timedelta(seconds=s)) for x, y in spans for s in range(x, y + 1, 30)]
    beats = sorted(beats, key=lambda r: r[1]) + [("z", late), ("z", late + dt.timedelta(seconds=60))]
    batches = [beats[k : k + 25] for k in range(0, len(beats), 25)]
    rows = drained(state.departures(stream_of(spark, tmp_path, batches, "worker string, ts timestamp"), "worker", delay="10 seconds")).collect()
    at = lambda s: T0 + dt.timedelta(seconds=s)
    assert sorted((r["worker"], r["joined"], r["left"], r["beats"]) for r in rows) == [("a", at(0), at(3990 + 120), 60), ("a", at(5000), at(5390 + 120), 14), ("b", at(100), at(280 + 120), 7), ("c", at(0), at(30 + 120), 2)]


# -- the queue


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["taken", "stored", "left"])
def test_queue_loses_and_doubles_nothing_after_a_crash(spark, tmp_path, step):
    batches = [[(k, k % 2) for k in range(n, n + 20)] for n in range(0, 60, 20)] + [[(3, 1), (100, 0)]]
    tasks = stream_of(spark, tmp_path, batches, "id long, priority int")
    store = ChunkStore(spark, str(tmp_path / "chunks"), ["id", "pos"], folders=4)
    work = lambda taken: taken.select("id", F.explode(F.sequence(F.lit(0), F.pmod("id", F.lit(3)).cast("int"))).alias("pos"), F.uuid().alias("run"))
    crashed = []

    def fail(batch, at):
        if batch == 1 and at == step and not crashed:
            crashed.append(1)
            raise Crash

    with pytest.raises(Exception, match="Crash"):
        Queue(spark, str(tmp_path / "q"), store, work, 12, fail).run(tasks)
    Queue(spark, str(tmp_path / "q"), store, work, 12, fail).run(tasks)
    rows = store.read().collect()
    assert sorted((r["id"], r["pos"]) for r in rows) == sorted((k, p) for k in [*range(60), 100] for p in range(k % 3 + 1))
    when = {r["id"]: r["done_in"] for r in rows}
    assert all(when[k] == 0 for k in range(1, 20, 2) if k != 3) and max(when.values()) >= 4
    assert when[3] >= 3  # sent again when it was done: done again, in the place of its old rows


# -- the store


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_store_rewrites_touched_folders_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ["id"], folders=16)
    assert store.read() is None and store.upsert(spark.range(200).withColumn("v", F.lit("old")), 1) == 16
    before = files(tmp_path / "s")
    assert store.upsert(spark.createDataFrame([(7, "new"), (7, "newer"), (500, "new")], "id long, v string"), 2, newest="v") <= 2
    after = files(tmp_path / "s")
    assert len(set(before.items()) & set(after.items())) >= 14
    assert store.upsert(spark.createDataFrame([(8, "again")], "id long, v string"), 2) == 0 and files(tmp_path / "s") == after
    rows = {r["id"]: r["v"] for r in store.read().collect()}
    assert len(rows) == 201 and rows[7] == "newer" and rows[500] == "new" and rows[8] == "old"
    assert [r["v"] for r in store.get({"id": 7}).collect()] == ["newer"]
    assert store.change(F.col("id") < 5, 3, {"v": F.lit("changed")}) == 5 and store.change(F.col("v") == "changed", 4) == 5
    assert store.change(F.col("id") < 50, 4) == 0 and store.read().count() == 196


def test_store_after_a_crash_before_the_version_was_noted(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), ["id"], folders=4)
    store.upsert(spark.range(20).withColumn("v", F.lit(0)), 1)
    batch = spark.range(5, 30).withColumn("v", F.lit(1))
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_note", lambda self, version: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            store.upsert(batch, 2)
    assert store.upsert(batch, 2) == 4
    assert sorted(map(tuple, store.read().collect())) == sorted((k, int(k >= 5)) for k in range(30))
    store.change(F.col("id") >= 0, 3)
    assert store.read().count() == 0


def test_store_takes_new_columns(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ["id"], folders=1)
    store.upsert(spark.createDataFrame([(1, "a")], "id long, v string"), 1)
    store.upsert(spark.createDataFrame([(2, "b", 5)], "id long, v string, extra int"), 2)
    assert {r["id"]: r["extra"] for r in store.read().collect()} == {1: None, 2: 5}
