"""Inverted lists against exact search."""

import numpy as np
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.operators import ann, search

DIR = "/root/testdata/sf0.1"


def test_recall_on_given_vectors(spark):
    """Queries are all vectors whose number is divisible by 50; those with a filter are set against an exact search with it."""
    found = {}
    for r in catalogue.queries()["knn_lists"](spark, DIR).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids, labels = np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for k in np.flatnonzero(ids % 50 == 0):
        score = x @ x[k]
        score[k] = -2
        if ids[k] % 100:
            score[labels % 2 == 1] = -2
        best = ids[np.argsort(-score)[:10]]
        mine = found[ids[k]]
        hits.append(len(set(best.tolist()) & set(mine)) / 10)
        assert all(abs(s - score[ids == v][0]) < 2e-6 for v, s in mine.items()) and len(mine) == 10
    assert np.mean(hits) >= 0.9


def test_lists_hold_all_rows_and_edges(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0], k % 2) for k in range(400)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0, 0.0, 0.0], 1), (1003, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    lists = ann.Lists(df, per_cell=50)
    assert lists.rows.count() == 401
    q = df.where("vec_id in (3, 4)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = lists.search(q, 5, where=F.col("label") == 1).collect()
    assert len(got) == 10 and all(r["vec_id"] % 2 == 1 and r["vec_id"] != r["query_id"] for r in got) and min(r["score"] for r in got) > 0.999
    none = ann.Lists(df.limit(0))
    assert none.search(q, 5).count() == 0


def test_exact_search_with_ties(spark):
    rows = [(k, [1.0, float(k % 3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    got = search.knn(df, df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 4, block=1, part=7).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, q + 3 * j) for q in range(3) for j in range(1, 5)}
