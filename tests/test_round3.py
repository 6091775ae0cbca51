"""Queries at sizes and shapes of tables that the smallest ones don't have, against their SQL and by their plans."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.functions import segment
from tessella.llm import decontam
from tessella.operators import index, leiden, walks

DIR = "/root/testdata/sf0.001"


def twin(sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet{'' if (sf_dir / (t + '.parquet')).is_file() else '/*.parquet'}'")
    return con.execute(catalogue.oracle_sql()[name]).df()


def same(ours, twin):
    cols = sorted(ours.columns)
    rows = lambda df: sorted(tuple(float(x) if isinstance(x, (int, float)) else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))
    return cols == sorted(twin.columns) and rows(ours) == rows(twin)


@pytest.mark.parametrize("name", ["weighted_fusion", "hybrid_rerank"])
def test_documents_without_a_vector_have_a_cosine_of_zero(spark, tmp_path, name):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same(catalogue.queries()[name](spark, str(tmp_path)).toPandas(), twin(tmp_path, name, ["documents", "benchmark", "embeddings"]))


def test_data_sets_are_paged_by_nation_not_by_user(spark, tmp_path):
    for t in ("customer", "supplier"):
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        many = df.unionByName(df.withColumns({df.columns[0]: F.col(df.columns[0]) + 1_000_000})).unionByName(df.limit(3).withColumns({df.columns[0]: F.col(df.columns[0]) + 2_000_000, df.columns[2]: F.lit(None).cast(df.schema[2].dataType)}))
        many.write.parquet(str(tmp_path / f"{t}.parquet"))
    found = catalogue.queries()["dataset_list"](spark, str(tmp_path))
    assert same(found.toPandas(), twin(tmp_path, "dataset_list", ["customer", "supplier"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("c_custkey" in line for line in plan.splitlines() if "Window" in line)


def test_folders_have_no_limit_of_rows(spark, tmp_path):
    tables = ["region", "nation", "customer"]
    for t in tables:
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, 100)  # the 0.001 tables have more rows than that, as tables of 1 GB have more than the default
    try:
        assert same(catalogue.queries()["folder_rollup"](spark, str(tmp_path)).toPandas(), twin(tmp_path, "folder_rollup", tables))
    finally:
        spark.conf.unset(limit)


def test_queue_of_many_files_takes_the_first_by_priority(spark, tmp_path):
    spark.read.parquet(f"{DIR}/documents.parquet").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(catalogue.queries()["stream_queue"](spark, str(tmp_path)).toPandas(), twin(tmp_path, "stream_queue", ["documents"]))


def test_a_similarity_on_a_half_is_rounded_upwards(spark, tmp_path):
    """Both words of a query stand in chunk 1, so its token share is 1, and its rank is 0.01: 0.31 + 0.7 * 0.0365 is a half of the fourth digit."""
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "doc_id long, text string").selectExpr("*", "'en' lang", "'web' source", "10L n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    cosines = {n: (2 * n + 1) / 10000 for n in range(100, 700)}
    spark.createDataFrame([(n, "alpha beta") for n in cosines], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    vectors = [(1, [1.0, *[0.0] * 63], 0)] + [(n, [c, math.sqrt(1 - c * c), *[0.0] * 62], 0) for n, c in cosines.items()]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    ours = catalogue.queries()["retrieve"](spark, str(tmp_path)).toPandas()
    assert same(ours, twin(tmp_path, "retrieve", ["documents", "benchmark", "embeddings"]))
    assert {r.query_id: r.sim for r in ours[ours.doc_id == 1].itertuples()} == {n: math.floor((31000 + 7 * (2 * n + 1)) / 10 + 0.5) / 10000 for n in cosines}


def test_texts_go_to_python_once_to_be_decontaminated(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    cut = decontam.stage(spark, docs, DIR)
    for plan, most in ((cut, 1), (decontam.op6_decontamination(spark, DIR), 1)):
        lines = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x]
        assert len(lines) <= most
    assert "body" not in decontam.report(docs, spark.read.parquet(f"{DIR}/benchmark.parquet"), body="none").columns
    bad = {r["doc_id"]: r for r in decontam.report(docs.select("doc_id", "text"), spark.read.parquet(f"{DIR}/benchmark.parquet")).select("row.doc_id", "body", "spans", "contaminated").collect()}
    want = {k: decontam.cut_words(r["body"], decontam.merged([(x["start"], x["end"]) for x in r["spans"]])) if r["contaminated"] else r["body"] for k, r in bad.items()}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert any(r["contaminated"] for r in bad.values()) and got == {k: t for k, t in want.items() if not bad[k]["contaminated"] or t.strip()}


def test_graph_retrieval_writes_no_similarity_of_each_query_and_node(spark, tmp_path, monkeypatch):
    """Edges of both signs and equal products; what is written between its jobs stays far below queries times nodes."""
    from tessella import scratch
    from tessella.operators import search
    from tessella.plans import hybrid

    rng = np.random.default_rng(3)
    spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 4000), rng.integers(0, 900, 4000), rng.integers(1, 4, 4000), strict=True)], "l_suppkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, [float(x) for x in rng.standard_normal(64)]) for k in range(1000)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    written = []

    def counted(df, name="step"):
        out = scratch.materialise(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(hybrid, "materialise", counted)
    monkeypatch.setattr(search, "materialise", counted, raising=False)
    ours = catalogue.queries()["graph_retrieval"](spark, str(tmp_path)).toPandas()
    assert same(ours, twin(tmp_path, "graph_retrieval", ["lineitem", "embeddings"]))
    assert max(n for name, n in written if name != "edges") < 20 * 900 / 4


def test_a_dictionary_of_many_words_is_cut_into_mapped_tries(spark):
    """More words than `most` were an error; the cuts are those of one trie, with words of one letter and without the last letters."""
    rng = np.random.default_rng(5)
    letters = list("abcdé東𝒳")
    words = {"".join(rng.choice(letters, rng.integers(1, 6))): int(rng.integers(1, 500)) for _ in range(400)}
    table = spark.createDataFrame([*words.items(), ("zzz", 0)], "word string, n long")
    one = segment.Trie(sorted(words.items()))
    many = segment.trie_of(table, most=100)
    few = segment.written(table, per_part=20)
    texts = ["".join(rng.choice([*letters, "q"], rng.integers(0, 80))) for _ in range(200)]
    want = [one.starts(t) for t in texts]
    assert many.starts_of(texts) == want and few.starts_of(texts) == want
    assert few.parts > 10 and list(segment.cuts_of(texts, few, letters=300)) == [segment.cut(t, one) for t in texts]


def test_blocks_of_node_vectors_are_tasks_of_their_own_and_as_many_as_pairs_ask_for(spark, monkeypatch):
    """Four small blocks were put into one task, and a number of blocks that was given stood however many pairs there were."""
    seen = []

    def counted(df, name="step"):
        from tessella import scratch

        out = scratch.materialise(df, name)
        if name == "vectors":
            seen.append(out.inputFiles())
        return out

    monkeypatch.setattr(walks, "materialise", counted)
    monkeypatch.setattr(walks, "PAIRS", 10)
    walked = walks.walks(spark.createDataFrame([(i, (i * 7 + j) % 60, 1.0) for i in range(60) for j in (1, 2, 3)], "a long, b long, w double"), walks=2, steps=3)
    assert walks.walk_vectors(walked, size=4, epochs=1, blocks=2).count() == 60
    assert len(seen) > 3 and len([f for f in seen[1] if "part-" in f]) > 2
    m, at, steps = np.zeros((5, 2)), np.array([3, 1, 3, 3, 0]), np.arange(10.0).reshape(5, 2)
    walks._add(m, at, steps)
    want = np.zeros((5, 2))
    np.add.at(want, at, steps)
    assert np.allclose(m, want)


@pytest.mark.parametrize("small", [1_000_000, 60])
def test_levels_of_small_scopes_are_made_in_tasks(spark, monkeypatch, small):
    """Each level of each scope was a series of jobs. Groups of groups, in tasks from the start and after rounds on Spark."""
    monkeypatch.setattr(leiden, "SMALL", small)
    rng = np.random.default_rng(4)
    prob = lambda i, j: 0.9 if i // 5 == j // 5 else 0.3 if i // 20 == j // 20 else 0.01
    edges = [(i, j, 1.0) for i in range(80) for j in range(i) if rng.random() < prob(i, j)] + [(3, 3, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    rows = leiden.hierarchy(df, most=6, whole=True).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before
    assert small == 60 or jobs < 60
    label = spark.createDataFrame([(r["node"], r["community"]) for r in rows if r["level"] == 0], "node long, c long")
    assert leiden.modularity(leiden.both_ways(df), label).first()["modularity"] > 0.55
    by = {}
    for r in rows:
        by.setdefault(r["level"], {})[r["node"]] = r
    assert set(by[0]) == set(range(80)) and all(r["parent"] is None for r in by[0].values()) and len(by) > 1
    for level, nodes in by.items():
        for n, r in nodes.items():
            assert r["final"] == (r["size"] <= 6) or (r["final"] and level > 0)
            assert (n in by.get(level + 1, {})) == (not r["final"])
            assert r["size"] == sum(x["community"] == r["community"] for x in nodes.values()) and r["community"] == min(m for m, x in nodes.items() if x["community"] == r["community"])
            assert not level or r["parent"] == by[level - 1][n]["community"]
        assert max(r["weight"] for r in nodes.values()) == 1.0


def test_postings_are_counted_in_their_rows(spark):
    """Words of a chunk were grouped after the shuffle, in two maps of all rows of a task."""
    texts = [["b", "a", "b", "é", "b"], [], ["x"], None, ["a", "a"]]
    chunks = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, pos int, w array<string>")
    kept = index.Index.build(chunks, {"content": F.col("w")})
    rows = {(r["doc_id"], r["term"], r["tf"], r["dl"]) for r in kept.every_posting().collect()}
    assert rows == {(0, "a", 1, 5), (0, "b", 3, 5), (0, "é", 1, 5), (2, "x", 1, 1), (4, "a", 2, 2)}
    plan = chunks.select(F.explode(index.counted(F.col("w"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
