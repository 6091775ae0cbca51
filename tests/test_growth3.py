"""What larger tables ask of the queries: results against plain ways, and how many rows go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.functions import text as tx
from tessella.operators import index, search
from tessella.plans import base

from .test_round3 import same, twin

DIR = "/root/testdata/sf0.001"


def test_chunks_of_one_score_go_on_up_to_the_best(spark):
    """A thousand chunks tie; each batch gives out the first by their keys, not all, and no score is lost."""
    terms = spark.createDataFrame([(q, t, w) for q in (1, 2) for t, w in (("a", 0.1), ("b", 0.2), ("c", 0.7))], "query_id long, term string, w double")
    posted = spark.range(1000).selectExpr("id doc_id", "0 pos", "explode(array('a', 'b')) term").coalesce(1)
    found = search.match(terms, posted, ["doc_id", "pos"], best=10).collect()
    assert len(found) <= 4 * 2 * 10 and {(q, d) for q in (1, 2) for d in range(10)} <= {(r["query_id"], r["doc_id"]) for r in found}
    assert {r["score"] for r in found} == {0.1 + 0.2}


def test_classes_and_missing_terms_and_values(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), 0, t, float(rng.random())) for d in range(300) for t in "abcdef" if rng.random() < 0.5]
    posted = spark.createDataFrame(rows, "doc_id long, pos int, term string, x double")
    terms = spark.createDataFrame([(q, t, float(rng.random())) for q in range(3) for t in "abcd"], "query_id long, term string, w double")
    apart = spark.createDataFrame([(d, d % 2) for d in range(0, 300, 3)], "doc_id long, given int")
    for how in ({"best": 5, "apart": apart}, {"missing": 1}, {"value": "x", "best": 5}):
        few = search.match(terms, posted, ["doc_id", "pos"], **how)
        every = search.match(terms, posted, ["doc_id", "pos"], sent_rows=0, **{k: v for k, v in how.items() if k != "best"})
        by = ["query_id", *(["given"] if "apart" in how else [])]
        top = lambda df: {tuple(r) for r in df.select(*by, "doc_id", F.round("score", 9), F.expr(f"row_number() over (partition by {', '.join(by)} order by round(score, 4) desc, doc_id)").alias("k")).where("k <= 5" if "best" in how else "true").drop("k").collect()}  # noqa: B023, E731
        assert top(few) == top(every)


def test_titles_are_posted_once_a_document(spark):
    kept = base.kept_index(spark, DIR)
    assert kept.every_posting("title").groupBy("doc_id", "term").count().where("count > 1").count() == 0
    chunks = kept.store.select("doc_id", "pos", F.explode(F.array_distinct(tx.tokenize(F.col("title")))).alias("term"))
    assert sorted(map(tuple, kept.terms("title").collect())) == sorted(map(tuple, chunks.groupBy("term").count().collect()))


@pytest.mark.parametrize("name", ["best_fields", "bm25_retrieval", "external_rerank", "retrieval_eval"])
def test_words_with_strokes_long_titles_and_ties(spark, tmp_path, name):
    lines = ["alpha_beta gamma", "gamma delta?", "beta alpha", "delta_ _ alpha", "src1 gamma"]
    texts = [(d, "\n".join(" ".join([lines[(d + k) % 5]] * (1 + 40 * (d % 4))) for k in range(1 + d % 9)), f"src{d % 3}") for d in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").selectExpr("*", "'en' lang", "10L n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    asks = ["alpha beta", "gamma delta", "src1 gamma alpha", "alpha_beta gamma", "delta", "nothing here"]
    spark.createDataFrame(list(enumerate(asks)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, d % 2, 0) for d in range(0, 60, 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(d, [1.0] * 64, 0) for d in range(3)], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same(catalogue.queries()[name](spark, str(tmp_path)).toPandas(), twin(tmp_path, name, ["documents", "benchmark", "labels", "embeddings"]))


def test_partitions_grow_with_the_rows(spark):
    from tessella import scratch
    from tessella.operators import graph

    e = spark.range(2000).selectExpr("id % 50 a", "1000 + id % 97 b", "1.0D w")
    assert scratch.dealt(e, 2000, "a", each=100).rdd.getNumPartitions() == 20 and scratch.dealt(e, 2000, "a").rdd.getNumPartitions() == e.rdd.getNumPartitions()
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(graph, "dealt", lambda df, rows, *keys, each=500_000: scratch.dealt(df, rows, *keys, each=500))
            assert graph.links(e).rdd.getNumPartitions() >= 1
            few = sorted(map(tuple, graph.label_propagation(e, 3).collect())), sorted(map(tuple, graph.components(e).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert few == (sorted(map(tuple, graph.label_propagation(e, 3).collect())), sorted(map(tuple, graph.components(e).collect())))


def test_ends_that_share_a_node(spark):
    from tessella.operators import graph

    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 300), rng.integers(100, 112, 300), strict=True)}
    want = {(x, z): sum((z, b) in edges for a, b in edges if a == x) for x, _ in edges for z, _ in edges if x != z}
    df = spark.createDataFrame([*edges, *list(edges)[:50]], "a long, b long")
    found = graph.shared_ends(df, block=4, each=100).collect()
    assert {(r["x"], r["z"]): r["paths"] for r in found} == {k: n for k, n in want.items() if n} and len(found) == len({(r["x"], r["z"]) for r in found})


def test_a_long_line_gives_its_last_clause_in_one_pass(spark, tmp_path):
    """A pattern that is tried from each place of this line takes minutes."""
    texts = ["a" * 400_000, "b " * 200_000 + ". a title that is long enough here:", "x. y: another title of some length：", ":", "no: colon at the end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["colon_titles"](spark, str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in found.where("part = 0").collect()} == {(1, "a title that is long enough here"), (2, "y: another title of some length")}
    assert found.where("part = 1").count() == 5


def test_markdown_rows_leave_python_a_few_texts_at_a_time(spark):
    from tessella.functions import markdown

    docs = spark.createDataFrame([(k, f"# h{k}\n\ntext {k}" if k % 3 else None) for k in range(100)], "doc_id long, text string").coalesce(1)
    rows = markdown.block_rows(docs, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["pos"], r["content"]) for r in rows) == sorted(x for k in range(100) if k % 3 for x in ((k, 0, f"# h{k}"), (k, 1, f"text {k}")))
    plan = catalogue.queries()["markdown_chunks"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_tasks_of_the_index_hold_so_many_letters_however_many_chunks(spark, monkeypatch):
    """Few long chunks in one split are dealt to tasks and files by their letters; what is posted stays the same."""
    rng = np.random.default_rng(7)
    texts = {d: [f"w{k}" for k in rng.integers(0, 900, 500)] for d in range(200)}
    rows = [(d, p, " ".join(w[p * 250 : (p + 1) * 250]), " ".join(w[:3])) for d, w in texts.items() for p in (0, 1)]
    monkeypatch.setattr(index, "PER_TASK", 20_000)
    monkeypatch.setattr(index, "PER_SLICE", 120_000)
    monkeypatch.setattr(index, "PER_BLOCK", 4)
    store = spark.createDataFrame(rows, "doc_id long, pos int, content string, title string").coalesce(1)
    kept = index.Index.build(store, {f: tx.tokenize(F.col(f)) for f in ("content", "title")}, whole=("title",))
    letters = sum(len(t) for _, _, t, _ in rows)
    assert (kept.n, kept.letters) == (len(rows), letters) and kept.fullest > 20_000
    held = kept._dealt(kept.store).groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).agg(F.max("n")).first()[0]
    assert held < 3 * 20_000 < letters / 5
    posted = kept.every_posting().withColumn("file", F.input_file_name())
    files = posted.groupBy("bucket", "file").agg(F.count_distinct(F.pmod("block", F.lit(-(-letters // 120_000)))).alias("slices")).collect()
    assert {r["slices"] for r in files} == {1} and len(files) > 3 * len({r["bucket"] for r in files})
    want = sorted((w, d, p, t.split().count(w)) for d, p, t, _ in rows for w in set(t.split()))
    assert sorted(map(tuple, posted.select("term", "doc_id", "pos", "tf").collect())) == want
    for name, asks in (("content", ["w1", "w5", "none"]), ("title", ["w1", "w5"])):
        every = dict(map(tuple, kept.terms(name).collect()))
        asked, fresh = spark.createDataFrame([(t,) for t in asks * 2], "term string"), index.Index(kept.store, kept.tokens, kept.n, kept.whole)
        for most in (1_000_000, 1):
            assert dict(map(tuple, fresh.counts(asked, name, most).collect())) == {t: every[t] for t in asks if t in every} == dict(map(tuple, kept.counts(asked, name).collect()))
    titles = sorted((w, d, 0, 2) for d, p, _, t in rows if p == 0 for w in set(t.split()))
    assert sorted(map(tuple, kept.every_posting("title").select("term", "doc_id", "pos", "copies").collect())) == titles


def test_weighted_questions_write_no_postings(spark, monkeypatch):
    """Only the asked words are counted in the chunks; the same rows come from an index that has its postings."""
    monkeypatch.setattr(index, "_KEPT", {})
    ask = lambda: sorted(map(tuple, catalogue.queries()["weighted_query"](spark, DIR).collect()))
    plain, kept = ask(), base.kept_index(spark, DIR)
    assert plain and not kept.fields
    kept.every_posting()
    assert ask() == plain
