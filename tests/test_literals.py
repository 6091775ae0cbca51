"""Small cases with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import hooks
from tessella.functions import text as tx
from tessella.operators import graph, pack, search, walks
from tessella.plans import composed
from tessella.plans.catalog import meta_condition, where_condition
from tessella.sources import tables


def test_greedy_overshoots(spark):
    text = "\n".join(" ".join(["w"] * n) for n in (5, 6, 3, 9, 1))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    out = {r["pos"]: len(r["content"].split()) for r in pack.greedy(df, limit=10).collect()}
    assert out == {0: 11, 1: 12, 2: 1}


def test_greedy_of_empty_text_has_no_chunk(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    assert pack.greedy(df, limit=10).count() == 0


def test_evaluation(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, key string, rank int")
    rels = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "query_id int, key string, rel int")
    r = search.evaluate(run, rels).first()
    assert math.isclose(r["ndcg"], 1.5 / (1 + 1 / math.log2(3)), rel_tol=1e-9)
    assert r["mrr"] == 1 and math.isclose(r["map"], (1 + 2 / 3) / 2, rel_tol=1e-9)


def test_similarity_of_weights(spark):
    terms = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.2)], "query_id int, term string, w double")
    posted = spark.createDataFrame([("a", 9), ("c", 9)], "term string, doc int")
    assert math.isclose(search.token_similarity(terms, posted, ["doc"]).first()["similarity"], 0.7, rel_tol=1e-6)


def test_meta_condition(spark):
    df = spark.createDataFrame([("5",), ("abc",)], "v string")
    assert [r["v"] for r in df.where(meta_condition(F.col("v"), ">", "3")).collect()] == ["5", "abc"]
    assert [r["v"] for r in df.where(meta_condition(F.col("v"), "contains", "5")).collect()] == ["5"]


def test_where_condition_skips_empty_values(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "x int, tags array<string>")
    assert where_condition(df, {"x": None, "tags": []}).count() == 2
    assert [r["x"] for r in where_condition(df, {"tags": ["b", "c"]}).collect()] == [2]


def test_entities(spark):
    df = spark.createDataFrame([(x, "T") for x in ("ACME1", "ACME2", "COLOUR", "COLOR", "CAT", "DOG")], "n string, t string")
    assert {(r["a"], r["b"]) for r in graph.similar_entities(df, "n", "t").collect()} == {("COLOR", "COLOUR")}


def test_components_and_contraction(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 2.0), (8, 9, 1.0)], "a int, b int, w double")
    assert {(r["node"], r["component"]) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    lead = spark.createDataFrame([(2, 1)], "node int, leader int")
    assert {(r["a"], r["b"], r["w"]) for r in graph.contract(e, lead).collect()} == {(1, 3, 2.0), (3, 4, 2.0), (8, 9, 1.0)}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 2.0)], "a int, b int, w double")
    assert math.isclose(graph.pagerank(e, 10).agg(F.sum("p")).first()[0], 1.0, rel_tol=1e-9)


def test_text_functions(spark):
    df = spark.createDataFrame([("Ａｂ，Ｃ d/e",)], "t string")
    assert df.select(tx.tokenize(F.col("t"))).first()[0] == ["ab", "c", "d", "e"]
    assert df.select(tx.drop_question_words(F.lit("What is the best of it"))).first()[0] == "best it"
    assert df.select(tx.drop_question_words(F.lit("what is"))).first()[0] == "what is"


def test_delimited_files_with_rejects(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name,size\n1,a,10\n2,b\n3,c,30\n4,d,40\n")
    good, bad = tables.read_delimited(spark, str(tmp_path / "t.csv"))
    assert [(r["line"], r["name"], r["size"]) for r in good.orderBy("line").collect()] == [(1, "a", "10"), (3, "c", "30"), (4, "d", "40")]
    assert good.columns == ["file", "line", "name", "size"] and [(r["line"], r["text"]) for r in bad.collect()] == [(2, "2,b")]
    assert tables.read_delimited(spark, str(tmp_path / "t.csv"), first=1, last=3)[0].count() == 1
    (tmp_path / "u.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_delimited(spark, str(tmp_path / "u.csv"))


def test_documents_by_suffix(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# x\ny")
    (tmp_path / "b.txt").write_text("z")
    got = {(r["name"], r["suffix"], r["route"], r["text"]) for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.MD", "md", "markdown", "# x\ny"), ("b.txt", "txt", "text", "z")}


def test_json_and_json_lines(spark):
    texts = [(1, '{"k": 1}'), (2, '{"k": 1}\nbad\n{"k": 2}\n{"k": 3}\n{"k": 4}\n{"k": 5}'), (3, "no\nno\n{}"), (4, None), (5, '{\n"k": 7\n}')]
    df = spark.createDataFrame(texts, "id int, t string")
    got = tables.json_rows(df, "id", "t").select("id", F.try_variant_get("row", "$.k", "int").alias("k")).collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (5, 7)]


def test_database_query(spark):
    url, driver = "jdbc:derby:memory:tessella;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.sql("select 1 a, date'2024-02-03' d, cast(1.5 as decimal(6,2)) x union all select 2, null, 2.25")
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "T").mode("overwrite").save()
    got = tables.read_database(spark, url, 'select "a" as A, "d" as D, "x" as X from t where "a" > 0', driver=driver)
    assert sorted((r["A"], r["D"] or "", r["X"]) for r in got.collect()) == [(1, "2024-02-03", 1.5), (2, "", 2.25)]


def test_overlap_prefixes_and_character_windows(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f\ng h i")], "doc_id int, text string")
    got = [r["content"] for r in pack.greedy(df, limit=2, overlap=20).orderBy("pos").collect()]
    assert got == ["a b c", "cd e f", " fg h i"]
    text = "x" * 700 + "." + "y" * 900
    got = [r["content"] for r in pack.char_windows(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("win").collect()]
    assert got[0] == text[:701] and got[1] == text[501:1501] and text.endswith(got[-1])


def test_named_models_and_steps(spark):
    df = spark.createDataFrame([(1, "one two two")], "doc_id int, text string")
    v = hooks.with_model(df, "hashed_words", "text", "v", places=8).first()["v"]
    assert sum(v) == 3 and len(v) == 8
    with pytest.raises(ValueError):
        hooks.with_model(df, "none", "text", "v")
    with pytest.raises(ValueError):
        hooks.run_steps(df, '[{"step": "clean"}, {"step": "nothing"}]')


def test_citations(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d", "e"]), (1, 2, ["z"])], "q int, sentence int, tokens array<string>")
    h = spark.createDataFrame([(1, 7, ["a", "b", "x"]), (1, 8, ["c", "d"]), (1, 9, ["q"])], "q int, hit int, tokens array<string>")
    assert {(r["sentence"], r["hit"]) for r in search.cite(s, h, ["q"]).collect()} == {(0, 7), (1, 8)}


def test_highlight_of_a_retrieval(spark):
    hits = spark.createDataFrame([(1, 5, 0, 1.0, 0.5, 2), (1, 6, 0, 0.1, 0.0, 1)], "query_id int, doc_id int, pos int, score double, cosine double, hits int")
    terms = spark.createDataFrame([(1, "red", 0.6), (1, "fox", 0.4)], "query_id int, term string, w double")
    content = spark.createDataFrame([(5, 0, "No sign. A Red fox. End"), (6, 0, "fox")], "doc_id int, pos int, content string")
    r = composed.retrieve(hits, terms, content).collect()
    assert [(x["doc_id"], x["rank"], x["total"], x["in_document"], x["highlight"]) for x in r] == [(5, 1, 1, 1, "A <em>Red</em> <em>fox</em>")]


def test_walk_vectors(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 3, 1.0)], "a long, b long, w double")
    w = walks.walks(e, 2, 3)
    assert w.count() == 18 and {r["node"] for r in walks.walk_vectors(w, size=4).collect()} == {1, 2, 3}


def test_walks_take_edges_and_vectors_tell_groups_apart(spark):
    """Four groups with a few edges between them, and a hub with an edge to every node; in one block and in three."""
    rng = np.random.default_rng(2)
    edges = {(i, j) for i in range(80) for j in range(i) if rng.random() < (0.5 if i // 20 == j // 20 else 0.004)} | {(999, i) for i in range(80)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges)], "a long, b long, w double")
    near = walks.adjacency(df, rows_per_part=100).orderBy("at").collect()
    assert [r["at"] for r in near] == list(range(2 * len(edges))) and {(r["node"], r["next"]) for r in near} == edges | {(b, a) for a, b in edges}
    walked = walks.walks(df, 10, 12)
    steps = {(r["origin"], r["walk"], r["step"]): r["node"] for r in walked.collect()}
    both = edges | {(b, a) for a, b in edges}
    assert len(steps) == 81 * 120 and all((steps.get((o, w, s - 1), o), n) in both for (o, w, s), n in steps.items())
    for blocks in (1, 3):
        got = {r["node"]: np.array(r["vector"]) for r in walks.walk_vectors(walked, size=16, blocks=blocks).collect()}
        assert len(got) == 81
        x = np.stack([got[k] / np.linalg.norm(got[k]) for k in range(80)])
        same = np.arange(80)[:, None] // 20 == np.arange(80) // 20
        sims = x @ x.T
        assert sims[same & ~np.eye(80, dtype=bool)].mean() > sims[~same].mean() + 0.2



def test_pagerank_stops_at_the_tolerance(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 2.0), (4, 1, 1.0)], "a int, b int, w double")
    p = {r["node"]: r["p"] for r in graph.pagerank(e, tolerance=1e-6).collect()}
    assert math.isclose(sum(p.values()), 1, rel_tol=1e-9) and p[3] > p[1]


def test_mail_has_headers_and_text_parts(spark):
    df = spark.sql("select 1 id, map('To','b','From','a') headers, array(named_struct('type','text/html','text','<p>x  y</p>'), named_struct('type','image/png','text','??')) parts")
    assert [(r["kind"], r["text"]) for r in tables.mail_sections(df, "id").orderBy("pos").collect()] == [("headers", "From: a\nTo: b"), ("text/html", "x y")]
