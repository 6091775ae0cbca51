"""Knowledge graphs further on: checks, merges, verdicts, communities with their contexts and reports, walks, topic trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import walks
from ..scratch import materialise
from .base import table
from .graph import BASE, E, _communities_sql, _edges, _records
from .registry import query


@query("subgraph_validation", "with " + BASE + """, ok as (select distinct name from ent where description<>'' and not (type='PART' and description='ECONOMY')),
e as (select distinct a, b from rel) select a, b from e where a in (select name from ok) and b in (select name from ok)""")
def subgraph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are nodes with a description that counts. An entity's record is read once, however many lines repeat it."""
    texts = _records(spark, sf_dir)
    told = texts.select(F.lit(0).alias("doc"), F.explode(F.split("text", "##")).alias("text")).where(F.col("text").contains('"entity"')).distinct()
    nodes, (_, edges) = g.parse_records(told, "doc", "text")[0], g.parse_records(texts, "doc", "text")
    ok = nodes.where("description <> '' and not (type = 'PART' and description = 'ECONOMY')").select("name").distinct()
    return g.with_both_ends(edges.select("a", "b").distinct(), ok, "name")


@query("graph_merge", "with " + BASE + """, m as (select a, b, sum(w)::double weight, count(distinct doc) sources from rel group by 1,2), d as (select node, count(*) r from (select a node from m union all select b from m) group by 1)
select a, b, weight, sources, x.r+y.r as rank from m join d x on x.node=a join d y on y.node=b""")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of two groups of documents merged: weights add up, sources join, an edge's rank is its ends' degrees."""
    _, edges = g.parse_records(_records(spark, sf_dir), "doc", "text")
    first, second = (edges.where(c).groupBy("a", "b").agg(F.sum("weight").alias("w"), F.countDistinct("doc").alias("n")) for c in ("doc < 25", "doc >= 25"))
    m = materialise(first.unionByName(second).groupBy("a", "b").agg(F.sum("w").alias("weight"), F.sum("n").alias("sources")), "merged")
    d = g.degrees(m)
    end = lambda c: d.select(F.col("node").alias(c), F.col("degree").alias(f"r{c}"))
    return m.join(end("a"), "a").join(end("b"), "b").select("a", "b", "weight", "sources", (F.col("ra") + F.col("rb")).alias("rank"))


@query("verdict_parse", """with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) k, o_orderstatus from orders)
select o_custkey batch, k::int as pair from o where o_orderstatus='F' and k<=10""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pairs from a model's answers on numbered questions; numbers beyond the batch of ten are ignored."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    said = F.concat(F.lit("Question <|"), "k", F.lit("|>: "), F.when(F.col("o_orderstatus") == "F", "Yes, the two are the same").otherwise("No, they differ"))
    answers = table(spark, sf_dir, "orders").withColumn("k", k).groupBy(F.col("o_custkey").alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("s")))), lambda x: x["s"]), "##").alias("text"))
    return g.accepted(answers, "batch", "text", 10)


@query("community_context", _communities_sql(4, """, big as (select community from com group by 1 having count(*)>1),
i as (select x.community, e.a, e.b, e.w, row_number() over (partition by x.community order by e.w desc, e.a, e.b) r from e join com x on x.node=e.a join com y on y.node=e.b and y.community=x.community)
select community, a, b, w from i where r<=10000 and community in (select community from big)""").replace(") , big", "), big"))
def community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner edges of each community of two nodes or more, the 10,000 heaviest (what a report can hold)."""
    e = _edges(spark, sf_dir)
    c = materialise(g.label_propagation(e, rounds=4), "communities")
    inner = g.inner_edges(e, c)
    w = Window.partitionBy("community").orderBy(F.desc("w"), "a", "b")
    return inner.withColumn("r", F.row_number().over(w)).where("r <= 10000").drop("r")


@query("community_reports", _communities_sql(4, """, d as (select node, count(*) r from (select a node from e union all select b from e) group by 1),
t as (select community, com.node, r, row_number() over (partition by community order by r desc, com.node) k, count(*) over (partition by community) n from com join d on d.node=com.node)
select community, '# Community '||community||chr(10)||chr(10)||any_value(n)||' nodes'||chr(10)||chr(10)||string_agg('## Node '||node||chr(10)||'rank '||r, chr(10)||chr(10) order by k) as report from t where k<=3 and n>1 group by 1""").replace(") , d as", "), d as"))
def community_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from model answers in JSON: title, summary and findings as text; answers that lack a part are left out."""
    e = _edges(spark, sf_dir)
    c = materialise(g.label_propagation(e, rounds=4), "communities").join(g.degrees(e), "node")
    w = Window.partitionBy("community")
    t = c.withColumn("k", F.row_number().over(w.orderBy(F.desc("degree"), "node"))).withColumn("n", F.count("*").over(w)).where("k <= 3 and n > 1")
    finding = F.struct(F.concat(F.lit("Node "), "node").alias("summary"), F.concat(F.lit("rank "), "degree").alias("explanation"))
    said = t.groupBy("community", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", finding.alias("f")))), lambda x: x["f"]).alias("findings"))
    answer = F.to_json(F.struct(F.concat(F.lit("Community "), "community").alias("title"), F.concat("n", F.lit(" nodes")).alias("summary"), F.lit(5.0).alias("rating"), "findings"))
    return g.reports(said.select("community", answer.alias("answer")), "community", "answer")


@query("graph_chunks", "with " + BASE + r"""select md5(name||':entity') id, name, 'entity' kind, count(distinct doc) sources, len(list_filter(string_split(regexp_replace(lower(name),'[^\p{L}\p{N}_]+',' ','g'),' '), lambda x: x<>''))::int n_tokens from ent group by name
union all select md5(a||':'||b), a||' - '||b, 'relation', count(distinct doc), len(list_filter(string_split(regexp_replace(lower(a||' - '||b),'[^\p{L}\p{N}_]+',' ','g'),' '), lambda x: x<>''))::int from rel group by a, b""")
def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations as rows of the chunk store."""
    nodes, edges = g.parse_records(_records(spark, sf_dir), "doc", "text")
    return g.chunk_rows(nodes, edges, "doc")


@query("random_walks", "with " + E + """, u as materialized (select distinct a, b from (select a, b from e union all select b, a from e)), k as materialized (select a, b, row_number() over (partition by a order by b) - 1 i, count(*) over (partition by a) d from u), n as (select distinct a node from u),
w0 as (select node origin, k::int walk, node from n, (select unnest([1,2]) k)),
""" + ",\n".join(f"w{s + 1} as materialized (select origin, walk, k.b node from w{s} join k on k.a=w{s}.node and k.i=('0x'||substring(md5(origin||':'||walk||':{s}'),1,8))::bigint % k.d)" for s in range(3)) + """
select origin, walk, 1 step, node from w1 union all select origin, walk, 2, node from w2 union all select origin, walk, 3, node from w3""")
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two walks of three steps from each node; the choice of the next node is by a hash, so a repeated task takes the same way."""
    return walks.walks(_edges(spark, sf_dir), walks=2, steps=3)


@query("topic_tree", """with p as (select 'root' l0, c_nationkey::varchar l1, c_mktsegment l2, (c_custkey%7)::varchar l3 from customer),
a as (select l0 path, 0 depth, count(*) n from p group by 1 union all select l0||'/'||l1, 1, count(*) from p group by 1 union all select l0||'/'||l1||'/'||l2, 2, count(*) from p group by 1 union all select l0||'/'||l1||'/'||l2||'/'||l3, 3, count(*) from p group by 1)
select path, depth::int depth, n as leaves from a""")
def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of many texts merged by their paths under one root: each node once, with the leaves that came below it."""
    paths = table(spark, sf_dir, "customer").select(F.array(F.col("c_nationkey").cast("string"), "c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("path"))
    return g.merged_trees(paths, "path")
