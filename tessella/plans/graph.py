"""Knowledge-graph queries: records to nodes and edges, merge, ranks, components, contraction, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.index import spread
from ..scratch import dealt
from .base import table
from .registry import query


def _records(spark, sf_dir) -> DataFrame:
    """(doc, text): extraction records of each order line, as a model would write them."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select((F.col("l_orderkey") % 50).alias("doc"), F.concat(
        F.lit('("entity"<|>'), "s_name", F.lit("<|>SUPPLIER<|>nation "), "s_nationkey", F.lit(')##("entity"<|>'), "p_name", F.lit("<|>PART<|>"), "p_type",
        F.lit(')##("relationship"<|>'), "s_name", F.lit("<|>"), "p_name", F.lit("<|>sells<|>sale<|>"), "l_quantity", F.lit(")")).alias("text"))


BASE = """li as (select l_orderkey%50 doc, s_name, s_nationkey, p_name, p_type, l_quantity from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey),
ent as (select doc, upper(s_name) as name, 'SUPPLIER' type, 'nation '||s_nationkey description from li union all select doc, upper(p_name), 'PART', p_type from li),
rel as (select doc, least(upper(s_name),upper(p_name)) a, greatest(upper(s_name),upper(p_name)) b, l_quantity w from li)"""


@query("parse_extractions", "with " + BASE + " select doc, name, type, description, count(*) n from ent group by all")
def parse_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = g.parse_records(_records(spark, sf_dir), "doc", "text")
    return nodes.groupBy("doc", "name", "type", "description").agg(F.count("*").alias("n"))


@query("node_merge", "with " + BASE + """, t as (select name, type, row_number() over (partition by name order by count(*) desc, type) r from ent group by 1,2)
select ent.name, any_value(t.type) type, string_agg(distinct description, '<SEP>' order by description) description, string_agg(distinct doc::varchar, ',' order by doc::varchar) sources from ent join t on t.name=ent.name and r=1 group by 1""")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = g.parse_records(_records(spark, sf_dir), "doc", "text")
    return g.merge_nodes(nodes, "doc").select("name", "type", "description", F.array_join("sources", ",").alias("sources"))


@query("edge_merge", "with " + BASE + " select a, b, sum(w)::double weight, count(distinct doc) docs from rel group by 1,2")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = g.parse_records(_records(spark, sf_dir), "doc", "text")
    one = edges.groupBy("a", "b", "doc").agg(F.sum("weight").alias("weight"))  # folded before sources are counted, so no list of them is made
    return one.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("docs"))


def _edges(spark, sf_dir) -> DataFrame:
    """Supplier and part nodes as numbers: suppliers negative."""
    li = table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("a"), F.col("l_partkey").alias("b"), "l_quantity")
    return dealt(li, li.count(), "a", "b").groupBy("a", "b").agg(F.sum("l_quantity").alias("w"))


E = "e as (select -l_suppkey-1 a, l_partkey b, sum(l_quantity)::double w from lineitem group by 1,2)"


@query("graph_degrees", "with " + E + " select node, count(*) rank from (select a node from e union all select b from e) group by 1")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(_edges(spark, sf_dir)).select("node", F.col("degree").alias("rank"))


def _pagerank_sql(rounds: int) -> str:
    sql = "with " + E + ", u as materialized (select a, b, w from e union all select b, a, w from e), o as materialized (select a, sum(w) t from u group by 1), n as (select count(*) n from o), p0 as materialized (select a node, 1.0/(select n from n) p from o)"
    for k in range(rounds):
        sql += f", p{k + 1} as materialized (select u.b node, 0.15/(select n from n)+0.85*sum(p*w/t) p from p{k} join u on u.a=node join o on o.a=node group by 1)"
    return sql + f" select node, round(p,6) pagerank from p{rounds}"


@query("pagerank_k", _pagerank_sql(5))
def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.pagerank(_edges(spark, sf_dir), rounds=5).select("node", F.round("p", 6).alias("pagerank"))


def _labels_sql(rounds: int) -> str:
    """Rounds of smallest labels, as many as the longest shortest path has edges at least."""
    sql = "with " + E + ", u as materialized (select a, b from e union all select b, a from e), l0 as materialized (select a node, least(a, min(b)) c from u group by a)"
    for k in range(rounds):
        sql += f", l{k + 1} as materialized (select u.a node, least(any_value(own.c), min(l{k}.c)) c from u join l{k} on l{k}.node=u.b join l{k} own on own.node=u.a group by 1)"
    return sql + f" select node, c component from l{rounds}"


@query("graph_components", _labels_sql(10))
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.components(_edges(spark, sf_dir))


@query("contract_nodes", "with " + E + ", m as (select case when a%3=0 then a else a end a, b - b%5 b, w from e) select a, b, sum(w) w from m where a<>b group by 1,2")
def contract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one group become their leader; parallel edges add up, inner edges go."""
    e = _edges(spark, sf_dir)
    leaders = e.select(F.col("b").alias("node")).distinct().withColumn("leader", F.col("node") - F.col("node") % 5)
    return g.contract(e, leaders)


@query("entity_pairs", """with s as (select distinct p_name x, p_brand k from part), c as (select x, k, list_distinct(list_transform(range(1,length(x)), lambda i: substring(x,i,2))) gr from s)
select distinct p.x a, q.x b from c p join c q on p.k=q.k and p.x<q.x where len(list_intersect(p.gr,q.gr))>0 and len(list_filter(p.gr, lambda z: not list_contains(q.gr,z) and regexp_matches(z,'[0-9]')))=0 and len(list_filter(q.gr, lambda z: not list_contains(p.gr,z) and regexp_matches(z,'[0-9]')))=0 and levenshtein(p.x,q.x)<=least(length(p.x),length(q.x))//2""")
def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return g.similar_entities(p, "p_name", "p_brand").distinct()


@query("nhop", "with " + E + """, u as (select a, b from e union all select b, a from e), s as (select distinct a from u where a<0 and (-a-1)%50=0), h1 as (select s.a origin, u.b node, u.a via from s join u on u.a=s.a), h2 as (select h1.origin, u.b node from h1 join u on u.a=h1.node where u.b<>h1.origin)
select origin, node, min(hop)::int hop from (select origin, node, 1 hop from h1 union all select origin, node, 2 from h2) group by 1,2""")
def nhop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each supplier whose number is divisible by 50."""
    e = _edges(spark, sf_dir)
    return g.hops(e, e.where("(-a - 1) % 50 = 0").select(F.col("a").alias("origin")).distinct(), 2)


@query("visible_graph", "with " + E + """, d as (select node, count(*) r from (select a node from e union all select b from e) group by 1), top as (select node from d order by r desc, node limit 256)
select a, b, w from e where a in (select node from top) and b in (select node from top) order by w desc, a, b limit 128""")
def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 128 heaviest edges among the 256 nodes of highest rank (a report of fixed size)."""
    e = _edges(spark, sf_dir)
    top = g.degrees(e).orderBy(F.desc("degree"), "node").limit(256).select("node")
    inner = e.join(top.select(F.col("node").alias("a")), "a", "left_semi").join(top.select(F.col("node").alias("b")), "b", "left_semi")
    return inner.orderBy(F.desc("w"), "a", "b").limit(128).select("a", "b", "w")


@query("graph_without_docs", "with " + BASE + " select a, b, sum(w)::double weight from rel where doc%5<>0 group by 1,2")
def graph_without_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("doc")).where("doc % 5 = 0").distinct()
    _, edges = g.parse_records(_records(spark, sf_dir), "doc", "text")
    return g.merge_edges(edges.join(gone, "doc", "left_anti"), "doc").select("a", "b", "weight")


def _communities_sql(rounds: int, rest: str) -> str:
    sql = "with " + E + ", u as materialized (select a, b, w from e union all select b, a, w from e), ow as materialized (select a node, max(w) w from u group by 1), l0 as (select distinct a node, a c from u)"
    for k in range(rounds):
        sql += f", v{k} as (select node, c, sum(w) w from (select u.a node, l.c, w from u join l{k} l on l.node=u.b union all select node, c, w from l{k} join ow using (node)) group by 1,2), l{k + 1} as materialized (select node, c from (select node, c, row_number() over (partition by node order by w desc, c) r from v{k}) where r=1)"
    return sql + ", com as (select node, c community from l" + str(rounds) + ") " + rest


@query("communities", _communities_sql(4, "select node, community from com"))
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation in a fixed number of rounds; every node is in one community."""
    return g.label_propagation(_edges(spark, sf_dir), rounds=4)
