"""Questions to a knowledge graph: entities and relations by similarity, raised by types and by what lies a few steps away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .search import knn, sent


def heaviest(edges: DataFrame, beam: int) -> DataFrame:
    """(x, y, w): each node's `beam` heaviest neighbours, so that a hub has no more ways on than any other node."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y"))).where(F.col("r") <= beam).drop("r")


def reached(hits: DataFrame, edges: DataFrame, hops: int, beam: int) -> DataFrame:
    """(query_id, a, b, sim, w): edges within `hops` steps of the hit nodes(query_id, node, sim), with the sum of sim / (2 + step).

    A path keeps the nodes it has been at and does not come back. Of all paths from one hit of a query the `beam`
    heaviest go on after each step, so the frontier has at most that many rows a hit, whatever the graph.
    """
    near = materialise(heaviest(edges, beam), "near")
    last = hits.select("query_id", F.col("node").alias("origin"), "sim", "node", F.array("node").alias("been"))
    found = None
    for k in range(hops):
        step = last.join(near, last.node == near.x).where(~F.array_contains("been", F.col("y")))
        order = Window.partitionBy("query_id", "origin").orderBy(F.desc("w"), "x", "y", F.col("been"))
        step = materialise(step.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).select("query_id", "origin", "sim", "x", "y", "w", "been"), "frontier")
        one = step.select("query_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("sim") / (2 + k)).alias("part"), "w")
        found = one if found is None else found.unionByName(one)
        last = step.select("query_id", "origin", "sim", F.col("y").alias("node"), F.array_append("been", F.col("y")).alias("been"))
    return found.groupBy("query_id", "a", "b").agg(F.sum("part").alias("sim"), F.max("w").alias("w"))


def graph_search(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, communities: DataFrame | None = None, candidates: int = 56, least: float = 0.3, hops: int = 2, beam: int = 32, entities: int = 6, relations: int = 6, budget: int = 8196
) -> DataFrame:
    """(query_id, kind, x, y, score, rank) of queries(query_id, q, types): the best entities, relations and community.

    nodes(node, kind, rank, v, tokens), edges(a, b, w) between nodes. An entity's score is its similarity, doubled
    if its kind is asked for, times its rank. A relation's similarity is that of its nearer end, times 1, plus what it
    has as a part of paths from the hit entities, plus one for each end of an asked kind; relations on such paths
    alone have that in the place of the similarity; the score is similarity times weight. Rows are taken,
    entities first, while their tokens stay within the budget. The community that holds most of the taken
    entities follows, of equal ones the heaviest.
    """
    hits = knn(nodes.select(F.col("node").alias("vec_id"), "v").where("v is not null"), queries.select("query_id", "q"), candidates, least)
    hits = materialise(hits.select("query_id", F.col("vec_id").alias("node"), F.col("score").alias("sim")), "hits")
    kinds = nodes.select("node", "kind", "rank", "tokens")
    asked = queries.select("query_id", "types")
    fits = F.coalesce(F.array_contains("types", F.col("kind")), F.lit(False)).cast("int")

    best = lambda df, n, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)
    own = hits.join(kinds.withColumnRenamed("rank", "p"), "node").join(sent(asked), "query_id")
    own = own.withColumn("score", F.round(F.col("sim") * (1 + fits) * F.col("p"), 4))
    own = best(own, entities, F.desc("score"), "node").select("query_id", F.lit("entity").alias("kind"), F.col("node").alias("x"), F.lit(0).cast("long").alias("y"), "score", "rank", "tokens")

    ends = edges.withColumnRenamed("a", "far").join(hits.withColumnRenamed("node", "b"), "b").select("query_id", F.col("far").alias("a"), "b", "sim", "w")
    ends = ends.unionByName(edges.withColumnRenamed("b", "far").join(hits.withColumnRenamed("node", "a"), "a").select("query_id", "a", F.col("far").alias("b"), "sim", "w"))
    told = ends.groupBy("query_id", "a", "b", "w").agg(F.max("sim").alias("sim"))
    told = best(told, candidates, F.desc("sim"), F.desc("w"), "a", "b").drop("rank")
    paths = reached(hits, edges, hops, beam)
    both = told.join(paths.select("query_id", "a", "b", F.col("sim").alias("near"), F.col("w").alias("wp")), ["query_id", "a", "b"], "full")
    side = lambda c: kinds.select(F.col("node").alias(c), F.col("kind").alias(f"k{c}"), F.col("tokens").alias(f"t{c}"))
    both = both.join(side("a"), "a", "left").join(side("b"), "b", "left").join(sent(asked), "query_id")
    typed = sum((F.coalesce(F.array_contains("types", F.col(k)), F.lit(False)).cast("int") for k in ("ka", "kb")), F.lit(0))
    near = F.coalesce("near", F.lit(0.0))
    sim: Column = F.when(F.col("sim").isNotNull(), F.col("sim") * (1 + near + typed)).otherwise(near * (1 + typed))
    both = both.withColumn("score", F.round(sim * F.coalesce("w", "wp"), 4))
    ways = best(both, relations, F.desc("score"), "a", "b").select("query_id", F.lit("relation").alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "score", "rank", (F.coalesce("ta", F.lit(0)) + F.coalesce("tb", F.lit(0))).alias("tokens"))

    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("kind", "rank").rowsBetween(Window.unboundedPreceding, 0))
    taken = materialise(own.unionByName(ways).withColumn("used", used).where(F.col("used") <= budget).drop("used", "tokens"), "taken")
    if communities is None:
        return taken
    over = taken.where("kind = 'entity'").join(communities.select(F.col("node").alias("x"), "community", "weight"), "x").groupBy("query_id", "community").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    one = best(over, 1, F.desc("n"), F.desc("weight"), "community").select("query_id", F.lit("community").alias("kind"), F.col("community").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("n").cast("double").alias("score"), "rank")
    return taken.unionByName(one)
