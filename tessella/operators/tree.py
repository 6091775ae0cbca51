"""A tree of summaries over vectors with texts: layers of clusters, each with a parent that stands for its members."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise


def _clusters(nodes: DataFrame, n: int, most: int, places: int, seed: int) -> DataFrame:
    """nodes with the cluster of each: of 2, 4, 8 ... clusters the number with the smallest Bayesian information criterion."""
    d = min(places, n - 1, len(nodes.first()["v"]))
    space = materialise(PCA(k=d, inputCol="x", outputCol="features").fit(nodes.withColumn("x", array_to_vector("v"))).transform(nodes.withColumn("x", array_to_vector("v"))).select("node", "v", "text", "features"))
    best = None
    k = 2
    while k <= most and k * 2 <= n:
        model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(space)
        free = k * (d + d * (d + 1) / 2) + k - 1
        score = free * math.log(n) - 2 * model.summary.logLikelihood
        if best is None or score < best[0]:
            best = (score, model)
        k *= 2
    if best is None:
        return space.withColumn("prediction", F.lit(0))
    return best[1].transform(space)


def summary_tree(vectors: DataFrame, most: int = 64, places: int = 8, most_layers: int = 8, seed: int = 1) -> DataFrame:
    """(layer, node, parent, text) of vectors(node, v, text): each layer's nodes are clustered, a cluster's parent has the
    mean of its members and the text of the member next to it, until one node is left. The root's parent is null.

    A layer is at most half as large as the one below. Nodes of higher layers have numbers of their own, from
    -1 downwards. Means and covariances of at most `most` clusters are all that comes to the driver.
    """
    nodes = materialise(vectors.select(F.col("node").cast("long").alias("node"), F.transform("v", lambda x: x.cast("double")).alias("v"), "text"))
    found, layer, lowest = None, 0, 0
    while True:
        n = nodes.count()
        if n <= 1 or layer == most_layers:
            last = nodes.select(F.lit(layer).alias("layer"), "node", F.lit(None).cast("long").alias("parent"), "text")
            return last if found is None else found.unionByName(last)
        dealt = _clusters(nodes, n, 1 if layer + 1 == most_layers else most, places, seed) if n > 2 else nodes.withColumn("prediction", F.lit(0))
        dealt = materialise(dealt.select("node", "v", "text", (F.lit(lowest - 1) - F.col("prediction")).cast("long").alias("parent")))
        means = dealt.withColumn("x", array_to_vector("v")).groupBy("parent").agg(Summarizer.mean(F.col("x")).alias("m")).select("parent", vector_to_array("m").alias("m"))
        far = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near = dealt.join(F.broadcast(means), "parent").groupBy("parent", "m").agg(F.min(F.struct(far.alias("far"), "node", "text")).alias("s"))
        edges = dealt.select(F.lit(layer).alias("layer"), "node", "parent", "text")
        found = edges if found is None else found.unionByName(edges)
        nodes = materialise(near.select(F.col("parent").alias("node"), F.col("m").alias("v"), F.col("s.text").alias("text")))
        lowest -= most
        layer += 1
