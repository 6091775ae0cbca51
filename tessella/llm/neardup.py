"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct 3-word shingles. A sketch holds, for each of `registers` hash
functions, the truncated minimum on an exponential scale: K = floor(1 - log_b(x)), x the smallest of
exponential variables drawn from the shingles. Sketches of parts merge by maximum, and a register is
equal in two sketches with probability near the Jaccard similarity. Bands of registers bring similar
documents into one bucket; the likelihood of the joint register counts estimates their similarity; a
link counts only after the full sets confirm it.

Equal sets are one node from the start. In a bucket each member is set against one centre, the member
that shares most buckets with others, so a bucket of k makes k - 1 pairs and these link nearly all there
is. Members of a bucket that are in different components after that meet block by block in a second
pass, which gives out links only, so a bucket loses no link and no table of its pairs is ever made.

Edges: null, empty and blank texts have an empty set and are linked with nothing; fewer than three
words are one shingle; repeated rows are copies; rows that share a doc_id count as one document; a row
without doc_id is linked with nothing, has no component and is not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, batches, having, lacking, materialise, mix, shingles
from .graph import components

BASE = 1.001  # registers on so fine a scale collide by chance once in a thousand
BANDS, ROWS = 24, 5  # a pair at 0.85 is in no common bucket once in 1.3 million
LEVELS = (1 << 16) - 2


class Sketcher:
    """Sets and sketches of texts; one in each task."""

    def __init__(self, width: int = 3, registers: int = BANDS * ROWS, seed: int = 7):
        self.width, self.words = width, WordHash()
        draw = np.random.default_rng(seed).integers(1, 2**63, (2, registers), np.uint64)
        self.factor, self.shift = draw[0] | np.uint64(1), draw[1]

    def shingle_sets(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, sizes = self.words.joined(texts)
        return [np.unique(shingles(w, self.width)) for w in np.split(flat, np.cumsum(sizes)[:-1])]

    def sketch(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers (documents x registers) of sets that are not empty."""
        flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        out = np.empty((len(sets), len(self.factor)), np.uint16)
        for i, (f, s) in enumerate(zip(self.factor, self.shift, strict=True)):
            v = flat * f + s
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum.reduceat(v, starts).astype(np.float64)
            x = -np.log1p(-(least + 0.5) / 2.0**64)  # smallest of n exponential variables
            out[:, i] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)) + 4096, 0, LEVELS + 1)
        return out


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood similarity from how many registers are greater, less and equal, given the set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood has one peak
        a1, a2 = low + (high - low) / 3, high - (high - low) / 3
        left = score(a1) < score(a2)
        low, high = np.where(left, a1, low), np.where(left, high, a2)
    return (low + high) / 2


def sketched(docs: DataFrame, text: str, ident: str, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set, null if empty) and registers of each document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketcher(width)
        for batch, ids, texts in batches(frames, ident, text):
            for at in range(0, len(ids), 500):
                sets = made.shingle_sets(texts[at : at + 500])
                full = [k for k, s in enumerate(sets) if len(s)]
                registers = made.sketch([sets[k] for k in full]) if full else []
                keys: list = [None] * len(sets)
                regs: list = [None] * len(sets)
                for k, r in zip(full, registers, strict=True):
                    keys[k], regs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "registers"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, registers binary")


def shingle_sets(docs: DataFrame, text: str, ident: str, width: int = 3) -> DataFrame:
    """doc_id and its shingles as array<long>."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketcher(width)
        for batch, texts in batches(frames, text):
            for at in range(0, len(texts), 200):
                sets = [s.view(np.int64) for s in made.shingle_sets(texts[at : at + 200])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select(ident, text).mapInArrow(run, f"node {docs.schema[ident].dataType.simpleString()}, shingles array<long>")


def banded(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(bucket, band, node): one row for each band of each node; a bucket is the hash of a band's registers."""

    @F.pandas_udf("array<long>")
    def buckets(registers: pd.Series) -> pd.Series:
        r = np.frombuffer(b"".join(registers), np.uint16).reshape(len(registers), -1).astype(np.uint64)
        out = np.empty((len(r), bands), np.uint64)
        for k in range(bands):
            h = np.full(len(r), k + 1, np.uint64)
            for c in range(k * rows, (k + 1) * rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, c])
            out[:, k] = h
        return pd.Series(list(out.view(np.int64)))

    return nodes.select("node", F.posexplode(buckets("registers")).alias("band", "bucket"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, ident: str, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    First the sizes and the likelihood estimate rule out pairs that can't be links: an estimate of 120
    registers has a standard error of 0.033 at 0.85, and 0.2 below is six of these.
    Sets are read again for the documents that are left only.
    """
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))

    @F.pandas_udf("double")
    def estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        one = lambda r: np.frombuffer(b"".join(r), np.uint16).reshape(len(r), -1)
        return pd.Series(likely_jaccard(one(ra), one(rb), na.to_numpy(float), nb.to_numpy(float)))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    likely = materialise(sized.where(estimate("ra", "rb", "na", "nb") >= percent / 100 - 0.2).select("a", "b", "na", "nb"), "likely")
    wanted = materialise(likely.select(F.col("a").alias(ident)).union(likely.select(F.col("b").alias(ident))).distinct(), "wanted")
    sets = materialise(shingle_sets(having(docs.select(ident, text), wanted, ident), text, ident, width).distinct(), "sets")
    # A centre of many pairs: its pairs are dealt to parts of at most 500, its set is copied to each part.
    sizes = likely.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("parts"))
    left = sets.join(sizes, sets.node == sizes.a).select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sa"))
    dealt = likely.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
    whole = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(left.drop("parts"), ["a", "part"])
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb")
    return whole.withColumn("i", shared).where(100 * F.col("i") >= percent * (union - F.col("i"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = 85, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = docs.select(ident, text)
    rows = materialise(sketched(docs, text, ident, width), "rows")
    sets = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
    sets = materialise(sets, "sets")  # one row for each different set, named by its smallest doc_id
    nodes = sets.dropDuplicates(["node", "set_key"])
    buckets = banded(nodes)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    crowd = materialise(buckets.join(sizes, "bucket"), "crowd")
    weights = crowd.groupBy("node").agg(F.sum("members").alias("weight"))
    # Struct order: largest weight, then smallest node.
    centre = crowd.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("n"))).alias("c")).select("bucket", (-F.col("c.n")).alias("centre"))
    pairs = materialise(crowd.join(centre, "bucket").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = materialise(confirmed(pairs, nodes, docs, text, ident, percent, width), "links")
    named = components(links)
    more = materialise(_rest(crowd, named, nodes, docs, text, ident, percent, width), "more")
    if more.limit(1).count():
        named = components(links.unionByName(more))
    final = sets.join(named, sets.node == named.node, "left").select("set_key", F.coalesce("component", sets.node).alias("component"))
    # Copies of one text by the million share a set_key: such keys go to every task (under 2000 of them, as each
    # has over 1/2000 of the rows), the others meet their rows in a shuffle.
    return _labelled(rows, final, named)


BLOCK = 256


def _rest(crowd: DataFrame, named: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, ident: str, percent: int, width: int) -> DataFrame:
    """Links within buckets between members that the centres have left in different components.

    The component with most members of a bucket needs no pairs of its own: each other member meets all
    members of other components, in blocks of 256 by 256, each a task's group. Buckets of one component
    have none. A pair is looked at in the first band it shares only; size and likelihood first, then the
    full sets.
    """
    of = crowd.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = of.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = counts.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("members"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = split.where("kinds > 1 and members > 2").select("bucket", F.col("top.main").alias("main"), blocks(F.col("members")).alias("wide"), blocks(F.col("members") - F.col("top.n")).alias("tall"))
    open_ = materialise(of.join(split, "bucket").select("bucket", "band", "node", "component", "main", "wide", "tall"), "open")
    wanted = materialise(open_.select(F.col("node").alias(ident)).distinct(), "wanted")
    sets = shingle_sets(having(docs.select(ident, text), wanted, ident), text, ident, width).distinct()
    full = open_.join(nodes.select("node", "registers").join(sets, "node"), "node")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["bucket", "band", "node", "component", "registers", "shingles"]
    left = full.where("component <> main").select(*cols, place("tall").alias("row"), cells("wide").alias("col"), F.lit(True).alias("left"))
    right = full.select(*cols, place("wide").alias("col"), cells("tall").alias("row"), F.lit(False).alias("left"))
    kind = docs.schema[ident].dataType.simpleString()

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        a, b = pdf[pdf.left], pdf[~pdf.left]
        if len(a) and len(b):
            band = int(pdf.band.iloc[0])
            rb = np.frombuffer(b"".join(b.registers), np.uint16).reshape(len(b), -1)
            cb, nb, sb = b.component.to_numpy(), b.node.to_numpy(), b.shingles.to_list()
            size = np.array([len(s) for s in sb], float)
            for node, comp, reg, own in zip(a.node, a.component, a.registers, a.shingles, strict=True):
                ra = np.frombuffer(reg, np.uint16)
                same = (rb == ra).reshape(len(rb), -1, ROWS).all(2)
                n = float(len(own))
                ok = (cb != comp) & (same.argmax(1) == band) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[likely_jaccard(np.broadcast_to(ra, rb[at].shape), rb[at], np.full(len(at), n), size[at], 20) >= percent / 100 - 0.2]
                for k in at:
                    i = len(np.intersect1d(own, sb[k], assume_unique=True))
                    if 100 * i >= percent * (n + size[k] - i):
                        out.append((node, nb[k]))
        return pd.DataFrame(out, columns=["a", "b"])

    return left.unionByName(right).groupBy("bucket", "row", "col").applyInPandas(met, f"a {kind}, b {kind}").distinct()


def _labelled(rows: DataFrame, final: DataFrame, named: DataFrame) -> DataFrame:
    thin = rows.select("doc_id", "n_shingles", "set_key")
    total = thin.count()
    often = thin.where("set_key is not null").groupBy("set_key").count().where(F.col("count") * 2000 > total)
    hot = final.join(often.select("set_key"), "set_key", "left_semi").groupBy("set_key").agg(F.min("component").alias("hot"))
    marked = thin.join(F.broadcast(hot), "set_key", "left")
    cold = marked.where("hot is null").join(final.groupBy("set_key").agg(F.min("component").alias("component")), "set_key", "left")
    out = cold.unionByName(marked.where("hot is not null").withColumn("component", F.col("hot")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the one with the smallest doc_id.
    Rows that are repeated in full stay once; texts without words and rows without doc_id are linked with nothing
    and stay."""
    found = materialise(near_duplicates(docs, percent=80, width=5).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")), "found")
    gone = materialise(found.where("not kept or rows > 1").select("doc_id"), "gone")
    twice = materialise(found.where("kept and rows > 1").select("doc_id"), "twice")
    # Texts are shuffled only where one doc_id has several rows.
    single = lacking(docs, gone, "doc_id").select(docs.columns)
    return single.unionByName(having(docs, twice, "doc_id").select(docs.columns).dropDuplicates(["doc_id", "text"]))


ORACLE_OP2 = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x<>'') w from documents),
s as (select doc_id, list_distinct(case when len(w)=0 then [] when len(w)<3 then [array_to_string(w,' ')] else list_transform(range(1, len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) end) s from w),
x as materialized (select doc_id, len(s) n, unnest(s) g from s),
sizes as (select doc_id, len(s) n from s),
p as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) i from x a join x b on a.g=b.g and a.doc_id<b.doc_id and 100*least(a.n,b.n)>=85*greatest(a.n,b.n) group by all),
l as materialized (select a, b from p where 100*i>=85*(na+nb-i)),
e as materialized (select a u, b v from l union select b, a from l),
c as (select u node, u root from e union select c.node, e.v from c join e on c.root=e.u),
m as (select node, min(root) root from c group by node)
select sizes.doc_id, n::bigint n_shingles, coalesce(root, sizes.doc_id) component_id, sizes.doc_id=coalesce(root, sizes.doc_id) kept from sizes left join m on m.node=sizes.doc_id
"""
