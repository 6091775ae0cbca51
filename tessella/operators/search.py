"""Full-text, vector and hybrid search over tables of chunks and tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..scratch import materialise


def postings(chunks: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(term, keys, tf): how often a term stands in a chunk."""
    return chunks.select(*keys, F.explode(tokens).alias("term")).groupBy("term", *keys).agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, ident: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term): distinct words of each query."""
    return queries.select(ident, F.explode(F.array_distinct(tx.tokenize(F.col(text)))).alias("term"))


def idf_share(df: Column, n: Column) -> Column:
    """Inverse document frequency, scaled so that a term of one document has about 1."""
    return F.log1p((n - df + 0.5) / (df + 0.5)) / F.log1p((n - 0.5) / 1.5)


def weighted(terms: DataFrame, stats: DataFrame, n: DataFrame) -> DataFrame:
    """terms with weight; n is one row with the number of chunks. Query terms are few, so they go to the statistics."""
    return terms.join(stats, "term").crossJoin(F.broadcast(n)).select("query_id", "term", idf_share(F.col("df"), F.col("n")).alias("w"))


def match(
    terms: DataFrame, posted: DataFrame, keys: list[str], best: int | None = None, near: float = 1e-4, sent_rows: int = 200_000, value: str | None = None, missing: int | None = None, apart: DataFrame | None = None, near_share: float = 0.0
) -> DataFrame:
    """(query_id, keys, score, hits): sum of the weights of the query's terms that a chunk holds.

    Postings are brought together by chunk and scored there against the terms of all queries, which go to every
    task if they are at most `sent_rows` rows; so one row for each posting is shuffled, not one for each posting
    and query. More terms meet the postings in a join. With `best`, chunks that can't be among that many best
    ones of a query (by scores rounded to `near`, and `near_share` of the query's whole weight) are left out where
    they are scored; of chunks with one and the same score the first by their keys stay, as these come first in the end.
    `value`: a column of posted that a term's weight is multiplied with. `missing`: chunks that lack more of the query's terms are left
    out. `apart`: (first key, a class); the best of each class stay, and the class is in the result.
    """
    rows, kind = terms.select("query_id", "term", "w").limit(sent_rows + 1).collect(), apart.columns[1] if apart is not None else None
    if len(rows) > sent_rows:
        own = F.col("w") * F.col(value) if value else F.col("w")
        found = posted.select("term", *keys, *([value] if value else [])).join(terms, "term").groupBy("query_id", *keys).agg(F.sum(own).alias("score"), F.count("*").alias("hits"))
        if missing is not None:
            found = found.join(terms.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id").where(F.col("hits") >= F.col("_n") - missing).drop("_n")
        return found if apart is None else found.join(apart, keys[0], "left")
    rows.sort(key=lambda r: r["term"])
    asked = sorted({r["query_id"] for r in rows})
    number, words = {q: k for k, q in enumerate(asked)}, sorted({r["term"] for r in rows})
    first = np.searchsorted(np.array([r["term"] for r in rows], object), np.array([*words], object)) if words else np.zeros(0, int)
    begins = np.append(first, len(rows))
    of, weight = np.array([number[r["query_id"]] for r in rows], np.int64), np.array([r["w"] for r in rows], float)
    many, ids, known = len(asked), pa.array(asked, to_arrow_type(terms.schema["query_id"].dataType)), pa.array(words, pa.string())
    enough = np.bincount(of, minlength=many) - missing if missing is not None else np.ones(many, int)
    close = near + near_share * np.bincount(of, weight, minlength=many)
    kinds = dict(posted.dtypes)
    schema = f"query_id {dict(terms.dtypes)['query_id']}, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double, hits long" + (f", `{kind}` {dict(apart.dtypes)[kind]}" if kind else "")

    def first_ones(total: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Which cells of chunks (in the order of their keys) and queries may be among the best."""
        if len(total) <= best:
            return there
        least = np.partition(total, -best, axis=0)[-best]
        same = there & (total == least)
        return there & (total >= least - close) & (~same | (np.cumsum(same, axis=0, dtype=np.int32) <= best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, 4_000_000 // max(1, many))):
                piece = batch.slice(at, step)
                held = piece.column(len(keys))
                flat_held = held.flatten()
                term = pc.index_in(pc.struct_field(flat_held, "term") if value else flat_held, known)
                there = term.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(piece.num_rows), held.value_lengths().to_numpy())[there]
                term = term.drop_null().to_numpy()
                order = np.lexsort((term, row))  # the same words are summed in the same order, so their sums are the same
                row, term = row[order], term[order]
                each = begins[term + 1] - begins[term]
                flat = np.repeat(begins[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                cell, part = np.repeat(row, each) * many + of[flat], weight[flat]
                if value:
                    part = part * np.repeat(pc.struct_field(flat_held, "value").to_numpy(zero_copy_only=False)[there][order], each)
                hits = np.bincount(cell, minlength=piece.num_rows * many)
                total = np.bincount(cell, part, minlength=piece.num_rows * many)
                there = hits.reshape(-1, many) >= np.maximum(enough, 1)
                if best and piece.num_rows > best:
                    place = pc.sort_indices(pa.table({k: piece.column(c) for c, k in enumerate(keys)}), sort_keys=[(k, "ascending") for k in keys]).to_numpy()
                    classes = pc.dictionary_encode(piece.column(len(keys) + 1)).indices.fill_null(-1).to_numpy()[place] if kind else np.zeros(len(place), int)
                    for c in np.unique(classes):
                        mine = place[classes == c]
                        there[mine] = first_ones(total.reshape(-1, many)[mine], there[mine])
                found = np.flatnonzero(there)
                take = lambda c: piece.column(c).take(pa.array(found // many))  # noqa: B023, E731
                cols = {"query_id": ids.take(pa.array(found % many)), **{k: take(c) for c, k in enumerate(keys)}, "score": pa.array(total[found]), "hits": pa.array(hits[found])}
                yield pa.RecordBatch.from_pydict(cols | ({kind: take(len(keys) + 1)} if kind else {}))

    if not rows:
        return terms.sparkSession.createDataFrame([], schema)
    item = F.struct("term", F.col(value).alias("value")) if value else F.col("term")
    together = lambda df: df.groupBy(*keys).agg(F.collect_list(item).alias("_held")).select(*keys, "_held")
    chunks = together(posted) if apart is None else together(posted.repartition(keys[0])).join(apart, keys[0], "left").select(*keys, "_held", kind)
    return chunks.mapInArrow(score, schema)


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query, by score, then keys; rank from 1 on."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *keys)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def half_up(x: Column, digits: int = 4) -> Column:
    """x rounded, halves upwards. A whole match with a rounded cosine lies on a half but for the last bit of the sum; what
    is added here takes such sums over it, in whatever order they are made."""
    return F.round(x + 1e-9, digits)


def token_similarity(terms: DataFrame, posted: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a query's weight that a chunk holds."""
    total = terms.groupBy("query_id").agg(F.sum("w").alias("total"))
    return match(terms, posted, keys).join(total, "query_id").withColumn("similarity", (F.col("score") + 1e-9) / (F.col("total") + 1e-9))


def rank_feature(hits: DataFrame, asked: DataFrame, tags: DataFrame, rank: Column) -> DataFrame:
    """hits with `feature`: ten times the cosine of the query's tags(query_id, tag, value) and the chunk's tags(doc_id, pos,
    tag, value), plus the chunk's rank; without tags on either side the rank alone.

    Only hits are looked at: their chunks' tags are joined to them, so a frequent tag brings no chunk to a query
    that has no hit there.
    """
    long = lambda df, keys, name: df.withColumn(name, F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys))))
    mine = long(asked, ["query_id"], "qn").withColumnRenamed("value", "qv")
    theirs = long(hits.select("doc_id", "pos").distinct().join(tags, ["doc_id", "pos"]), ["doc_id", "pos"], "tn")
    both = hits.select("query_id", "doc_id", "pos").join(theirs, ["doc_id", "pos"]).join(sent(mine), ["query_id", "tag"])
    cosine = both.groupBy("query_id", "doc_id", "pos").agg(F.sum(F.col("value") * F.col("qv") / F.col("tn") / F.col("qn")).alias("cos"))
    return hits.join(cosine, ["query_id", "doc_id", "pos"], "left").withColumn("feature", 10 * F.coalesce("cos", F.lit(0.0)) + rank).drop("cos")


def unit(vec: Column) -> Column:
    size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))


def fitted(vec: Column, places: int) -> Column:
    """The vector, or zeros where it is missing or of another size."""
    return F.when(F.size(vec) == places, vec).otherwise(F.array_repeat(F.lit(0.0).cast("float"), places))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = 256, part: int = 8192) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine search of queries(query_id, q) among vectors(vec_id, v).

    Queries are dealt to blocks and vectors to parts; each pair of a block and a part is one task's matrix
    product (16 MB), of which the k best of each query go on, with those that are as good as the last of them. A
    vector is never its own hit.
    """
    many = lambda df, n: max(1, -(-df.count() // n))
    blocks, parts = many(queries, block), many(vectors, part)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(at("query_id", blocks).alias("block"), copies(parts).alias("part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"))
    v = vectors.select(copies(blocks).alias("block"), at("vec_id", parts).alias("part"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v")

    def best(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, rows = t.column("asks").to_numpy(), t.column("id").to_numpy(), t.column("v").combine_chunks()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(a) and len(b):
            m = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(asks), -1)
            m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
            score = np.round(m[a] @ m[b].T, 6)
            score[ids[a][:, None] == ids[b]] = -2
            n = min(k, len(b))
            last = np.partition(score, len(b) - n, axis=1)[:, len(b) - n]
            r, c = np.nonzero((score >= last[:, None]) & (score >= max(least, -1.5)))
            out = {"query_id": ids[a][r], "vec_id": ids[b][c], "score": score[r, c]}
        return pa.table(out)

    found = q.unionByName(v).groupBy("block", "part").applyInArrow(best, "query_id long, vec_id long, score double")
    return top_k(found, ["vec_id"], k)


def knn_weighted(vectors: DataFrame, queries: DataFrame, k: int, near: float = 2e-4, block: int = 256, part: int = 8192) -> DataFrame:
    """(query_id, vec_id, sim): vectors(vec_id, v, lo, hi) whose cosine times their better weight may be among the k best of a query.

    Blocks as in `knn`. What is within `near` of the k-th best product stays, so that products which are rounded later may
    be ranked by those who ask; a block gives out little more than k rows a query, whatever it holds. A vector is never its own hit.
    """
    many = lambda df, n: max(1, -(-df.count() // n))
    blocks, parts = many(queries, block), many(vectors, part)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("double")
    q = queries.select(at("query_id", blocks).alias("block"), copies(parts).alias("part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"), none.alias("lo"), none.alias("hi"))
    v = vectors.select(copies(blocks).alias("block"), at("vec_id", parts).alias("part"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))

    def best(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, rows = t.column("asks").to_numpy(), t.column("id").to_numpy(), t.column("v").combine_chunks()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "sim": np.zeros(0), "value": np.zeros(0)}
        if len(a) and len(b):
            m = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(asks), -1)
            m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
            sim = np.round(m[a] @ m[b].T, 6)
            value = np.maximum(sim * t.column("lo").to_numpy()[b], sim * t.column("hi").to_numpy()[b])
            value[ids[a][:, None] == ids[b]] = -np.inf
            n = min(k, len(b))
            last = np.partition(value, len(b) - n, axis=1)[:, len(b) - n]
            r, c = np.nonzero((value >= last[:, None] - near) & (value > -np.inf))
            out = {"query_id": ids[a][r], "vec_id": ids[b][c], "sim": sim[r, c], "value": value[r, c]}
        return pa.table(out)

    found = materialise(q.unionByName(v).groupBy("block", "part").applyInArrow(best, "query_id long, vec_id long, sim double, value double"), "near")
    least = top_k(found, ["vec_id"], k, "value").groupBy("query_id").agg((F.min("value") - near).alias("least"))
    return found.join(sent(least), "query_id").where("value >= least").select("query_id", "vec_id", "sim")


def sent(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a hint to send it to every task, if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def evaluate(run: DataFrame, qrels: DataFrame, cut: int = 10) -> DataFrame:
    """(query_id, ndcg, map, mrr) of run(query_id, key, rank) against qrels(query_id, key, rel)."""
    judged = run.join(qrels, ["query_id", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = judged.withColumn("sofar", F.sum("rel").over(w))
    ideal = qrels.where("rel > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "key"))).where(F.col("r") <= cut).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("ideal"))
    got = found.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= cut, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("rel") > 0), F.col("sofar") / F.col("rank")).otherwise(0.0)).alias("prec"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("rel") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when((F.col("rel") > 0) & (F.col("rank") <= cut), F.col("rank"))).alias("first"),
    )
    return got.join(ideal, "query_id", "left").select("query_id", (F.col("dcg") / F.col("ideal")).alias("ndcg"), (F.col("prec") / F.when(F.col("hits") > 0, F.col("hits"))).alias("map"), (1 / F.col("first")).alias("mrr"))


#: Thresholds that an answer's sentences are held against, from strict to loose (fixed values).
LADDER = tuple(0.63 * 0.8**n for n in range(4))


def cite(sentences: DataFrame, hits: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """(keys, sentence, hit): which hits an answer's sentences lean on.

    sentences(keys, sentence, tokens) and hits(keys, hit, tokens) share the keys of an answer. A sentence's
    similarity to a hit is the share of its words that the hit has. The strictest threshold of the ladder that
    some sentence passes holds for the answer; a sentence that passes cites hits with over 0.99 of its best
    similarity, four at most, and each hit is cited once, where it stands first.
    """
    shared = F.size(F.array_intersect("tokens", "words"))
    sim = F.round(shared / F.size("tokens"), 6)
    both = sentences.join(hits.withColumnRenamed("tokens", "words"), keys).where(F.size("tokens") > 0).withColumn("sim", sim).select(*keys, "sentence", "hit", "sim")
    of = lambda *c: Window.partitionBy(*keys, *c)
    best = both.withColumn("best", F.max("sim").over(of("sentence"))).withColumn("top", F.max("sim").over(of()))
    limit = F.coalesce(*(F.when(F.col("top") >= t, F.lit(t)) for t in LADDER))
    passed = best.where((F.col("best") >= limit) & (F.col("sim") > 0.99 * F.col("best")))
    few = passed.withColumn("r", F.row_number().over(of("sentence").orderBy(F.desc("sim"), "hit"))).where(F.col("r") <= most)
    return few.withColumn("k", F.row_number().over(of("hit").orderBy("sentence"))).where("k = 1").select(*keys, "sentence", "hit")
