"""Approximate vector search: inverted lists over cells, product-quantised codes, exact scores for the last candidates.

Cells and codebooks are fitted on a sample of at most `SAMPLE` vectors; every vector is in the list of its nearest cell.
How many lists a query reads is set on the sample too, so that the target share of true neighbours lies in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .search import sent, top_k

#: Vectors that the quantisers are fitted on, at most; codewords of a part of a vector; vectors of a list scored in one task.
SAMPLE, WORDS, BLOCK = 16_384, 256, 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means; an empty cell takes the point that is farthest from its own mean."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = (c * c).sum(1) - 2 * x @ c.T
        near = far.argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
        if (empty := np.flatnonzero(count == 0)).size:
            c[empty] = x[np.argsort(-(far.min(1) + (x * x).sum(1)), kind="stable")[: len(empty)]]
    return c


class Quantiser:
    """Cells, codebooks for the parts of a vector, and how many cells to read."""

    def __init__(self, sample: np.ndarray, cells: int, width: int, k: int, target: float, seed: int = 7):
        self.cells = means(sample, min(cells, len(sample)), seed)
        self.edges = list(range(0, sample.shape[1], width)) + [sample.shape[1]]
        self.words = [means(np.ascontiguousarray(sample[:, a:b]), min(WORDS, len(sample)), seed + a) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.probes = self._probes(sample, k, target, np.random.default_rng(seed))

    def near(self, x: np.ndarray) -> np.ndarray:
        return np.argsort((self.cells * self.cells).sum(1) - 2 * x @ self.cells.T, axis=1, kind="stable")

    def code(self, x: np.ndarray) -> np.ndarray:
        parts = [((w * w).sum(1) - 2 * x[:, a:b] @ w.T).argmin(1) for w, a, b in zip(self.words, self.edges, self.edges[1:], strict=False)]
        return np.stack(parts, 1).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of one query with coded vectors: one look-up for each part."""
        out = np.zeros(len(codes))
        for m, (w, a, b) in enumerate(zip(self.words, self.edges, self.edges[1:], strict=False)):
            out += (w @ q[a:b])[codes[:, m]]
        return out

    def _probes(self, sample: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
        asked = rng.permutation(len(sample))[:256]
        score = sample[asked] @ sample.T
        score[np.arange(len(asked)), asked] = -2
        best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
        if not best.size:
            return len(self.cells)
        home, order = self.near(sample)[:, 0], self.near(sample[asked])
        place = np.argsort(order, axis=1)  # of each cell in a query's order
        reach = np.sort(np.take_along_axis(place, home[best], 1).ravel())
        return int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))))]) + 1


class Lists:
    """An index of vectors(vec_id, v, ...): other columns stay beside the codes for filters."""

    def __init__(self, vectors: DataFrame, k: int = 10, width: int = 2, target: float = 0.97, per_cell: int = 256):
        rows = vectors.withColumn("v", F.col("v").cast("array<double>")).where(F.col("v").isNotNull() & (F.size("v") > 0))
        size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.vectors, self.d, self.n = rows.where(F.size("v") == (size["d"] if size else 0)), size["d"] if size else 0, size["n"] if size else 0
        share = min(1.0, SAMPLE / max(1, self.n))
        drawn = self.vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("vec_id")).select("v").limit(SAMPLE).collect()
        self.quantiser = Quantiser(_unit(np.array([r["v"] for r in drawn], float)), max(1, min(4096, self.n // per_cell)), width, k, target) if drawn else None
        self.rows = self._coded() if drawn else None

    def _coded(self) -> DataFrame:
        own, d, schema = self.quantiser, self.d, self.vectors.drop("v").schema

        def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    x = _unit(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                    cells, codes = own.near(x)[:, 0], own.code(x)
                    kept = [c for c in piece.schema.names if c != "v"]
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes])], names=[*kept, "cell", "code"])

        return materialise(self.vectors.mapInArrow(code, schema.add("cell", "integer").add("code", "binary")), "lists")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, over: int = 2) -> DataFrame:
        """(query_id, vec_id, score, rank): the k nearest of queries(query_id, q) by cosine among the rows that pass the
        filter. The `over` times k best by code are scored exactly; a vector is never its own hit."""
        form = "query_id long, vec_id long, score double, rank int"
        if self.quantiser is None:
            return queries.sparkSession.createDataFrame([], form)
        own, d, most, probes = self.quantiser, self.d, over * k, self.quantiser.probes

        def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                q = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "q": [r.tobytes() for r in q], "cell": pa.array(own.near(q)[:, :probes].astype(np.int32).tolist(), pa.list_(pa.int32()))})

        asked = queries.where(F.size("q") == d).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        asked = materialise(asked.mapInArrow(ask, "query_id long, q binary, cell array<int>").select("query_id", "q", F.explode("cell").alias("cell")), "asked")
        lists = self.rows.where(where) if where is not None else self.rows
        lists = lists.select(F.col("vec_id").cast("long").alias("id"), "cell", "code")
        parts = lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # one row a cell, 4096 at most
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        live = lists.join(F.broadcast(parts), "cell").select("cell", part.alias("part"), "id", F.col("code").alias("x"), F.lit(False).alias("asks"))
        goes = asked.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("query_id").alias("id"), F.col("q").alias("x"), F.lit(True).alias("asks"))

        def score(t: pa.Table) -> pa.Table:
            asks = t.column("asks").to_numpy()
            ids, x = t.column("id").to_numpy(), t.column("x").combine_chunks()
            lists_at, out = np.flatnonzero(~asks), {"query_id": [], "id": [], "about": []}
            codes = np.frombuffer(b"".join(v.as_buffer() for v in x.take(pa.array(lists_at))), np.uint8).reshape(len(lists_at), -1)
            for r in np.flatnonzero(asks):
                about = own.scores(np.frombuffer(x[int(r)].as_buffer(), float), codes)
                about[ids[lists_at] == ids[r]] = -np.inf
                best = np.argpartition(-about, most)[:most] if len(about) > most else np.arange(len(about))
                best = best[about[best] > -np.inf]
                out["query_id"] += [int(ids[r])] * len(best)
                out["id"] += ids[lists_at[best]].tolist()
                out["about"] += about[best].tolist()
            return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "about": pa.array(out["about"], pa.float64())})

        found = live.unionByName(goes).groupBy("cell", "part").applyInArrow(score, "query_id long, id long, about double")
        few = materialise(top_k(found, ["id"], most, "about").select("query_id", F.col("id").alias("vec_id")), "candidates")
        unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))
        exact = sent(few).join(self.vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vec_id")
        exact = exact.join(sent(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))), "query_id")
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
        size = unit(F.col("q")) * unit(F.col("v"))
        scored = exact.select("query_id", "vec_id", F.round(F.when(size > 0, dot / size).otherwise(0.0), 6).alias("score"))
        return top_k(scored, ["vec_id"], k)
