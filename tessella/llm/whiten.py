"""Whitening of vectors on their leading principal components, by Chebyshev-filtered subspace iteration.

The covariance matrix is never built: each step is one pass over the rows that adds up X'(XQ) of the centred rows
for a narrow block Q. A polynomial that is small on the unwanted part of the spectrum and grows fast above it is
applied by its three-term recurrence, a pass for each degree; then QR and a Rayleigh-Ritz step, whose residuals
certify the result. What comes to the driver is d x b numbers a pass, whatever the number of rows.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, as are those of
another length than the most frequent one (the longer of two as frequent); equal vectors count once in the fit and
get a row each in the result, as do repeated rows; components without variance (next to the largest, below 1e-10)
are left out, so vectors that are all equal, or a single one, give no rows; an empty table gives none; a deviation
beyond 64 bits is null; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Vectors of a stored block.
BLOCK = 1024


def integers(table: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """(ident, x): floor(scale * c) of the entries of whole vectors."""
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return table.where(fit).select(F.col(ident).alias("ident"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """Each distinct vector once, `BLOCK` of them in a cell of bytes, so that a pass unpacks no lists."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                yield pa.RecordBatch.from_pydict({"block": [np.ascontiguousarray(x[at : at + BLOCK], "<i8").tobytes()]})

    return materialise(rows.select("x").distinct().mapInArrow(pack, "block binary"), "blocks")


class Passes:
    """Sums over all rows of a table of blocks."""

    def __init__(self, table: DataFrame, d: int):
        self.table, self.d, self.parts = table, d, table.rdd.getNumPartitions()

    def total(self, f: Callable[[np.ndarray], np.ndarray], shape: tuple, kind: str = "<f8") -> np.ndarray:
        """The sum of f(x) over blocks x of whole numbers. Tasks add up their own; sums of many tasks are added by tasks again."""
        d = self.d

        def begin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape, kind)
            for batch in parts:
                for block in batch.column(0):
                    out += f(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d))
            yield pa.RecordBatch.from_pydict({"s": [out.tobytes()]})

        def more(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape, kind)
            for batch in parts:
                for s in batch.column(0):
                    out += np.frombuffer(s.as_buffer(), kind).reshape(shape)
            yield pa.RecordBatch.from_pydict({"s": [out.tobytes()]})

        sums, left = self.table.mapInArrow(begin, "s binary"), self.parts
        while left > 64:
            left = -(-left // 32)
            sums = sums.repartition(left).mapInArrow(more, "s binary")
        return sum((np.frombuffer(r[0], kind).reshape(shape) for r in sums.collect()), np.zeros(shape, kind))


def lowest(apply: Callable[[np.ndarray], np.ndarray], d: int, steps: int, seed: int) -> float:
    """A lower bound for the eigenvalues of a symmetric positive matrix, from a few Lanczos steps."""
    q = np.random.default_rng(seed).normal(size=d)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, d)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(w @ basis[-1])
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, values[0] - beta[-1] * abs(vectors[-1, 0]))


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = 12, degree: int = 10, tolerance: float = 1e-14, certified: float = 1e-11, rounds: int = 40, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit vectors (d x wanted) of a symmetric positive matrix
    that is known by its products with narrow blocks only.

    The block has `guard` more vectors. The filter damps what lies between a lower bound of the spectrum and the
    block's smallest Ritz value. Residuals of the wanted pairs must come below `certified` times the largest value;
    they are driven on to `tolerance`, or until a round no longer halves them. Else the result is refused.
    """
    wanted = min(wanted, d)
    width = min(d, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    floor, before = None, np.inf
    for _ in range(rounds):
        w = apply(q)
        small = q.T @ w
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        rest = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / max(values[0], 1e-300)
        if values[0] <= 0 or rest <= tolerance or (rest <= certified and rest > before / 2):
            return values[:wanted], q[:, :wanted]
        before = rest
        floor = lowest(apply, d, 10, seed) if floor is None else floor
        centre, half = (values[-1] + floor) / 2, max((values[-1] - floor) / 2, 1e-3 * values[0])
        sigma = first = half / (values[0] - centre)
        old, new = q, (w - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            old, new = new, (apply(new) - centre * new) * (2 * after / half) - old * (sigma * after)
            sigma = after
        q = np.linalg.qr(new)[0]
    raise RuntimeError(f"residual {rest:.1e} of the largest value after {rounds} rounds")


def whiten(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(ident, component, n, deviation, whitened, explained, identity_error): see the module."""
    spark, kind = table.sparkSession, dict(table.dtypes)[ident]
    schema = f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(table, ident, vector, scale)
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    d = common[0]["d"]
    rows = materialise(rows.where(F.size("x") == d), "vectors")
    over = Passes(blocks(rows, d), d)
    sums = over.total(lambda x: np.concatenate((x.sum(0), [len(x)])), (d + 1,), "<i8")
    n, total = int(sums[-1]), sums[:-1]
    mean = total / n
    trace = float(over.total(lambda x: ((x - mean) ** 2).sum(0), (d,)).sum()) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return over.total(product, q.shape) / n

    values, axes = leading(apply, d, components)
    some = values > 1e-10 * max(values[0], 0)
    values, axes = values[some], axes[:, some]
    k = len(values)
    if not k or trace <= 0:
        return spark.createDataFrame([], schema)
    root = np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ axes / root
        return np.vstack((z.T @ z, z.sum(0)))

    moments = over.total(spread, (k + 1, k)) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    explained = values / trace

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, m = _matrix(batch.column(1), d), batch.num_rows
            if np.abs(x - mean).max(initial=0) * n < (2**62 / d) ** 0.5:
                far = pa.array(((n * x - total) ** 2).sum(1))
            else:
                exact = [sum((n * a - s) ** 2 for a, s in zip(r, total.tolist(), strict=True)) for r in x.tolist()]
                far = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(pa.array(each)),
                 pa.array(((x - mean) @ axes / root).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
