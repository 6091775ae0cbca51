"""Near-duplicate vectors through an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codewords, one of each, is a cell of the product grid, and
every vector lives in the cell of its nearest codewords. A vector asks cells in the order of their summed squared
distances (multi-sequence traversal: a heap over the two sorted lists) until the cell is farther than its own by
more than an excess; the excess is set on a sample so that the target share of partners at the least similarity is
met by one side or the other. Every vector is indexed and all that live in a visited cell are verified by their
cosine in double precision; there is no cap on cells' members, partners or candidates.

Equal vectors of a group are one member with a count. Crowded cells are dealt to parts, members by members in blocks,
and a block gives out counts of links and a spanning forest of them, so a group of m near copies makes about m rows
for each pair of parts, not m * m.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries, and rows with a null group,
link with nothing; vectors of different lengths don't link; each row is a vector of its own, so repeated rows link
with each other; component_id is null where all reachable idents are null, and kept is then false; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_bounded, materialise
from .graph import components

#: Vectors that the codebooks are fitted on, and their bytes, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def members(table: DataFrame, ident: str, vector: str, group: str) -> DataFrame:
    """(ident, group, key, v): key is a digest of group and vector, null where the row can't link; v are the unit vector's doubles."""
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) > 0) & F.col(group).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(v, lambda c: c != 0)
    kind = dict(table.dtypes)[ident]
    rows = table.select(F.col(ident).alias("ident"), F.when(fit, F.concat_ws("/", F.size(v).cast("string"), F.col(group).cast("string"))).alias("grp"), F.when(fit, v.cast("array<double>")).alias("x"))

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            groups, x = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, units = [None] * len(x), [None] * len(x)
            lengths = {len(r) for r in x if r is not None}
            for d in lengths:
                at = [i for i, r in enumerate(x) if r is not None and len(r) == d]
                raw = np.array([x[i] for i in at], "<f8") + 0.0
                for i, r, u in zip(at, raw, _unit(raw), strict=True):
                    keys[i] = hashlib.blake2b(groups[i].encode() + b"\0" + r.tobytes(), digest_size=16).digest()
                    units[i] = u.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["ident", "grp", "key", "v"])

    return materialise(rows.mapInArrow(code, f"ident {kind}, grp string, key binary, v binary"), "members")


def codebook(y: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; codewords without points stay where they are."""
    c = y[np.random.default_rng(seed).permutation(len(y))[:size]].copy()
    for _ in range(rounds):
        near = _nearest(y, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        c[some] = np.add.reduceat(y[order], (np.cumsum(count) - count)[some]) / count[some, None]
    return c


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to a term that is the same for all codewords."""
    return (c * c).sum(1) - 2 * y @ c.T


class Grid:
    """Two codebooks and the excess up to which cells are visited."""

    def __init__(self, sample: np.ndarray, cells: int, least: float, target: float, seed: int = 11):
        d = sample.shape[1]
        self.half = max(1, d // 2)
        self.size = max(1, min(round(cells**0.5), len(sample) // 16))
        self.books = [codebook(np.ascontiguousarray(h), self.size, seed + k) for k, h in enumerate(self._halves(sample))]
        self.excess = self._calibrate(sample, least, target, np.random.default_rng(seed))

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, x]

    def excesses(self, x: np.ndarray) -> list[np.ndarray]:
        """For both halves: how much farther each codeword is than the nearest, in squared distance."""
        found = [_nearest(h, c) for h, c in zip(self._halves(x), self.books, strict=True)]
        return [e - e.min(1, keepdims=True) for e in found]

    def _calibrate(self, sample: np.ndarray, least: float, target: float, rng: np.random.Generator) -> float:
        """The excess that the target share of pairs at similarity `least` keeps to, seen from the better side.

        Partners are made: the sample's vectors turned by that angle in random directions.
        """
        a = sample[rng.permutation(len(sample))[:4096]]
        turn = rng.normal(size=a.shape)
        turn -= (turn * a).sum(1, keepdims=True) * a
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
        b = least * a + (1 - least * least) ** 0.5 * turn
        ea, eb, every = self.excesses(a), self.excesses(b), np.arange(len(a))
        at = lambda e, o: sum(x[every, y.argmin(1)] for x, y in zip(e, o, strict=True))
        return float(np.quantile(np.minimum(at(ea, eb), at(eb, ea)), target, method="higher")) + 1e-12

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """For each vector the numbers of the cells it visits, its own first."""
        e1, e2 = self.excesses(x)
        o1, o2 = np.argsort(e1, axis=1, kind="stable"), np.argsort(e2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(e1, o1, 1), np.take_along_axis(e2, o2, 1)
        n1, n2 = (s1 <= self.excess).sum(1), (s2 <= self.excess).sum(1)
        for r in range(len(x)):
            yield list(traverse(s1[r, : n1[r]].tolist(), s2[r, : n2[r]].tolist(), o1[r], o2[r], self.excess, self.size))


def traverse(a: list[float], b: list[float], first: np.ndarray, second: np.ndarray, most: float, size: int) -> Iterator[int]:
    """Cells by rising sum of two rising lists, up to `most`. A cell enters the heap when the one before it in its
    row has left, a row when the row above it has begun."""
    heap = [(a[0] + b[0], 0, 0)]
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield int(first[i]) * size + int(second[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def forest(link: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (row, column) that join all that the given ones join, at most rows + columns of them."""
    rows, cols = np.nonzero(link)
    if len(rows) <= sum(link.shape):
        return rows.tolist(), cols.tolist()
    a, b, seen, open_ = [], [], np.zeros(link.shape[1], bool), np.ones(link.shape[0], bool)
    for start in np.flatnonzero(link.any(1)):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue:
            r = queue.pop()
            new = np.flatnonzero(link[r] & ~seen)
            seen[new] = True
            a += [r] * len(new)
            b += new.tolist()
            for c in new:
                more = np.flatnonzero(link[:, c] & open_)
                open_[more] = False
                a += more.tolist()
                b += [c] * len(more)
                queue += more.tolist()
    return [int(x) for x in a], [int(x) for x in b]


def _verify(least: float):
    def verify(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        cls, home, copies = (t.column(c).to_numpy() for c in ("cls", "home", "copies"))
        v = t.column("v").combine_chunks()
        v = np.frombuffer(b"".join(x.as_buffer() for x in v), "<f8").reshape(len(asks), -1)
        a, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        node, count, one, two = [], [], [], []
        if len(a) and len(r):
            homes, which = np.unique(home[a], return_inverse=True)
            seen = t.column("visits").combine_chunks().take(pa.array(r))
            back = np.zeros((len(r), len(homes)), bool)  # cells that the members of this cell ask themselves
            flat, of = seen.flatten().to_numpy(), np.repeat(np.arange(len(r)), seen.value_lengths().to_numpy())
            place = np.searchsorted(homes, flat)
            hit = (place < len(homes)) & (homes[np.minimum(place, len(homes) - 1)] == flat)
            back[of[hit], place[hit]] = True
            link = np.empty((len(a), len(r)), bool)
            for at in range(0, len(a), 512):
                link[at : at + 512] = v[a[at : at + 512]] @ v[r].T >= least
            link &= cls[a][:, None] != cls[r]
            found = link @ copies[r].astype(float)
            alone = (link & ~back[:, which].T).T @ copies[a].astype(float)  # links that the other side doesn't find
            node = np.concatenate((cls[a][found > 0], cls[r][alone > 0])).tolist()
            count = np.concatenate((found[found > 0], alone[alone > 0])).astype(np.int64).tolist()
            x, y = forest(link)
            one, two = cls[a][x].tolist(), cls[r][y].tolist()
        return pa.table({"a": pa.array(node + one, pa.int64()), "b": pa.array([None] * len(node) + two, pa.int64()), "n": pa.array(count + [0] * len(one), pa.int64())})

    return verify


def near_duplicates(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.98, target: float = 0.999, per_cell: int = 1024, block: int = 2048) -> DataFrame:
    """(ident, n_links, component_id, kept): one row for each row of the table; see the module.

    per_cell: members of a cell that the size of the codebooks aims at (they can't have more codewords than a
    sixteenth of the sample); block: members of a cell that meet in one task. The excess is set for the target
    share of the hardest partners, those at `least` itself.
    """
    spark, kind = table.sparkSession, dict(table.dtypes)[ident]
    rows = members(table, ident, vector, group)
    classes = rows.where("key is not null").groupBy("grp", "key").agg(F.min("ident").alias("ident"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n, wide = classes.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not n:
        return rows.select(F.col("ident").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("ident").alias("component_id"), F.col("ident").isNotNull().alias("kept"))
    most = min(SAMPLE, SAMPLE_BYTES // wide)
    # Vectors of all lengths share the codebooks, filled up with zeros; the group keeps lengths apart.
    full = lambda v: np.frombuffer(v.ljust(wide, b"\0"), "<f8")
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * most / n)) + 1) if n > most // 2 else classes
    drawn = np.array([full(bytes(r["v"])) for r in collect_bounded(sample.select("key", "v").orderBy("key"), most, "the sample")] or [full(b"")])
    grid = Grid(drawn, max(1, n // per_cell), least, target)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                visits = list(grid.visits(np.array([full(x.as_buffer().to_pybytes()) for x in piece.column(3)])))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([w[0] for w in visits], pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=["cls", "grp", "copies", "v", "home", "visits"])

    placed = materialise(classes.select("cls", "grp", "copies", "v").mapInArrow(place, "cls long, grp string, copies long, v binary, home long, visits array<long>"), "placed")
    asked = placed.select("grp", F.explode("visits").alias("cell"))
    load = asked.groupBy("grp", "cell").agg(F.count("*").alias("askers")).join(placed.groupBy("grp", F.col("home").alias("cell")).agg(F.count("*").alias("livers")), ["grp", "cell"])
    up = lambda c: F.ceil(F.col(c) / block).cast("int")
    hot = materialise(load.select("grp", "cell", up("askers").alias("ap"), up("livers").alias("lp")).where("ap > 1 or lp > 1"), "hot")  # at most a visit's share of n / block cells
    hot = F.broadcast(hot) if hot.limit(100_001).count() <= 100_000 else hot
    part = lambda c: F.pmod(F.xxhash64("cls"), F.coalesce(c, F.lit(1))).cast("int")
    copies = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    asks = placed.select("cls", "grp", "copies", "v", "home", F.array().cast("array<long>").alias("visits"), F.explode("visits").alias("cell")).join(hot, ["grp", "cell"], "left")
    asks = asks.select("cls", "grp", "copies", "v", "home", "visits", "cell", F.lit(True).alias("asks"), part(F.col("ap")).alias("a"), copies(F.col("lp")).alias("l"))
    lives = placed.withColumn("cell", F.col("home")).join(hot, ["grp", "cell"], "left")
    lives = lives.select("cls", "grp", "copies", "v", "home", "visits", "cell", F.lit(False).alias("asks"), copies(F.col("ap")).alias("a"), part(F.col("lp")).alias("l"))
    found = materialise(asks.unionByName(lives).groupBy("grp", "cell", "a", "l").applyInArrow(_verify(least), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    linked = classes.select("cls", "key", "ident", "copies").join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    linked = materialise(linked.select("key", "ident", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "linked")
    lowest = linked.groupBy("component").agg(F.min("ident").alias("component_id"))
    linked = linked.join(lowest, "component").select("key", "n_links", "component_id")
    alone = F.col("key").isNull()
    out = rows.select("ident", "key").join(linked, "key", "left")
    return out.select(F.col("ident").alias(ident), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("ident")).otherwise(F.col("component_id")).cast(kind).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(ident) == F.col("component_id"), F.lit(False))
    )


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP11 = """with recursive
u as materialized (select vec_id, label, embedding::double[] v from embeddings where embedding is not null and len(embedding) > 0 and label is not null
  and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
link as materialized (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select vec_id a, vec_id b from embeddings union select reach.a, link.b from reach join link on link.a = reach.b),
least as (select a vec_id, min(b) component_id from reach group by 1),
degree as (select a vec_id, count(*) n from link group by 1)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from embeddings left join degree using (vec_id) join least using (vec_id)"""
