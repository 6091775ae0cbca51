"""Passages that repeat across documents, exactly or nearly, by compact windows.

For each of `hashes` hash functions, the Cartesian tree of a document's 5-word shingle hashes groups
all passages of at least `least` words by their minimum: a node (l, c, r) stands for every passage that
begins in [l, c] and ends in [c, r], all with the hash at c as signature. There are about 2n / least
nodes, so a text of n words gives few rows. Windows with one signature are brought together, and a pair of
documents is verified if windows of at least two hash functions overlap in it. Verification aligns the
shingles and keeps spans of at least `least` words with Jaccard similarity of 0.8 or more.

Equal texts are one from the start: later copies are spans of the whole text. In a signature of up to 16
documents all meet all. In a crowded one each meets the first, and what this leaves without a span goes on
with a longer signature: the 25 words before, around and after the centre, again all with all up to 16 and
else with the first, and last the 50 words of each passage over the centre. Documents with one signature
of 50 words share that passage word by word, so its first document is a source for all, and no passage that
is repeated exactly is lost by the crowd. (The five hash functions pass over a passage at 0.8 exactly once
in 150, and one at 0.9 once in 2,000; longer passages have more windows and more chances.)

The later document (larger doc_id) holds the repeat, the earlier one is its source.

Edges: null and empty texts and texts under `least` words have no passages; a doc_id that is null or no
whole number is passed over; repeats within one document, and between rows that share a doc_id, don't
count; documents of any length take n log n time; verification compares shingles by 32-bit hashes within
the pair; a window's reach to either side of its centre is known up to 65535 words, and wider ones overlap
through the narrower windows inside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WordHash, batches, having, joined_shingles, materialise, mix, partitions, shingles
from .decontam import cut_words, merged

WIDTH, LEAST, HASHES, SIMILAR = 5, 50, 5, 0.8
RAW_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SEEDS = np.random.default_rng(11).integers(1, 2**63, HASHES, np.uint64)
#: Documents of a signature that all meet all; parts of a signature that holds over 1/2000 of all windows.
MANY, SALTS = 16, 64


def compact_windows(h: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, c, l, r) of every Cartesian-tree node at least `least` wide, of many texts whose hashes stand in one row.

    Text k has the places from starts[k] to starts[k + 1]; c is the first place of the minimum. The centres
    are the minima of all runs of `least` places, found by running minima from block ends. The next smaller
    place to a side of a centre is a centre too, so bounds are found among the centres alone, by jumping over
    those that are larger.
    """
    n = len(h)
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    bits = np.uint64(int(n).bit_length())
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)  # equal hashes: the first place is the least
    box = np.full(-(-n // least) * least, 2**64 - 1, np.uint64)
    box[:n] = key
    box = box.reshape(-1, least)
    ahead = np.minimum.accumulate(box, 1).ravel()
    back = np.minimum.accumulate(box[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[: n - least + 1], ahead[least - 1 : n])
    edge = np.zeros(n + 1, np.int64)  # runs that begin in a text's last places would end in the next text
    np.add.at(edge, np.maximum(starts[1:] - least + 1, starts[:-1]), 1)
    np.add.at(edge, starts[1:], -1)
    low = low[np.cumsum(edge)[: len(low)] == 0]
    low = low[np.concatenate((np.ones(min(1, len(low)), bool), low[1:] != low[:-1]))]
    c = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(starts, c, "right") - 1
    bound = []
    for step, end in ((-1, np.searchsorted(text, text, "left")), (1, np.searchsorted(text, text, "right") - 1)):
        todo = np.arange(len(c))
        to = todo + step
        while len(todo):
            todo = todo[(to[todo] - end[todo]) * step <= 0]
            todo = todo[low[to[todo]] > low[todo]]
            to[todo] = to[to[todo]]
        bound.append((to, (to - end) * step <= 0))
    (before, has), (after, had) = bound
    last = max(0, len(c) - 1)
    l = np.where(has, c[np.maximum(before, 0)] + 1, starts[text])
    r = np.where(had, c[np.minimum(after, last)] - 1, starts[text + 1] - 1)
    return text, c - starts[text], l - starts[text], r - starts[text]


def _place(f, c: np.ndarray, left, right) -> np.ndarray:
    return f << 60 | c << 32 | np.minimum(left, 65535) << 16 | np.minimum(right, 65535)


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash function and both ends of windows."""
    c = place >> 32 & (1 << 28) - 1
    return place >> 60, c - (place >> 16 & 65535), c + (place & 65535)


def _rows(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in columns], names=names)


def windows(docs: DataFrame, text: str, ident: str, hashes: int = HASHES, least: int = LEAST) -> DataFrame:
    """(value, doc_id, place): signature of a window, and the hash function, c, c - l and r - c in one number."""
    wide = least - WIDTH + 1

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for _, ids, texts in batches(frames, ident, text):
            owner = np.array(ids, np.int64)
            base, starts = joined_shingles(*words.joined(texts), WIDTH)
            rows: list[list[np.ndarray]] = [[], [], []]
            for f in range(hashes if len(base) else 0):
                h = mix(base ^ _SEEDS[f])
                k, c, l, r = compact_windows(h, starts, wide)
                for to, x in zip(rows, (h[starts[k] + c].view(np.int64), owner[k], _place(f, c, c - l, r - c)), strict=True):
                    to.append(x)
            yield _rows(rows, ["value", "doc_id", "place"])

    return docs.select(ident, text).mapInArrow(run, "value long, doc_id long, place long")


#: Kinds of rows that `meetings` gives out.
PAIR, CROWD, FIRST = 0, 1, 2


def _met(v: np.ndarray, s: np.ndarray, d: np.ndarray, p: np.ndarray, first: int | None = None) -> list[np.ndarray]:
    """Rows (kind, value, a, b, place) of groups of equal (v, s), sorted by d; with `first`, all are of one crowded
    group that began with that document."""
    fresh = np.concatenate(([True], (v[1:] != v[:-1]) | (s[1:] != s[:-1])))
    other = fresh | np.concatenate(([True], d[1:] != d[:-1]))
    begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    docs, rank = d[other], np.cumsum(other) - 1
    low = rank[begin]
    rank = rank - low[group]
    lead, crowd = docs[low], (np.diff(np.append(low, len(docs))) > MANY) | (s[begin] >= 0)
    if first is not None:
        lead, crowd, rank = np.array([first]), np.array([True]), (d != first).astype(np.int64)
    few = np.flatnonzero((rank > 0) & ~crowd[group])
    n = rank[few]  # each window meets all earlier documents of its group
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(few, n)
    pairs = np.stack([np.full(len(at), PAIR), v[at], docs[low[group[at]] + step], d[at], p[at]])
    at = np.flatnonzero(crowd[group])
    crowded = np.stack([np.full(len(at), CROWD), v[at], lead[group[at]], d[at], p[at]])
    at = np.flatnonzero((s >= 0) & (rank == 0))
    return [pairs, crowded, np.stack([np.full(len(at), FIRST), v[at], d[at], d[at], p[at]])]


def meetings(found: DataFrame, hot: list[int]) -> DataFrame:
    """(kind, value, a, b, place), a <= b. PAIR: a window of b meets an earlier document. CROWD: a window of a crowded
    signature and its first document. FIRST: windows of the first document of each part of a hot signature.

    A hot signature is dealt to 64 parts, each a crowd of its own; their first documents meet in a second pass.
    """
    salt = F.when(F.col("value").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))) if hot else F.lit(None)
    dealt = found.select("value", F.coalesce(salt.cast("long"), F.lit(-1)).alias("salt"), "doc_id", "place")
    dealt = dealt.repartition(partitions(found.sparkSession), "value", "salt").sortWithinPartitions("value", "salt", "doc_id", "place")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 4
        held, crowd = none, None
        for batch in frames:
            cols, rows = [batch.column(k).to_numpy() for k in range(4)], []
            if crowd is not None and len(cols[0]):  # goes on with the crowd that the last batch ended in
                same = (cols[0] == crowd[0]) & (cols[1] == crowd[1])
                k = len(same) if same.all() else int(same.argmin())
                if k:
                    rows += _met(*(x[:k] for x in cols), first=crowd[2])
                    cols = [x[k:] for x in cols]
                if len(cols[0]):
                    crowd = None
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            v, s, d, _ = held
            if len(v):
                cut = int(((v == v[-1]) & (s == s[-1])).argmax())  # the group that the batch ends in begins here
                if cut:
                    rows += _met(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
                if len(np.unique(d[cut:])) > MANY:
                    rows += _met(*held)
                    crowd, held = (v[cut], s[cut], int(d[cut])), none
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(rows, 1)], names=["kind", "value", "a", "b", "place"])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(_met(*held), 1)], names=["kind", "value", "a", "b", "place"])

    out = dealt.mapInArrow(run, "kind long, value long, a long, b long, place long")
    return out


def _all_meetings(found: DataFrame, sample: DataFrame) -> DataFrame:
    """Meetings with hot signatures dealt apart; `sample` (windows of a fiftieth of the documents) only says which are hot."""
    total = sample.count()
    hot = [r["value"] for r in sample.groupBy("value").count().where(f"count > greatest({total} / 2000, 50)").collect()]  # fewer than 2000
    met = materialise(meetings(found, hot), "met")
    if hot:
        firsts = met.where(f"kind = {FIRST}").select("value", F.col("b").alias("doc_id"), "place")
        met = met.unionByName(materialise(meetings(firsts, []), "met"))
    return met


def _overlap(places: np.ndarray) -> bool:
    """Windows of two hash functions overlap: in order of begin, one begins before an earlier one of another function ends."""
    f, lo, hi = _parts(places)
    order = np.argsort(lo, kind="stable")
    best: dict[int, int] = {}
    for k in order.tolist():
        if any(g != f[k] and end >= lo[k] for g, end in best.items()):
            return True
        best[int(f[k])] = max(best.get(int(f[k]), -1), int(hi[k]))
    return False


def candidates(met: DataFrame) -> DataFrame:
    """(a, b), a < b: documents with matched windows of two hash functions that overlap in b."""
    links = met.where(f"kind <> {FIRST} and a < b")
    per = links.groupBy("a", "b").agg(F.collect_set("place").alias("places"))
    per = per.where(F.size(F.array_distinct(F.transform("places", lambda p: F.shiftright(p, 60)))) > 1)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            places = batch.column(2)
            flat, size = places.flatten().to_numpy(), places.value_lengths().to_numpy()
            ends = np.cumsum(size)
            keep = [_overlap(flat[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return per.mapInArrow(run, "a long, b long")


OFTEN = 8


def _numbered(*rows: np.ndarray) -> list[np.ndarray]:
    """The rows with each value as its rank among all."""
    both = np.unique(np.concatenate(rows), return_inverse=True)[1]
    return np.split(both, np.cumsum([len(r) for r in rows[:-1]]))


def _grams(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the runs of 1, 2, 4 ... shingles that begin at each place of a and of b; as long as both have one in common."""
    out = [(a, b)]
    k = 1
    while 2 * k <= min(len(a), len(b)):
        x, y = out[-1]
        x, y = _numbered(*(v[:-k] * (len(a) + len(b)) + v[k:] for v in (x, y)))
        if not np.isin(y, x).any():
            break
        out.append((x, y))
        k *= 2
    return out


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of x in order of its numbers; for each number of y, where its places begin there and how many there are."""
    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    times = np.bincount(x, minlength=n)
    return np.argsort(x, kind="stable"), (np.cumsum(times) - times)[y], times[y]


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (p in b, q in a) of equal numbers.

    All places of a shingle that a has at most eight times. Of one that a has more often, the places of the
    shortest run of 1, 2, 4 ... shingles from there on that a has at most eight times, or else of the longest
    run that a has at all (one place: all are alike); runs are followed along their diagonals to both sides.
    """
    spread = lambda order, lo, n: order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    order, lo, times = _places(a, b)
    if times.max(initial=0) <= OFTEN:
        return np.repeat(np.arange(len(b)), times), spread(order, lo, times)
    levels = _grams(a, b)
    ps, qs = [], []
    todo = np.flatnonzero(times)
    for k, (x, y) in enumerate(levels):
        order, lo, times = _places(x, y)
        inside = todo[todo < len(y)]
        n = times[inside]
        rare = inside[(n > 0) & (n <= OFTEN)]
        ps.append(np.repeat(rare, times[rare]))
        qs.append(spread(order, lo[rare], times[rare]))
        more = inside[n > OFTEN]
        # Those whose next longer run a does not have, or that end here: one place, unless a run before covers them.
        after = np.zeros(len(more), bool)
        if k + 1 < len(levels):
            x2, y2 = levels[k + 1]
            fits = more < len(y2)
            after[fits] = np.isin(y2[more[fits]], x2)
        to = -1
        for at in more[~after].tolist():
            if at >= to:
                ps.append(np.array([at]))
                qs.append(order[[lo[at]]])
                to = at + (1 << k)
        todo = more[after]
    p, q = np.concatenate(ps), np.concatenate(qs)
    # To both ends of each run: steps of 2^k shingles, longest first.
    first, end = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        (x, y), step = levels[k], 1 << k
        for _ in range(2 if k < len(levels) - 1 else max(1, len(b) // step)):
            i, j = p + end, q + end
            ok = (i < len(y)) & (j < len(x))
            ok[ok] = y[i[ok]] == x[j[ok]]
            end += ok * step
            i, j = p - first - step, q - first - step
            ok2 = (i >= 0) & (j >= 0)
            ok2[ok2] = y[i[ok2]] == x[j[ok2]]
            first += ok2 * step
            if not (ok.any() or ok2.any()):
                break
    runs = np.unique(np.stack([p - first, q - first, first + end], 1), axis=0)
    n = runs[:, 2]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(runs[:, 0], n) + step, np.repeat(runs[:, 1], n) + step


def _chains(parts: list[np.ndarray], p: np.ndarray, q: np.ndarray, gap: int) -> list[np.ndarray]:
    """Runs that follow each other in both texts, joined. A step over words that one side lacks may be a
    quarter as long as what it joins; each run is in one chain."""
    parts = sorted(parts, key=lambda x: int(p[x[0]]))
    b0, b1 = np.array([p[x[0]] for x in parts]), np.array([p[x[-1]] + 1 for x in parts])
    a0, a1 = np.array([q[x].min() for x in parts]), np.array([q[x].max() + 1 for x in parts])
    score, before = np.array([len(x) for x in parts], float), np.full(len(parts), -1)
    own = score.copy()
    for j in range(1, len(parts)):
        step = np.maximum(b0[j] - b1[:j], a0[j] - a1[:j])
        ok = (b0[j] > b0[:j]) & (a0[j] > a0[:j]) & (b1[j] > b1[:j]) & (a1[j] > a1[:j]) & (b0[j] >= b1[:j] - WIDTH) & (a0[j] >= a1[:j] - WIDTH) & (step <= gap + (score[:j] + own[j]) / 4)
        if ok.any():
            before[j] = int(np.where(ok, score[:j] - np.maximum(step, 0) / 2, -1e18).argmax())
            score[j] += score[before[j]]
    out, used = [], np.zeros(len(parts), bool)
    for j in np.argsort(-score, kind="stable"):
        chain: list[np.ndarray] = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(parts[j])
            j = before[j]
        if chain:
            out.append(np.concatenate(chain[::-1]))
    return out


def align(a: np.ndarray, b: np.ndarray, wide: int, similar: float = SIMILAR, gap: int = 20, drift: int = 4) -> list[tuple[int, int, int, int, float]]:
    """(b begin, b end, a begin, a end, similarity) in shingles, ends exclusive, of the spans that a and b share.

    Equal shingles are sorted by diagonal; neighbours up to `drift` apart are one band, and a band is cut
    where `gap` shingles have no match. Pieces that follow each other in both texts are chained, so words put
    in or left out don't part a passage. A chain that is long but not similar enough is split at its widest
    step in either text, and one without steps by diagonal.
    """
    if min(len(a), len(b)) < wide * similar:
        return []
    a, b = _numbered(a, b)
    p, q = _matches(a, b)
    if len(p) < wide * similar:
        return []
    kinds = int(max(a.max(), b.max())) + 1
    d = q - p
    by = np.lexsort((p, d))
    parts: list[np.ndarray] = []
    ends = [0, *(np.flatnonzero(np.diff(d[by]) > drift) + 1).tolist(), len(by)]
    for lo, hi in zip(ends, ends[1:], strict=False):
        if hi - lo < WIDTH:
            continue
        band = by[lo:hi]
        band = band[np.argsort(p[band], kind="stable")]
        at = [0, *(np.flatnonzero(np.diff(p[band]) > gap) + 1).tolist(), len(band)]
        parts += [band[x:y] for x, y in zip(at, at[1:], strict=False) if y - x >= WIDTH]
    out: list[tuple[int, int, int, int, float]] = []
    work = [x for x in (_chains(parts, p, q, gap) if len(parts) > 1 else parts) if len(x) >= wide * similar]
    while work:
        run = work.pop()
        if not len(run):
            continue
        in_b, in_a = p[run], q[run]
        b0, b1 = int(in_b.min()), int(in_b.max()) + 1
        if b1 - b0 < wide:
            continue
        a0, a1 = int(in_a.min()), int(in_a.max()) + 1
        if a1 - a0 < wide * similar:
            continue
        seen = np.zeros(kinds, np.int8)
        seen[a[a0:a1]] = 1
        seen[b[b0:b1]] |= 2
        j = np.count_nonzero(seen == 3) / np.count_nonzero(seen)
        if j >= similar:
            out.append((b0, b1, a0, a1, j))
            continue
        steps = np.maximum(in_b[1:] - in_b[:-1], np.abs(in_a[1:] - in_a[:-1]))
        if len(steps) and steps.max() > 1:
            k = int(steps.argmax()) + 1
            work += [run[:k], run[k:]]
        elif (across := np.unique(d[run])).size > 1:
            work += [run[d[run] == x] for x in across]
    return out


def repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row for each repeated span: doc_id, text_key, start, end (words), source_doc_id, source_start,
    source_end, similarity. A span found with several sources is given with the smallest one."""
    docs = docs.select(F.col(ident).try_cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    digests = materialise(docs.select("doc_id", F.md5("text").alias("digest")), "digests")
    first = materialise(digests.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("most"), F.count("*").alias("n")), "first")
    own = materialise(first.select(F.col("source").alias("doc_id")).distinct(), "own")
    # A text that has over 1/2000 of the rows (fewer than 2000 texts do) is sent to every task, the others meet their copies in a shuffle.
    total = digests.count()
    often = F.broadcast(first.where(f"source < most and n * 2000 > {total}").select("digest", F.col("source").alias("hot")))
    marked = digests.join(often, "digest", "left")
    cold = marked.where("hot is null").join(first.where(f"source < most and n * 2000 <= {total}").select("digest", "source"), "digest").select("doc_id", "digest", "source")
    copies = materialise(cold.unionByName(marked.where("hot is not null").select("doc_id", "digest", F.col("hot").alias("source"))).where("source < doc_id").distinct(), "copies")
    words = F.size(F.array_remove(F.split("text", BLANKS), ""))
    whole = having(docs, materialise(copies.select("doc_id").distinct(), "copy_ids"), "doc_id").select("doc_id", F.md5("text").alias("digest"), F.xxhash64("text").alias("text_key"), words.alias("end"))
    whole = materialise(whole.join(copies, ["doc_id", "digest"]), "whole").where(F.col("end") >= least).distinct()  # written first, so words are counted in copies only
    whole = whole.select("doc_id", "text_key", F.lit(0).alias("start"), "end", F.col("source").alias("source_doc_id"), F.lit(0).alias("source_start"), F.col("end").alias("source_end"), F.lit(1.0).alias("similarity"))
    docs = having(docs, own, "doc_id")

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0)
    met = _all_meetings(windows(docs, "text", "doc_id", least=least), materialise(windows(some, "text", "doc_id", least=least).select("value"), "some"))
    pairs = materialise(candidates(met), "pairs")
    spans = materialise(verified(pairs, docs, "text", "doc_id", least), "spans")
    for width, offsets in ((LONGER, (LONGER - 1, LONGER // 2, 0)), (least - WIDTH + 1, range(least - WIDTH + 1))):
        free = materialise(_free(met.where(f"kind = {CROWD}"), spans).groupBy("doc_id").agg(F.collect_set("c").alias("marks")), "free")
        longer = materialise(longer_windows(free, docs, width, offsets), "longer")
        met = _all_meetings(longer, longer.where(F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0))
        more = met.where(f"kind <> {FIRST} and a < b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        more = materialise(more, "more")
        if more.limit(1).count():
            pairs = pairs.unionByName(more)
            spans = spans.unionByName(materialise(verified(more, docs, "text", "doc_id", least), "spans"))
    one = spans.unionByName(whole).groupBy("doc_id", "text_key", "start", "end").agg(F.min(F.struct("source_doc_id", "source_start", "source_end", "similarity")).alias("m"))
    return one.select("doc_id", "text_key", "start", "end", "m.*")


LONGER = 21  # shingles, 25 words


def _free(crowd: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, c): centres of crowded windows that lie in no span of their document."""
    held = spans.select(F.col("doc_id").alias("d"), "start", "end").distinct()
    c = F.shiftright("place", 32).bitwiseAND((1 << 28) - 1).cast("int")
    one = crowd.select(F.col("b").alias("doc_id"), c.alias("c")).distinct()
    return one.join(held, (F.col("doc_id") == F.col("d")) & (F.col("c") >= F.col("start")) & (F.col("c") < F.col("end")), "left_anti")


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(base: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` shingles from each of `begin` on: differences of one polynomial's running sums."""
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(base), _STEP))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(base), np.uint64(pow(int(_STEP), -1, 1 << 64))))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(base * power[:-1])))
    return mix((sums[begin + width] - sums[begin]) * back[begin])


def longer_windows(free: DataFrame, docs: DataFrame, width: int, offsets) -> DataFrame:
    """(value, doc_id, place): signatures of `width` shingles that hold a centre of `marks` at one of the offsets."""
    total = free.agg(F.coalesce(F.sum(F.size("marks") + 1), F.lit(0))).first()[0]
    both = with_lists(docs.select("doc_id", "text"), free, total).select("doc_id", "text", "marks")
    shift = np.array(offsets, np.int64)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for _, ids, texts, marks in batches(frames, "doc_id", "text", "marks"):
            rows: list[list[np.ndarray]] = [[], [], []]
            for doc, t, m in zip(ids, texts, marks, strict=True):
                base = shingles(words.of(t), WIDTH)
                c = np.array(m, np.int64)
                begin, c = (c[:, None] - shift).ravel(), np.repeat(c, len(shift))
                inside = (begin >= 0) & (begin + width <= len(base))
                begin, at = np.unique(begin[inside], return_index=True)
                for to, x in zip(rows, (_run_hashes(base, begin, width).view(np.int64), np.full(len(begin), doc), _place(7, c[inside][at], 0, 0)), strict=True):
                    to.append(x)
            yield _rows(rows, ["value", "doc_id", "place"])

    return both.mapInArrow(run, "value long, doc_id long, place long")


def with_lists(docs: DataFrame, lists: DataFrame, entries: int) -> DataFrame:
    """docs joined with lists(doc_id, ...) of `entries` entries in all: up to two million (some 40 MB) are sent to the
    tasks, so texts are not shuffled; more meet the texts in a shuffle."""
    return docs.join(F.broadcast(lists) if entries <= 2_000_000 else lists.hint("merge"), "doc_id")


def verified(pairs: DataFrame, docs: DataFrame, text: str, ident: str, least: int) -> DataFrame:
    """Spans of the pairs (a, b) that the alignment of their shingles confirms.

    Each b's shingles travel once for each of its pairs, to the task of a; an a of many pairs has a copy in
    each part of 100 of them.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 100).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").select("b", "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    asked = dealt.groupBy(F.col("b").alias("doc_id")).agg(F.collect_list(F.struct("a", "part")).alias("asked"))
    lists = materialise(asked.join(sizes.withColumnRenamed("a", "doc_id"), "doc_id", "full_outer").select("doc_id", F.coalesce("asked", F.array().cast("array<struct<a:bigint,part:int>>")).alias("asked"), F.coalesce("parts", F.lit(0)).alias("parts")), "lists")
    total = lists.agg(F.coalesce(F.sum(F.size("asked") + 1), F.lit(0))).first()[0]
    both = with_lists(docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("body")), lists, total)
    names = ["a", "part", "b", "text_key", "s"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, ids, keys, texts, copies in batches(frames, "doc_id", "text_key", "body", "parts", rows=64):
            base, starts = joined_shingles(*words.joined(texts), WIDTH)
            short = (base >> np.uint64(32)).astype(np.uint32).view(np.int32)
            asked = batch.column(batch.schema.get_field_index("asked")).to_pylist()
            rows: list[tuple] = []
            for k, (doc, key, n) in enumerate(zip(ids, keys, copies, strict=True)):
                s = short[starts[k] : starts[k + 1]]
                rows += [(doc, part, None, key, s) for part in range(n)] + [(x["a"], x["part"], doc, key, s) for x in asked[k]]
                if len(rows) >= 256 or k == len(ids) - 1:
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=names)
                    rows = []

    met = both.select("doc_id", "text_key", "body", "asked", "parts").mapInArrow(run, "a long, part int, b long, text_key long, s array<int>")
    met = met.repartition(partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "b")  # the copies of a come first
    wide = least - WIDTH + 1

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in frames:
            s = batch.column(4)
            flat, ends = s.flatten().to_numpy(), np.cumsum(s.value_lengths().to_numpy())
            begins, rows = np.concatenate(([0], ends[:-1])) if len(ends) else ends, []
            for k, (a, part, b, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (a, part) != last:
                    last, own = (a, part), []
                mine = flat[begins[k] : ends[k]]
                if b is None:
                    own.append(mine.copy())  # rows that share a doc_id are several texts
                else:
                    rows += [(b, key, b0, b1 + WIDTH - 1, a, a0, a1 + WIDTH - 1, j) for x in own for b0, b1, a0, a1, j in align(x, mine, wide)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "text_key", "start", "end", "source_doc_id", "source_start", "source_end", "similarity"])

    return met.mapInArrow(verify, "doc_id long, text_key long, start int, end int, source_doc_id long, source_start int, source_end int, similarity double")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents with a repeat have rows: the span, and the earlier document that has it too."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "source_doc_id", F.col("source_start").alias("source_start_word"), F.col("source_end").alias("source_end_word"), F.round("similarity", 6).alias("similarity"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; repeated spans are cut from the later ones. A document with nothing else left goes."""
    found = materialise(repeats(docs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "cut")
    keyed = docs.select(F.struct("*").alias("row"), F.col("text").alias("body"), F.col("doc_id").try_cast("long").alias("k"), F.xxhash64("text").alias("h"))
    # A row for each document with a repeat: up to a million spans in all (8 MB) go to the tasks, more meet the texts in a shuffle.
    held = found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    found = F.broadcast(found) if held <= 1_000_000 else found.hint("merge")
    both = keyed.join(found, (keyed.k == found.doc_id) & (keyed.h == found.text_key), "left").select("row", "body", "spans")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, spans in batches(frames, "body", "spans"):
            new = [cut_words(t, merged([(x["start"], x["end"]) for x in s]), RAW_WORD, None) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())], names=["row", "body", "cut"])

    out = both.mapInArrow(run, both.select("row", "body", F.lit(True).alias("cut")).schema)
    n = F.length("body").cast("long")
    kept = out.where(~F.col("cut") | F.col("body").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("body").alias(c) if c == "text" else F.when(F.col("cut"), n).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
