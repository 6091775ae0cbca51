"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the words: the sorted 64-bit hashes of all training words and the running sums of their
counts, both Elias-Fano sequences; a word's number is its rank, its count is exact. Level 2 holds, for each
word, its successors: a sequence of pointers (monotone) to the first successor of each word number, one of
the successors (made monotone by the context's place), and a quantised log probability for each. Level 3
does the same for pairs of words as contexts, with a quantised back-off weight for each context. A successor
is found relative to its context: the pointers give the range, select on the high bits the few entries with
the same high part, and a search of low bytes the entry. Levels are files that tasks map into memory.

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | v) = (c(v, w) + k * P(w)) / (c(v) + k)
    P(w | u, v) = (c(u, v, w) + k * P(w | v)) / (C(u, v) + k),   C the sum of c(u, v, w) over the level's w

Level 3 has the triples both of whose pairs occur at least twice (no other can occur twice), with all their
counts; a context without entries there is one of level 2. Counts cover all training documents. The trie is
cut into parts of nearly equal training mass by the order of (v, w), so a frequent context is several parts;
their number grows with the corpus, and no part, nor a table of n-grams, ever passes through the driver.
Files are in the folder of spark.checkpoint.dir, which must be mounted on every machine (a path that can be
mapped).

Edges: null and empty texts are the end token alone; repeated rows count as often as they occur; words
unseen in training get the unigram's add-one share; an empty training set gives a model without words.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, batches, scratch_path

END, BEGIN = np.uint64(1), np.uint64(0)  # hashes kept for the end of a text and what stands before it
STEP = 4096.0  # codes are -log10 p in steps of 1/4096
KAPPA = 4.0


_SELECT = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[r] for x in range(256) for r in range(8)], np.int64)
_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def _in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word: running counts of its bytes side by side in one word, then a table for the byte."""
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    r = r.astype(np.uint64)
    b = np.bitwise_count(((r * _ONES | _TOPS) - s) & _TOPS).astype(np.uint64) << _U(3)  # bits in bytes that end before it
    before = ((s << _U(8)) >> b) & _U(255)
    byte = (x >> b) & _U(255)
    return b.astype(np.int64) + _SELECT[(byte << _U(3) | (r - before)).astype(np.int64)]


def _sampled(ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """Words of each 2**shift-th bit, as many samples as there are words about, and the shift."""
    shift = min(6, max(0, (int(ranks[-1]) // max(1, len(ranks) - 1)).bit_length() - 1))
    at = np.searchsorted(ranks, np.arange(0, int(ranks[-1]) + (2 << shift), 1 << shift), "right") - 1
    return np.minimum(at, max(0, len(ranks) - 2)).astype(np.int32), shift


class EliasFano:
    """A monotone sequence of integers: low bits packed in whole bytes, high bits in unary with counts per word.

    Low parts are rounded to the next number of bytes, so an entry has at most 17 high bits and at most 16 entries
    share a high part on the average. Samples of set and unset bits lead to their words.
    """

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low = min(56, (max(0, (max(1, universe) // max(1, n)).bit_length() - 1) + 4) // 8 * 8)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(high[-1]) + 1 if n else 0) // 64 + 1) * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.concatenate(([0], np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))))
        lows = v.view(np.uint8).reshape(n, 8)[:, : low // 8] if n else np.zeros((0, low // 8), np.uint8)
        (ones, one), (gaps, gap) = _sampled(ranks), _sampled(np.arange(len(ranks)) * 64 - ranks)
        form = np.array([low, n, int(high[-1]) - n + 1 if n else -1, one, gap])
        return {"words": words, "ranks": ranks, "lows": np.ascontiguousarray(lows).ravel(), "ones": ones, "gaps": gaps, "form": form}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.words, self.ranks, self.ones, self.gaps = (parts[k] for k in ("words", "ranks", "ones", "gaps"))
        self.low, self.n, self.top, self.one, self.gap = (int(x) for x in parts["form"])
        self.lows = parts["lows"].reshape(self.n, self.low // 8) if self.low else None

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the i-th set bit, or unset one: between two samples, a search over the counts of the words there."""
        samples, shift = (self.ones, self.one) if ones else (self.gaps, self.gap)
        before = (lambda w: self.ranks[w]) if ones else (lambda w: (w << 6) - self.ranks[w])
        k = i >> shift
        lo, hi = samples[k].astype(np.int64), samples[k + 1].astype(np.int64)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo] + 1) >> 1
            ok = before(mid) <= i[todo]
            lo[todo] = np.where(ok, mid, lo[todo])
            hi[todo] = np.where(ok, hi[todo], mid - 1)
            todo = todo[lo[todo] < hi[todo]]
        at = self.words[lo]
        return (lo << 6) + _in_word(at if ones else ~at, i - before(lo))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low // 8):
            out |= self.lows[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: select on the high bits, then the low bytes."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low) | self._low(i)) if self.low else high

    def find(self, target: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Place of each target within [low, high) of the sequence, -1 where it isn't there."""
        out = np.full(len(target), -1, np.int64)
        h = target >> np.uint64(self.low)
        at = np.flatnonzero(h <= np.uint64(self.top)) if self.n else out[:0]
        if not len(at):
            return out
        h = h[at].astype(np.int64)
        # Entries with this high part stand between two unset bits.
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        end = self._select(h, False) - h
        if low is not None:
            begin, end = np.maximum(begin, low[at]), np.minimum(end, high[at])
        want = target[at] & ((np.uint64(1) << np.uint64(self.low)) - np.uint64(1))
        b, e = begin.copy(), end.copy()
        todo = np.flatnonzero(b < e)
        while len(todo):
            mid = (b[todo] + e[todo]) >> 1
            less = self._low(mid) < want[todo] if self.low else np.zeros(len(mid), bool)
            b[todo] = np.where(less, mid + 1, b[todo])
            e[todo] = np.where(less, e[todo], mid)
            todo = todo[b[todo] < e[todo]]
        hit = np.flatnonzero(b < end)
        if self.low:
            hit = hit[self._low(b[hit]) == want[hit]]
        out[at[hit]] = b[hit]
        return out


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One flat file and a small index; written under another name first, so a repeated task can't be seen half done."""
    os.makedirs(folder, exist_ok=True)
    index, at = {}, 0
    path = f"{folder}/{name}"
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for k, a in arrays.items():
            a = np.ascontiguousarray(a)
            f.write(b"\0" * (-at % 8))
            at += -at % 8
            index[k] = (at, len(a), a.dtype.str)
            f.write(a.tobytes())
            at += a.nbytes
    with open(f"{own}.json", "w") as f:
        json.dump(index, f)
    os.replace(own, f"{path}.bin")
    os.replace(f"{own}.json", f"{path}.json")


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    with open(f"{folder}/{name}.json") as f:
        index = json.load(f)
    raw = np.asarray(np.memmap(f"{folder}/{name}.bin", np.uint8, "r")) if os.path.getsize(f"{folder}/{name}.bin") else np.zeros(0, np.uint8)
    return {k: raw[at : at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in index.items()}


def sequences(**named: tuple[np.ndarray, int]) -> dict[str, np.ndarray]:
    """Arrays of Elias-Fano sequences, by name: (values, universe)."""
    return {f"{name}.{k}": a for name, (v, u) in named.items() for k, a in EliasFano.encode(v, u).items()}


def opened(raw: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: raw[f"{name}.{k}"] for k in ("words", "ranks", "lows", "ones", "gaps", "form")})


class Words:
    """Level 1: parts by the leading bits of the hash; number of a word = numbers before its part + rank in it."""

    def __init__(self, folder: str, parts: int, starts: list[int], below: list[int]):
        self.folder, self.parts = folder, parts
        self.starts, self.before = np.array(starts, np.int64), np.array(below, np.int64)
        self.bits = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else np.uint64(64)
        self.open: dict[int, tuple[EliasFano, EliasFano]] = {}

    def level(self, k: int) -> tuple[EliasFano, EliasFano]:
        """Hashes without their leading bits, and the counts of all lesser words of the part (one entry more)."""
        if k not in self.open:
            raw = mapped(self.folder, f"words-{k}")
            self.open[k] = opened(raw, "hash"), opened(raw, "below")
        return self.open[k]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1 if unseen), count and count of all lesser words of each sorted hash."""
        number, count, below = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> self.bits).astype(np.int64) if self.parts > 1 else np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            at = np.arange(cuts[k], cuts[k + 1])
            seq, sums = self.level(k)
            i = seq.find(tail(hashes[at], self.bits))
            at, i = at[i >= 0], i[i >= 0]
            number[at] = self.starts[k] + i
            low = sums.get(i).astype(np.int64)
            count[at], below[at] = sums.get(i + 1).astype(np.int64) - low, self.before[k] + low
        return number, count, below

    def of_numbers(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and count of all lesser words of sorted word numbers."""
        count, below = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        part = np.searchsorted(self.starts, numbers, "right") - 1
        for k in np.unique(part).tolist():
            at = np.flatnonzero(part == k)
            sums, i = self.level(k)[1], numbers[at] - self.starts[k]
            low = sums.get(i).astype(np.int64)
            count[at], below[at] = sums.get(i + 1).astype(np.int64) - low, self.before[k] + low
        return count, below


def tail(hashes: np.ndarray, bits: np.uint64) -> np.ndarray:
    return hashes & ((np.uint64(1) << bits) - np.uint64(1)) if bits < 64 else hashes


def hashed_tokens(words: WordHash, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, in one row, and the number of tokens of each text; the two
    kept values are moved aside by one bit."""
    h, sizes = words.joined(texts)
    return np.insert(np.where(h <= END, h + np.uint64(2), h), np.cumsum(sizes), END), sizes + 1


def grouped(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def varints(values: np.ndarray) -> bytes:
    """Seven bits to a byte, least first; the top bit says that more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k)) if k < 9 else v >= np.uint64(1 << 63)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    start = ends - size
    for k in range(10):
        at = size > k
        if not at.any():
            break
        byte = (v[at] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[start[at] + k] = byte | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)[:n]
    start = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(n, np.uint64)
    size = last - start + 1
    for k in range(int(size.max()) if n else 0):
        at = size > k
        out[at] |= (raw[start[at] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, and their counts."""
    return varints(np.concatenate((np.diff(keys, prepend=keys[:1] * 0), counts.astype(keys.dtype))))


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = from_varints(data, 2 * n)
    return np.cumsum(both[:n]), both[n:].astype(np.int64)


class Gathered:
    """Counts of keys within a task, folded together now and then; the fold is a map-side combine."""

    def __init__(self, most: int = 1_500_000):
        self.keys: list[np.ndarray] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray) -> bool:
        self.keys.append(keys)
        self.held += len(keys)
        return self.held >= self.most

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        keys, self.keys, self.held = (np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)), [], 0
        return grouped(keys)


def _dealt(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part: its packed keys and counts. part and keys are sorted."""
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts[:-1]].astype(np.int32) if spans else [], pa.int32()), pa.array([packed(keys[a:b], counts[a:b]) for a, b in spans], pa.binary()), pa.array([b - a for a, b in spans], pa.int32())], names=["part", "data", "n"])


def _whole(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    both = [unpacked(d, n) for d, n in zip(pdf.data, pdf.n, strict=True)]
    return grouped(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]))


def _code(p: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.round(-np.log10(p) * STEP)).astype(np.uint16)


def train(docs: DataFrame, chosen, text: str = "text", mass: int = 2_000_000) -> dict:
    """Builds the trie from the rows where the column `chosen` holds; returns what a task needs to open it.

    mass: training tokens to a part.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "trie")
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"the trie is mapped into memory: spark.checkpoint.dir must be a mounted folder, not {folder}")
    folder = "/" + folder.split(":", 1)[-1].lstrip("/")
    rows = docs.where(chosen).select(text)
    # Words are dealt to parts by the leading bits of their hash, so no part is hot: 20 million letters of text to a part.
    letters = rows.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    split = min(16, max(0, int(letters // 20_000_000).bit_length()))
    word_parts, bits = 1 << split, np.uint64(64 - split)

    def count_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = WordHash(), Gathered()

        def give():
            h, c = held.drain()
            return _dealt(h >> bits if split else np.zeros(len(h), np.int64), h, c)

        for _, texts in batches(frames, text, rows=1024):
            if held.add(hashed_tokens(words, texts)[0]):
                yield give()
        yield give()

    def write_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        h, c = _whole(pdf)
        save(folder, f"words-{part}", sequences(hash=(tail(h, bits), 1 << int(bits)), below=(np.concatenate(([0], np.cumsum(c))), int(c.sum()) + 1)))
        return pd.DataFrame({"part": [part], "v": [len(h)], "n": [int(c.sum())]})

    sizes = rows.mapInArrow(count_words, "part int, data binary, n int").groupBy("part").applyInPandas(write_words, "part int, v long, n long")
    found = {r["part"]: (r["v"], r["n"]) for r in sizes.collect()}  # a row for each part
    for k in set(range(word_parts)) - set(found):
        save(folder, f"words-{k}", sequences(hash=(np.zeros(0, np.uint64), 1), below=(np.zeros(1, np.int64), 1)))
    v = [found.get(k, (0, 0))[0] for k in range(word_parts)]
    n = [found.get(k, (0, 0))[1] for k in range(word_parts)]
    starts, below = [0, *np.cumsum(v)[:-1].tolist()], [0, *np.cumsum(n)[:-1].tolist()]
    model = {"folder": folder, "word_parts": word_parts, "starts": starts, "below": below, "v": int(sum(v)), "n": int(sum(n)), "parts": max(1, -(-int(sum(n)) // mass)), "pairs": [], "triples": []}

    def count_pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, words, held = Trie(model), WordHash(), Gathered()

        def give():
            keys, c = held.drain()
            return _dealt(lm.parts_of(keys // lm.size, keys % lm.size), keys, c)

        for _, texts in batches(frames, text, rows=1024):
            t = lm.tokens(*hashed_tokens(words, texts))
            if held.add(t.u * lm.size + t.w):
                yield give()
        yield give()

    def write_pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, lm = int(key[0]), Trie(model)
        keys, c = _whole(pdf)
        u, w = keys // lm.size, keys % lm.size
        low, high = int(u[0]), int(u[-1])
        pointers = np.concatenate(([0], np.cumsum(np.bincount((u - np.uint64(low)).astype(np.int64), minlength=high - low + 1))))
        (cu, _), (cw, _) = lm.numbers(u), lm.numbers(w)
        place = u - np.uint64(low)  # makes the successors of all contexts one monotone sequence
        arrays = sequences(pointers=(pointers, len(keys) + 1), successors=(place * lm.size + w, (high - low + 1) * int(lm.size)))
        arrays |= {"codes": _code((c + KAPPA * (cw + 1) / (lm.n + lm.v + 1)) / (cu + KAPPA)), "often": np.packbits(c > 1, bitorder="little"), "range": np.array([low, high])}
        save(folder, f"pairs-{part}", arrays)
        return pd.DataFrame({"part": [part], "n": [len(keys)]})

    done = rows.mapInArrow(count_pairs, "part int, data binary, n int").groupBy("part").applyInPandas(write_pairs, "part int, n long")
    model["pairs"] = sorted(r["part"] for r in done.collect())  # a row for each part

    def count_triples(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, words, held, parts, n = Trie(model), WordHash(), [], [], 0

        def give():
            part, keys = np.concatenate(parts), np.concatenate(held)
            order = np.lexsort((keys, part))
            part, keys = part[order], keys[order]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])))) if len(keys) else np.zeros(0, np.int64)
            return _dealt(part[first], keys[first], np.diff(np.append(first, len(keys))))

        for _, texts in batches(frames, text, rows=1024):
            t = lm.tokens(*hashed_tokens(words, texts))
            lm.look_up_pairs(t)
            at = np.flatnonzero(t.often[1:] & t.often[:-1] & ~t.begins[1:]) + 1
            held.append(t.index[at - 1].astype(np.uint64) * lm.size + t.w[at])
            parts.append(t.part[at - 1])
            n += len(at)
            if n >= 1_500_000:
                yield give()
                held, parts, n = [], [], 0
        if held:
            yield give()

    def write_triples(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, lm = int(key[0]), Trie(model)
        keys, c = _whole(pdf)
        context, w = (keys // lm.size).astype(np.int64), keys % lm.size
        level = lm.level("pairs", part)
        n = level["successors"].n
        sums = np.bincount(context, c, n)
        v = level["successors"].get(np.arange(n))[context] % lm.size  # the context's second word
        arrays = sequences(pointers=(np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n)))), len(keys) + 1), successors=(keys, n * int(lm.size)))
        arrays |= {"codes": _code((c + KAPPA * 10 ** lm.pair_log10(v, w)) / (sums[context] + KAPPA)), "backoff": _code(KAPPA / (sums + KAPPA))}
        save(folder, f"triples-{part}", arrays)
        return pd.DataFrame({"part": [part], "n": [len(keys)]})

    done = rows.mapInArrow(count_triples, "part int, data binary, n int").groupBy("part").applyInPandas(write_triples, "part int, n long")
    model["triples"] = sorted(r["part"] for r in done.collect())
    return model


@dataclass
class Tokens:
    """Tokens of many texts in one row: numbers of the word before and of the word, counts of both, the part of the
    pair and where a text begins; after a look-up the pair's place in its part (-1: none), log10 P and whether it occurs twice."""

    u: np.ndarray
    w: np.ndarray
    cu: np.ndarray
    cw: np.ndarray
    part: np.ndarray
    begins: np.ndarray
    index: np.ndarray | None = None
    log10: np.ndarray | None = None
    often: np.ndarray | None = None
    rank: np.ndarray | None = None  # among the distinct pairs of the batch


class Trie:
    """The levels as a task sees them."""

    def __init__(self, model: dict):
        self.model = model
        self.words = Words(model["folder"], model["word_parts"], model["starts"], model["below"])
        self.v, self.n, self.parts = model["v"], model["n"], model["parts"]
        self.size = np.uint64(self.v + 2)  # numbers of words, then unseen, then the begin of a text
        self.unseen, self.begin = self.v, self.v + 1
        self.open: dict[tuple[str, int], dict] = {}
        self.ends = int(self.words.look_up(np.array([END]))[1][0])  # documents
        self.have = {kind: set(model[kind]) for kind in ("pairs", "triples")}

    def numbers(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count of word numbers (of the begin: documents) and mass before each."""
        distinct, back = np.unique(numbers.astype(np.int64), return_inverse=True)
        count, below = np.zeros(len(distinct), np.int64), np.full(len(distinct), self.n, np.int64)
        k = int(np.searchsorted(distinct, self.v))
        count[:k], below[:k] = self.words.of_numbers(distinct[:k])
        count[distinct == self.begin] = self.ends
        return count[back], below[back]

    def _part(self, w: np.ndarray, cu: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Part of each pair: training mass before the context, and the word's share of the context's own."""
        share = (below + cu * (w.astype(np.float64) / float(self.size))) / (self.n + self.ends + 1)
        return np.minimum((share * self.parts).astype(np.int64), self.parts - 1)

    def parts_of(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._part(w, *self.numbers(u))

    def tokens(self, flat: np.ndarray, lengths: np.ndarray) -> Tokens:
        distinct, back = np.unique(flat, return_inverse=True)
        number, count, below = self.words.look_up(distinct)
        below[number < 0] = self.n
        number[number < 0] = self.unseen
        w, cw, below = number[back].astype(np.uint64), count[back], below[back]
        first = np.cumsum(lengths) - lengths
        u, cu, bu = np.roll(w, 1), np.roll(cw, 1), np.roll(below, 1)
        u[first], cu[first], bu[first] = self.begin, self.ends, self.n
        begins = np.zeros(len(flat), bool)
        begins[first] = True
        return Tokens(u, w, cu, cw, self._part(w, cu, bu), begins)

    def level(self, kind: str, k: int) -> dict:
        if (kind, k) not in self.open:
            raw = mapped(self.model["folder"], f"{kind}-{k}")
            self.open[kind, k] = raw | {name: opened(raw, name) for name in ("pointers", "successors")}
        return self.open[kind, k]

    def _by_part(self, kind: str, part: np.ndarray, at: np.ndarray):
        """Each part that there is, and which of the rows `at` fall into it."""
        order = at[np.argsort(part[at], kind="stable")]
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = int(part[order[a]])
            if k in self.have[kind]:
                yield self.level(kind, k), order[a:b]

    def find_pairs(self, u: np.ndarray, w: np.ndarray, part: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in its part (-1: none), log10 P and whether it occurs twice, of each pair; base: log10 P of one that isn't there."""
        index, log10, often = np.full(len(u), -1, np.int64), base.copy(), np.zeros(len(u), bool)
        for level, at in self._by_part("pairs", part, np.arange(len(u))):
            low, high = level["range"].tolist()
            at = at[(u[at] >= low) & (u[at] <= high)]
            place = u[at] - np.uint64(low)
            fresh = np.concatenate((np.ones(min(1, len(place)), bool), place[1:] != place[:-1]))  # the pairs of a context stand together
            contexts, back = place[fresh].astype(np.int64), np.cumsum(fresh) - 1
            lo, hi = (level["pointers"].get(contexts + d).astype(np.int64)[back] for d in (0, 1))
            i = level["successors"].find(place * self.size + w[at], lo, hi)
            at, i = at[i >= 0], i[i >= 0]
            index[at], log10[at] = i, level["codes"][i] / -STEP
            often[at] = level["often"][i >> 3] >> (i & 7).astype(np.uint8) & 1
        return index, log10, often

    def _absent(self, cu: np.ndarray, cw: np.ndarray) -> np.ndarray:
        return np.log10(KAPPA * (cw + 1) / (self.n + self.v + 1) / (cu + KAPPA))

    def look_up_pairs(self, t: Tokens) -> None:
        keys = t.u * self.size + t.w
        order = np.argsort(keys)
        fresh = np.concatenate((np.ones(min(1, len(keys)), bool), np.diff(keys[order]) != 0))
        first, back = order[fresh], np.empty(len(keys), np.int64)
        back[order] = np.cumsum(fresh) - 1
        index, log10, often = self.find_pairs(t.u[first], t.w[first], t.part[first], self._absent(t.cu[first], t.cw[first]))
        t.index, t.log10, t.often, t.rank = index[back], log10[back], often[back], back

    def pair_log10(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | u) of word numbers."""
        distinct, back = np.unique(u * self.size + w, return_inverse=True)
        u, w = distinct // self.size, distinct % self.size
        (cu, below), (cw, _) = self.numbers(u), self.numbers(w)
        return self.find_pairs(u, w, self._part(w, cu, below), self._absent(cu, cw))[1][back]

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 P of each token after the two before it."""
        self.look_up_pairs(t)
        out = t.log10.copy()
        at = np.flatnonzero(t.often[:-1] & ~t.begins[1:])  # places of contexts; the token stands behind
        at = at[np.argsort(t.rank[at])]  # in the trie's order, so the levels are read from front to back
        for level, k in self._by_part("triples", t.part, at):
            some = np.flatnonzero(level["backoff"][t.index[k]] > 0)  # contexts with entries
            k = k[some]
            context, k = t.index[k], k + 1
            lo, hi = (level["pointers"].get(context + d).astype(np.int64) for d in (0, 1))
            i = level["successors"].find(context.astype(np.uint64) * self.size + t.w[k], lo, hi)
            out[k] = np.where(i >= 0, level["codes"][np.maximum(i, 0)] / -STEP, out[k] - level["backoff"][context] / STEP)
        return out

    def scores(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens, of known ones, base score and model score of each text."""
        t = self.tokens(flat, lengths)
        base = np.log10((t.cw + 1) / (self.n + self.v + 1))
        first = np.cumsum(lengths) - lengths
        return lengths, np.add.reduceat((t.cw > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(self.log10(t), first)


def score(docs: DataFrame, model: dict, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, words = Trie(model), WordHash()
        for batch, texts in batches(frames, text, rows=1024):
            n, known, base, own = lm.scores(*hashed_tokens(words, texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(ident: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
