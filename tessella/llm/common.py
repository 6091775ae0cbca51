"""Helpers shared by the training-data operators: word rules, hashes, scratch tables, skew tools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise, scratch_path  # noqa: F401

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = r"[\x20\x09-\x0D]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def ascii_lower(col):
    """Lower-case A-Z only, as the word contracts ask for; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# -- hashing in tasks -------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, the same for A-Z and a-z; blanks have none.
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_BLANK] = 0
_BASE = 0x9E3779B97F4A7C15


class WordHash:
    """64-bit hashes of the words of texts (between ASCII blanks, A-Z as a-z), for all words of a piece at once.

    A word's hash is a polynomial of its bytes: the difference of running sums at its ends, brought back to
    place zero. Pieces end at a blank after `piece` bytes, so long texts need no more memory than short ones.
    """

    def __init__(self, piece: int = 1 << 21):
        self.piece = piece
        self.power = self.back = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.power):
            size = max(n, min(2 * len(self.power), self.piece + 4096))
            one = lambda base: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))))
            self.power, self.back = one(_BASE), one(pow(_BASE, -1, 1 << 64))

    def _piece(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of a piece that begins and ends with a blank."""
        self._reach(len(raw))
        sums = np.cumsum(_BYTE[raw] * self.power[: len(raw)])
        blank = _BLANK[raw]
        begin = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before a word
        end = np.flatnonzero(~blank[:-1] & blank[1:])  # a word's last byte
        return mix((sums[end] - sums[begin]) * self.back[begin]), begin + 1

    def joined(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in one row, and the number of words of each text."""
        coded = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        data = b"\n" + b"\n".join(coded) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum([1 + len(c) for c in coded])  # the blank behind each text
        hashes, places, at = [], [], 0
        while at < len(raw) - 1:
            to = min(at + self.piece, len(raw) - 1)
            if to < len(raw) - 1:
                blanks = np.flatnonzero(_BLANK[raw[at + 1 : to + 1]])
                to = at + 1 + int(blanks[-1]) if len(blanks) else to
                while not _BLANK[raw[to]]:  # a word longer than a piece
                    more = np.flatnonzero(_BLANK[raw[to : to + self.piece]])
                    to = to + int(more[0]) if len(more) else to + self.piece
            h, place = self._piece(raw[at : to + 1])
            hashes.append(h)
            places.append(place + at)
            at = to
        flat, where = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(places) if places else np.zeros(0, np.int64)
        return flat, np.diff(np.searchsorted(where, ends), prepend=0)

    def of(self, text: str | None) -> np.ndarray:
        return self.joined([text])[0]


#: Odd factors of the places in a shingle.
_PLACE = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words; with fewer words, of the whole sequence (none: none)."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += hashes[k : n - width + 1 + k] * _PLACE[k]
    return mix(out)


def joined_shingles(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts in one row, and where each text's begin (and the end); texts under `width` words have none.

    flat: word hashes of all texts, sizes: words of each.
    """
    counts = np.maximum(sizes - width + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if not starts[-1]:
        return flat[:0], starts
    at = np.arange(starts[-1]) + np.repeat(np.cumsum(sizes) - sizes - starts[:-1], counts)
    return shingles(flat, width)[at], starts


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased; lone surrogates can't occur in Spark strings."""
    return [] if not text else text.encode("utf-8", "replace").lower().split()


def batches(frame_iter: Iterator, *columns: str, rows: int = 512):
    """The named columns of slices of Arrow batches as Python lists, with the slice itself: few texts are held at once."""
    for batch in frame_iter:
        for at in range(0, max(1, batch.num_rows), rows):
            part = batch.slice(at, rows)
            yield (part, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))


def collect_bounded(df: DataFrame, rows: int, what: str) -> list:
    """Bring a table to the driver that is known to be small; more rows than `rows` is an error, not a cut."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return out


def having(docs: DataFrame, ids: DataFrame, ident: str, small: int = 2_000_000) -> DataFrame:
    """Rows of docs whose `ident` is in ids (one column of that name, distinct and written).

    Up to `small` ids are sent to the tasks, so whole texts need not be shuffled; more ids than that meet
    the rows in a shuffle.
    """
    return docs.join(F.broadcast(ids) if ids.limit(small + 1).count() <= small else ids.hint("merge"), ident, "left_semi")


def lacking(docs: DataFrame, ids: DataFrame, ident: str, small: int = 2_000_000) -> DataFrame:
    """Rows of docs whose `ident` is null or not in ids; the ids travel as in `having`."""
    return docs.join(F.broadcast(ids) if ids.limit(small + 1).count() <= small else ids.hint("merge"), ident, "left_anti")
