"""Byte-level BPE: encode by a priority queue of merge ranks over a linked symbol list, decode by
joining vocabulary strings. The vocabulary is a public tokenizer file, never trained here.

Edges: a null or empty text has no tokens and decodes to the empty text; very long words are merged
in O(n log n); the text of a special token becomes that token, as the file's library does; repeated
rows give equal rows; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

#: White space of Unicode, as the pre-tokenizer's `\s` has it (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
#: A run without white space and the one blank before it, or white space; cut before finer rules apply.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The pre-tokenizer's pattern (fixed value).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


class ByteBpe:
    """One vocabulary with its merges; keeps the ids of short chunks it has met, up to `limit`, and of a quarter as many pieces
    (some 110 MB in all)."""

    def __init__(self, spec: str | bytes, limit: int = 400_000, longest: int = 40):
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.made: list[int] = []
        ranks: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(vocab[a + b])
            ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
        self.rank_of = ranks.get
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Queue entries are rank and place in one integer; an entry whose pair has
        changed since is stale and skipped."""
        n = len(piece)
        first, rank_of, made = self.first, self.rank_of, self.made
        symbols = [first[b] for b in piece]
        if n == 1:
            return symbols
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = right[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue
            symbols[i] = new = made[rank]
            symbols[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank_of(new << 20 | symbols[k])) is not None:
                    push(queue, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | new)) is not None:
                push(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        packed = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.merge(piece.encode())) else b""
        if len(piece) <= self.longest:
            if len(self.pieces) >= self.limit // 4:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces
        packed = b"".join([pieces.get(p) or self._piece(p) for p in PIECE.findall(chunk)])
        if len(chunk) <= self.longest:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[chunk] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            known, chunk = self.known, self._chunk
            for c in CHUNK.findall(part):
                out.append(known.get(c) or chunk(c))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def _loaded(spec: bytes) -> ByteBpe:
    """One instance for each vocabulary in a worker; it serves every task there."""
    key = hashlib.md5(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(spec)
    return _LOADED[key]


def encode(docs: DataFrame, spec: bytes, columns: dict[str, str], text: str = "text") -> DataFrame:
    """Adds to every row the asked outputs; columns: output name -> ids, n_tokens, ids_sha256, decoded
    or decoded_sha256. A new name that docs has already is an error."""
    clash = set(columns) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: fixed, about 1.5 MB
    kinds = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "n_tokens": (T.LongType(), pa.int64())} | {k: (T.StringType(), pa.string()) for k in ("ids_sha256", "decoded", "decoded_sha256")}
    decodes = any(k.startswith("decoded") for k in columns.values())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch, texts in batches(frames, text):
            found: dict[str, list] = {name: [] for name in columns}
            for t in texts:
                packed = bpe.encode_packed(t or "")
                ids = np.frombuffer(packed, "<u4")
                decoded = bpe.decode(ids.tolist()) if decodes else ""
                for name, kind in columns.items():
                    found[name].append(
                        ids.astype(np.int32) if kind == "ids" else len(ids) if kind == "n_tokens" else hashlib.sha256(packed).hexdigest() if kind == "ids_sha256"
                        else decoded if kind == "decoded" else hashlib.sha256(decoded.encode()).hexdigest()
                    )
            arrays = [pa.array(found[n], kinds[columns[n]][1]) for n in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *columns])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kinds[kind][0])
    return docs.mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> bytes:
    """A tokenizer file by path, on the driver; by default the 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, vocabulary(), {"n_tokens": "n_tokens", "ids_sha256": "ids_sha256", "decoded_sha256": "decoded_sha256"})
    return out.drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number and a flag that decoding gives the text back."""
    taken = set(docs.columns)
    free = lambda name: name if name not in taken else free(f"{name}_bpe")
    ids, n, back = free("token_ids"), free("n_tokens"), free("decoded")
    out = encode(docs, vocabulary(), {ids: "ids", n: "n_tokens", back: "decoded"})
    return out.withColumn(free("round_trip"), F.col(back) == F.coalesce("text", F.lit(""))).drop(back)
