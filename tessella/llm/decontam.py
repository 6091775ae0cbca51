"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are numbered and put into one automaton. Each document's words are streamed through
it; the length of the longest match that ends at a word tells at once whether one of the windows
(13 consecutive words of an item, or a whole shorter item) ends there. Words of such windows are hit.

The test set is cut into blocks of bounded size; each block is one pass over the documents with its
automaton sent to every task, so a larger test set means more passes, not a larger broadcast.

Edges: a null or empty text or item has no words; an item without id is left out; repeated items and
rows are judged alike; a document of any length takes linear time.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialise

WINDOW = 13
#: A-Z to lower case, other letters and digits of ASCII stay, the rest of ASCII is a blank; above ASCII all stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that own each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        ends: dict[int, set[str]] = defaultdict(set)
        shorter: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        self.least = window
        for item, words in items:
            if not words:
                continue
            at = 0
            for w in words:
                at = self._extend(at, self.number.setdefault(w, len(self.number)))
                ends[at].add(item)
            if len(words) < window:
                shorter[at][len(words)].add(item)
                self.least = min(self.least, len(words))
        # A state's owners: items that end in it or in a state below it in the tree of links.
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        owners: list[set[str]] = [set(ends.get(s, ())) for s in range(len(self.link))]
        for s in order:
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        self.items: dict[int, frozenset[str]] = {}
        for s in order:
            if self.length[self.link[s]] < window <= self.length[s]:
                self.items[s] = frozenset(owners[s])
        # Whole short items that end where a state's strings end: own ones and those up the links.
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.link)
        for s in reversed(order):
            own = tuple((n, frozenset(x)) for n, x in shorter.get(s, {}).items())
            self.short[s] = own + (self.short[self.link[s]] if self.link[s] > 0 else ())

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) covered by windows, and the items of these windows."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.least:  # a run of known words too short for any window holds none
                self._run(ids[a:b].tolist(), a, out, items)
        return out, items

    def _run(self, ids: list[int], offset: int, out: list[tuple[int, int]], items: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at = matched = 0
        for i, c in enumerate(ids, offset + 1):
            while at and c not in nxt[at]:
                at = link[at]
                matched = length[at]
            at = nxt[at].get(c, 0)
            matched = matched + 1 if at else 0
            reach = 0
            if matched >= window:
                reach, s = window, at
                while length[link[s]] >= window:
                    s = link[s]
                items |= self.items[s]
            for n, own in self.short[at]:
                if n <= matched:
                    reach = max(reach, n)
                    items |= own
            if reach:
                start = i - reach
                while out and start <= out[-1][1]:
                    start = min(start, out.pop()[0])
                out.append((start, i))


def blocks(bench: DataFrame, text: str = "text", ident: str = "item_id", most: int = 4_000_000) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of at most `most` bytes of text (a longer item is a block of its own)."""
    block, held = [], 0
    rows = bench.select(F.col(ident).cast("string"), F.col(text)).where(F.col(ident).isNotNull() & F.col(text).isNotNull())
    for item, body in rows.toLocalIterator():
        if block and held + len(body) > most:
            yield block
            block, held = [], 0
        block.append((item, normal_words(body)))
        held += len(body)
    yield block


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = 4_000_000, body: str = "whole") -> DataFrame:
    """row struct<all columns but the text>, body, n_words, spans array<struct<start,end>> (words) and items array<string>.

    body: the `whole` text, `cut` (without the hit words where the document is contaminated) or `none`. Texts go to
    Python once in a pass, and come back from the last one only where they are asked for; they are cut in
    that pass, as a second one behind it would be a second Python process for each task.
    """
    spark = docs.sparkSession
    rest, words = [c for c in docs.columns if c != text], F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text).alias("body"), F.size(F.array_remove(words, "")).cast("long").alias("n_words"), empty.alias("spans"), F.array().cast("array<string>").alias("items"))
    shared, every = None, blocks(bench, most=block_bytes)
    block = next(every)
    while block is not None:
        following = next(every, None)
        if shared is not None:  # the next block's pass reads what this one wrote, so a task holds one automaton at a time
            out = materialise(out, "pass")
            shared.destroy()
        shared = spark.sparkContext.broadcast(pickle.dumps(Automaton(block, window)))
        out = _pass(out, shared, "whole" if following is not None else body)
        block = following
    return out


def contaminated(n_hit, n_words):
    """A word is hit, and hits are 5 % or more (numbers or columns)."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _pass(rows: DataFrame, shared, body: str) -> DataFrame:
    schema = rows.schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        kind_s, kind_i = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
        for batch, texts, n_words, spans, items in batches(frames, "body", "n_words", "spans", "items"):
            new_s, new_i, new_t = [], [], []
            for t, n, s, i in zip(texts, n_words, spans, items, strict=True):
                found, own = automaton.spans(normal_words(t))
                new_s.append(s + [{"start": a, "end": b} for a, b in found])
                new_i.append(sorted({*i, *own}))
                if body == "cut":
                    whole = merged([(x["start"], x["end"]) for x in new_s[-1]])
                    new_t.append(cut_words(t, whole) if contaminated(sum(b - a for a, b in whole), n) else t)
            text = {"whole": lambda: [batch.column(1)], "cut": lambda: [pa.array(new_t, pa.string())], "none": list}[body]()  # noqa: B023
            names = ["row", *(["body"] if text else []), "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text, batch.column(2), pa.array(new_s, kind_s), pa.array(new_i, kind_i)], names=names)

    return rows.mapInArrow(run, rows.drop("body").schema if body == "none" else schema)


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = 4_000_000, body: str = "whole") -> DataFrame:
    """row, body (see `hits`), spans, items and the counts; a document is contaminated if a word is hit and hits are 5 % or more."""
    found = hits(docs, bench, window=window, block_bytes=block_bytes, body=body)
    ordered = F.array_sort("spans")
    # Spans of several blocks may overlap: length of the union by a fold over the ordered spans.
    union = F.aggregate(
        ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, s.e))).alias("n"), F.greatest(s.e, x.end).alias("e")),
    )
    return found.withColumn("n_hit", union.n.cast("long")).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), body="none")
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def cut_words(text: str, spans: list[tuple[int, int]], word: re.Pattern = _WORD, table: bytes | None = _TABLE) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in word.finditer(raw.translate(table) if table else raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; contaminated ones lose the hit words. A document with nothing else left goes."""
    cut = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), body="cut")
    kept = cut.where(~F.col("contaminated") | F.col("body").rlike(r"[^\x20\x09-\x0D]"))
    n = F.length("body").cast("long")
    return kept.select(*[F.col("body").alias(c) if c == "text" else F.when(F.col("contaminated"), n).otherwise(F.col(f"row.{c}")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE_OP6 = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') w from documents),
b as (select distinct item_id, list_filter(string_split_regex(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') w from benchmark where text is not null and item_id is not null),
bw as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') g from (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w)-least(13, len(w))+2)) i from b where len(w)>0)),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w)-n+2)) i from d, ns where len(w)>=n)),
h as (select doc_id, i, dw.n n, item_id from dw join bw using (n, g)),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i+n)) p from h) group by doc_id),
hi as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit,0)::bigint n_hit, coalesce(n_items,0)::bigint n_items, sha256(coalesce(items,'')) items_sha256,
 coalesce(n_hit,0)>0 and 20*coalesce(n_hit,0)>=len(w) contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""
