"""Chunking: folds over the lines of a document within its row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_count(col: Column) -> Column:
    return F.size(F.array_remove(F.split(col, " "), ""))


def starts(counts: Column, opens: Callable) -> Column:
    """Places (from 1) of the pieces that begin a chunk: the first, and each for which `opens(size of the open chunk, count)` holds."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(s, c):
        fresh = (s.i == 0) | opens(s.n, c)
        return F.struct(F.when(fresh, c).otherwise(s.n + c).alias("n"), (s.i + 1).alias("i"), F.when(fresh, F.concat(s["at"], F.array(s.i + 1))).otherwise(s["at"]).alias("at"))

    return F.aggregate(counts, empty, step, lambda s: s["at"])


def cut(pieces: Column, at: Column, joiner: str) -> Column:
    """The pieces from each start to the next one, joined."""
    end = lambda k: F.coalesce(F.get(at, k + 1), F.size(pieces) + 1)
    return F.transform(at, lambda s, k: F.array_join(F.slice(pieces, s, end(k) - s), joiner))


def _chunked(df: DataFrame, keep: list[str], opens: Callable, joiner: str = "\n") -> DataFrame:
    """One row (keep, pos, content) for each chunk of the array column `pieces`."""
    placed = df.withColumn("starts", starts(F.transform("pieces", word_count), opens))
    return placed.select(*keep, F.posexplode(cut(F.col("pieces"), F.col("starts"), joiner)).alias("pos", "content"))


def _lines(docs: DataFrame, text: str, delimiter: str = "\n") -> DataFrame:
    return docs.withColumn("pieces", F.filter(F.split(F.col(text), delimiter, -1), lambda x: F.trim(x) != "")).drop(text)


def greedy(docs: DataFrame, limit: int, text: str = "text", delimiter: str = "\n", overlap: int = 0) -> DataFrame:
    """Pieces go to the open chunk until that one is over the limit, so a chunk overshoots by one piece at most.

    With an overlap the limit shrinks by that percentage, and each chunk but the first begins with as large a
    share of the last characters of the one before.
    """
    keep = [c for c in docs.columns if c != text]
    most = limit * (100 - overlap) / 100
    if not overlap:
        return _chunked(_lines(docs, text, delimiter), keep, lambda n, c: n > most)
    placed = _lines(docs, text, delimiter).withColumn("starts", starts(F.transform("pieces", word_count), lambda n, c: n > most))
    share = lambda x: F.length(x) - F.floor(F.length(x) * F.lit((100 - overlap) / 100)).cast("int")
    last = lambda acc: F.element_at(acc, -1)
    tail = lambda x: F.when(share(x) > 0, F.right(x, share(x))).otherwise("")
    none = F.array().cast("array<string>")
    chained = F.aggregate(cut(F.col("pieces"), F.col("starts"), "\n"), none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.concat(tail(last(acc)), x)))))
    return placed.select(*keep, F.posexplode(chained).alias("pos", "content"))


def bounded(docs: DataFrame, limit: int, text: str = "text", delimiter: str = "\n") -> DataFrame:
    """A piece that would pass the limit opens a new chunk; a longer piece is cut into windows of `limit` words first."""
    keep = [c for c in docs.columns if c != text]
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    many = lambda w: F.greatest(F.ceil(F.size(w) / limit).cast("int") - 1, F.lit(0))
    windows = lambda w: F.transform(F.sequence(F.lit(0), many(w)), lambda k: F.array_join(F.slice(w, k * limit + 1, limit), " "))
    split = _lines(docs, text, delimiter).withColumn("pieces", F.flatten(F.transform(F.transform("pieces", words), windows)))
    return _chunked(split, keep, lambda n, c: n + c > limit)


def by_pattern(sections: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """A line that matches opens a new chunk. sections(doc_id, pos, text)."""
    flag = F.when(F.col("text").rlike(rf"^\s*(?:{pattern})"), 1).otherwise(0)
    of = sections.withColumn("cid", F.sum(flag).over(Window.partitionBy(key).orderBy("pos")))
    return of.groupBy(key, "cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("content"))


def by_title(sections: DataFrame, level: int, key: str = "doc_id") -> DataFrame:
    """Split at headings of up to `level`; if that leaves one chunk, of the next smaller level, down to 1.

    With one chunk at every level the document is one chunk.
    """
    depth = F.length(F.regexp_extract("text", r"^(#{1,6}) ", 1))
    d = sections.withColumn("depth", depth)
    w = Window.partitionBy(key).orderBy("pos")
    ids = {k: F.sum(F.when((F.col("depth") > 0) & (F.col("depth") <= k), 1).otherwise(0)).over(w) for k in range(1, level + 1)}
    d = d.withColumns({f"id{k}": c for k, c in ids.items()})
    whole = Window.partitionBy(key)
    d = d.withColumns({f"n{k}": F.max(f"id{k}").over(whole) - F.min(f"id{k}").over(whole) + 1 for k in ids})
    cid = F.lit(0).cast("long")
    for k in range(1, level + 1):
        cid = F.when(F.col(f"n{k}") > 1, F.col(f"id{k}")).otherwise(cid)
    return d.withColumn("cid", cid).groupBy(key, "cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("content"))


def parent_child(docs: DataFrame, child: int = 256, parent: int = 1024, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children of up to `child` words, parents of consecutive children of up to `parent` words, and the mapping."""
    keep = [c for c in docs.columns if c != text]
    own = _lines(docs, text).withColumn("starts", starts(F.transform("pieces", word_count), lambda n, c: n + c > child)).select(*keep, cut(F.col("pieces"), F.col("starts"), "\n").alias("kids"))
    own = own.withColumn("up", starts(F.transform("kids", lambda x: word_count(F.translate(x, "\n", " "))), lambda n, c: n + c > parent))
    kids = own.select(*keep, F.posexplode("kids").alias("child", "content"))
    parents = own.select(key, F.posexplode(cut(F.col("kids"), F.col("up"), "\n\n")).alias("parent", "content"))
    of = F.transform("kids", lambda x, k: F.size(F.filter("up", lambda s: s <= k + 1)) - 1)
    return parents, kids, own.select(key, F.posexplode(of).alias("child", "parent"))


def char_windows(docs: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of at most `size` characters; one that isn't the last ends behind its last full stop if that is beyond
    its half, and the next begins `overlap` characters before its end. All of the text is in some window."""
    n = F.length("t")
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def step(s, _):
        piece = F.substring(F.col("t"), s["at"], F.lit(size))
        stop = F.length(piece) - F.instr(F.reverse(piece), ".") + 1
        last = s["at"] + size > n
        keep = F.when(~last & (F.instr(piece, ".") > 0) & (stop > size / 2), stop).otherwise(F.length(piece)).cast("int")
        following = F.when(last, n + 1).otherwise(s["at"] + F.greatest(keep - overlap, F.lit(1)))
        return F.when(s["at"] > n, s).otherwise(F.struct(following.cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), keep.alias("n")))).alias("out")))

    most = F.ceil(n / (size // 2 - overlap)).cast("int")  # no window but the last is shorter than a half
    cuts = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), empty, step, lambda s: s["out"])
    d = docs.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("t"))
    pieces = F.transform(cuts, lambda x: F.substring(F.col("t"), x["at"], x["n"]))
    return d.select(key, F.posexplode(pieces).alias("win", "content"))


def starts_signed(sizes: Column, least: int, most: int) -> Column:
    """Starts of chunks over pieces whose headings have negative sizes: a heading closes a chunk of `least` words or
    more, and a piece that would pass `most` words closes any."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(s, c):
        fresh = (s.i == 0) | ((c < 0) & (s.n >= least)) | (s.n + F.abs(c) > most)
        return F.struct(F.when(fresh, F.abs(c)).otherwise(s.n + F.abs(c)).alias("n"), (s.i + 1).alias("i"), F.when(fresh, F.concat(s["at"], F.array(s.i + 1))).otherwise(s["at"]).alias("at"))

    return F.aggregate(sizes, empty, step, lambda s: s["at"])
