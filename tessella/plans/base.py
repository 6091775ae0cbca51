"""Table readers and derived inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index, pack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sections(doc_id, pos, text): the lines of each document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "text"))


def chunks(spark: SparkSession, sf_dir: str, limit: int = 128) -> DataFrame:
    """chunks(doc_id, pos, content, kb_id, available, tokens) by greedy packing of lines."""
    packed = _packed(table(spark, sf_dir, "documents"), limit)
    return packed.select("doc_id", "pos", "content", "kb_id", "available", tx.tokenize(F.col("content")).alias("tokens"))


def _packed(docs: DataFrame, limit: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = index.spread(docs.select("doc_id", "source", text.alias("text"), F.split(text, "\n")[0].alias("title")))
    available = F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(1)
    return pack.greedy(d, limit=limit).select("doc_id", "pos", "content", "title", F.col("source").alias("kb_id"), available.cast("int").alias("available"))


def _questions(content):
    """Lines that end with a question mark."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: F.rtrim(x).endswith("?")), " ")


def field_tokens() -> dict:
    """Fields of the kept index: the words of a chunk's title, keywords (its data set), questions and content, plain and fine; `rerank` has the words of all but the fine ones. Fine words are told by what the plain ones don't hold."""
    finer = lambda text: F.transform(F.array(tx.tokenize(text)), lambda w: F.array_except(tx.fine_tokens(F.filter(w, lambda x: x.contains("_"))), w))[0]
    return {
        "title": tx.tokenize(F.col("title")), "title_fine": finer(F.col("title")), "keyword": F.array_compact(F.array("kb_id")), "keyword_words": tx.tokenize(F.coalesce("kb_id", F.lit(""))),
        "rerank": F.array_distinct(F.concat(tx.tokenize(F.col("content")), tx.tokenize(F.col("title")), tx.tokenize(F.coalesce("kb_id", F.lit(""))), tx.tokenize(_questions(F.col("content"))))),
        "question": tx.tokenize(_questions(F.col("content"))), "content": tx.tokenize(F.col("content")), "content_fine": finer(F.col("content")),
    }


def kept_index(spark: SparkSession, sf_dir: str, limit: int = 128) -> index.Index:
    """The index of the documents' chunks: built by the first query of an application that asks for it, read by all others."""
    key = index.fingerprint(spark, f"{sf_dir}/documents.parquet")
    return index.kept(spark, (*key, limit), lambda: index.Index.build(_packed(table(spark, sf_dir, "documents"), limit), field_tokens(), whole=("title", "title_fine", "keyword", "keyword_words"), extends={f"{f}_fine": (f, ~F.col("term").contains("_")) for f in ("title", "content")}))
