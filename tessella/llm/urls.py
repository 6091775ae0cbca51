"""URL filter: fixed host and path rules, then host word segmentation with naive Bayes.

Names that no rule fits are judged by their words. Parts of a host are split into words by Viterbi
over a unigram model (counts of words in titles, hosts and paths of all pages, and the listed seed
words). A multinomial naive Bayes model over host and path words is trained on all distinct urls; those
whose host has a seed word count as block, the others as allow. So words that keep company with seed
words count too.

All tables here are joined by key: words to substrings, weights to words, verdicts to pages; none is
sent to every task. Pages are first folded to distinct (host, path without digits), which takes the
weight out of frequent hosts.

Edges: a null url or one without `://` has an empty host and path, fits no rule and gets the verdict of
a name without words (allow); repeated rows give equal rows; further columns are left alone.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: (verdict, host, path) (fixed values of the contract).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that mark a host by themselves (fixed values).
SEEDS = ("casino", "casinos", "bet", "bets", "betting", "poker", "slots", "jackpot", "pills", "viagra", "cialis", "pharma", "porn", "xxx", "sex", "nude", "escort", "webcam", "ads", "adserver", "malware", "warez", "torrent", "crack", "payday", "lottery", "spam", "scam", "phishing")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def pieces(col: Column) -> Column:
    """Runs of letters of a host or path, lower-cased."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}]+"), lambda x: x != "")


def unigrams(pages: DataFrame, folded: DataFrame) -> DataFrame:
    """word, n: words of titles, of paths and of hosts, with each seed word counted once more than any rare word."""
    titles = pages.select(F.explode(pieces(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))).alias("word"), F.lit(1).alias("n"))
    paths = folded.select(F.explode(pieces(F.col("path"))).alias("word"), F.col("pages").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, 100) for w in (*SEEDS, *COMMON)], "word string, n long")
    return titles.unionByName(paths).unionByName(seeds).groupBy("word").agg(F.sum("n").cast("long").alias("n"))


#: Frequent words of names, so that small tables can be split too (fixed values).
COMMON = ("free", "win", "cheap", "best", "online", "shop", "news", "blog", "home", "the", "my", "your", "track", "click", "buy", "deal", "deals", "game", "games", "live", "now", "top", "web", "site", "mail", "info", "and")


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """names(piece) -> (piece, words): the most likely split of each piece.

    Substrings of all lengths that words have meet the word counts in a join; one row for each piece then
    holds the words found in it, for each letter at most one of each length.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    reach = names.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in words.select(F.length("word").alias("size")).where(F.col("size") <= reach).distinct().collect())  # numbers up to the longest piece
    starts = names.where("length(piece) > 0").select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    spans = starts.select("piece", "start", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("piece") - F.col("start") + 1)).alias("size"))
    found = spans.withColumn("word", F.expr("substring(piece, start, size)")).join(words, "word")
    held = found.groupBy("piece").agg(F.collect_list(F.struct("start", "size", F.log10(F.col("n") / total).alias("p"))).alias("found"))

    @F.pandas_udf("array<string>")
    def viterbi(piece: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spots in zip(piece, found, strict=True):
            known = {(s["start"] - 1, s["size"]): s["p"] for s in (spots if spots is not None else ())}
            n = len(text)
            best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
            start = 0  # where the best unknown word that ends here begins: it costs a digit, and one more for each letter
            for end in range(1, n + 1):
                best[end], back[end] = best[start] - math.log10(total) - (end - start), end - start
                for size in lengths:
                    p = best[end - size] + known[end - size, size] if (end - size, size) in known else -math.inf
                    if p > best[end]:
                        best[end], back[end] = p, size
                if best[end] + end > best[start] + start:
                    start = end
            split, end = [], n
            while end > 0:
                split.append(text[end - back[end] : end])
                end -= back[end]
            out.append(split[::-1])
        return pd.Series(out)

    whole = names.where("length(piece) > 0").join(held, "piece", "left")
    return whole.select("piece", viterbi("piece", "found").alias("words"))


def judged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with host, path and folded path; (host, folded path, log_odds of block))."""
    host, path = host_and_path()
    named = pages.withColumns({"_host": host, "_path": path}).withColumn("_fold", F.regexp_replace(F.lower("_path"), r"\d+", "0"))
    folded = materialise(named.groupBy(F.col("_host").alias("host"), F.col("_fold").alias("path")).agg(F.count("*").alias("pages")), "folded")
    hosts = folded.select("host").distinct()
    split = hosts.select("host", F.explode(pieces(F.col("host"))).alias("piece"))
    words = materialise(unigrams(pages, folded), "unigrams")
    parts = segmented(split.select("piece").distinct(), words)
    by_host = materialise(split.join(parts, "piece").select("host", F.explode("words").alias("token")).groupBy("host", "token").agg(F.count("*").alias("n")), "host_words")
    marked = by_host.groupBy("host").agg(F.max(F.col("token").isin(*SEEDS)).alias("block"))
    counted = folded.join(by_host, "host").select("host", "path", F.concat(F.lit("h:"), "token").alias("token"), "n")
    of_path = folded.select("host", "path", F.explode(pieces(F.col("path"))).alias("token")).select("host", "path", F.concat(F.lit("p:"), "token").alias("token"), F.lit(1).cast("long").alias("n"))
    tokens = materialise(counted.unionByName(of_path), "tokens")
    labelled = tokens.join(marked, "host")
    each = materialise(labelled.groupBy("token").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("a")), "each")
    t = each.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    c = folded.join(marked, "host", "left").agg(F.coalesce(F.sum(F.when(F.col("block"), 1).otherwise(0)), F.lit(0)), F.count("*")).first()
    prior = math.log((c[0] + 1) / (c[1] - c[0] + 1)) if c[1] else -1.0
    weight = F.log((F.col("b") + 1) / (t[0] + t[2] + 1)) - F.log((F.col("a") + 1) / (t[1] + t[2] + 1))
    scored = tokens.join(each.select("token", weight.alias("w")), "token").groupBy("host", "path").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    scored = scored.select(F.col("host").alias("_h"), F.col("path").alias("_p"), (F.col("s") + min(prior, -0.1)).alias("log_odds"))
    return named, scored


def judge(pages: DataFrame, ident: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and log_odds of block for each page (columns url and html are read)."""
    named, scored = judged(pages.select(ident, "url", "html"))
    own = named.select(ident, "_host", "_path", "_fold")
    rule, verdict = rule_of(F.col("_host"), F.col("_path"))
    out = own.join(scored, (own["_host"] == scored["_h"]) & (own["_fold"] == scored["_p"]), "left")
    method = F.when(F.coalesce("log_odds", F.lit(-1.0)) >= 0, "block").otherwise("allow")
    return out.select(ident, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("log_odds", 6).alias("log_odds"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
