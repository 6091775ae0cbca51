"""Retrieval: passages of the benchmark searched for in chunks of the corpus, vectors, tags, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ann, index, search
from ..scratch import materialise
from .base import chunks, kept_index, table
from .registry import query

TOK = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x<>'')"
CHUNKS = r"""
pc as (select doc_id, source, piece, row_number() over (partition by doc_id order by i) p, len(list_filter(string_split(piece,' '), lambda x: x<>'')) c
  from (select doc_id, source, unnest(string_split(coalesce(text,''), chr(10))) piece, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) i from documents) where trim(piece)<>''),
fold as (select doc_id, p, c n, 0 id from pc where p=1 union all
  select f.doc_id, f.p+1, case when f.n>128 then pc.c else f.n+pc.c end, case when f.n>128 then f.id+1 else f.id end from fold f join pc on pc.doc_id=f.doc_id and pc.p=f.p+1),
chunks as materialized (select pc.doc_id, any_value(source) kb_id, id pos, string_agg(piece, chr(10) order by pc.p) content,
  case when pc.doc_id%7=0 then 0 when pc.doc_id%5=0 then null else 1 end available from pc join fold f on f.doc_id=pc.doc_id and f.p=pc.p group by pc.doc_id, id)"""
POSTED = CHUNKS + r""",
posted as materialized (select doc_id, pos, term, count(*) tf from (select doc_id, pos, unnest(""" + TOK.format("content") + r""") term from chunks) group by all),
stats as (select term, count(*) df from posted group by term),
nn as (select count(*) n from chunks),
qt as (select distinct query_id, unnest(""" + TOK.format("text") + r""") term from queries),
terms as materialized (select query_id, term, ln(1+(n-df+0.5)/(df+0.5))/ln(1+(n-0.5)/1.5) w from qt join stats using (term), nn),
scored as (select query_id, doc_id, pos, sum(w) score, count(*) hits from posted join terms using (term) group by all)"""
BENCH = "with recursive queries as (select item_id query_id, text from benchmark),"


def _parts(spark: SparkSession, sf_dir: str):
    """Chunks, postings of the queries' terms, weighted terms, queries; all but the queries from the kept index."""
    kept = kept_index(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = search.query_terms(queries)
    posted = kept.postings(asked).select("term", "doc_id", "pos")
    return kept.store, posted, _weighted(asked, kept.terms(), kept.n), queries


def _weighted(asked: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """asked(query_id, term) with w, by counts(term, df) in n chunks."""
    terms = search.sent(asked).join(counts, "term").select("query_id", "term", search.idf_share(F.col("df"), F.lit(n)).alias("w"))
    return search.sent(materialise(terms, "terms"))


def with_chunks(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns of their chunks; few hits go to the scan of the chunks, so that no texts are shuffled."""
    return search.sent(materialise(hits, "hits")).join(chunks.select("doc_id", "pos", *columns), ["doc_id", "pos"])


@query("passage_retrieval", BENCH + POSTED + """
select query_id, doc_id, pos, rank::int rank, score from (select query_id, doc_id, pos, round(score,4) score, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) rank from scored) where rank<=10""")
def passage_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, posted, terms, _ = _parts(spark, sf_dir)
    scored = search.match(terms, posted, ["doc_id", "pos"], best=10).withColumn("score", F.round("score", 4))
    return search.top_k(scored, ["doc_id", "pos"], 10).select("query_id", "doc_id", "pos", "rank", "score")


@query("bm25_retrieval", BENCH + POSTED + """,
dl as (select doc_id, pos, len(""" + TOK.format("content") + """) dl from chunks), av as (select avg(dl) al from dl),
bm as (select query_id, doc_id, pos, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/al))),4) score from qt join posted using (term) join stats using (term) join dl using (doc_id, pos), nn, av group by all)
select query_id, doc_id, pos, rank::int rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id, pos) rank from bm) where rank<=10""")
def bm25_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by BM25; blocks of chunks that can't hold one of them are not scored."""
    asked = search.query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    found, _ = index.block_max(asked, kept_index(spark, sf_dir), k=10)
    return found.select("query_id", "doc_id", "pos", "rank", "score")


@query("term_statistics", "with recursive queries as (select 0 query_id, '' as text)," + POSTED + " select term, df, round(ln(1+(n-df+0.5)/(df+0.5))/ln(1+(n-0.5)/1.5), 4) idf from stats, nn")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_index(spark, sf_dir)
    return kept.terms().select("term", "df", F.round(search.idf_share(F.col("df"), F.lit(kept.n)), 4).alias("idf"))


@query("inverted_index", "with recursive queries as (select 0 query_id, '' as text)," + POSTED + " select term, doc_id, pos, tf from posted where tf>=3")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).every_posting().where("tf >= 3").select("term", "doc_id", "pos", "tf")


@query("token_similarity", BENCH + POSTED + """,
tot as (select query_id, sum(w) total from terms group by 1)
select query_id, doc_id, pos, round((score+1e-9)/(total+1e-9),4) similarity from scored join tot using (query_id) where round((score+1e-9)/(total+1e-9),4)>=0.5""")
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, posted, terms, _ = _parts(spark, sf_dir)
    return search.token_similarity(terms, posted, ["doc_id", "pos"]).select("query_id", "doc_id", "pos", F.round("similarity", 4).alias("similarity")).where("similarity >= 0.5")


@query("minimum_match", BENCH + POSTED + """,
nt as (select query_id, count(*) nq from terms group by 1)
select query_id, doc_id, pos, hits from scored join nt using (query_id) where hits >= greatest(1, floor(0.3*nq))""")
def minimum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, posted, terms, _ = _parts(spark, sf_dir)
    n = terms.groupBy("query_id").agg(F.count("*").alias("nq"))
    return search.match(terms, posted, ["doc_id", "pos"]).join(n, "query_id").where("hits >= greatest(1, floor(0.3 * nq))").select("query_id", "doc_id", "pos", "hits")


@query("relaxed_second_pass", BENCH + POSTED + """,
nt as (select query_id, count(*) nq from terms group by 1),
s as materialized (select query_id, doc_id, pos, hits, nq from scored join nt using (query_id)),
a as materialized (select query_id, doc_id, pos, hits, 1 pass from s where hits >= greatest(1, floor(0.9*nq))),
b as (select query_id, doc_id, pos, hits, 2 pass from s anti join a using (query_id) where hits >= greatest(1, floor(0.5*nq)))
select * from a union all select * from b""")
def relaxed_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a strict hit are asked again with a lower minimum."""
    _, posted, terms, _ = _parts(spark, sf_dir)
    n = terms.groupBy("query_id").agg(F.count("*").alias("nq"))
    found = materialise(search.match(terms, posted, ["doc_id", "pos"]).join(n, "query_id"), "found")
    cols = ["query_id", "doc_id", "pos", "hits"]
    strict = found.where("hits >= greatest(1, floor(0.9 * nq))").select(*cols, F.lit(1).alias("pass"))
    loose = found.where("hits >= greatest(1, floor(0.5 * nq))").join(strict.select("query_id").distinct(), "query_id", "left_anti").select(*cols, F.lit(2).alias("pass"))
    return strict.unionByName(loose)


@query("hits_per_document", BENCH + POSTED + """,
t as (select *, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) rank from scored)
select query_id, doc_id, count(*) hits from t where rank<=50 group by all""")
def hits_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, posted, terms, _ = _parts(spark, sf_dir)
    scored = search.match(terms, posted, ["doc_id", "pos"], best=50).withColumn("score", F.round("score", 4)).drop("hits")
    return search.top_k(scored, ["doc_id", "pos"], 50).groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))


@query("retrieval_eval", BENCH + POSTED + """,
t as (select query_id, doc_id, pos, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) rank from scored),
qr as (select q.query_id, c.doc_id, c.pos, 1 rel from queries q join chunks c on contains(c.content, q.text)),
j as (select t.query_id, rank, coalesce(rel,0) rel from t left join qr on qr.query_id=t.query_id and qr.doc_id=t.doc_id and qr.pos=t.pos where rank<=10),
s as (select *, sum(rel) over (partition by query_id order by rank) sofar from j),
i as (select query_id, sum(1/log2(r+1)) ideal from (select query_id, row_number() over (partition by query_id order by doc_id::varchar||':'||pos::varchar) r from qr) where r<=10 group by 1)
select s.query_id, round(sum(rel/log2(rank+1))/any_value(ideal),4) ndcg, round(sum(case when rank<=5 and rel>0 then sofar/rank else 0 end)/nullif(sum(case when rank<=5 and rel>0 then 1 else 0 end),0),4) as "map",
 round(1/min(case when rel>0 then rank end),4) mrr from s join i using (query_id) group by 1""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, posted, terms, queries = _parts(spark, sf_dir)
    key = F.concat_ws(":", "doc_id", "pos")
    run = search.top_k(search.match(terms, posted, ["doc_id", "pos"], best=10).withColumn("score", F.round("score", 4)), ["doc_id", "pos"], 10).select("query_id", key.alias("key"), "rank")
    # A chunk with the query's text in it holds all its words, but for the first and the last, which may be parts of words there.
    some = search.match(terms, posted, ["doc_id", "pos"], missing=2).select("query_id", "doc_id", "pos")
    rels = with_chunks(some, c, "content").join(search.sent(queries), "query_id").where(F.col("content").contains(F.col("text"))).select("query_id", key.alias("key"), F.lit(1).alias("rel"))
    out = search.evaluate(run.join(rels.select("query_id").distinct(), "query_id", "left_semi"), rels)
    return out.select("query_id", *(F.round(m, 4).alias(m) for m in ("ndcg", "map", "mrr")))


COS = """u as (select vec_id, label, embedding::double[64] v from embeddings),
qv as (select * from u where vec_id%50=0),
cs as (select q.vec_id query_id, u.vec_id, u.label, q.label ql, round(array_cosine_similarity(q.v, u.v),6) score from qv q join u on u.vec_id<>q.vec_id)"""


def _vectors(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v"))


@query("knn_cosine", "with " + COS + " select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from cs) where r<=10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, v = _vectors(spark, sf_dir)
    return search.knn(v, q, 10).select("query_id", "vec_id", "score")


@query("knn_lists")
def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by inverted lists and codes; of vectors with an even label where the query's number is odd by fifties,
    as a filter is applied before the candidates are drawn."""
    e, q, _ = _vectors(spark, sf_dir)
    lists = ann.Lists(e.select("vec_id", "label", F.col("embedding").alias("v")))
    even = F.col("query_id") % 100 == 0
    every = lists.search(q.where(even), 10)
    return every.unionByName(lists.search(q.where(~even), 10, where=F.col("label") % 2 == 0)).select("query_id", "vec_id", "score")


@query("knn_eval", "with " + COS + """, t as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from cs)
select query_id, round(avg(case when label=ql then 1.0 else 0.0 end),4) precision_at_10 from t where r<=10 group by 1""")
def knn_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = knn_cosine(spark, sf_dir).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("label") == F.col("ql"), 1.0).otherwise(0.0)), 4).alias("precision_at_10"))


@query("title_blend", "select a.vec_id, round(0.1*b.embedding[1]::double+0.9*a.embedding[1]::double,5)+0.0 as first, len(a.embedding) dim from embeddings a join embeddings b on b.vec_id=a.label")
def title_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of a title vector (here the label's vector) and a content vector."""
    e = table(spark, sf_dir, "embeddings")
    titles = F.broadcast(e.where("vec_id < 10").select(F.col("vec_id").alias("label"), F.col("embedding").alias("title")))  # ten labels
    both = e.join(titles, "label").withColumn("v", F.zip_with("title", "embedding", lambda t, c: 0.1 * t.cast("double") + 0.9 * c.cast("double")))
    return both.select("vec_id", (F.round(F.get("v", F.lit(0)), 5) + F.lit(0.0)).alias("first"), F.size("v").cast("long").alias("dim"))


@query("highlight", r"""with s as (select doc_id, unnest(string_split(coalesce(text,''),'.')) s, generate_subscripts(string_split(coalesce(text,''),'.'),1) i from documents)
select doc_id, string_agg(regexp_replace(s, '(^|[^\p{L}])(tion|there|heed)([^\p{L}]|$)', '\1<em>\2</em>\3', 'g'), '...' order by i) highlight from s where regexp_matches(s, '(^|[^\p{L}])(tion|there|heed)([^\p{L}]|$)') group by 1""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a keyword, the keyword marked."""
    marked = F.transform(F.split("text", r"\."), lambda s: F.regexp_replace(s, r"(^|[^\p{L}])(tion|there|heed)([^\p{L}]|$)", "$1<em>$2</em>$3"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(marked, lambda s: s.contains("<em>")).alias("s"))
    return d.where(F.size("s") > 0).select("doc_id", F.array_join("s", "...").alias("highlight"))


@query("tag_prior", """with t as (select source tag, count(*) c from documents group by 1) select tag, c, round((c+1)/((select sum(c) from t)+1000),6) prior from t""")
def tag_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tag")).agg(F.count("*").alias("c"))
    total = t.agg(F.sum("c").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("tag", "c", F.round((F.col("c") + 1) / (F.col("total") + 1000), 6).alias("prior"))


@query("auto_tag", BENCH + POSTED + """,
hit as (select query_id, doc_id, pos, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) r from scored),
tg as (select query_id, kb_id tag, count(*) c from hit join chunks using (doc_id, pos) where r<=100 group by all),
cnt as (select query_id, sum(c) cnt from tg group by 1),
pr as (select kb_id tag, (count(*)+1)/((select count(*) from chunks)+1000) prior from chunks group by 1)
select query_id, tag, lift from (select query_id, tag, lift, row_number() over (partition by query_id order by lift desc, tag) k from
 (select query_id, tag, round(0.1*(c+1)/(cnt+1000)/greatest(1e-6,prior),6) lift from tg join cnt using (query_id) join pr using (tag))) where k<=3 and lift>0""")
def auto_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that are more frequent among the hits of a text than in the whole tag set."""
    c, posted, terms, _ = _parts(spark, sf_dir)
    scored = search.match(terms, posted, ["doc_id", "pos"], best=100).withColumn("score", F.round("score", 4)).drop("hits")
    hit = with_chunks(search.top_k(scored, ["doc_id", "pos"], 100), c, "kb_id").withColumnRenamed("kb_id", "tag")
    tags = hit.groupBy("query_id", "tag").agg(F.count("*").alias("c"))
    tags = tags.withColumn("cnt", F.sum("c").over(Window.partitionBy("query_id")))
    prior = c.groupBy(F.col("kb_id").alias("tag")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(c.agg(F.count("*").alias("total")))).select("tag", ((F.col("n") + 1) / (F.col("total") + 1000)).alias("prior"))
    lift = F.round(0.1 * (F.col("c") + 1) / (F.col("cnt") + 1000) / F.greatest(F.lit(1e-6), F.col("prior")), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("lift"), "tag")
    return tags.join(prior, "tag").withColumn("lift", lift).withColumn("k", F.row_number().over(w)).where("k <= 3 and lift > 0").select("query_id", "tag", "lift")


@query("context_budget", BENCH + POSTED + """,
t as (select query_id, doc_id, pos, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) rank from scored),
b as (select query_id, doc_id, pos, rank, sum(len(""" + TOK.format("content") + """)) over (partition by query_id order by rank) used from t join chunks using (doc_id, pos) where rank<=10)
select query_id, doc_id, pos, rank::int rank, used::bigint used from b where used<=485""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in rank order while their running size stays within 0.97 of 500 words."""
    c, posted, terms, _ = _parts(spark, sf_dir)
    hits = search.top_k(search.match(terms, posted, ["doc_id", "pos"], best=10).withColumn("score", F.round("score", 4)).drop("hits"), ["doc_id", "pos"], 10)
    sized = with_chunks(hits, c, "content").withColumn("size", F.size(tx.tokenize(F.col("content"))))
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("used", used).where("used <= 0.97 * 500").select("query_id", "doc_id", "pos", "rank", "used")


_ASKED = ", ".join(f"'{w}'" for w in tx.QUESTION_WORDS)


@query("question_terms", f"select item_id, case when x='' then text else x end cleaned from (select item_id, text, array_to_string(list_filter(string_split(lower(text),' '), lambda w: w<>'' and w not in ({_ASKED})),' ') x from benchmark)")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.drop_question_words(F.col("text")).alias("cleaned"))


@query("availability_filter", "with recursive " + CHUNKS.lstrip() + " select doc_id, pos, available from chunks where coalesce(available,1)>=1")
def availability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as available."""
    return kept_index(spark, sf_dir).store.where(F.coalesce("available", F.lit(1)) >= 1).select("doc_id", "pos", "available")
