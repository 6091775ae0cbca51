"""Smaller operators: readers of line formats, parsers of marks in text, ranks, sections, term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from ..scratch import materialise
from .base import chunks, lines, table
from .chunking import html_sections
from .registry import SQL, query
from .retrieval import BENCH, CHUNKS, POSTED, _parts


@query("json_rows", "select event_id, try_cast(json_extract_string(props,'$.k') as bigint) k, props is null or json_extract_string(props,'$.k') is null rejected from events")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed JSON lines; what doesn't parse is marked."""
    v = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", v.try_cast("long").alias("k"), v.isNull().alias("rejected"))


@query("heading_qa", "with sec as (" + SQL["html_sections"] + r"""), g as (select *, regexp_matches(text,'^#{1,6} ') h, sum(case when regexp_matches(text,'^#{1,6} ') then 1 else 0 end) over (partition by page_id order by pos) k from sec)
select page_id, k::bigint section, max(case when h then regexp_replace(text,'^#+ ','') end) question, string_agg(case when not h then text end, chr(10) order by pos) answer from g where k>0 group by 1,2 having count(case when not h then 1 end)>0""")
def heading_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question: the headings above a body (of pages, which have one level); answer: the body up to the next heading."""
    s = html_sections(spark, sf_dir)
    level = F.length(F.regexp_extract("text", "^(#{1,6}) ", 1))
    w = Window.partitionBy("page_id").orderBy("pos")
    s = s.withColumn("level", level).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w)).where("section > 0")
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", F.regexp_replace("text", "^#+ ", "").alias("t"))), True).over(w) for k in range(1, 7)}
    s = s.withColumns({f"h{k}": c for k, c in last.items()})
    # A heading counts only if none of a lesser level came after it.
    shown = [F.when(~F.coalesce(F.greatest(F.lit(-1), *[F.col(f"h{j}.pos") for j in range(1, k)]) > F.col(f"h{k}.pos"), F.lit(False)), F.col(f"h{k}.t")) if k > 1 else F.col("h1.t") for k in range(1, 7)]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    out = s.withColumn("q", F.concat_ws(" / ", *shown)).groupBy("page_id", "section").agg(F.max("q").alias("question"), body.alias("answer"), F.count(F.when(F.col("level") == 0, 1)).alias("n"))
    return out.where("n > 0").drop("n")


@query("table_row_groups", "select p_brand, k::bigint as grp, 'name|size;'||string_agg(p_name||'|'||p_size, ';' order by p_partkey) as content from (select *, (row_number() over (partition by p_brand order by p_partkey)-1)//12 k from part) group by 1,2")
def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve rows to a group, each with the header before it."""
    k = F.floor((F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 12)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws("|", "p_name", "p_size").alias("r")))), lambda x: x["r"])
    return table(spark, sf_dir, "part").withColumn("grp", k).groupBy("p_brand", "grp").agg(F.concat(F.lit("name|size;"), F.array_join(rows, ";")).alias("content"))


@query("benchmark_reader", """with q as (select o_custkey query_id, list(o_orderkey order by o_orderkey) keys, list(case when o_orderstatus='F' then 1 else 0 end order by o_orderkey) sel from orders group by 1)
select query_id, unnest(keys) passage, unnest(sel) rel from q""")
def benchmark_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested passages and judgements, one row for each passage."""
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("s")))).alias("p"))
    nested = q.select("query_id", F.col("p.k").alias("keys"), F.col("p.s").alias("sel"))
    return nested.select("query_id", F.explode(F.arrays_zip("keys", "sel")).alias("z")).select("query_id", F.col("z.keys").alias("passage"), F.col("z.sel").alias("rel"))


@query("position_unpack", r"""with t as (select l_orderkey, l_linenumber, l_partkey, 'a@@'||l_linenumber||chr(9)||l_partkey||chr(9)||l_suppkey||chr(9)||l_quantity::int||chr(9)||(l_quantity::int+9)||'##b' x from lineitem)
select l_orderkey, l_linenumber, l_partkey, split_part(regexp_extract(x,'@@([0-9\t]+)##',1),chr(9),1)::bigint page, split_part(regexp_extract(x,'@@([0-9\t]+)##',1),chr(9),2)::bigint "left", split_part(regexp_extract(x,'@@([0-9\t]+)##',1),chr(9),3)::bigint "right", split_part(regexp_extract(x,'@@([0-9\t]+)##',1),chr(9),4)::bigint top, split_part(regexp_extract(x,'@@([0-9\t]+)##',1),chr(9),5)::bigint bottom, regexp_replace(x,'@@[0-9\t]+##','','g') as text from t""")
def position_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place tags to numbers, and the text without them."""
    x = F.concat(F.lit("a@@"), F.concat_ws("\t", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.col("l_quantity").cast("int") + 9), F.lit("##b"))
    numbers = F.split(F.regexp_extract("x", r"@@([0-9\t]+)##", 1), "\t")
    five = [F.get(numbers, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("page", "left", "right", "top", "bottom"))]
    return table(spark, sf_dir, "lineitem").withColumn("x", x).select("l_orderkey", "l_linenumber", "l_partkey", *five, F.regexp_replace("x", r"@@[0-9\t]+##", "").alias("text"))


@query("citation_repair", r"""with t as (select o_orderkey, 'x (ID: '||o_orderkey%40||') y [ID:'||o_custkey%40||'] ref'||o_orderkey%7 x from orders),
r as (select o_orderkey, regexp_replace(regexp_replace(x,'\(\s*ID\s*:?\s*([0-9]+)\s*\)','[ID:\1]','g'),'\bref\s*([0-9]+)','[ID:\1]','gi') x from t)
select o_orderkey, x as text, list_aggr(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(x,'\[ID:([0-9]+)\]',1), lambda y: y::int), lambda y: y<20))),'string_agg',',') cited from r""")
def citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a citation to one form; numbers of hits that exist are cited."""
    x = F.concat(F.lit("x (ID: "), F.col("o_orderkey") % 40, F.lit(") y [ID:"), F.col("o_custkey") % 40, F.lit("] ref"), F.col("o_orderkey") % 7)
    x = F.regexp_replace(F.regexp_replace(x, r"\(\s*ID\s*:?\s*([0-9]+)\s*\)", "[ID:$1]"), r"(?i)\bref\s*([0-9]+)", "[ID:$1]")
    ids = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\[ID:([0-9]+)\]"), F.lit(1)), lambda y: y.cast("int")), lambda y: y < 20)
    cited = F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda y: y.cast("string")), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("text")).select("o_orderkey", "text", F.when(F.size(ids) > 0, cited).alias("cited"))


@query("tagged_spans", r"select page_id, array_to_string(regexp_extract_all(html,'<li>(.*?)</li>',1),'|') spans from pages")
def tagged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1)), "|").alias("spans"))


@query("float_parse", "select doc_id, case when doc_id%3=0 then n_chars::double else '-inf'::double end as value from documents")
def float_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.to_float(raw).alias("value"))


@query("section_ids", "with sec as (" + SQL["html_sections"] + r"""), v as (select page_id, pos, case when regexp_matches(text,'^#{1,6} ') then length(regexp_extract(text,'^(#{1,6}) ',1)) else 9 end lv from sec),
f as (select *, case when lv<=2 and lv is distinct from lag(lv) over (partition by page_id order by pos) then 1 else 0 end f from v)
select page_id, pos, sum(f) over (partition by page_id order by pos)::bigint section from f""")
def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section begins where the level is at most the pivot and differs from the block's before."""
    w = Window.partitionBy("page_id").orderBy("pos")
    v = html_sections(spark, sf_dir).withColumn("level", F.when(F.col("text").rlike("^#{1,6} "), F.length(F.regexp_extract("text", "^(#{1,6}) ", 1))).otherwise(9))
    f = F.when((F.col("level") <= 2) & ~F.col("level").eqNullSafe(F.lag("level").over(w)), 1).otherwise(0)
    return v.withColumn("f", f).select("page_id", "pos", F.sum("f").over(w).alias("section"))


@query("title_levels", "with sec as (" + SQL["html_sections"] + r"""), l as (select page_id, length(regexp_extract(text,'^(#{1,6}) ',1)) as level, count(*) n from sec where regexp_matches(text,'^#{1,6} ') group by 1,2) select page_id, level::int as level from (select *, row_number() over (partition by page_id order by n desc, level) r from l) where r=1""")
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading level that a page has most often."""
    g = html_sections(spark, sf_dir).where(F.col("text").rlike("^#{1,6} ")).groupBy("page_id", F.length(F.regexp_extract("text", "^(#{1,6}) ", 1)).alias("level")).agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "level"))).where("r = 1").select("page_id", "level")


@query("bullet_vote", r"""with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) t from documents), v as (select doc_id, sum(regexp_matches(t,'^\s*[0-9]+[.)]')::int) a, sum(regexp_matches(t,'^\s*[-*•]')::int) b, sum(regexp_matches(t,'^[A-Z]{2,}')::int) c from l group by 1)
select doc_id, (case when greatest(a,b,c)=0 then -1 when a>=b and a>=c then 0 when b>=c then 1 else 2 end)::int style from v""")
def bullet_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbering family that most lines fit, -1 for none."""
    n = lambda p: F.sum(F.when(F.col("text").rlike(p), 1).otherwise(0))
    v = lines(spark, sf_dir).groupBy("doc_id").agg(n(r"^\s*[0-9]+[.)]").alias("a"), n(r"^\s*[-*•]").alias("b"), n(r"^[A-Z]{2,}").alias("c"))
    style = F.when(F.greatest("a", "b", "c") == 0, -1).when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 0).when(F.col("b") >= F.col("c"), 1).otherwise(2)
    return v.select("doc_id", style.alias("style"))


@query("label_numbering", "select c_custkey, c_mktsegment||case when r=0 then '' else '('||r||')' end as label from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey)-1 r from customer)")
def label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")) - 1
    c = table(spark, sf_dir, "customer").withColumn("r", r)
    return c.select("c_custkey", F.concat("c_mktsegment", F.when(F.col("r") == 0, "").otherwise(F.concat(F.lit("("), "r", F.lit(")")))).alias("label"))


@query("chunk_order", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by m, o_orderkey desc) ordered from (select *, (o_orderkey%7+o_orderkey%3)/2.0 m from orders) group by 1")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the mean of their page numbers, newest first among equals."""
    pages = F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 3)
    mean = F.aggregate(pages, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pages)
    rows = F.array_sort(F.collect_list(F.struct(mean.alias("m"), (-F.col("o_orderkey")).alias("k"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: (-x["k"]).cast("string")), ",").alias("ordered"))


@query("rank_features", BENCH + POSTED + """, hit as (select query_id, doc_id, pos from (select *, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) r from scored) where r<=50),
q as (select item_id query_id, 'en' lang, 2.0 ql, 'src'||item_id%20 source, 1.0 qs from benchmark where item_id%3<>0)
select hit.query_id, hit.doc_id, pos, round(coalesce(10*((case when d.lang=q.lang then (1.0+d.doc_id%3)*ql else 0 end)+(case when d.source=q.source then qs else 0 end))/sqrt((1.0+d.doc_id%3)*(1.0+d.doc_id%3)+1)/sqrt(ql*ql+qs*qs),0)+d.doc_id%4,4) score
from hit join documents d using (doc_id) left join q on q.query_id=hit.query_id""")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best 50 hits of each query ten times the cosine of the query's tags and the chunk's, plus the rank of its document;
    a third of the queries have no tags, and their hits the rank alone."""
    c, posted, terms, queries = _parts(spark, sf_dir)
    hits = search.top_k(search.match(terms, posted, ["doc_id", "pos"], best=50).withColumn("score", F.round("score", 4)), ["doc_id", "pos"], 50).select("query_id", "doc_id", "pos")
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map("lang", 1.0 + F.col("doc_id") % 3, "source", F.lit(1.0).cast("double")).alias("tags"))
    tags = c.select("doc_id", "pos").join(d, "doc_id").select("doc_id", "pos", F.explode("tags").alias("tag", "value"))
    asked = queries.where("query_id % 3 <> 0").select("query_id", F.explode(F.create_map(F.lit("en"), F.lit(2.0), F.concat(F.lit("src"), F.col("query_id") % 20), F.lit(1.0))).alias("tag", "value"))
    out = search.rank_feature(materialise(hits, "hits"), asked, tags, F.col("doc_id") % 4)
    return out.select("query_id", "doc_id", "pos", F.round("feature", 4).alias("score"))


@query("term_weights", BENCH + POSTED + " select query_id, term, round(w/sum(w) over (partition by query_id),6) weight from terms")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, terms, _ = _parts(spark, sf_dir)
    return terms.select("query_id", "term", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")), 6).alias("weight"))


@query("paragraph_query", BENCH + POSTED + " select query_id, term from (select query_id, term, row_number() over (partition by query_id order by round(w,6) desc, term) r from terms) where r<=30")
def paragraph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 heaviest terms of a text, as a query."""
    _, _, terms, _ = _parts(spark, sf_dir)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("w", 6)), "term")
    return terms.withColumn("r", F.row_number().over(w)).where("r <= 30").select("query_id", "term")


@query("synonym_expansion", "with t as (select distinct p_brand term from part), s as (select p_brand term, p_type syn, row_number() over (partition by p_brand order by p_type) k from (select distinct p_brand, p_type from part)) select term, term word, 1.0 weight from t union all select term, syn, 0.25 from s where k<=8")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term with up to eight synonyms at a quarter of its weight."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("word")).distinct()
    k = F.row_number().over(Window.partitionBy("term").orderBy("word"))
    own = p.select("term", F.col("term").alias("word"), F.lit(1.0).alias("weight")).distinct()
    return own.unionByName(p.withColumn("k", k).where("k <= 8").select("term", "word", F.lit(0.25).alias("weight")))


@query("adjacent_pairs", BENCH + r"""t as (select query_id, list_filter(string_split(regexp_replace(lower(text),'[^\p{L}\p{N}_]+',' ','g'),' '), lambda x: x<>'') w from queries)
select query_id, i::int pos, w[i+1]||' '||w[i+2] as phrase from (select *, unnest(range(0, len(w)-1)) i from t)""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words of a query as phrases."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.tokenize(F.col("text")).alias("w")).where("size(w) > 1")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return q.select("query_id", F.posexplode(pairs).alias("pos", "phrase"))


@query("id_remapping", "with m as (select o_orderkey tmp, o_orderkey*10 id from orders where o_orderkey%2=0) select a.id child, b.id parent from lineitem join m a on a.tmp=l_orderkey join m b on b.tmp=l_partkey group by 1,2")
def id_remapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary ids of a relation replaced by stored ones; pairs without both go."""
    m = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("tmp"), (F.col("o_orderkey") * 10).alias("id"))
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return r.join(m.select(F.col("tmp").alias("l_orderkey"), F.col("id").alias("child")), "l_orderkey").join(m.select(F.col("tmp").alias("l_partkey"), F.col("id").alias("parent")), "l_partkey").select("child", "parent").distinct()


@query("hit_enrichment", BENCH + POSTED + ", t as (select *, row_number() over (partition by query_id order by round(score,4) desc, doc_id, pos) rank from scored) select query_id, rank::int rank, 'ID:'||(rank-1)||' '||source||' '||lang as block from t join documents using (doc_id) where rank<=5")
def hit_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the columns of their documents, as context blocks."""
    _, posted, terms, _ = _parts(spark, sf_dir)
    hits = search.top_k(search.match(terms, posted, ["doc_id", "pos"], best=5).withColumn("score", F.round("score", 4)), ["doc_id", "pos"], 5)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return hits.join(d, "doc_id").select("query_id", "rank", F.concat(F.lit("ID:"), F.col("rank") - 1, F.lit(" "), "source", F.lit(" "), "lang").alias("block"))


@query("text_sql", "with recursive " + CHUNKS.lstrip() + r" select kb_id, count(*) n from chunks where len(list_intersect(list_distinct(list_filter(string_split(regexp_replace(lower(content),'[^\p{L}\p{N}_]+',' ','g'),' '), lambda x: x<>'')), ['the','and','heed']))>=2 group by 1")
def text_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a chunk table with a text predicate: at least a share of the asked words."""
    return spark.sql("select kb_id, count(*) n from {c} where size(array_intersect(tokens, split({asked}, ' '))) >= greatest(1, ceil({share} * size(split({asked}, ' ')))) group by kb_id", c=chunks(spark, sf_dir), asked="the and heed", share=0.5)
