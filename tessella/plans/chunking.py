"""Chunking and text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import pack
from .base import chunks, lines, table
from .registry import query
from .retrieval import CHUNKS, TOK

PIECES = r"""pc as (select doc_id, piece, row_number() over (partition by doc_id order by i) p, len(list_filter(string_split(piece,' '), lambda x: x<>'')) c
  from (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) piece, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) i from documents) where trim(piece)<>'')"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("pack_greedy", "with recursive " + CHUNKS.lstrip() + " select doc_id, pos::int pos, content from chunks")
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "pos", "content")


@query("pack_bounded", r"""with recursive w as (select doc_id, i, list_filter(string_split(piece,' '), lambda x: x<>'') w from
 (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) piece, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) i from documents) where trim(piece)<>''),
pc as (select doc_id, array_to_string(w[k*100+1:k*100+100],' ') piece, len(w[k*100+1:k*100+100]) c, row_number() over (partition by doc_id order by i, k) p from (select *, unnest(range(0, greatest(1, ceil(len(w)/100.0)::int))) k from w)),
fold as (select doc_id, p, c n, 0 id from pc where p=1 union all select f.doc_id, f.p+1, case when f.n+pc.c>100 then pc.c else f.n+pc.c end, case when f.n+pc.c>100 then f.id+1 else f.id end from fold f join pc on pc.doc_id=f.doc_id and pc.p=f.p+1)
select pc.doc_id, id pos, string_agg(piece, chr(10) order by pc.p) content from pc join fold f on f.doc_id=pc.doc_id and f.p=pc.p group by 1,2""")
def pack_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.bounded(_docs(spark, sf_dir), 100)


@query("pack_regex", r"""with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) t, generate_subscripts(string_split(coalesce(text,''), chr(10)),1) i from documents),
c as (select *, sum(case when regexp_matches(t, '^\s*(?:The|And|Is)\b') then 1 else 0 end) over (partition by doc_id order by i) cid from l)
select doc_id, cid::bigint cid, string_agg(t, chr(10) order by i) content from c group by 1,2""")
def pack_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.by_pattern(lines(spark, sf_dir), r"(?:The|And|Is)\b")


@query("pack_title", r"""with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) t, generate_subscripts(string_split(coalesce(text,''), chr(10)),1)-1 i from documents),
h as (select doc_id, i, case when i%3=0 then repeat('#', (1+i%3)::int)||' '||t when i%5=1 then '## '||t else t end t from l),
d as (select *, length(regexp_extract(t,'^(#{1,6}) ',1)) depth from h),
x as (select *, sum(case when depth between 1 and 1 then 1 else 0 end) over w id1, sum(case when depth between 1 and 2 then 1 else 0 end) over w id2 from d window w as (partition by doc_id order by i)),
y as (select *, max(id1) over (partition by doc_id)-min(id1) over (partition by doc_id)+1 n1, max(id2) over (partition by doc_id)-min(id2) over (partition by doc_id)+1 n2 from x)
select doc_id, (case when n2>1 then id2 when n1>1 then id1 else 0 end)::bigint cid, string_agg(t, chr(10) order by i) content from y group by 1,2""")
def pack_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("pos") % 5 == 1, F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    return pack.by_title(lines(spark, sf_dir).withColumn("text", t), 2)


@query("parent_child", "with recursive " + PIECES + r""",
fold as (select doc_id, p, c n, 0 id from pc where p=1 union all select f.doc_id, f.p+1, case when f.n+pc.c>256 then pc.c else f.n+pc.c end, case when f.n+pc.c>256 then f.id+1 else f.id end from fold f join pc on pc.doc_id=f.doc_id and pc.p=f.p+1),
kids as materialized (select pc.doc_id, id child, string_agg(piece, chr(10) order by pc.p) content, sum(pc.c)::bigint n, row_number() over (partition by pc.doc_id order by id) k from pc join fold f on f.doc_id=pc.doc_id and f.p=pc.p group by 1,2),
up as (select doc_id, k, n, 0 id from kids where k=1 union all select u.doc_id, u.k+1, case when u.n+kids.n>1024 then kids.n else u.n+kids.n end, case when u.n+kids.n>1024 then u.id+1 else u.id end from up u join kids on kids.doc_id=u.doc_id and kids.k=u.k+1)
select kids.doc_id, up.id parent, string_agg(content, chr(10)||chr(10) order by child) content from kids join up on up.doc_id=kids.doc_id and up.k=kids.k group by 1,2""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.parent_child(_docs(spark, sf_dir))[0]


@query("char_windows", """with recursive p as (select doc_id, text t, 1 st, 0 win, substring(text,1,1000) piece from documents where length(text)>0
 union all select doc_id, t, nxt, win+1, substring(t,nxt,1000) from (select *, st+greatest((case when strpos(piece,'.')>0 and length(piece)-strpos(reverse(piece),'.')+1>500 then length(piece)-strpos(reverse(piece),'.')+1 else length(piece) end)-200,1) nxt from p where st+1000<=length(t))),
k as (select doc_id, win, piece, st+1000>length(t) as done, length(piece)-strpos(reverse(piece),'.')+1 stop from p)
select doc_id, win::int win, case when not done and strpos(piece,'.')>0 and stop>500 then substring(piece,1,stop) else piece end as content from k""")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.char_windows(_docs(spark, sf_dir))


@query("whole_document", "select doc_id, text as content, len(list_filter(string_split(text,' '), lambda x: x<>''))::bigint words from documents where trim(coalesce(text,''))<>''")
def whole_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.trim("text") != "").select("doc_id", F.col("text").alias("content"), pack.word_count(F.col("text")).cast("long").alias("words"))


@query("chunk_records", "with recursive " + CHUNKS.lstrip() + ", t as (select *, " + TOK.format("content") + " tk from chunks) select doc_id, pos::int pos, kb_id, md5(content||doc_id::varchar) chunk_id, len(tk)::bigint n_tokens, array_to_string(tk[1:8],' ') as head from t where trim(content)<>''")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where(F.trim("content") != "")
    return c.select("doc_id", "pos", "kb_id", F.md5(F.concat("content", F.col("doc_id").cast("string"))).alias("chunk_id"), F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.slice("tokens", 1, 8), " ").alias("head"))


@query("token_counts", r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint n_tokens, array_to_string(string_split_regex(trim(text),'\s+')[1:10],' ') truncated from documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("n_tokens"), tx.truncate_words(F.col("text"), 10).alias("truncated"))


@query("language_tests", r"select doc_id, coalesce(length(regexp_replace(text,'[^\x00-\x7F]','','g'))/nullif(length(text),0) > 0.8, false) english, coalesce((length(text)-length(regexp_replace(text,'[\x{4E00}-\x{9FFF}]','','g')))/nullif(length(text),0) > 0.2, false) chinese from documents")
def language_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_english(F.col("text")).alias("english"), tx.is_chinese(F.col("text")).alias("chinese"))


@query("text_cleaning", r"""select item_id, trim(regexp_replace(regexp_replace(text,'[^\p{L}\p{N}_\s]',' ','g'),'\s+',' ','g')) stripped, regexp_replace(regexp_replace(text,'([^\x00-\x7F]) +','\1','g'),' +([^\x00-\x7F])','\1','g') squeezed,
 regexp_replace(text,'([:\{\}/\[\]\-\*"\(\)\|\+~\^])','\\\1','g') escaped from benchmark""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", tx.strip_marks(t).alias("stripped"), tx.squeeze_spaces(t).alias("squeezed"), tx.escape_query(t).alias("escaped"))


@query("content_hash_dedup", "select md5(text) id, min(doc_id) doc_id, count(*) copies from documents where text is not null group by 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("id"))
    return d.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("category_vote", r"""with c as (select doc_id, len(regexp_extract_all(lower(text),'the')) a, len(regexp_extract_all(lower(text),'les')) b, len(regexp_extract_all(lower(text),'und')) c from documents)
select doc_id, case when a>=b and a>=c then 'the' when b>=c then 'les' else 'und' end category from c""")
def category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category named most often; the first of equals, and the first where none is named."""
    n = {c: F.regexp_count(F.lower("text"), F.lit(c)) for c in ("the", "les", "und")}
    best = F.when((n["the"] >= n["les"]) & (n["the"] >= n["und"]), "the").when(n["les"] >= n["und"], "les").otherwise("und")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", best.alias("category"))


BLOCKS = "p|div|h1|h2|h3|h4|h5|h6|li|ul|ol|table|tr|br|article|section|nav|footer|header|aside|title"


@query("html_sections", r"""with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<(h[1-6])[^>]*>', chr(1)||'\1'||chr(2), 'g') h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?i)</?(""" + BLOCKS + r""")( [^>]*)?/?>', chr(1), 'g'), '<[^>]*>', '', 'g') h from a),
s as (select page_id, unnest(string_split(h, chr(1))) t, generate_subscripts(string_split(h, chr(1)),1) i from b),
u as (select page_id, i, case when regexp_matches(t, '^h[1-6]\x02') then repeat('#', substring(t,2,1)::int)||' '||trim(substring(t,4)) else trim(t) end t from s)
select page_id, (row_number() over (partition by page_id order by i)-1)::int pos, replace(replace(replace(replace(t,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&amp;','&') as text from u where t<>'' and not regexp_matches(t,'^#+ $')""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page in order, headings marked by number signs, scripts and comments gone."""
    h = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    h = F.regexp_replace(h, r"(?i)<(h[1-6])[^>]*>", "\x01$1\x02")
    h = F.regexp_replace(F.regexp_replace(h, rf"(?i)</?({BLOCKS})( [^>]*)?/?>", "\x01"), r"<[^>]*>", "")
    s = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(h, "\x01")).alias("i", "t"))
    t = F.when(F.col("t").rlike("^h[1-6]\x02"), F.concat(F.repeat(F.lit("#"), F.substring("t", 2, 1).cast("int")), F.lit(" "), F.trim(F.substring("t", 4, 1_000_000_000)))).otherwise(F.trim("t"))
    s = s.withColumn("t", t).where((F.col("t") != "") & ~F.col("t").rlike("^#+ $"))
    text = F.col("t")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return s.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("i")) - 1).alias("pos"), text.alias("text"))


@query("web_documents", r"""select md5(url||':'||substring(html,1,100)) id, page_id, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) "domain", coalesce(nullif(trim(regexp_extract(html,'<title>([^<]*)</title>',1)),''), url) title,
 substring(trim(regexp_replace(regexp_replace(html,'<[^>]*>',' ','g'),'\s+',' ','g')),1,200) description from pages where html<>''""")
def web_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").where("html <> ''").select(
        F.md5(F.concat_ws(":", "url", F.substring("html", 1, 100))).alias("id"), "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("domain"),
        F.when(title != "", title).otherwise(F.col("url")).alias("title"), F.substring(plain, 1, 200).alias("description"))


QA = """l as (select p_partkey k, p_partkey//50 g, case when p_partkey%5=0 then p_name else p_name||chr(9)||p_type end t from part),
f as (select *, sum(case when contains(t, chr(9)) then 1 else 0 end) over (partition by g order by k) qid from l)"""


@query("qa_pairs", "with " + QA + """ select g, qid::bigint qid, any_value(string_split(t, chr(9))[1]) filter (where contains(t, chr(9))) question,
 string_agg(case when contains(t, chr(9)) then string_split(t, chr(9))[2] else t end, chr(10) order by k) answer from f where qid>0 group by 1,2""")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a delimiter are pairs, other lines continue the answer; lines before the first pair are dropped."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50).alias("g"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat_ws("\t", "p_name", "p_type")).alias("t"))
    f = p.withColumn("start", F.col("t").contains("\t")).withColumn("qid", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(Window.partitionBy("g").orderBy("k"))).where("qid > 0")
    part = F.split("t", "\t")
    answers = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("start"), part[1]).otherwise(F.col("t")).alias("a")))), lambda x: x["a"]), "\n")
    return f.groupBy("g", "qid").agg(F.max(F.when(F.col("start"), part[0])).alias("question"), answers.alias("answer"))


@query("tag_rows", """with l as (select p_partkey k, p_partkey//50 g, case when p_partkey%5=0 then p_name else p_name||chr(9)||p_brand||', '||p_type end t from part),
f as (select *, coalesce(sum(case when contains(t, chr(9)) then 1 else 0 end) over (partition by g order by k rows between unbounded preceding and 1 preceding),0) rid from l)
select g, rid::bigint rid, string_agg(string_split(t, chr(9))[1], chr(10) order by k) as content, max(case when contains(t,chr(9)) then replace(replace(string_split(t, chr(9))[2],'.','_'),', ','|') end) tags from f group by 1,2 having count(case when contains(t,chr(9)) then 1 end)>0""")
def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of content and tags; lines without tags stand before the content of the next one, and such at the end are left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50).alias("g"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("\t"), "p_brand", F.lit(", "), "p_type")).alias("t"))
    part = F.split("t", "\t")
    before = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    f = p.withColumn("pair", F.size(part) == 2).withColumn("rid", F.coalesce(F.sum(F.when(F.col("pair"), 1).otherwise(0)).over(before), F.lit(0)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", part[0].alias("c")))), lambda x: x["c"]), "\n")
    tags = F.array_join(F.filter(F.transform(F.split(F.max(F.when(F.col("pair"), part[1])), ","), lambda x: F.replace(F.trim(x), F.lit("."), F.lit("_"))), lambda x: x != ""), "|")
    return f.groupBy("g", "rid").agg(content.alias("content"), tags.alias("tags"), F.max("pair").alias("pair")).where("pair").drop("pair")


@query("row_text", "select p_partkey, 'name：'||p_name||'; brand：'||p_brand||'; size：'||p_size::varchar as text from part")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"name": "p_name", "brand": "p_brand", "size": "p_size"}
    cells = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{h}："), F.col(c).cast("string"))) for h, c in cols.items()]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("; ", *cells).alias("text"))


@query("delimited_rows", "select p_partkey, case when p_partkey%13=0 then null else p_name end as name, p_partkey%13=0 rejected from part")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose field count differs from the header's are set aside."""
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, F.concat_ws("\t", "p_name", "p_brand")).otherwise(F.concat_ws("\t", "p_name", "p_brand", "p_type")).alias("line"))
    cells = F.split("line", "\t")
    return raw.select("p_partkey", F.when(F.size(cells) == 3, cells[0]).alias("name"), (F.size(cells) != 3).alias("rejected"))


@query("history_budget", r"""with t as (select conv_id, turn, role, text, len(string_split(text,' ')) n from conversations), s as (select *, sum(n) over (partition by conv_id) total, row_number() over (partition by conv_id order by turn desc, role, text) last from t),
k as (select *, sum(n) over (partition by conv_id) kept, row_number() over (partition by conv_id order by n desc, turn, role, text) longest from s where total<100 or role='system' or last=1)
select conv_id, turn, role, case when kept>100 and longest=1 then array_to_string(string_split(text,' ')[1:greatest(100-(kept-n),0)::int],' ') else text end as text from k""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under the budget; of others the system rows and the last row, the longest cut to fit."""
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.size(F.split("text", " ", -1)).alias("n"))
    s = c.withColumn("total", F.sum("n").over(w)).withColumn("last", F.row_number().over(w.orderBy(F.desc("turn"), "role", "text")))
    k = s.where("total < 100 or role = 'system' or last = 1").withColumn("kept", F.sum("n").over(w)).withColumn("longest", F.row_number().over(w.orderBy(F.desc("n"), "turn", "role", "text")))
    room = F.greatest(100 - (F.col("kept") - F.col("n")), F.lit(0)).cast("int")
    cut = F.array_join(F.slice(F.split("text", " ", -1), F.lit(1), room), " ")
    return k.select("conv_id", "turn", "role", F.when((F.col("kept") > 100) & (F.col("longest") == 1), cut).otherwise(F.col("text")).alias("text"))


@query("last_turns", "select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc, text) r from conversations where role='user') where r<=3")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    return table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn", "text")


@query("range_parent", """with l as (select doc_id, generate_subscripts(string_split(coalesce(text,''),chr(10)),1)-1 pos from documents),
m as (select doc_id, max(pos) last from l group by 1),
kid as (select doc_id, unnest(range(0, last//2+1)) k, last from m), par as (select doc_id, unnest(range(0, last//5+1)) p, last from m)
select kid.doc_id, k::bigint child, min(p)::bigint parent from kid join par on par.doc_id=kid.doc_id and 5*p<=2*k and least(2*k+1,kid.last)<=least(5*p+4,par.last) group by 1,2""")
def range_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children [2k, 2k+1] of lines inside parents [5p, 5p+4]; the first parent wins, children without one drop."""
    m = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("pos").alias("last"))
    ranges = lambda n, name: m.select("doc_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / n))).alias(name)).select("doc_id", name, (F.col(name) * n).alias(f"{name}0"), F.least(F.col(name) * n + n - 1, F.col("last")).alias(f"{name}1"))
    return ranges(2, "child").join(ranges(5, "parent"), "doc_id").where("parent0 <= child0 and child1 <= parent1").groupBy("doc_id", "child").agg(F.min("parent").alias("parent"))
