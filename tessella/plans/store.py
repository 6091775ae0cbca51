"""Chunk-store changes, set operations and incremental work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import ChunkStore
from ..scratch import scratch_path
from .base import chunks, table
from .registry import query
from .retrieval import CHUNKS


def upsert(store: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables; of one key the row with the largest version stays."""
    both = store.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


@query("chunk_upsert", """with a as (select doc_id, source kb, 1 v from documents), b as (select doc_id, 'moved' kb, 2 v from documents where doc_id%3=0 union all select doc_id+1000000, 'new', 2 from documents where doc_id%10=0)
select doc_id, arg_max(kb, v) kb, max(v)::int v from (select * from a union all select * from b) group by 1""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    store = d.select("doc_id", F.col("source").alias("kb"), F.lit(1).alias("v"))
    new = d.where("doc_id % 3 = 0").select("doc_id", F.lit("moved").alias("kb"), F.lit(2).alias("v")).unionByName(d.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("kb"), F.lit(2).alias("v")))
    return upsert(store, new, "doc_id", "v")


@query("store_changes", """with a as (select doc_id, source kb, 1 v from documents), b as (select doc_id, 'moved' kb, 2 v from documents where doc_id%50=0 union all select doc_id+1000000, 'new', 2 from documents where doc_id%100=0),
m as (select doc_id, arg_max(kb, v) kb from (select * from a union all select * from b) group by 1)
select doc_id, case when kb='moved' and doc_id%150=0 then 'checked' else kb end kb from m where not (kb='new' and doc_id%200=0)""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store on files after a load, an upsert that is sent twice, an update and a delete."""
    d = table(spark, sf_dir, "documents")
    store = ChunkStore(spark, scratch_path(spark, "chunks"), ["doc_id"])
    store.upsert(d.select("doc_id", F.col("source").alias("kb")), 1)
    moved = d.where("doc_id % 50 = 0").select("doc_id", F.lit("moved").alias("kb"))
    new = moved.unionByName(d.where("doc_id % 100 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("kb")))
    for _ in range(2):
        store.upsert(new, 2)
    store.change((F.col("kb") == "moved") & (F.col("doc_id") % 150 == 0), 3, {"kb": F.lit("checked")})
    store.change((F.col("kb") == "new") & (F.col("doc_id") % 200 == 0), 4)
    return store.read().select("doc_id", "kb")


def where(df: DataFrame, condition: dict) -> Column:
    """{column: value, list of values, {"exists": bool}}; what is empty is passed over, an array column fits if any element does."""
    tests = [F.lit(True)]
    for c, v in condition.items():
        if isinstance(v, dict):
            tests.append(F.col(c).isNotNull() if v["exists"] else F.col(c).isNull())
        elif v not in (None, "", []):
            values = v if isinstance(v, list) else [v]
            tests.append(F.arrays_overlap(c, F.array(*map(F.lit, values))) if df.schema[c].dataType.typeName() == "array" else F.col(c).isin(*values))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def update(df: DataFrame, condition: dict, set: dict | None = None, remove: dict | None = None, add: dict | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that fit the condition get scalars, lose the first such element of an array, gain one at its end, or lose a field."""
    hit, new = where(df, condition), {c: F.lit(v) for c, v in (set or {}).items()} | {c: F.lit(None).cast(df.schema[c].dataType) for c in drop}
    for c, v in (remove or {}).items():
        at = F.array_position(c, v).cast("int")
        new[c] = F.when(at > 0, F.concat(F.slice(c, 1, at - 1), F.slice(c, at + 1, F.size(c)))).otherwise(F.col(c))
    for c, v in (add or {}).items():
        new[c] = F.array_append(new.get(c, F.col(c)), F.lit(v))
    return df.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def delete(df: DataFrame, condition: dict | None = None, key: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """What is left without the rows that fit; with keys (one column), without those rows."""
    out = df.where(~where(df, condition)) if condition else df
    return out.join(keys, key, "left_anti") if keys is not None else out


@query("chunk_update", """select doc_id, case when lang='fr' then 'edited' else source end source, case when lang='fr' then null else n_chars end n_chars, array_to_string(case when lang='fr' then ['fr', source, 'checked'] else [lang, lang, source] end, ',') tags from documents""")
def chunk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.array("lang", "lang", "source").alias("tags"))
    out = update(d, {"lang": "fr", "tags": ["fr"], "source": ""}, set={"source": "edited"}, remove={"tags": "fr"}, add={"tags": "checked"}, drop=("n_chars",))
    return out.select("doc_id", "source", "n_chars", F.array_join("tags", ",").alias("tags"))


@query("chunk_delete", """with k as (select doc_id, lang from documents where not (lang in ('de') and text is not null) and doc_id not in (select doc_id from labels where quality=0))
select doc_id, lang, (select count(*) from documents)-(select count(*) from k) deleted from k""")
def chunk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, and how many rows went."""
    d = table(spark, sf_dir, "documents")
    left = delete(d, {"lang": ["de"], "text": {"exists": True}}, "doc_id", table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")).select("doc_id", "lang")
    gone = d.agg(F.count("*").alias("n")).crossJoin(F.broadcast(left.agg(F.count("*").alias("m")))).select((F.col("n") - F.col("m")).alias("deleted"))
    return left.crossJoin(F.broadcast(gone))


@query("get_by_key", "select doc_id, source, 'documents' as origin from documents where doc_id=17 union all select conv_id, role, 'conversations' from conversations where conv_id=17")
def get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "source", F.lit("documents").alias("origin"))
    return a.unionByName(table(spark, sf_dir, "conversations").where("conv_id = 17").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("source"), F.lit("conversations").alias("origin")))


@query("batch_append", """with r as (select doc_id, text, [[doc_id%9, 1, 2, 3, 4], case when doc_id%6=0 then [1, 2] else [1, 2, 3, 4, 5] end] pos, case when doc_id%8=0 then null else string_split(source,'c') end kw from documents)
select doc_id, case when trim(coalesce(text,''))='' then 'blank' when kw is null then 'keywords' when doc_id%6=0 then 'positions' end reason, case when trim(coalesce(text,''))<>'' and kw is not null and doc_id%6<>0 then md5(text||doc_id::varchar||':'||(doc_id%100)) end id from r""")
def batch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row has a reason to be rejected (blank text, keywords that are no list, positions that are not five numbers) or an id of text, document and order."""
    five = F.when(F.col("doc_id") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5))))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 100).alias("order"), F.array(F.array((F.col("doc_id") % 9).cast("int"), *map(F.lit, (1, 2, 3, 4))), five).alias("positions"), F.when(F.col("doc_id") % 8 != 0, F.split("source", "c")).alias("keywords"))
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").when(F.col("keywords").isNull(), "keywords").when(~F.forall("positions", lambda p: F.size(p) == 5), "positions")
    return d.select("doc_id", reason.alias("reason"), F.when(reason.isNull(), F.md5(F.concat("text", F.col("doc_id").cast("string"), F.lit(":"), "order"))).alias("id"))


def as_markdown(df: DataFrame, key: str, order: str, columns: dict[str, str]) -> DataFrame:
    """(key, table): the rows of each key as a Markdown table with aliases for a header; blank rows go, times lose their zone part."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"(T00:00:00| 00:00:00)(\.\d+)?Z?$", ""), F.lit(""))
    line = F.concat(F.lit("|"), F.array_join(F.array(*map(cell, columns)), "|"), F.lit("|"))
    some = reduce(lambda a, b: a | b, [F.trim(cell(c)) != "" for c in columns])
    head = "|" + "|".join(columns.values()) + "|\n|" + "|".join("------" for _ in columns) + "|\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n")
    return df.where(some).groupBy(key).agg(F.concat(F.lit(head), rows).alias("table"))


@query("markdown_export", "select n_regionkey, '|Key|Name|'||chr(10)||'|------|------|'||chr(10)||string_agg('|'||n_nationkey::varchar||'|'||n_name||'|', chr(10) order by n_nationkey) as \"table\" from nation group by 1")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_markdown(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", {"n_nationkey": "Key", "n_name": "Name"})


@query("reuse_by_digest", """with t as (select o_orderkey, md5(o_custkey::varchar||o_orderpriority) digest, o_orderstatus from orders)
select o_orderkey, digest, digest in (select digest from t where o_orderstatus='F') reused from t where o_orderstatus<>'F'""")
def reuse_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose digest was done before are reused, the rest run."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat(F.col("o_custkey").cast("string"), "o_orderpriority")).alias("digest"), "o_orderstatus")
    done, todo = t.where("o_orderstatus = 'F'").select("digest").distinct(), t.where("o_orderstatus <> 'F'").select("o_orderkey", "digest")
    return todo.join(done, "digest", "left_semi").withColumn("reused", F.lit(True)).unionByName(todo.join(done, "digest", "left_anti").withColumn("reused", F.lit(False))).select("o_orderkey", "digest", "reused")


@query("multi_index_union", "select * from (select doc_id id, n_chars score, 'en' part from documents where lang='en' union all select doc_id, n_chars, 'fr' from documents where lang='fr') order by score desc, id limit 50")
def multi_index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x: table(spark, sf_dir, "documents").where(F.col("lang") == x).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.lit(x).alias("part"))
    return part("en").unionByName(part("fr")).orderBy(F.desc("score"), "id").limit(50)


@query("filter_intersection", "select doc_id from documents where lang='en' intersect select doc_id from labels where quality=1")
def filter_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("graph_change_set", """with a as (select l_partkey p, l_suppkey s, sum(l_quantity) w from lineitem where l_orderkey%2=0 group by 1,2), b as (select l_partkey p, l_suppkey s, sum(l_quantity) w from lineitem where l_orderkey%3=0 group by 1,2)
select coalesce(a.p,b.p) p, coalesce(a.s,b.s) s, case when a.p is null then 'added' when b.p is null then 'removed' else 'updated' end as change from a full join b on a.p=b.p and a.s=b.s where a.w is distinct from b.w""")
def graph_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lambda m, w: table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % m == 0).groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias(w))
    both = edges(2, "wa").join(edges(3, "wb"), ["p", "s"], "full_outer").where(~F.col("wa").eqNullSafe(F.col("wb")))
    return both.select("p", "s", F.when(F.col("wa").isNull(), "added").when(F.col("wb").isNull(), "removed").otherwise("updated").alias("change"))


@query("search_merge", "select doc_id, 1 origin from documents where lang='en' union all select doc_id, 2 from labels where doc_id not in (select doc_id from documents where lang='en')")
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("origin"))
    return a.unionByName(table(spark, sf_dir, "labels").join(a, "doc_id", "left_anti").select("doc_id", F.lit(2).alias("origin")))


@query("distinct_counts", "select lang, count(distinct source) sources, count(distinct md5(text)) texts from documents group by 1")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.md5("text")).alias("texts"))


@query("chunk_listing", "with recursive " + CHUNKS.lstrip() + " select doc_id, pos::int pos, length(content)::bigint size from (select *, row_number() over (partition by doc_id order by pos) r from chunks) where r<=1024")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return chunks(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 1024").select("doc_id", "pos", F.length("content").cast("long").alias("size"))


@query("child_to_parent", """with h as (select l_orderkey q, l_partkey child, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) rank from lineitem),
m as (select *, case when child%4=0 then null else child//10 end parent from h), r as (select *, row_number() over (partition by q, parent order by rank) k from m)
select q, rank::int rank, child, case when parent is not null and k=1 then 'parent'||parent else 'child'||child end as shown from r""")
def child_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent stands in for its first hit; later siblings and children without parent stay."""
    w = Window.partitionBy("q").orderBy(F.desc("l_extendedprice"), "child", "l_linenumber")
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("child"), "l_extendedprice", "l_linenumber").withColumn("rank", F.row_number().over(w))
    m = h.withColumn("parent", F.when(F.col("child") % 4 != 0, F.floor(F.col("child") / 10)))
    k = F.row_number().over(Window.partitionBy("q", "parent").orderBy("rank"))
    return m.withColumn("k", k).select("q", "rank", "child", F.when(F.col("parent").isNotNull() & (F.col("k") == 1), F.concat(F.lit("parent"), "parent")).otherwise(F.concat(F.lit("child"), "child")).alias("shown"))
