"""Catalogue analytics: listings, usage, permissions, teams, folders, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import sent
from ..scratch import materialise
from .base import table
from .registry import query


@query("daily_usage", """select date_trunc('day', ts)::timestamp as day, count(*) n, count(distinct user_id) users, round(sum(value),2) tokens, round(sum(value)/(sum(value/10)+0.1),4) speed,
 round(avg(event_id%5),4) rounds, sum(case when event_type='signup' then 1 else 0 end)::bigint thumbs from events where ts>=timestamp '2024-01-05' and ts<timestamp '2024-01-25' group by 1""")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25'")
    return e.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("tokens"),
        F.round(F.sum("value") / (F.sum(F.col("value") / 10) + 0.1), 4).alias("speed"), F.round(F.avg(F.col("event_id") % 5), 4).alias("rounds"), F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("thumbs"))


RUN = "case when o_orderkey%11=0 then null else o_orderstatus end"


def _tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumn("run", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))).withColumn("progress", F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0).otherwise(0.5))


@query("status_summary", f"""select o_custkey, sum(case when coalesce(run,'')='F' then 1 else 0 end)::bigint finished, sum(case when coalesce(run,'')='O' then 1 else 0 end)::bigint failed, sum(case when run is null or run='P' then 1 else 0 end)::bigint processing
 from (select *, {RUN} run from orders) group by 1""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    run = F.coalesce("run", F.lit(""))
    return _tasks(spark, sf_dir).groupBy("o_custkey").agg(n(run == "F").alias("finished"), n(run == "O").alias("failed"), n(run.isin("", "P")).alias("processing"))


@query("facets", f"select coalesce(o_orderpriority,'*') priority, coalesce(run,'*') run, count(*) n from (select o_orderpriority, coalesce({RUN},'none') run from orders where o_totalprice>100000) group by grouping sets ((o_orderpriority),(run))")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir).where("o_totalprice > 100000").select("o_orderpriority", F.coalesce("run", F.lit("none")).alias("run"))
    g = t.groupingSets([["o_orderpriority"], ["run"]], "o_orderpriority", "run").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), F.coalesce("run", F.lit("*")).alias("run"), "n")


@query("total_size", "select source, coalesce(sum(n_chars) filter (where lang='en'),0)::bigint size from documents group by 1")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).alias("size"))


@query("progress_rollup", """select o_custkey, round(avg(greatest(p,0)),4) progress, case when bool_and(p in (1,-1)) and bool_or(p=-1) then 'FAIL' when bool_and(p=1) then 'DONE' else 'RUNNING' end status, min(o_orderpriority) priority,
 string_agg(o_orderkey::varchar, ',' order by o_orderkey) messages from (select *, case o_orderstatus when 'F' then 1.0 when 'O' then -1.0 else 0.5 end p from orders) group by 1""")
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("progress")
    status = F.when(F.bool_and(p.isin(1.0, -1.0)) & F.bool_or(p == -1), "FAIL").when(F.bool_and(p == 1), "DONE").otherwise("RUNNING")
    return _tasks(spark, sf_dir).groupBy("o_custkey").agg(F.round(F.avg(F.greatest(p, F.lit(0.0))), 4).alias("progress"), status.alias("status"), F.min("o_orderpriority").alias("priority"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("messages"))


@query("counters", """with d as (select l_suppkey kb, l_partkey%10 doc, case l_returnflag when 'R' then -1 else 1 end n, case l_returnflag when 'R' then -l_quantity else l_quantity end q, case when l_linestatus='O' then 1 else 0 end live from lineitem)
select kb, doc, greatest(sum(n*live),0)::bigint n_chunks, greatest(sum(q*live),0)::bigint tokens from d group by 1,2""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after additions, removals (returns) and clearing (closed lines count no more); never below zero."""
    sign, live = F.when(F.col("l_returnflag") == "R", -1).otherwise(1), F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    total = lambda c: F.greatest(F.sum(sign * c * live), F.lit(0)).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("kb"), (F.col("l_partkey") % 10).alias("doc")).agg(total(F.lit(1)).alias("n_chunks"), total(F.col("l_quantity")).alias("tokens"))


_KIND = "case when regexp_matches(v,'^[+-]?[0-9]+$') then 'int' when regexp_matches(v,'^[+-]?[0-9]*\\.[0-9]+$') then 'float' when regexp_matches(v,'^[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'datetime' else 'text' end"


@query("column_types", f"""with u as (select 'p_size' c, p_size::varchar v from part union all select 'p_name', p_name from part union all select 'p_partkey', p_partkey::varchar from part union all select 'p_brand', p_brand from part),
k as (select c, {_KIND} kind, count(*) n from u group by 1,2) select c as "column", kind, n from (select *, row_number() over (partition by c order by n desc, kind) r from k) where r=1""")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that most values of a column fit."""
    cols = ["p_size", "p_name", "p_partkey", "p_brand"]
    u = table(spark, sf_dir, "part").select(*(F.col(c).cast("string").alias(c) for c in cols)).unpivot([], cols, "column", "v")
    kind = F.when(F.col("v").rlike(r"^[+-]?[0-9]+$"), "int").when(F.col("v").rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "float").when(F.col("v").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "datetime").otherwise("text")
    k = u.groupBy("column", kind.alias("kind")).agg(F.count("*").alias("n"))
    return k.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "kind"))).where("r = 1").drop("r")


@query("most_frequent_value", "select source, lang from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) r from documents group by 1,2) where r=1")
def most_frequent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))).where("r = 1").select("source", "lang")


@query("terms_aggregation", "select term, count(*) n from (select trim(unnest(string_split_regex(p_type||'###'||replace(p_name,' ',',')||', '||p_brand,'###|,'))) term from part) where term<>'' group by 1")
def terms_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a field that holds several, between ### or commas."""
    whole = F.concat("p_type", F.lit("###"), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(", "), "p_brand")
    return table(spark, sf_dir, "part").select(F.explode(F.split(whole, "###|,")).alias("term")).select(F.trim("term").alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


@query("doc_list", "with f as (select doc_id, source, n_chars from documents where lang in ('en','fr') and lower(source) like '%src1%') select *, (select count(*) from f) total from f order by n_chars desc, doc_id limit 30 offset 30")
def doc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of thirty of a filtered list, with the size of the whole list."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr") & F.lower("source").contains("src1")).select("doc_id", "source", "n_chars")
    return d.orderBy(F.desc("n_chars"), "doc_id").offset(30).limit(30).crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))


@query("session_list", "select conv_id, rows, last, total from (select *, count(*) over () total, row_number() over (order by last desc, conv_id) r from (select conv_id, count(*) rows, max(turn) last from conversations where conv_id in (select conv_id from conversations where contains(lower(text),'the') and role='user') group by 1 having max(turn) between 1 and 20)) where r between 11 and 30")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the conversations in which the user said a word, by their last turn within a range, with the total."""
    c = table(spark, sf_dir, "conversations")
    hit = c.where(F.lower("text").contains("the") & (F.col("role") == "user")).select("conv_id").distinct()
    s = c.join(hit, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("rows"), F.max("turn").alias("last")).where("last between 1 and 20")
    return s.orderBy(F.desc("last"), "conv_id").offset(10).limit(20).crossJoin(F.broadcast(s.agg(F.count("*").alias("total"))))


@query("meta_index", "select k as key, v as value, doc_id//1000 part, list_aggr(list_sort(list(doc_id)),'string_agg',',') docs from (select doc_id, 'lang' k, lang v from documents union all select doc_id, 'source', source from documents) where v is not null group by 1,2,3")
def meta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each metadata value, in parts of a thousand numbers, so no cell grows with the table."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "value")).where("value is not null")
    part = F.floor(F.col("doc_id") / 1000)
    return d.groupBy("key", "value", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))


def meta_condition(value, op: str, asked: str):
    """One of twelve comparisons; numbers compare as numbers if both sides are numbers, else as texts."""
    n, a = value.try_cast("double"), F.lit(asked).try_cast("double")
    both = n.isNotNull() & a.isNotNull()
    text = {"contains": value.contains(asked), "not contains": ~value.contains(asked), "start with": value.startswith(asked), "end with": value.endswith(asked), "empty": value.isNull() | (value == ""), "not empty": value.isNotNull() & (value != "")}
    if op in text:
        return text[op]
    pick = {"=": lambda x, y: x == y, "≠": lambda x, y: x != y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, "≥": lambda x, y: x >= y, "≤": lambda x, y: x <= y}[op]
    return F.when(both, pick(n, a)).otherwise(pick(value, F.lit(asked)))


def where_condition(df: DataFrame, condition: dict) -> DataFrame:
    """All of {column: value or list of values}; empty values are passed over, an array column fits if any element does."""
    tests = []
    for c, v in condition.items():
        if v is None or v == "" or v == []:
            continue
        values = v if isinstance(v, list) else [v]
        tests.append(F.arrays_overlap(c, F.array(*map(F.lit, values))) if df.schema[c].dataType.typeName() == "array" else F.col(c).isin(*values))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


@query("meta_filter", "select doc_id from documents where n_chars>500 and contains(source,'1') and lang<>'de' and starts_with(source,'src')")
def meta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("n_chars"), "source", "lang")
    tests = [("n_chars", ">", "500"), ("source", "contains", "1"), ("lang", "≠", "de"), ("source", "start with", "src")]
    return m.where(reduce(lambda a, b: a & b, [meta_condition(F.col(c), op, v) for c, op, v in tests])).select("doc_id")


_TWELVE = [("contains", "source", "1"), ("not contains", "source", "1"), ("start with", "source", "src1"), ("end with", "source", "1"), ("empty", "lang", ""), ("not empty", "lang", ""), ("=", "lang", "en"), ("≠", "lang", "en"), (">", "n_chars", "500"), ("<", "n_chars", "500"), ("≥", "n_chars", "abc"), ("≤", "source", "src15")]
_TWELVE_SQL = ["contains(source,'1')", "not contains(source,'1')", "starts_with(source,'src1')", "ends_with(source,'1')", "lang is null or lang=''", "lang is not null and lang<>''", "lang='en'", "lang<>'en'", "n_chars>500", "n_chars<500", "n_chars::varchar>='abc'", "source<='src15'"]


@query("meta_operators", " union all ".join(f"select '{op}' op, doc_id from documents where {sql}" for (op, _, _), sql in zip(_TWELVE, _TWELVE_SQL, strict=True)))
def meta_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the twelve comparisons lets through: numbers as numbers where both sides are, else as texts."""
    m = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("n_chars"), "source", "lang")
    passed = F.array(*(F.when(meta_condition(F.col(c), op, v), F.lit(op)) for op, c, v in _TWELVE))
    return m.select(F.explode(F.filter(passed, lambda x: x.isNotNull())).alias("op"), "doc_id")


@query("condition_filter", "select doc_id, lang, source from documents where lang in ('en','es') and source='src3'")
def condition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where_condition(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), {"lang": ["en", "es"], "source": "src3", "n_chars": None})


def route(df: DataFrame, rules: list[dict], default: str):
    """Column of routes: rules [{"to", "all" or "any": [(column, comparison, value)]}] in order, the first that holds decides."""
    out = None
    for r in rules:
        tests = [meta_condition(F.col(c).cast("string"), op, v) for c, op, v in r.get("all") or r["any"]]
        holds = reduce((lambda a, b: a & b) if "all" in r else (lambda a, b: a | b), tests)
        out = F.when(holds, r["to"]) if out is None else out.when(holds, r["to"])
    return F.lit(default) if out is None else out.otherwise(default)


@query("rule_routing", "select o_orderkey, case when o_totalprice>200000 and o_orderpriority like '1%' then 'urgent' when o_orderstatus='P' or o_totalprice<5000 then 'later' else 'default' end route from orders")
def rule_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first true rule of a list gives the route."""
    rules = [{"to": "urgent", "all": [("o_totalprice", ">", "200000"), ("o_orderpriority", "start with", "1")]}, {"to": "later", "any": [("o_orderstatus", "=", "P"), ("o_totalprice", "<", "5000")]}]
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", route(o, rules, "default").alias("route"))


@query("field_selection", "select doc_id::varchar id, source dataset, n_chars::varchar size from documents where lang is not null")
def field_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("dataset"), F.col("n_chars").cast("string").alias("size"))


@query("ownership_violations", "select l_suppkey, count(*) n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal>0) group by 1")
def ownership_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(own, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("n"))


LEVELS = "case c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 2 else 1 end"


def _grants(spark, sf_dir):
    """(user, resource, level, via): direct by segment, team by nation and region, owner where a supplier has the nation."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    level = F.when(F.col("c_mktsegment") == "BUILDING", 3).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1)
    direct = c.select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 20).alias("resource"), level.alias("level"), F.lit("direct").alias("via"))
    team = c.select(F.col("c_custkey").alias("user"), (F.col("c_nationkey") % 20).cast("long").alias("resource"), F.when(F.col("n_regionkey") == 0, 2).otherwise(1).alias("level"), F.lit("team").alias("via"))
    return direct.unionByName(team)


GRANTS = f"""g as (select c_custkey "user", c_custkey%20 resource, {LEVELS} as level, 'direct' via from customer union all
 select c_custkey, (c_nationkey%20)::bigint, case when n_regionkey=0 then 2 else 1 end, 'team' from customer join nation on c_nationkey=n_nationkey)"""


def effective(grants: DataFrame, resources: DataFrame, owners: DataFrame, admins: DataFrame) -> DataFrame:
    """(user, resource, level, via): the highest level of grants(user, resource, level, via), a null resource for all;
    an owner has 3 on what is theirs, and an administrator 4 on everything."""
    every = lambda df: df.crossJoin(F.broadcast(resources))  # noqa: E731  (resources: a catalogue table)
    wide = every(grants.where("resource is null").drop("resource")).select("user", "resource", "level", "via")
    own = owners.select("user", "resource", F.lit(3).alias("level"), F.lit("owner").alias("via"))
    boss = every(admins.select("user")).select("user", "resource", F.lit(4).alias("level"), F.lit("admin").alias("via"))
    all_ = grants.where("resource is not null").select("user", "resource", "level", "via").unionByName(wide).unionByName(own).unionByName(boss)
    return all_.groupBy("user", "resource").agg(F.max("level").alias("level"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


EFFECTIVE = "with " + GRANTS + """, w as (select "user", case when "user"%97=5 and via='team' then null else resource end resource, level, via from g), rs as (select unnest(range(0,20)) resource),
al as (select * from w where resource is not null union all select w."user", rs.resource, w.level, w.via from w, rs where w.resource is null union all select c_custkey, c_custkey%20, 3, 'owner' from customer where c_acctbal>9000 union all select c_custkey, rs.resource, 4, 'admin' from customer, rs where c_custkey%500=7),
ep as (select "user", resource, max(level)::int as level, string_agg(distinct via, ',' order by via) via from al group by 1,2)"""


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    g = _grants(spark, sf_dir).withColumn("resource", F.when((F.col("user") % 97 != 5) | (F.col("via") != "team"), F.col("resource")))
    return effective(g, spark.range(20).withColumnRenamed("id", "resource"), c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 20).alias("resource")), c.where("c_custkey % 500 = 7").select(F.col("c_custkey").alias("user")))


@query("effective_permissions", EFFECTIVE + " select * from ep")
def effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir)


@query("permission_diff", EFFECTIVE + """, a as (select "user"//2 pair, * from ep where "user"%2=0), b as (select "user"//2 pair, * from ep where "user"%2=1)
select coalesce(a.pair,b.pair) pair, coalesce(a.resource,b.resource) resource, coalesce(a.level,0)::int one, coalesce(b.level,0)::int two from a full join b on a.pair=b.pair and a.resource=b.resource""")
def permission_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who of two users has what: each user set beside the next one."""
    e = _effective(spark, sf_dir).withColumn("pair", F.floor(F.col("user") / 2))
    a, b = (e.where(f"user % 2 = {k}").select("pair", "resource", F.col("level").alias(n)) for k, n in ((0, "one"), (1, "two")))
    return a.join(b, ["pair", "resource"], "full_outer").select("pair", "resource", F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", F.lit(0)).alias("two"))


@query("grant_counts", "with " + GRANTS + """ select resource, count(distinct case when via='direct' then "user" end) users, count(distinct case when via='team' then "user" end) members from g where level>=2 group by 1""")
def grant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda via: F.countDistinct(F.when(F.col("via") == via, F.col("user")))
    return _grants(spark, sf_dir).where("level >= 2").groupBy("resource").agg(n("direct").alias("users"), n("team").alias("members"))


@query("grant_list", "with " + GRANTS + """ select distinct resource, via, case level when 3 then 'admin' when 2 then 'editor' else 'viewer' end as role from g""")
def grant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("level") == 3, "admin").when(F.col("level") == 2, "editor").otherwise("viewer")
    return _grants(spark, sf_dir).select("resource", "via", role.alias("role")).distinct()


@query("team_list", """select n_name team, r_name owner, (select count(*) from customer where c_nationkey=n_nationkey and c_acctbal>0) members from nation join region on n_regionkey=r_regionkey
 where exists (select 1 from supplier where s_nationkey=n_nationkey) and not exists (select 1 from customer where c_nationkey=n_nationkey and c_acctbal>9990)""")
def team_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    members = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(s.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi").join(c.where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti")
    return n.join(members, "n_nationkey", "left").select(F.col("n_name").alias("team"), F.col("r_name").alias("owner"), F.coalesce("members", F.lit(0)).alias("members"))


@query("preferred_group", "with p as (select c_nationkey, coalesce(max(case when c_mktsegment='BUILDING' then c_custkey end), max(c_custkey)) preferred from customer group by 1) select c_custkey, preferred, c.c_custkey=preferred mine from customer c join p using (c_nationkey)")
def preferred_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user with the group they start in."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = c.groupBy("c_nationkey").agg(F.coalesce(F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))), F.max("c_custkey")).alias("preferred"))
    return c.join(p, "c_nationkey").select("c_custkey", "preferred", (F.col("c_custkey") == F.col("preferred")).alias("mine"))


@query("role_flags", "select s_nationkey, count(case when s_acctbal>5000 then 1 end) super_admins, count(case when s_acctbal between 0 and 5000 then 1 end) admins from supplier group by 1")
def role_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.when(F.col("s_acctbal") > 5000, 1)).alias("super_admins"), F.count(F.when(F.col("s_acctbal").between(0, 5000), 1)).alias("admins"))


@query("folder_rollup", """with recursive t as (select 'r'||r_regionkey id, 'root' parent, 0.0::double size from region union all select 'n'||n_nationkey, 'r'||n_regionkey, 0.0::double from nation union all select 'c'||c_custkey, 'n'||c_nationkey, c_acctbal from customer),
up as (select id, id root, size from t union all select up.id, t.parent, up.size from up join t on t.id=up.root) select root folder, round(sum(size),2) size, count(*) files from up where root not like 'c%' group by 1""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of everything below each folder, itself included: contents are folded into their folder, then folder by folder upwards."""
    none = F.lit(0.0)
    node = lambda name, ident, parent, size: table(spark, sf_dir, name).select(F.concat(*ident).alias("id"), F.concat(*parent).alias("parent"), size.alias("size"))
    tree = node("region", (F.lit("r"), "r_regionkey"), (F.lit("root"),), none).unionByName(node("nation", (F.lit("n"), "n_nationkey"), (F.lit("r"), "n_regionkey"), none))
    tree = tree.unionByName(node("customer", (F.lit("c"), "c_custkey"), (F.lit("n"), "c_nationkey"), F.col("c_acctbal")))
    return rolled_up(tree).where("not folder like 'c%'").select("folder", F.round("size", 2).alias("size"), "files")


def rolled_up(tree: DataFrame, most: int = 1000) -> DataFrame:
    """(folder, size, files) of tree(id, parent, size): sums over everything below a folder, itself included.

    Each round folds the sums by parent before they go one folder up, so a round has a row for each folder of its
    height and not one for each file and folder above it.
    """
    fold = lambda df: df.groupBy(F.col("parent").alias("folder")).agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    levels = [tree.select(F.col("id").alias("folder"), "size", F.lit(1).cast("long").alias("files"))]
    above = materialise(fold(tree.withColumn("files", F.lit(1))), "folders")
    parents = tree.select(F.col("id").alias("folder"), "parent")
    while above.limit(1).count():
        if len(levels) > most:
            raise ValueError(f"folders lie more than {most} deep, or within themselves")
        levels.append(above)
        above = materialise(fold(sent(above).join(parents, "folder")), "folders")
    return reduce(DataFrame.unionByName, levels).groupBy("folder").agg(F.sum("size").alias("size"), F.sum("files").alias("files"))


@query("latest_task", "select c_custkey, c_name, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) r from orders) o right join customer on o_custkey=c_custkey and r=1")
def latest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus")).alias("t"))
    c = table(spark, sf_dir, "customer")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", "c_name", "t.*")


@query("token_usage", "select user_id, event_type model, round(sum(value),2) tokens, count(*) calls from events group by 1,2")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(F.round(F.sum("value"), 2).alias("tokens"), F.count("*").alias("calls"))


@query("task_context", "select distinct o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey where o_orderstatus='P'")
def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name").distinct()


@query("ongoing_tasks", "select distinct c_custkey, o_orderpriority from customer left join orders on o_custkey=c_custkey and o_orderstatus='P'")
def ongoing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderpriority").distinct()
