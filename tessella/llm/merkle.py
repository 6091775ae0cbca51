"""Merkle manifest of a table: every level is a self-join of nodes with their siblings' numbers.

A leaf is the digest of a row's columns. Leaves of a group stand in order; every `arity` neighbours (the last
run may be shorter, even of one) become the digest of their digests, until one node is left, the group's subroot.
The subroots, in order of their groups, become the root in the same way. A leaf's proof is what its runs' other
nodes hold, from its own level to the root; with it and a leaf alone the root can be computed again.

Defined results: a null column counts as `-`, an empty text as `0:`; null groups come first, null order keys
before all others; rows equal in group and order key stand by their digest, so repeated rows get leaves of their
own; a group of one row has that leaf as its subroot; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Node tables and group tables up to so many rows go to every task: a few hundred bytes each.
SMALL = 4096


def coded(value: Column) -> Column:
    """A value so that no two rows of values run together: its length in bytes, a colon, its text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of texts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def told(node: Column) -> Column:
    """Digests as they are fed on: lower-case hexadecimal text."""
    return F.lower(F.hex(node))


def numbered(rows: DataFrame, group: str, order: list, rows_per_part: int) -> DataFrame:
    """rows with `idx` (0, 1, 2 ... in `order` within the group) and `size` (rows of the group).

    Rows are dealt by ranges of group and order key and sorted within a range; a row's number is its place
    in the range and the rows of its group in the ranges before. So a group of any size is spread over many
    ranges, and only the counts of (group, range) are summed up in one place for each group.
    """
    parts = max(1, -(-rows.count() // rows_per_part))
    line = [F.col(group), *order]
    dealt = materialise(rows.repartitionByRange(parts, *line).sortWithinPartitions(*line).withColumn("_at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_range", F.shiftrightunsigned("_at", 33))
    mine = Window.partitionBy(group)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("size")), "counts")
    return dealt.join(_light(counts), [group, "_range"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _light(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, sent to every task if it has at most `most` short rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """nodes(group, idx, digest, ...) with `sibs`: the digests of the run's other nodes, from left to right.

    Each offset within the run is an equijoin of the nodes with themselves on the computed number; for runs
    of two that number is idx XOR 1. Keys are (group, idx), so no key has more than one row on either side.
    """
    slot = F.pmod(F.col("idx"), F.lit(arity))
    out, found = nodes, []
    for offset in range(1, arity):
        other = F.pmod(slot + offset, F.lit(arity))
        sought = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + other
        theirs = nodes.select(F.col("group"), F.col("idx").alias("_sought"), F.col("digest").alias(f"_d{offset}"))
        out = out.withColumn("_sought", sought).join(F.broadcast(theirs) if small else theirs, ["group", "_sought"], "left").drop("_sought")
        found.append(F.struct(other.alias("slot"), F.col(f"_d{offset}").alias("d")))
    here = F.transform(F.array_sort(F.filter(F.array(*found), lambda s: s.d.isNotNull())), lambda s: s.d)
    sibs = F.aggregate(here, F.lit(b""), lambda a, d: F.concat(a, d))
    return out.withColumn("sibs", sibs).drop(*(f"_d{o}" for o in range(1, arity)))


def grow(leaves: DataFrame, arity: int, rows: int, groups: int, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all groups' trees from the leaves on, and (group, digest) of their roots."""
    levels, nodes, width = [], leaves, largest
    while width > 1:
        small = rows // arity ** len(levels) + groups <= SMALL
        joined = siblings(nodes, arity, small)
        levels.append(materialise(joined.coalesce(1) if small else joined, f"level{len(levels)}"))
        first = levels[-1].where((F.col("size") > 1) & (F.pmod("idx", F.lit(arity)) == 0))
        step = lambda c: F.floor((F.col(c) + arity - 1) / arity) if c == "size" else F.floor(F.col(c) / arity)
        nodes = first.select("group", step("idx").alias("idx"), step("size").alias("size"), digest(told(F.col("digest")), told(F.col("sibs"))).alias("digest"))
        width = -(-width // arity)
    roots = nodes.where("size = 1").select("group", "digest")
    for level in levels:
        roots = roots.unionByName(level.where("size = 1").select("group", "digest"))
    return levels, materialise(roots, "roots")


def proofs(levels: list[DataFrame], leaves: DataFrame, arity: int, rows: int, groups: int) -> DataFrame:
    """leaves with `path`: what their runs' other nodes hold, level by level. From the top down, each node
    takes over its parent's path."""
    if not levels:
        return leaves.withColumn("path", F.lit(b""))
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if paths is None:
            paths = level.withColumn("path", F.col("sibs"))
        else:
            above = paths.select("group", F.col("idx").alias("_above"), F.col("path").alias("_path"))
            small = rows // arity ** (k + 1) + groups <= SMALL
            joined = level.withColumn("_above", F.floor(F.col("idx") / arity)).join(F.broadcast(above) if small else above, ["group", "_above"], "left")
            paths = joined.withColumn("path", F.concat("sibs", F.coalesce("_path", F.lit(b"")))).drop("_above", "_path")
        if k:
            kept = paths.select("group", "idx", "path")
            paths = materialise(kept.coalesce(1) if rows // arity**k + groups <= SMALL else kept, f"paths{k}")
    return paths.drop("sibs")


def fold(leaf: Column, path: Column, idx: Column, size: Column, arity: int, levels: int) -> Column:
    """The root that a leaf's digest and its path lead to; struct(digest, pos), pos bytes of the path being used."""

    def step(s: Column, _: Column) -> Column:
        slot = F.pmod(s.idx, F.lit(arity))
        others = F.least(F.lit(arity).cast("long"), s.size - (s.idx - slot)) - 1
        left, right = told(F.substring(path, s.pos + 1, (slot * 32).cast("int"))), told(F.substring(path, (s.pos + 1 + slot * 32).cast("int"), ((others - slot) * 32).cast("int")))
        up = F.struct(digest(left, told(s.digest), right).alias("digest"), (s.pos + others * 32).cast("int").alias("pos"), F.floor(s.idx / arity).alias("idx"), F.floor((s.size + arity - 1) / arity).alias("size"))
        return F.when(s.size > 1, up).otherwise(s)

    start = F.struct(leaf.alias("digest"), F.lit(0).alias("pos"), idx.cast("long").alias("idx"), size.cast("long").alias("size"))
    return F.aggregate(F.array(*map(F.lit, range(levels))), start, step) if levels else start


def _height(width: int, arity: int) -> int:
    n = 0
    while width > 1:
        width, n = -(-width // arity), n + 1
    return n


def manifest(table: DataFrame, columns: list[str], group: str, order: str, changed: dict[str, Column] | None = None, arity: int = 2, rows_per_part: int = 200_000) -> DataFrame:
    """One row for each row of the table: order column, leaf, subroot, root, proof_sha256, folded_root, verified.

    Texts are read once, for the leaf digests; all that follows moves digests of 32 bytes. `changed` gives
    other values of columns: folded_root is what the leaf of the changed row and the original siblings lead
    to, and verified says whether it is the root. Levels and paths halve (for runs of two) from one to the
    next, so all levels together hold about two nodes a row.
    """
    row = lambda values: digest(*(coded(values.get(c, F.col(c))) for c in columns))
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null groups first
    leaves = materialise(table.select(F.col(order).alias("key"), named.alias("group"), row({}).alias("digest"), row(changed or {}).alias("changed"), F.monotonically_increasing_id().alias("tie")), "leaves")
    leaves = materialise(numbered(leaves, "group", [F.asc_nulls_first("key"), F.col("digest"), F.col("tie")], rows_per_part).drop("tie"), "numbered")
    rows, largest = leaves.agg(F.count("*"), F.max("size")).first()
    groups = leaves.where("idx = 0").count()
    levels, subroots = grow(leaves, arity, rows, groups, largest or 0)
    top = materialise(numbered(subroots.withColumn("line", F.lit(0)), "line", [F.col("group")], rows_per_part).select(F.lit("").alias("group"), F.col("group").alias("name"), "idx", "size", "digest"), "top")
    upper, root = grow(top, arity, groups, 1, groups)
    over = proofs(upper, top, arity, groups, 1).select(F.col("name").alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("over"), F.col("idx").alias("gidx"), F.col("size").alias("gsize"))
    over = materialise(over.crossJoin(F.broadcast(root.select(F.col("digest").alias("root")))), "over")  # one root
    every = proofs(levels, leaves, arity, rows, groups).join(_light(over), "group")
    inner = fold(F.col("changed"), F.col("path"), F.col("idx"), F.col("size"), arity, _height(largest or 0, arity)).digest
    every = every.withColumn("inner", inner)
    outer = fold(F.col("inner"), F.col("over"), F.col("gidx"), F.col("gsize"), arity, _height(groups, arity)).digest
    every = every.withColumn("outer", outer)
    return every.select(
        F.col("key").alias(order), told(F.col("digest")).alias("leaf"), told(F.col("subroot")).alias("subroot"), told(F.col("root")).alias("root"),
        F.sha2(told(F.concat("path", "over")), 256).alias("proof_sha256"), told(F.col("outer")).alias("folded_root"), (F.col("outer") == F.col("root")).alias("verified"),
    )


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of `documents`; rows whose doc_id's CRC-32 is divisible by 7 are told with n_chars one larger."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), COLUMNS, "lang", "doc_id", changed)


def _leaf_sql(n_chars: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else f"d.{c}") for c in COLUMNS) + ")"


#: The CRC-32 is taken bit by bit over the digits of the number.
ORACLE_OP12 = f"""with recursive
crc as (select doc_id, d, 0 k, 4294967295::bigint c from (select distinct doc_id, doc_id::varchar d from documents where doc_id is not null)
  union all select doc_id, d, k+1, list_reduce(list_prepend(xor(c, ascii(d[k+1])::bigint), [0::bigint,0,0,0,0,0,0,0]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) from crc where k < length(d)),
hit as (select doc_id from crc where k = length(d) and xor(c, 4294967295) % 7 = 0),
leaves as materialized (select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by lang) size, leaf, changed
  from (select d.doc_id, d.lang, {_leaf_sql('d.n_chars')} leaf, {_leaf_sql('(d.n_chars + (h.doc_id is not null)::int)')} changed
    from documents d left join (select doc_id, 1 one from hit) h on h.doc_id = d.doc_id)),
tree as (select 0 level, lang, idx, size, leaf node from leaves
  union all select level+1, lang, idx//2, (size+1)//2, sha256(string_agg(node, '' order by idx)) from tree where size > 1 group by level, lang, idx//2, size),
subs as materialized (select lang, node, row_number() over (order by lang nulls first) - 1 idx, count(*) over () size from tree where size = 1),
top as (select 0 level, idx, size, node from subs
  union all select level+1, idx//2, (size+1)//2, sha256(string_agg(node, '' order by idx)) from top where size > 1 group by level, idx//2, size),
walk as (select doc_id, leaf, lang, idx start, 0 level, idx, changed node, '' path from leaves
  union all select w.doc_id, w.leaf, w.lang, w.start, w.level+1, w.idx//2, sha256(case when w.idx%2=1 then t.node||w.node else w.node||coalesce(t.node,'') end), w.path||coalesce(t.node,'')
    from walk w join tree u on u.lang is not distinct from w.lang and u.level = w.level and u.idx = w.idx and u.size > 1
    left join tree t on t.lang is not distinct from w.lang and t.level = w.level and t.idx = xor(w.idx, 1)),
done as materialized (select w.* from walk w join tree u on u.lang is not distinct from w.lang and u.level = w.level and u.idx = w.idx and u.size = 1),
rise as (select d.doc_id, d.leaf, s.node subroot, d.lang, d.start, 0 level, s.idx, d.node, d.path from done d join subs s on s.lang is not distinct from d.lang
  union all select w.doc_id, w.leaf, w.subroot, w.lang, w.start, w.level+1, w.idx//2, sha256(case when w.idx%2=1 then t.node||w.node else w.node||coalesce(t.node,'') end), w.path||coalesce(t.node,'')
    from rise w join top u on u.level = w.level and u.idx = w.idx and u.size > 1
    left join top t on t.level = w.level and t.idx = xor(w.idx, 1))
select r.doc_id, r.leaf, r.subroot, u.node root, sha256(r.path) proof_sha256, r.node folded_root, r.node = u.node verified
from rise r join top u on u.level = r.level and u.idx = r.idx and u.size = 1"""
