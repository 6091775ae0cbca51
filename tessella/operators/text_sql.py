"""A user's SQL over the chunk table, with predicates on token columns that mean a full-text match.

`content_words like '%some text%'` or `content_words = 'some text'` holds for chunks with at least 30 % of the text's
words. The statement sees only the asked data sets, and rows that are not groups carry the document's columns. Spark's
own parser decides what the statement is; here only text predicates are found and put into other words.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Share of the words that a chunk must hold (fixed value).
LEAST = 0.3
LITERAL = r"'(?:[^'\\]|\\.|'')*'"


class Refused(ValueError):
    """The statement is no query over the chunk table alone."""


def words_of(spark: SparkSession, texts: list[str]) -> list[list[str]]:
    """The words of texts, as chunks are cut into words."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.array_distinct(tx.tokenize(F.col("t"))).alias("w")).collect()
    return [r["w"] for r in sorted(rows, key=lambda r: r["k"])]


def rewritten(spark: SparkSession, statement: str, columns: tuple[str, ...], least: float = LEAST) -> str:
    """The statement with its text predicates as array expressions; texts within other literals stay."""
    names = "|".join(map(re.escape, columns))
    pattern = re.compile(rf"(?is)(?<![\w.`])(?P<column>(?:\w+\.)?`?(?:{names})`?)\s*(?P<no>\bnot\s+)?(?P<sign>\blike\b|!=|<>|=)\s*(?P<text>{LITERAL})|{LITERAL}")
    asked = [m for m in pattern.finditer(statement) if m["column"]]
    plain = [re.sub(r"[%_\\]", " ", m["text"][1:-1].replace("''", "'")) for m in asked]
    words = iter(words_of(spark, plain) if plain else [])

    def put(m: re.Match) -> str:
        if not m["column"]:
            return m[0]
        own = next(words)
        listed = "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in own) + ")"
        many = max(1, int(least * len(own)))
        test = f"coalesce(size(array_intersect({m['column']}, {listed})) >= {many}, false)" if own else "1 = 0"
        return f"(not {test})" if m["no"] or m["sign"] in ("!=", "<>") else f"({test})"

    return pattern.sub(put, statement)


def checked(spark: SparkSession, statement: str, name: str) -> str:
    """The statement without fences and a last semicolon, if it is one query that reads the chunk table only."""
    text = re.sub(r"(?is)^\s*```(?:sql)?|```\s*$", " ", statement).strip().rstrip(";").strip()
    if not re.match(r"(?is)(select|with)\b", text):
        raise Refused("only select statements are answered")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    except Exception as e:
        raise Refused(f"no SQL: {str(e).splitlines()[0]}") from e
    own = {n.lower() for n in re.findall(r"(?is)(?:\bwith|,)\s*(\w+)\s+as\s*\(", re.sub(LITERAL, "''", text))}
    read = {r.lower() for r in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)}
    if read - own - {name} or "UnresolvedTableValuedFunction" in plan or name in own:
        raise Refused(f"only the table {name} can be read")
    if re.search(r"(?i)\b(java_method|reflect|input_file_name)\s*\(", re.sub(LITERAL, "''", text)):
        raise Refused("the function is not allowed")
    return text


def answer(chunks: DataFrame, statement: str, columns: tuple[str, ...] = ("content_words",), datasets: tuple = (), dataset: str = "kb_id", idents: tuple[str, ...] = ("doc_id",), name: str = "chunks") -> DataFrame:
    """The statement's rows. datasets: values of the data set column that may be seen (none: all); idents are added to
    statements whose rows are chunks, where they are not selected anyway."""
    spark = chunks.sparkSession
    text = rewritten(spark, checked(spark, statement, name), columns)
    seen = chunks.where(F.col(dataset).isin(*datasets)) if datasets else chunks
    view = f"v_{uuid.uuid4().hex}"
    seen.createTempView(view)
    head = f"with {name} as (select * from {view})"

    def run(body: str) -> DataFrame:
        rest = re.match(r"(?is)with\b(.*)", body)
        return spark.sql(f"{head}, {rest[1]}" if rest else f"{head} {body}")

    try:
        out = run(text)
        plan = out._jdf.queryExecution().analyzed().toString()
        grouped = re.search(r"(?m)^[\s:+|-]*(Aggregate|Distinct|Union|Join|Intersect|Except)\b", plan)
        missing = [c for c in idents if c not in out.columns]
        if missing and not grouped and re.match(r"(?is)select\b", text):
            out = run(re.sub(r"(?is)^select\b", "select " + ", ".join(missing) + ",", text, count=1))
        return out
    except ParseException as e:
        raise Refused(str(e).splitlines()[0]) from e
    finally:
        spark.catalog.dropTempView(view)
