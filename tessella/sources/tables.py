"""Readers: documents by suffix, JSON lines, delimited files with rejects, database queries, mail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def suffix(name: Column) -> Column:
    """Lower-cased end of a file name behind its last dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def route(kind: Column) -> Column:
    """Which chunker takes a document of this suffix."""
    out = F.when(kind.isin("htm", "html", ""), "html")
    for name, kinds in {"markdown": ("md", "markdown", "mdx"), "table": ("csv", "tsv", "xls", "xlsx"), "json": ("json", "jsonl"), "text": ("txt", "py", "js", "java", "c", "cpp", "h", "php", "go", "ts", "sh", "cs", "kt", "sql")}.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("other")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, suffix, route, text) of whole text files below a path of any store Spark reads."""
    d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("name"), F.col("value").alias("text"))
    return d.withColumn("suffix", suffix(F.col("name"))).withColumn("route", route(F.col("suffix")))


def json_rows(texts: DataFrame, key: str, text: str, share: float = 0.8, looked_at: int = 10) -> DataFrame:
    """(key, pos, row): the objects of JSON and JSON-lines texts, as variants.

    A text that is no JSON as a whole counts as JSON lines if `share` of its first lines parse; its bad lines
    are skipped.
    """
    parsed = lambda x: F.try_parse_json(x)
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    d = texts.select(key, F.col(text).alias("t"), lines.alias("lines"))
    head = F.slice("lines", 1, looked_at)
    good = F.size(F.filter(head, lambda x: parsed(x).isNotNull())) >= share * F.size(head)
    # A parser may stop behind the first of several objects, so a text whose first line is an object by itself is lines.
    single = parsed(F.col("t")).isNotNull() & ((F.size("lines") == 1) | parsed(F.get("lines", F.lit(0))).isNull())
    rows = F.when(single, F.array("t")).when((F.size(head) > 0) & good, F.filter("lines", lambda x: parsed(x).isNotNull()))
    return d.select(key, F.posexplode(rows).alias("pos", "r")).select(key, "pos", parsed(F.col("r")).alias("row"))


def read_delimited(spark: SparkSession, path: str, separator: str = ",", first: int = 0, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files with a header line. rejects: (file, line, text) of lines whose field count differs.

    Columns named id, _id, index or idx are left out; a name that occurs twice is an error. Lines are counted in
    each file, so a file is one row until it is split (2 GB at most); `first` and `last` cut out a range of them,
    the header not counted.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "text"))
    raw = raw.withColumn("cells", F.split("text", f"\\Q{separator}\\E", -1))
    header = [c.strip() for c in raw.where("line = 0").select("cells").first()["cells"]]
    if len(set(header)) < len(header):
        raise ValueError(f"a column name occurs twice: {header}")
    body = raw.where((F.col("line") > first) & (F.lit(True) if last is None else F.col("line") <= last))
    fits = F.size("cells") == len(header)
    keep = [(k, c) for k, c in enumerate(header) if c.lower() not in ("id", "_id", "index", "idx")]
    return body.where(fits).select("file", "line", *(F.get("cells", F.lit(k)).alias(c) for k, c in keep)), body.where(~fits).select("file", "line", "text")


def read_database(spark: SparkSession, url: str, sql: str, most: int = 1024, **options: str) -> DataFrame:
    """At most `most` rows of a query on another database: decimals as doubles, dates as yyyy-MM-dd text."""
    df = spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load().limit(most)
    kind = lambda f: F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.date_format(f.name, "yyyy-MM-dd") if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(f.name)
    return df.select(*(kind(f).alias(f.name) for f in df.schema.fields))


def mail_sections(mail: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, text) of decoded mail (key, headers map, parts array<struct<type, text>>): one section of the
    headers in order of name, then one for each text part, markup taken out of HTML parts; other parts are left out."""
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    body = F.transform(F.filter("parts", lambda p: p["type"].startswith("text/")), lambda p: F.struct(p["type"].alias("kind"), F.when(p["type"] == "text/html", plain(p["text"])).otherwise(p["text"]).alias("text")))
    every = F.concat(F.array(F.struct(F.lit("headers").alias("kind"), headers.alias("text"))), body)
    return mail.select(key, F.posexplode(F.filter(every, lambda s: s["text"] != "")).alias("pos", "s")).select(key, "pos", "s.kind", "s.text")


def question_pairs(lines: DataFrame, key: str, delimiter: str = "\t") -> DataFrame:
    """(key, qid, question, answer): lines of two fields are pairs, other lines continue the answer."""
    start = F.size(F.split("text", f"\\Q{delimiter}\\E")) == 2
    d = lines.withColumn("start", start).withColumn("qid", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))).where("qid > 0")
    part = F.split("text", f"\\Q{delimiter}\\E")
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("start"), part[1]).otherwise(F.col("text")).alias("a")))), lambda x: x["a"]), "\n")
    return d.groupBy(key, "qid").agg(F.max(F.when(F.col("start"), part[0])).alias("question"), answer.alias("answer"))
