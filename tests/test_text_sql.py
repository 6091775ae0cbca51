"""Statements with text predicates: what they become, what they answer, what is refused."""

import pytest

from tessella.operators import text_sql


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "a", "red green blue"), (2, "a", "red"), (3, "b", "black white"), (4, "b", "it's 'content_words = red'"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, kb_id string, content string")
    from pyspark.sql import functions as F

    from tessella.functions import text as tx

    return df.withColumn("content_words", tx.tokenize(F.col("content")))


@pytest.mark.parametrize(
    "statement,want",
    [
        ("select content from chunks where content_words like '%red sky at night%'", {(1, "red green blue"), (2, "red"), (4, "it's 'content_words = red'")}),
        ("select doc_id, kb_id from chunks where content_words = 'white' or kb_id = 'content_words = ''red'''", {(3, "b")}),
        ("select count(*) n from chunks where content_words not like 'red'", {(2,)}),
        ("SELECT kb_id, count(*) n FROM chunks c WHERE c.content_words LIKE 'red green blue black' GROUP BY kb_id;", {("a", 2), ("b", 2)}),
        ("select doc_id from chunks where content_words like '%'", set()),
        ("with x as (select * from chunks where content_words = 'blue') select content from x", {("red green blue",)}),
        ("select distinct kb_id from chunks where content_words != 'red'", {("b",), (None,)}),
    ],
)
def test_answers(chunks, statement, want):
    assert set(map(tuple, text_sql.answer(chunks, statement).collect())) == want


def test_data_sets_that_may_not_be_seen(chunks):
    said = "select count(*) n from chunks where content_words like 'red'"
    assert text_sql.answer(chunks, said, datasets=("b",)).first()["n"] == 1
    assert text_sql.answer(chunks, "with y as (select kb_id from chunks) select kb_id from y", datasets=("a",)).distinct().collect()[0]["kb_id"] == "a"


def test_thirty_per_cent_of_the_words(spark):
    text = " ".join(f"w{k}" for k in range(10))
    assert ">= 3," in text_sql.rewritten(spark, f"select 1 from chunks where content_words = '{text}'", ("content_words",))


@pytest.mark.parametrize(
    "statement",
    ["delete from chunks", "drop table chunks", "insert into chunks values (1)", "select * from other", "select * from chunks, parquet.`/etc`", "select * from range(5)", "selec * from chunks", "select * from chunks where doc_id in (select id from secrets)", "with chunks as (select 1) select * from chunks", "select 1; select 2", "select java_method('java.lang.System', 'exit') from chunks", ""],
)
def test_refused(chunks, statement):
    with pytest.raises(text_sql.Refused):
        text_sql.answer(chunks, statement)
