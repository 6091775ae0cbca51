"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if pd.isna(x) else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df.astype(object).itertuples(index=False))


def kinds(df):
    """What kind of values each column has: a number told as a text, or a flag told as a number, is a difference."""
    kind = lambda x: "flag" if isinstance(x, (bool, np.bool_)) else "number" if isinstance(x, (int, float, np.number)) else type(x).__name__
    return {c: {kind(x) for x in df[c] if not isinstance(x, (list, np.ndarray)) and not pd.isna(x)} for c in df.columns}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, duck, name):
    ours = catalogue.queries()[name](spark, DIR).toPandas()
    twin = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns)
    assert kinds(ours) == kinds(twin)
    assert rows(ours) == rows(twin)


def test_summary_tree_has_one_root_and_a_parent_for_every_node(spark):
    rows = catalogue.queries()["summary_tree"](spark, DIR).collect()
    nodes = {r["node"]: r["layer"] for r in rows}
    assert len(nodes) == len(rows) and sum(r["parent"] is None for r in rows) == 1
    assert all(nodes[r["parent"]] == r["layer"] + 1 for r in rows if r["parent"] is not None)


def test_node_vectors_cover_all_nodes(spark):
    found = catalogue.queries()["node_vectors"](spark, DIR)
    nodes = catalogue.queries()["communities"](spark, DIR)
    assert found.count() == nodes.count() and found.join(nodes, "node", "left_anti").count() == 0
