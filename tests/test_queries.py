"""Every query against its SQL, and the shape of the entry point."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# The optional training-data queries have tests of their own.
own = lambda found: {k: v for k, v in found.items() if not re.match(r"op\d+_|pipeline$", k)}
QUERIES, ORACLES = own(entry_point.queries()), own(entry_point.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def bag(frame):
    columns = sorted(frame.columns)
    blank = lambda v: "∅" if v is None or v != v else str(v)
    return columns, sorted(tuple(map(blank, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = bag(QUERIES[name](spark, sf_dir).toPandas()), bag(duck.execute(ORACLES[name]).df())
    assert got == want
    assert got[1] or name in ("articles_by_tag",)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark, sf_dir):
    cards = entry_point.entry(spark)
    assert cards.columns == ["question_id", "group_no", "pos", "title", "source", "date", "snippet", "url", "tags"]
    assert cards.count() == 40 * 8
