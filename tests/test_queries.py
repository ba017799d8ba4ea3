"""Every registered query against its SQL at the smallest scale."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from doctriage.plans import oracle
from doctriage.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(oracle.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, SF)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path_in", "path_out", "top_class", "confidence"] and df.count() > 0


def test_one_row_group_is_many_tasks(spark):
    """The given files are one row group each; what is made of their rows is made by as many tasks as the session says."""
    from doctriage.plans import queries, render

    sf = "/root/testdata/sf0.001"
    for df in (render.render_tickets(spark, sf), render.render_invoices(spark, sf), queries.parse_dates(spark, sf), queries.best_names(spark, sf)):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_given_texts_are_dealt_over_all_cores(spark):
    """So are the given texts, each table by its whole key: one long conversation is no single task."""
    from doctriage.plans import queries, render

    sf, asked = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (render.documents(spark, sf), render.pages(spark, sf), render.turns(spark, sf)):
        assert df.rdd.getNumPartitions() == asked
    dealt = queries.all_texts(spark, sf).select("path").rdd.glom().map(len).collect()
    assert len(dealt) == 3 * asked and sum(n > 0 for n in dealt) > 2 * asked
