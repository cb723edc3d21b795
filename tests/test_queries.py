"""Every registered query runs; those with a DuckDB twin give its rows."""

import pytest
from oracle_check import compare, connect
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry
from scorelens import oracle, queries
from scorelens.oracle import STOP_WORDS

QUERIES, TWINS = queries.ALL, oracle.ALL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_stop_words_are_those_of_spark(spark):
    assert StopWordsRemover.loadDefaultStopWords("english") == STOP_WORDS


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, sf, con, name):
    assert compare(QUERIES[name], TWINS[name], spark, con, sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_registers_them():
    assert QUERIES.items() <= entry.queries().items() and TWINS.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
