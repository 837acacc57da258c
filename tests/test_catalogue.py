import pytest

from quillon.plans import catalogue

from .oracle import rows_of, sql_rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    assert rows_of(QUERIES[name](spark, folder)) == sql_rows(folder, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0
    assert {"username", "status", "likelihood"} <= set(out.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_triggers_are_found_once(spark, folder):
    """The optimised plan holds each of the lexicon's patterns once."""
    plan = QUERIES["top5_triggers"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    once = QUERIES["rule_verdict"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == once.count("regexp_extract(")
