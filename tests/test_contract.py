"""Driver contract: stable entry schema, documented queries, twins have queries."""

import __spark_entry__ as E


def test_entry_schema_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema and a.count() == b.count() > 0


def test_every_query_documented():
    assert set(E.oracle_sql()) <= set(E.queries())
    missing = [k for k, query in E.queries().items() if not (query.__doc__ or "").strip()]
    assert not missing, missing
