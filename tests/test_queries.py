"""Every core query on the smallest tables: against its SQL, or that it gives rows."""

import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from plexaform.plans import catalogue

QUERIES = {n: (f, r.sql.get(n)) for r in catalogue.registries() for n, f in r.queries.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    fn, sql = QUERIES[name]
    got = spark_rows(fn(spark, SF))
    if sql is None:
        assert got[1], "no rows"
    else:
        assert got == duck_rows(duck, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
