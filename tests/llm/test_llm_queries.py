import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from plexaform.llm import queries

NAMES = sorted(queries.R.queries)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = spark_rows(queries.R.queries[name](spark, SF))
    if name in queries.R.sql:
        assert got == duck_rows(duck, queries.R.sql[name])
    else:
        assert got[1], "no rows"


def test_registered():
    import __spark_entry__ as entry

    assert set(NAMES) <= set(entry.queries())
