"""Every registered query of the engine against its SQL in an independent engine."""

import pytest

from strandline.plans import queries as registry
from tests.conftest import SMALL, oracle, rows_of

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(oracle(SQL[name]))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
