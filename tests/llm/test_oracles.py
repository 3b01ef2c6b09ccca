import pytest

from domscope.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], DATA)
