import pytest

from lodestone.llm.queries import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name], "/root/testdata/sf0.01")
