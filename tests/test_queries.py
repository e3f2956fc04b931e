import pytest

from lodestone import queries as Q

from .oracle import compare


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_sql(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["archive_e2e", "archive_extract", "pack_toml", "pack_lines"])
def test_more_documents_than_an_archive_holds(spark, name):
    """200 documents in archives of 64: each is packed, and the results are those of the SQL."""
    compare(spark, name, lambda s, d: Q.QUERIES[name](s, d, most=64), Q.SQL[name], "/root/testdata/sf0.001")
