import pytest
from oracle import differences

from gleaner.plans import oracle, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_matches_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], oracle.SQL[name], SF) == ""
