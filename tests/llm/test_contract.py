"""Queries of the subpackage against their SQL."""

import pytest

import check_oracle
from inkwell.llm.queries import ORACLE


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert check_oracle.compare(spark, check_oracle.connect(sf), name, sf) is None
