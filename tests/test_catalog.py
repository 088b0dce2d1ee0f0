import os

import pytest
from compare import assert_same

from larkspur import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)
