import os

import pytest

import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(e.SMOKE_DIR), reason="no test tables")
def test_entry(spark):
    assert e.entry(spark).count() == 10
