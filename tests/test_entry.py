import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "question_id" in df.columns
