import pytest
from compare import in_name_order, sql_rows

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = in_name_order(df.columns, df.collect())
    assert got[1], "no rows"
    if name in ORACLE:
        wanted = in_name_order(*sql_rows(SF, ORACLE[name]))
        assert got[0] == wanted[0]
        assert len(got[1]) == len(wanted[1])
        assert got[1] == wanted[1]


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
