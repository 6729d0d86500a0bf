import pytest

from fidelis.llm.queries import ORACLE_SQL, QUERIES
from parity import connect, duck_rows, kinds, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_the_sqls(spark, name):
    duck = connect(SF)
    df = QUERIES[name](spark, SF)
    assert spark_rows(df) == duck_rows(duck, ORACLE_SQL[name]) and not kinds(df, duck, ORACLE_SQL[name])
