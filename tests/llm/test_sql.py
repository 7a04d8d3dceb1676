import pytest
from oracle import compare

from loamworks.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE[name])


def test_names():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
