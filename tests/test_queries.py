"""Each query against its SQL on the smallest tables."""

import pytest

import loomspan.plans.queries as plans
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    if name in plans.SQL:
        assert compare(spark, con, name, plans.QUERIES[name], plans.SQL[name], SF) == ""
    else:
        assert len(plans.QUERIES[name](spark, SF).columns) > 0
        plans.QUERIES[name](spark, SF).count()


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_top_k_is_a_heap_and_reads_two_columns(spark, capsys):
    plans.QUERIES["vector_topk"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "label" not in plan
