import pytest

from lakeloom.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, pushed, schema", [("p3_ground_term", "EqualTo(p_size,10)", "p_partkey"), ("p6_constraint", "EqualTo(c_mktsegment,BUILDING)", "c_custkey"), ("p4_compare_gt", "GreaterThan(l_quantity,40.0)", "l_orderkey")])
def test_filters_and_columns_reach_the_scan(spark, name, pushed, schema):
    text = plan(spark, name)
    assert pushed in text and "p_retailprice" not in text and "c_acctbal" not in text and "l_tax" not in text and schema in text


def test_no_python_and_no_cross_join_where_none_is_asked_for(spark):
    for name in ("j3_join4", "a2_sum", "t4_facts_bitemporal", "f4_fact_id", "i1_i2_dedup", "j12_j13_drift", "f12_search_boolean", "w3_m13_retention"):
        text = plan(spark, name)
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
