"""Every query of the engine against its SQL."""

import re

import pytest

from tests.harness import connection, differences
from tidelark.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    if name in ORACLE:
        assert not differences(got, duck.sql(ORACLE[name]).df())
    else:
        assert len(got)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked(spark):
    plan = physical(QUERIES["gate_sample_any"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all({c.split(":")[0] for c in s.split(",")} == {"event_id", "ts", "user_id", "value"} for s in schemas)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 49").groupBy("l_returnflag").count()
    assert "GreaterThan(l_quantity,49.0)" in physical(rows)


def test_hot_paths_stay_in_the_engine(spark):
    for name in ("gate_features", "state_machine_final", "time_domain_features", "tree_score", "threshold_sweep", "auc_per_feature", "ood_score", "sample_metrics"):
        assert not re.search("Python|Pandas|InArrow", physical(QUERIES[name](spark, SF))), name


def test_features_of_a_window_shuffle_by_sample_alone(spark):
    plan = physical(QUERIES["gate_features"](spark, SF))
    assert "SinglePartition" not in plan


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and len(ORACLE) > 75


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
