"""What the plans must look like whatever the data."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallybook.plans.skew import one_per_key

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LAZY = [q for q in sorted(contract.queries()) if not q.startswith("stream_")]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join_and_no_python_rows(no_broadcast, name):
    text = plan(contract.queries()[name](no_broadcast, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize(
    "name,columns,pushed",
    [
        ("monthly_revenue", {"l_extendedprice", "l_shipdate"}, "GreaterThanOrEqual(l_shipdate"),
        ("collections_today", {"l_extendedprice", "l_shipdate"}, "GreaterThanOrEqual(l_shipdate"),
        ("payment_method_mix", {"l_returnflag"}, None),
        ("activity_stats", {"user_id", "ts"}, None),
        ("logs_today", {"event_id", "user_id", "event_type", "ts"}, "LessThan(ts"),
        ("payment_status_breakdown_admin", {"l_orderkey", "l_extendedprice"}, None),
        ("retained_logs_deleted_count", {"ts"}, "LessThan(ts"),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns, pushed):
    text = plan(contract.queries()[name](spark, SF_DIR))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    read = [{re.sub(r"#\d+L?", "", c) for c in s.split(",")} for s in scans]
    assert columns in read
    assert pushed is None or pushed in text


def test_one_per_key_lets_a_hot_key_be_split(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
        rows = spark.range(0, 2000000, 1, 8).select(k.alias("k"), F.col("id").alias("v"), F.rand(1).alias("x"))
        sums = rows.groupBy(F.col("k").alias("k2")).agg(F.sum("v").alias("s"))
        out = rows.join(one_per_key(sums, "k2"), F.col("k") == F.col("k2")).agg(F.sum("x"), F.sum("s"))
        out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_changes_are_reduced_without_window_or_sort(no_broadcast):
    """OP-44: the changes of a key merge by partial aggregation; nothing orders or windows them."""
    for name in ("upsert_courses", "upsert_courses_report"):
        text = plan(contract.queries()[name](no_broadcast, SF_DIR))
        assert "Window" not in text and not re.search(r"\bSort \[", text), name
        assert "HashAggregate" in text
