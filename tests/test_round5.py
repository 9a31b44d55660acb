"""Tasks whose number grows with the table, joins on keys that are often NULL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from factloom.operators import layout, link
from factloom.plans import extraction
from factloom.plans.registry import Tables
from factloom.sources import shared

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few(monkeypatch):
    """Tasks of 100 rows: small tables are dealt out as large ones are."""
    monkeypatch.setattr(shared, "ROWS", 100)


def parts(spark, query):
    return E.queries()[query](spark, SF).rdd.getNumPartitions()


def test_relations_of_documents_grow_by_tasks(spark, few):
    assert parts(spark, "ir_relations_all") >= spark.read.parquet(f"{SF}/orders.parquet").count() * 11 // 100

def test_boxes_meet_in_tasks_that_grow_with_them(spark, few):
    part = spark.read.parquet(f"{SF}/part.parquet")
    boxes = extraction._boxes(Tables(spark, SF))
    met = layout._met(boxes, boxes, ["page", "l"], shared.tasks(part, 6))
    assert met.rdd.getNumPartitions() == part.count() * 6 // 100

def test_units_of_cases_grow_by_tasks(spark, few):
    assert parts(spark, "truth_case_issues") >= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100


def test_pairs_without_a_key_are_dealt_out(spark):
    none = lambda kind: f"cast(if(id < 0, '', null) as {kind})"  # noqa: E731  # not a literal, for which there would be no join
    pairs = spark.range(1000).selectExpr("id", f"{none('date')} as src_date", f"{none('string')} as src_isin", f"{none('string')} as cand_register", "'base' as cand_version")
    known = spark.createDataFrame([("r", ".1", "A", "x", 1), (None, ".1", "A", "x", 2)], "register string, suffix string, role string, issuer string, ordinal int").selectExpr("*", "date '2020-01-01' as date")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = link.with_knowledge(pairs, known, spark.createDataFrame([(None,), ("i",)], "isin string"))
        rows = d.withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 1000 and not any(r["cand_known"] or r["isin_siblings"] or r["earlier_supplements"] for r in rows)
    assert max(Counter(r["at"] for r in rows).values()) < 500


def test_lists_are_compared_in_many_tasks(spark, few):
    assert parts(spark, "value_equal_multiset") >= int(spark.conf.get("spark.sql.shuffle.partitions"))
