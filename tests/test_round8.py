"""gold_coverage without broadcasts of exploded rows; fields of short sheets by cheaper steps, with the same results."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from factloom.functions import lexemes as L
from factloom.operators import coverage, extract, metrics
from factloom.plans import fields
from factloom.plans.registry import Tables
from factloom.sources import shared

SF = "/root/testdata/sf0.001"


def test_exploded_rows_are_not_broadcast(spark, capsys):
    """Tables whose files are small stay with the executors, whatever comes out of their rows."""
    gold = spark.range(300).select(F.col("id").alias("case_id"), F.explode(F.array(F.lit("rate"), F.lit("fix"))).alias("field"), (F.col("id") % 5).cast("string").alias("value"))
    found = gold.select("case_id", F.lit("rate").alias("field"), F.concat("value", F.when(F.col("case_id") % 2 == 0, ".0").otherwise(" ﬁx")).alias("value"))
    d = coverage.covered(gold, found, {"rate": ("rate",), "fix": ("rate",)})
    d.explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
    assert metrics.same_values("3", "3.0") and metrics.same_values("3", "3 ﬁx")  # the latter meet without a common key
    assert d.where("covered").count() == d.count() == 600


def test_equal_pairs_are_compared_once(spark, monkeypatch):
    """Values come again and again; pairs with a NULL are NULL."""
    d = spark.range(0, 400, 1, 1).select(F.when(F.col("id") % 5 == 4, None).otherwise(F.lit('["a b"]')).alias("a"), F.when(F.col("id") % 2 == 0, '["A  b"]').otherwise('["c"]').alias("b"))
    got = [r["same"] for r in d.select(metrics.same_json_column(F.col("a"), F.col("b")).alias("same")).collect()]
    assert got == [None if i % 5 == 4 else i % 2 == 0 for i in range(400)]


def test_sheets_are_dealt_out_by_their_number(spark, monkeypatch):
    """However small the files of their orders are; and they are read where they lie, with no line shuffled and nothing broadcast."""
    monkeypatch.setattr(shared, "ROWS", 1000)
    asked = spark.read.parquet(f"{SF}/orders.parquet").count() * 13 // 1000
    assert asked > 4 and fields._sheets(Tables(spark, SF)).rdd.getNumPartitions() >= asked
    d = E.queries()["extract_fields"](spark, SF)
    assert d.rdd.getNumPartitions() >= asked
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and set(re.findall(r"(?<!Reused)Exchange ([^#]*)", plan)) == {"hashpartitioning(o_orderkey"}


def test_a_bound_value_is_not_typed_for_each_row(spark):
    """`let` gives what its body gives, NULL too, without an element of an array whose type would be worked out for each row."""
    d = spark.createDataFrame([(1,), (None,)], "x int").select(L.let(F.col("x"), lambda v: F.coalesce(v + 1, F.lit(-1))).alias("y"), L.let(F.struct("x"), lambda s: L.let(s["x"], lambda v: s["x"] + v)).alias("z"))
    assert sorted(map(tuple, d.collect()), key=str) == [(-1, None), (2, 2)]
    assert "transform" not in d._jdf.queryExecution().analyzed().toString()


def test_labels_that_go_on_in_the_next_text(spark):
    """Rules of the first text's head stand for the joined text, but for short heads and brackets that close later: as each pattern on each text."""
    parts = ["(a", "(a ", "12", "12.", "a", "Is", "IS", "Issue", "Aggregate", "(i) Aggregate", "ISI", "Maturity", "(iv", "Código", "1. P", "Put Option:", "Nothing", ""]
    nexts = [None, ") Issue Date: 1", "Nominal Amount: 5", "IN: XS1", "Date: 2", ". Maturity Date: 3", "ISIN", ") ISIN: x", "ut Option: 4"]
    d = spark.createDataFrame([(p, p + j + n if n is not None else None) for p in parts for n in nexts for j in (" ", "")], "p string, j string")
    rx = {n: extract.pattern(r) for n, r in extract.RULES.items()}
    entry = lambda n, t, k: F.struct(F.lit(n).alias("field"), F.lit(k).alias("which"), F.regexp_extract(t, rx[n], 1).alias("sep"), F.trim(F.regexp_extract(t, rx[n], 2)).alias("value"))
    want = F.array_compact(F.array(*(F.when(F.col("p").rlike(rx[n]), entry(n, "p", 0)).when(F.col("j").rlike(rx[n]), entry(n, "j", 1)) for n in rx)))
    n = 0
    for r in d.select("p", "j", F.coalesce(extract._labels([F.col("p"), F.col("j")], extract.RULES), F.array()).alias("x"), want.alias("want")).collect():
        assert sorted(map(tuple, r["x"])) == sorted(map(tuple, r["want"])), (r["p"], r["j"])
        n += len(r["x"])
    assert n > 40


def test_documents_without_observations(spark):
    """Each document has all its fields, MISSING where it says nothing of them, and what is said of others is left out."""
    blocks = spark.createDataFrame([(1, 0, 0, "Issue Date: 01/02/2020"), (1, 1, 0, "ISIN XS0000000001"), (3, 0, 0, "Issue Date: 01/02/2020")], "doc_id long, ix long, page long, text string")
    got = extract.extract_all(spark.createDataFrame([(1,), (2,), (1,)], "doc_id long"), blocks).collect()
    assert len(got) == 2 * len(extract.RULES) and {r["doc_id"] for r in got} == {1, 2}
    assert sorted((r["doc_id"], r["field"], r["values"]) for r in got if r["status"] != "MISSING") == [(1, "isin", ["XS0000000001"]), (1, "issue_date", ["2020-02-01"])]
    assert all(r["class"] is r["values"] is r["lexeme"] is r["blocks"] is r["own"] is None for r in got if r["status"] == "MISSING")


def test_observations_are_not_broadcast(spark, monkeypatch):
    """Fields by section: the small file of the orders doesn't bring what their sheets say to the driver."""
    ran = []
    monkeypatch.setattr(extract.layout, "inside", lambda s, *a, real=extract.layout.inside: ran.append(real(s, *a)) or ran[-1])
    E.queries()["extract_failures"](spark, SF)
    plan = ran[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
