"""Literal cases of field extraction: labels in text, in tables and on a page, guards, and what is settled."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract as E
from factloom.operators import layout, metrics

SHEET = """(i) Specified Currency: U.S. dollars
Aggregate Nominal
Amount: 1,500,000 EUR
Rate of Interest: 2.5 per cent
Rate of Interest: 3.5%
Maturity Date:
05/08/2036
Issue Date: 01/02/2020 · Fecha de emisión: 03/02/2020
Day Count Fraction: ACT/ACT ICMA
ISIN: XS0000000123
Business Day Convention: Modified Following Business Day Convention
Status of the Notes: Senior Preferred
Call Option: Not applicable
Barrier: See Condition 5
Underlying: is the index
Participation Rate: [●]"""
TABLE = [["Strike Price", "", "120%"], ["Cap Rate"], ["Series A", "5%"], ["Spread", "1"], ["Spread", "2"], ["Spread", "3"]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, SHEET), (2, "nothing"), (3, None), (4, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def got(spark, docs):
    rows = spark.createDataFrame([(1, 0, i, r) for i, r in enumerate(TABLE)], "doc_id long, table int, row int, cells array<string>")
    blocks = layout.line_blocks(docs).withColumnRenamed("block", "text")
    return {(r["doc_id"], r["field"]): (r["status"], r["class"], r["values"]) for r in E.extract_all(docs, blocks, rows).collect()}


@pytest.mark.parametrize(("field", "want"), [
    ("currency", ("DERIVED", "anchored", ["USD"])), ("issued_amount", ("DERIVED", "anchored", ["1500000|EUR"])), ("coupon_rate", ("OBSERVED", "multi_aspect", ["2.5", "3.5"])), ("maturity", ("DERIVED", "anchored", ["2036-08-05"])),
    ("issue_date", ("CONFLICT", None, ["2020-02-01", "2020-02-03"])), ("day_count", ("DERIVED", "anchored+canonical", ["ACT_ACT_ICMA"])), ("isin", ("DERIVED", "anchored", ["XS0000000123"])),
    ("business_day_convention", ("DERIVED", "anchored", ["Modified Following Business Day Convention"])), ("ranking", ("DERIVED", "anchored", ["SENIOR_PREFERRED"])), ("subordination", ("OBSERVED", "raw_only", [])),
    ("call_dates", ("OBSERVED", "explicit_na", ["NOT_APPLICABLE"])), ("barrier", ("OBSERVED", "cross_reference", [])), ("underlying", ("MISSING", None, None)), ("participation", ("MISSING", None, None)),
    ("strike", ("DERIVED", "anchored", ["120"])), ("cap", ("DERIVED", "anchored", ["5"])), ("spread", ("MISSING", None, None)),
])
def test_fields(got, field, want):
    assert got[1, field] == want


def test_every_field_of_every_document(got):
    assert len(got) == 4 * len(E.RULES) == 4 * 28
    assert {got[d, f][0] for d in (2, 3, 4) for f in E.RULES} == {"MISSING"}


def test_boxes(spark, docs):
    at = "doc_id long, ix long, page long, text string, l double, t double, r double, b double"
    rows = [(1, 0, 0, "Maturity Date:", 0.0, 100.0, 50.0, 90.0), (1, 1, 0, "5 August 2036", 60.0, 100.0, 90.0, 90.0), (1, 2, 0, "Specified Denomination:", 0.0, 80.0, 50.0, 70.0), (1, 3, 0, "Series: EUR 25.000.000", 0.0, 60.0, 50.0, 50.0)]
    out = E.extract_all(docs.where("doc_id = 1"), spark.createDataFrame(rows, at)).where(F.col("status") != "MISSING").select("field", "values").collect()
    assert {r["field"]: r["values"] for r in out} == {"maturity": ["2036-08-05"], "denomination": ["25000000|EUR"]}


def test_sections(docs):
    blocks = layout.line_blocks(docs).withColumnRenamed("block", "text")
    out = {(r["doc_id"], r["field"]): (r["values"], r["failure"]) for r in E.extract_by_section(docs, blocks).collect()}
    assert out[1, "maturity"] == (["2036-08-05"], None)
    assert out[1, "spread"] == (None, "PARSING_MISS")
    assert out[2, "spread"] == (None, "LOCATION_MISS")
    assert out[2, "strike"] == (None, "PARSING_MISS")


@pytest.mark.parametrize(("a", "b", "want"), [
    ("4.35%", "4.35% of the initial nominal investment", True), ("75%", "75% of initial price (2,472.165 pts)", False), ("50.000 euros", "50,000 EUR", True), ("ACT/ACT (ICMA)", "ACT_ACT_ICMA", True), ("2,50", "2.5", True), ("2.5", "2.6", False),
    ("10 de septiembre de 2031", "10/09/2031", True), ("September 10, 2031", "2031-09-10", True), ("2031-09-10", "2031-09-11", False), ("Dólares", "USD", True), ("euro", "yen", False), ("ﬁxed", "FIXED", True), ("", "x", False), (None, "", True),
])
def test_same_scalar(a, b, want):
    assert metrics.same_scalar(metrics.Reading(a), metrics.Reading(b)) is want
    assert metrics.same_scalar(metrics.Reading(b), metrics.Reading(a)) is want


def test_same_values_as_often():
    assert metrics.same_values(["a", "a", "b"], ["b", "a", "A"])
    assert not metrics.same_values(["a", "a", "b"], ["a", "b", "b"])
    assert not metrics.same_values(["a"], ["a", "b"])
    assert metrics.same_values(None, [])
