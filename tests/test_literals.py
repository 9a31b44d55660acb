"""Literal cases of the normalisers, rules and scores."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import link, metrics, reconcile, review
from factloom.sources import files
from factloom.streaming import log


def one(spark, f, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "text", "want"), [
    (L.norm_number, "3,625", 3.625), (L.norm_number, "25,000,000", 25000000), (L.norm_number, "1.234.567,89", 1234567.89), (L.norm_number, "abc", None), (L.norm_number, "25,000", 25), (L.norm_number, "100.000", 100), (L.norm_number, "1-2", None),
    (L.norm_percent, "2,07 por ciento", 2.07), (L.norm_percent, "sin cupon", None), (L.norm_spread, "+ 0,46%", 0.46), (L.norm_spread, "45 bps", 0.45), (L.norm_spread, "4%", None),
])
def test_numbers(spark, f, text, want):
    got = one(spark, f, text)
    assert got is None if want is None else float(got) == pytest.approx(want)


@pytest.mark.parametrize(("f", "text", "want"), [
    (L.norm_date, "5 August 2036", "2036-08-05"), (L.norm_date, "05/08/2036", "2036-08-05"), (L.norm_date, "10 de septiembre de 2031", "2031-09-10"), (L.norm_date, "5/13/2031", None),
    (L.norm_currency, 'U.S dollars ("USD")', "USD"), (L.norm_currency, "Renminbi- Offshore CNY ('CNH')", "CNH"), (L.norm_currency, "EURIBOR", "EUR"),
    (L.norm_benchmark, "EURIBOR 3 months was 2.335%", "EURIBOR 3 months"), (L.norm_frequency, "5 August in each year, adjusted", "ANNUAL"), (L.norm_frequency, "5 August [in each year]", "RAW_ONLY"), (L.norm_frequency, "", None),
    (L.norm_ranking, "Senior Non-Preferred", "SENIOR_NON_PREFERRED"), (L.norm_subordination, "Tier 2", "TIER_2"), (L.norm_applicability, "N/A", "NOT_APPLICABLE"),
])
def test_texts(spark, f, text, want):
    assert one(spark, f, text) == want


def test_money_and_daycount(spark):
    m = one(spark, L.norm_money, "Nominal: 750.000.000 Euros")
    assert (int(m["amount"]), m["currency"], m["raw_number"]) == (750000000, "EUR", "750.000.000")
    assert one(spark, L.resolve_daycount, "1/1", "") is None
    assert one(spark, L.resolve_daycount, "1/1", "Day Count Fraction: 1/1") == "ONE_ONE"
    assert one(spark, L.resolve_daycount, "ACT/ACT ICMA", "") == "ACT_ACT_ICMA"


def test_schedule(spark):
    s = one(spark, lambda a, b: reconcile.schedule(F.lit(12), a.cast("date"), b.cast("date")), "2026-08-05", "2036-08-05")
    assert (s["status"], s["n_dates"], str(s["last"])) == ("VALID", 10, "2036-08-05")
    assert one(spark, lambda a, b: reconcile.schedule(F.lit(12), a.cast("date"), b.cast("date")), "2026-08-05", "2026-09-05")["status"] == "INVALID"


def test_ladder(spark):
    rows = [("cnmv_ccff", "", "1", "folleto", "1", "base"), ("cnmv_ccff", "", "1", "folleto", "2", "base"), ("x", "SUPLEMENTO", None, "folleto", "1", None), ("x", "", None, "none", None, None)]
    df = spark.createDataFrame(rows, "src_family string, src_role string, src_number string, cand_type string, cand_register string, cand_version string").withColumn("earlier_supplements", F.lit(0))
    assert [r["operation"] for r in link.adjudicate(df).collect()] == ["AUTO_LINKED", "NO_LINK", "REVIEW_REQUIRED", "NO_LINK"]


def test_timing(spark):
    rows = [("a", 1, "CASE_OPENED", 0), ("a", 2, "CASE_PAUSED", 10), ("a", 3, "CASE_RESUMED", 210), ("b", 1, "CASE_OPENED", 0), ("b", 2, "CASE_PAUSED", 10), ("b", 3, "CASE_SUBMITTED", 410)]
    df = spark.createDataFrame(rows, "k string, n int, kind string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["k"]: r["timing"] for r in review.timing_status(df, "kind", "ts", "n", "k").collect()} == {"a": "VALID", "b": "INVALID_TIMING"}


def test_statistics():
    low, high = metrics.exact_interval(82, 100)
    assert (low, high) == (pytest.approx(0.730522914033188), pytest.approx(0.8896887708467394))
    assert metrics.exact_interval(0, 0) == (None, None) and metrics.exact_interval(0, 5)[0] == 0 and metrics.exact_interval(5, 5)[1] == 1
    assert metrics.same_values(["2.50", "Ａ b"], ["a  B", "2,5"]) and not metrics.same_values(["a", "a"], ["a"])


def test_files_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df, f"{tmp_path}/log")
    assert files.read_log_strict(spark, f"{tmp_path}/log", df.schema).count() == 2
    with pytest.raises(Exception, match="finite"):
        files.append_log(df.withColumn("v", F.lit(float("nan"))), f"{tmp_path}/log")
    row = spark.createDataFrame([('<tr><td>1 <b>x</b></td><td><a href="d?NUMFOL=7">y</a></td></tr>',)], "html string")
    r = files.registry_record(row, "html", ["first", "second"]).first()
    assert (r["first"], r["second"], r["numfol"]) == ("1 x", "y", "7")
    events = spark.createDataFrame([(1, 0), (1, 100), (1, 1000), (1, 9000)], "u int, s int").select("u", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    log.run_available(log.sessions(log.read_events(spark, f"{tmp_path}/in", events.schema), "ts", "u"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
