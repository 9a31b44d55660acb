"""extract_documents: documents are dealt out, one region is settled, patterns are tried only where they may fit."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from factloom.operators import extract, layout
from factloom.sources import shared

SF = "/root/testdata/sf0.001"


def test_documents_are_dealt_out_by_their_number(spark, monkeypatch):
    """However small their files are: blocks, rows and documents are written by tasks that grow with the customers."""
    monkeypatch.setattr(shared, "ROWS", 100)
    written = {}
    monkeypatch.setattr(extract, "table", lambda df, name: (written.setdefault(name, df.rdd.getNumPartitions()), shared.table(df, name))[1])
    E.queries()["extract_documents"](spark, SF)
    asked = spark.read.parquet(f"{SF}/customer.parquet").count() * 10 // 100
    assert asked > 4 and min(written["documents"], written["read"], written["rows"]) >= asked


def test_best_region_alone_is_settled(spark):
    """As settling all regions and taking the best after."""
    r = random.Random(7)
    ways = [("EUR", "anchored"), ("EUR 1", "anchored"), ("USD", "anchored"), (None, "raw_only"), ("NOT_APPLICABLE", "explicit_na")]
    rows = []
    for _ in range(600):
        value, kind = r.choice(ways)
        raw = r.choice(["Euros", "ΑΣ", "a  b", "\teuro"])
        rows.append((r.randrange(40), r.choice(["currency", "coupon_type", "isin"]), page := r.randrange(3), page % 2, r.choice([0, 1, 2]), r.randrange(9), [r.randrange(9)], raw, value, kind, r.choice(["", f"x {raw} y", f"{raw}Α", "other", raw.replace("  ", " ")])))
    d = spark.createDataFrame(rows, "doc_id long, field string, page long, score long, source int, ix long, k array<long>, raw string, value string, class string, excerpt string")
    each = extract.settle(d, by=("doc_id", "field", "page", "score"))
    want = each.groupBy("doc_id", "field").agg(F.max_by(F.struct(*extract.SETTLED), F.struct("score", -F.col("page"))).alias("r")).select("doc_id", "field", "r.*")
    got = extract.settle_best(d)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    # and `own` by the keys of lexeme and excerpt
    one = d.where("value = 'EUR'").limit(80).withColumn("doc_id", F.monotonically_increasing_id())
    said = {x["doc_id"]: x["own"] for x in extract.settle(one).collect()}
    key = extract.L.verbatim_key
    for x in one.select("doc_id", ((F.col("excerpt") != "") & F.contains(key(F.col("excerpt")), key(F.trim("raw")))).alias("own")).collect():
        assert said[x["doc_id"]] == x["own"]


def test_patterns_by_the_words_they_begin_with(spark):
    """A text without any of them isn't searched; other forms of letters, and patterns that don't tell, are."""
    texts = ["Rate of Interest: 5", "INTEREST  BASIS", "ıſın", "ISIN x", "Iſſue", "notes", "", None, "subtipo de interés", "cupon", "xput option", "PUT/CALL", "Kall option"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*extract.SECTIONS.values(), *(p for own in extract.ROLE_SECTIONS.values() for p in own.values()), "(?i)ISIN", "(?i)ab?|cd", "(?s)isin", "\\binterest|(?:a|b)c"]
    for p in patterns:
        assert d.where(F.col("t").rlike(p) & ~layout.may_hold(F.col("t"), p)).count() == 0, p
    assert d.where(layout.may_hold(F.col("t"), extract.SECTIONS["structured"])).count() == 3  # those that aren't ASCII
    assert layout._starts(extract.SECTIONS["redemption"]) == {"reembolso", "amortizaci", "redemption", "vencimiento", "maturity"}
    assert layout._starts("(?i)fo?|bar") is None and layout._starts("(?i)foo?|bar") == {"fo", "bar"} and layout._starts("(?s)foo") is None
    said = ["Following Business Day Convention", "Siguiente Día Hábil", "Convención del Día Hábil Anterior", "SIGUIENTE DIA HABIL", "FRN Convention"]
    said = spark.createDataFrame([(t,) for t in said], "t string").where(F.col("t").rlike(extract.CONVENTION))
    assert said.where(layout.may_hold(F.col("t"), "|".join(extract.CONVENTION_WORDS))).count() == said.count() == 3


def test_labels_by_three_letters(spark):
    """Few patterns are tried on a label, none for a label that opens with another sign than a letter."""
    lines = ["Interest Basis: Fixed", "Final Terms", "First Margin: 1", "Relevant Screen Page: x", "€STR + 1"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select("t", F.bit_count(extract._may_open(F.col("t"), extract.RULES)).alias("n"), extract._labels([F.col("t")], extract.RULES).alias("x")).collect()
    assert [r["n"] <= 4 for r in got] == [True, True, True, True, False]
    assert [sorted(x["field"] for x in r["x"]) for r in got] == [["coupon_rate", "coupon_type"], [], ["spread"], ["fixing_rules"], ["benchmark"]]
