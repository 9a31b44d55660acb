"""Values that denote the same share a key; what a candidate covers, against comparing everything."""

import itertools
import json

from pyspark.sql import functions as F

from factloom.operators import coverage, metrics

VALUES = ["2.5", "2,50", " 2.50 ", "2.5 per cent", "1.000", "1000", "1", "50.000 euros", "50,000 EUR", "50.000", "10/09/2031", "10 de septiembre de 2031", "September 10, 2031", "2031-09-10", "2031-9-10", "EUR", "euro", "Dólares", "USD", "us dollar", "ACT/ACT (ICMA)", "ACT_ACT_ICMA", "1.5x", "15x", "ﬁxed", "fixed", "FIXED rate", "ﬁxed rate", "x", "", "  ", "75% of initial price (2,472.165 pts)", "75%", "4.35%", "4.35% of the initial nominal investment", "漢字", "１２", "12", "Notes", "notes ", "1e3", "-0", "0", '["a", "B"]', '["b", "A"]', '["a"]', '{"k": 1}', '{"k": "1.0"}', "inf", "nan"]


def loads(x):
    return json.loads(x) if x[:1] in "[{" and x else x


def test_equal_values_share_a_key(spark):
    got = {r["v"]: set(r["k"]) for r in spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", coverage.keys(F.col("v")).alias("k")).collect()}
    same = 0
    for a, b in itertools.product(VALUES, VALUES):
        if a != b and metrics.same_values(loads(a), loads(b)):
            same += 1
            assert got[a] & got[b] or ("odd" in got[a]) != ("odd" in got[b]), (a, b)
    assert same > 40


def test_covered_by_all_pairs(spark):
    takes = {"rate": ("rate",), "fix": ("dates", "rules"), "none": ()}
    gold = [(c, f, v) for c in (1, 2, None) for f in ("rate", "fix", "none", "other") for v in VALUES[c or 0 :: 3]] + [(1, "rate", None)]
    cands = [(c, f, v) for c, f, step in ((1, "rate", 4), (1, "rules", 5), (2, "dates", 3), (2, "rules", 7), (2, "rate", 6)) for v in VALUES[::step]] + [(1, "rate", None), (None, "rate", "2.5")]
    kind = "case_id long, field string, value string"
    out = coverage.covered(spark.createDataFrame(gold, kind), spark.createDataFrame(cands, kind), takes).collect()
    want = {}
    for c, f, v in gold:
        want[c, f, v] = v is not None and c is not None and any(c == d and g in takes.get(f, ()) and w is not None and metrics.same_values(loads(v), loads(w)) for d, g, w in cands)
    got = {(r["case_id"], r["field"], r["value"]): r["covered"] for r in out}
    assert len(out) == len(gold)
    assert {k: x for k, x in got.items() if k[0] is not None} == {k: x for k, x in want.items() if k[0] is not None}
    assert sum(got.values()) > 20
    assert coverage.coverage(spark.createDataFrame([("a", True), ("a", False)], "field string, covered boolean"), "field").first()[:] == ("a", 2, 1, 0.5)


def test_few_pairs_reach_python(spark):
    """A case with many candidates of other values compares none of them."""
    gold = spark.createDataFrame([(1, "rate", "2.5")], "case_id long, field string, value string")
    found = spark.range(500).select(F.lit(1).cast("long").alias("case_id"), F.lit("rate").alias("field"), (F.col("id") + 10).cast("string").alias("value"))
    a, b = gold.withColumn("key", F.explode(coverage.keys(F.col("value")))), found.withColumn("key", F.explode(coverage.keys(F.col("value"))))
    assert a.join(b, ["case_id", "field", "key"]).count() <= 1  # 25 has the same digits
    assert not coverage.covered(gold, found, {"rate": ("rate",)}).first()["covered"]
