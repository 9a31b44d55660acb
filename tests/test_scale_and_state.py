"""Order statistics, shares and bounds without gathering groups; sealed results, kept manifests, and values of several shapes."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import extract, layout, metrics, sampling
from factloom.sources import files

rng = random.Random(4)


def test_order_statistics(spark):
    groups = {"one": [3.5], "two": [1.0, 9.0], "ties": [2.0] * 50 + [7.0] * 51, "spread": [rng.gauss(0, 1e6) for _ in range(301)], "near": [1e9 + rng.random() for _ in range(40)]}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs] + [("two", None)], "k string, x double").repartition(5)
    for r in metrics.order_statistics(rows, "x", "k").collect():
        xs = sorted(groups[r["k"]])
        assert r["median"] == statistics.median(xs) and r["p90"] == xs[int(0.9 * len(xs)) - 1] and r["most"] == xs[-1] and r["total"] == pytest.approx(sum(xs))
    every = sorted(x for xs in groups.values() for x in xs)
    assert metrics.order_statistics(rows, "x").first()["median"] == statistics.median(every)
    assert metrics.order_statistics(rows.where("false"), "x", "k").count() == 0


@pytest.mark.parametrize("digits", [1, 4])
def test_share(spark, digits):
    df = spark.range(1003).select("id")
    want = [r["id"] for r in df.orderBy(sampling.hash_order("id", 9), "id").limit(201).collect()]
    assert sorted(r["id"] for r in sampling.share(df, "id", 0.2, 9, digits).collect()) == sorted(want)
    assert sampling.share(df, "id", 0, 9).count() == 0 and sampling.share(df, "id", 1, 9).count() == 1003 and sampling.share(df.where("false"), "id", 0.5, 9).count() == 0


def test_bootstrap_of_any_size(spark):
    """Larger groups are not refused, and their interval is that of resampling, within what a finite number of replicates leaves open."""
    rows = spark.createDataFrame([("a", 0.4), ("a", 0.25)], "k string, x double")
    assert metrics.bootstrap_median(rows, "x", "k", 1, 50).first()["median"] == 0.325
    groups = {"odd": [rng.gauss(0, 1) for _ in range(801)], "even": [rng.expovariate(1) for _ in range(600)], "ties": [1.0] * 300 + [2.0] * 301, None: [rng.random() for _ in range(501)], "small": [1.0, 5.0, 2.0]}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs] + [("odd", None)], "k string, x double").repartition(5)
    got = {r["k"]: r for r in metrics.bootstrap_median(rows, "x", "k", 7, 2000, most=100).collect()}
    assert set(got) == set(groups)
    slack = 3 * (0.025 * 0.975 / 2000) ** 0.5
    for k, xs in groups.items():
        r, own = got[k], random.Random(3)
        assert r["n"] == len(xs) and r["median"] == statistics.median(xs)
        meds = sorted(statistics.median(own.choices(xs, k=len(xs))) for _ in range(4000))
        at = lambda q: meds[min(max(int(q * 4000), 0), 3999)]  # noqa: B023, E731
        assert at(0.025 - 2 * slack) <= r["low"] <= at(0.025 + 2 * slack) and at(0.975 - 2 * slack) <= r["high"] <= at(0.975 + 2 * slack)
    again = {r["k"]: r for r in metrics.bootstrap_median(rows.repartition(2), "x", "k", 7, 2000, most=100).collect()}
    assert again == got


def test_no_range_of_heavy_tails_is_large(spark):
    """One value of 1e12 beside many near ones: equal widths would put all others into one range."""
    xs = [rng.gauss(0, 1) for _ in range(30_000)] + [1e12, -1e15] + [5.0 + i * 1e-9 for i in range(20_000)]
    rows = spark.createDataFrame([("a", x) for x in xs] + [("b", x) for x in xs[:50]], "k string, x double").repartition(4)
    counts = rows.groupBy("k", F.col("x").alias("_v")).agg(F.count("*").alias("_n"))
    sizes = {(r["k"], r["_part"]): r["n"] for r in metrics._parts(counts, ["k"]).groupBy("k", "_part").agg(F.count("*").alias("n")).collect()}
    assert max(n for (k, _), n in sizes.items() if k == "a") < len(xs) / 100 and len(sizes) > 500
    order = metrics._parts(counts, ["k"]).where("k = 'a'").groupBy("_part").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).orderBy("_part").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(order, order[1:], strict=False))
    r = next(r for r in metrics.order_statistics(rows, "x", "k").collect() if r["k"] == "a")
    assert r["median"] == statistics.median(xs) and r["p90"] == sorted(xs)[int(0.9 * len(xs)) - 1] and r["most"] == 1e12


@pytest.mark.parametrize(("a", "b", "same"), [
    ({"a": "1", "b": ["x", "2,0"]}, {"b": ["2", "X"], "a": 1}, True), ({"a": 1}, {"a": 1, "b": 2}, False), ({"a": 1}, [1], False), ([1], 1, False), ([[1, 2], [3]], [[3], [2, 1]], True), ([], [], True), ([1, 1], [1, 2], False), (True, 1, False), ("4.35%", "4.35% of the initial nominal investment", True),
])
def test_values_of_several_shapes(a, b, same):
    assert metrics.same_values(a, b) is same and metrics.same_values(b, a) is same


def test_json_values(spark):
    d = spark.createDataFrame([(json.dumps([1, "x"]), json.dumps(["X", 1.0])), ("[1]", "[1]"), (None, "1"), ("[1]", "1")], "a string, b string")
    assert [r["s"] for r in d.select(metrics.same_json_column(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, None, False]


def test_keys(spark):
    r = spark.sql("select array(' B ', '2.50', null) as v, 1500.25 as amount").select(L.list_key(F.col("v")).alias("l"), L.money_key(F.col("amount")).alias("m"), L.list_key(F.lit(None).cast("array<string>")).alias("n"), L.record_ids(F.lit('{"a": ["(FOL_1) x", "PSE_2"], "b": "XADM_3 CCFF_4"}')).alias("ids")).first()
    assert (r["l"], r["m"], r["n"], r["ids"]) == (" 2.5 b", "150025", "", ["FOL_1", "PSE_2", "CCFF_4"])


def test_sealed_results(spark, tmp_path):
    at = str(tmp_path / "r")
    files.write_sealed(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), at, "scorer 3")
    assert files.broken_seals(spark, at).isEmpty() and files.read_sealed(spark, at, "k long, v string").count() == 2
    part = next(p for p in (tmp_path / "r" / "results").glob("part-*") if p.stat().st_size)
    part.write_text(part.read_text().replace("a", "z").replace("b", "z"))
    (part.parent / f".{part.name}.crc").unlink()
    assert files.broken_seals(spark, at).count() == 1
    with pytest.raises(ValueError, match="not those that were sealed"):
        files.read_sealed(spark, at, "k long, v string")


def test_replaced_and_appended(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in (1, 2):
        files.replace_table(spark.range(n), at)
    assert files.read_replaced(spark, at).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    log = tmp_path / "log"
    files.append_log(spark.createDataFrame([(1,)], "k long"), str(log))
    (log / "part-x.json").write_text('{"k": 2')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.append_log(spark.createDataFrame([(3,)], "k long"), str(log))


def test_kept_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('[{"k": 1}]')
    first = files.read_manifest_kept(spark, str(p), "k long")
    assert files.read_manifest_kept(spark, str(p), "k long") is first and first.count() == 1
    p.write_text('[{"k": 1}, {"k": 2}]')
    assert files.read_manifest_kept(spark, str(p), "k long").count() == 2


def test_verification(spark):
    """A lexeme that the document doesn't have is no value, nor is a list without an excerpt."""
    blocks = spark.createDataFrame([(1, 0, 0, "Cap  Rate: 5%"), (1, 1, 0, "far")], "doc_id long, ix long, page long, text string")
    schema = "doc_id long, field string, status string, class string, values array<string>, lexeme string, blocks array<long>, own boolean"
    rows = [(1, "cap", "DERIVED", "anchored", ["5"], "5%", [0], True), (1, "strike", "DERIVED", "anchored", ["9"], "9%", [0], False), (1, "spread", "DERIVED", "anchored", ["x"], "FAR", [None], False), (1, "barrier", "OBSERVED", "multi_aspect", ["a", "b"], None, [None], False), (1, "autocall", "CONFLICT", None, ["a", "b"], None, [0], True), (1, "isin", "OBSERVED", "raw_only", [], " ", [0], True)]
    got = {r["field"]: (r["status"], r["class"], r["values"]) for r in extract.verify(spark.createDataFrame(rows, schema), blocks).collect()}
    assert got == {"cap": ("DERIVED", "verified_verbatim", ["5"]), "strike": ("OBSERVED", "VALUE_UNVERIFIED", None), "spread": ("DERIVED", "verified_verbatim_doclevel", ["x"]), "barrier": ("OBSERVED", "VALUE_UNVERIFIED", None), "autocall": ("CONFLICT", None, ["a", "b"]), "isin": ("OBSERVED", "no_lexeme", [])}


def test_conventions_in_cells(spark):
    docs = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, 0, ["x", "• FRN Convention applies"])], "doc_id long, table int, row int, cells array<string>")
    got = extract.extract_all(docs, layout.line_blocks(docs).withColumnRenamed("block", "text"), rows).where("status <> 'MISSING'").collect()
    assert [(r["field"], r["values"]) for r in got] == [("business_day_convention", ["FRN Convention"])]
    assert extract.extract_all(docs, layout.line_blocks(docs).withColumnRenamed("block", "text"), role="letter").count() == 0
