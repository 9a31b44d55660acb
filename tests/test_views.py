"""Views of regions against reading each region by itself, joins by bins and cells against all pairs, cells as hits."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract as E
from factloom.operators import layout

rng = random.Random(4)
LINES = ["Maturity Date:", "05/08/2036", "Maturity", "Date: 6 August 2036", "", "Issue Date: 01/02/2020", "ISIN XS0000000123", "Rate of Interest:", "2.5 per cent", "Rate of Interest: 3.5%", "Specified Currency: EUR", "Put Option:", "5 August 2030", "No such thing", "Day Count Fraction:", "ACT/360", "Spread", "of Aggregate Nominal", "Amount: 5 EUR"]
SECTIONS = {"general": r"(?i)maturity|currency", "interest": r"(?i)rate of|spread", "exercise": r"(?i)option|noteholder"}


def read_by_hand(spark, texts):
    """Each region of each section is a document of its own."""
    want = {}
    for doc, lines in enumerate(texts):
        for section, pattern in SECTIONS.items():
            hits = [i for i, x in enumerate(lines) if __import__("re").search(pattern.replace("(?i)", ""), x, 2)]
            regions = []
            for page in sorted({i // 10 for i in hits}):
                on = [i for i in hits if i // 10 == page]
                regions.append((-len(on), page, lines[max(0, on[0] - 3) : on[-1] + 5]))
            for n, (_, _, part) in enumerate(sorted(regions)):
                want[doc, section, n] = part
    part = spark.createDataFrame([(list(want).index(k), i, i // 10, x) for k, v in want.items() for i, x in enumerate(v)], "doc_id long, ix long, page long, text string")
    docs = spark.createDataFrame([(i,) for i in range(len(want))], "doc_id long")
    read = {}
    for r in E.extract_all(docs, part).where("status <> 'MISSING'").collect():
        read[list(want)[r["doc_id"]], r["field"]] = (r["status"], r["values"])
    out = {}
    for doc in range(len(texts)):
        for field, rule in E.RULES.items():
            if rule.section:
                found = [read[k, field] for k in sorted(want) if k[:2] == (doc, rule.section) and (k, field) in read]
                out[doc, field] = found[0] if found else ("MISSING", None)
    return out


def test_views_are_regions_read_alone(spark, monkeypatch):
    monkeypatch.setattr(layout, "BIN", 4)
    monkeypatch.setattr(layout.regions, "__defaults__", (3, 5))
    texts = [[rng.choice(LINES) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts += [["Maturity Date:"] + ["x"] * 4 + ["Issue Date:", "01/02/2020"], ["currency"] + ["x"] * 3 + ["Issue", "Date: 01/02/2020"]]  # a label on a region's last line
    blocks = spark.createDataFrame([(d, i, i // 10, x) for d, t in enumerate(texts) for i, x in enumerate(t)], "doc_id long, ix long, page long, text string")
    docs = spark.createDataFrame([(d,) for d in range(len(texts))], "doc_id long")
    got = {(r["doc_id"], r["field"]): (r["status"], r["values"]) for r in E.extract_by_section(docs, blocks, sections=SECTIONS).collect() if E.RULES[r["field"]].section}
    want = read_by_hand(spark, texts)
    assert got == want and len({x[0] for x in got.values()}) >= 3
    assert got[12, "issue_date"] == got[13, "issue_date"] == ("MISSING", None)


def test_cells_make_regions(spark):
    """Hits in cells count for their page; a page with none but those has a region of tables alone."""
    blocks = spark.createDataFrame([(1, 0, 1, "Maturity Date: 05/08/2036"), (1, 30, 2, "Maturity Date: 06/08/2036")], "doc_id long, ix long, page long, text string")
    rows = spark.createDataFrame([(1, 0, 0, 2, ["currency", "EUR"]), (1, 1, 0, 7, ["Noteholder Put", "5 August 2030"])], "doc_id long, table int, row int, page long, cells array<string>")
    docs = blocks.select("doc_id").distinct()
    got = {r["field"]: r for r in E.extract_by_section(docs, blocks, rows, sections=SECTIONS).collect()}
    assert got["put_dates"]["values"] == ["2030-08-05"] and got["put_dates"]["failure"] is None
    assert got["maturity"]["values"] == ["2036-08-05", "2036-08-06"] or got["maturity"]["values"] == ["2036-08-06"]
    found = {(r["section"], r["page"]): (r["lo"], r["hi"], r["score"]) for r in layout.regions(layout.section_hits(blocks.withColumnRenamed("text", "block"), SECTIONS, rows)).collect()}
    assert found == {("general", 1): (0, 40, 1), ("general", 2): (20, 70, 2), ("exercise", 7): (0, 0, 1)}
    without = {r["field"]: r["failure"] for r in E.extract_by_section(docs, blocks, rows.drop("page"), sections=SECTIONS).collect()}
    assert without["put_dates"] == "LOCATION_MISS"


def test_inside_by_hand(spark):
    spans = [(i, rng.choice("ab"), a, a + rng.randint(0, 90)) for i, a in enumerate(rng.randint(0, 400) for _ in range(300))] + [(900, "a", None, None)]
    areas = [(j, rng.choice("ab"), lo, lo + rng.choice([0, 1, 63, 64, 65, 200])) for j, lo in enumerate(rng.randint(0, 400) for _ in range(80))]
    got = layout.inside(spark.createDataFrame(spans, "i int, k string, first long, last long"), spark.createDataFrame(areas, "j int, k string, lo long, hi long"), ["k"], "first", "last")
    want = sorted((i, j) for i, k, a, b in spans for j, m, lo, hi in areas if k == m and (a is None or lo <= a and b < hi))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and want


@pytest.mark.parametrize("seed", range(3))
def test_boxes_by_all_pairs(spark, seed):
    r = random.Random(seed)
    boxes = [(r.randint(0, 2), i, float(x := r.randint(-40, 600)), float(t := r.choice([r.randint(0, 800), 6 * r.randint(0, 100), 100])), float(x + r.randint(5, 80)), float(t - r.choice([10, 12])), r.choice(["a", " ", "b"])) for i in range(250)]
    boxes.append((0, 999, None, None, None, None, "x"))
    df = spark.createDataFrame(boxes, "page int, ix int, l double, t double, r double, b double, text string")
    right, low = {}, {}
    for p, i, left, t, e, b, _ in boxes[:-1]:
        for q, j, left2, t2, _, b2, text in boxes[:-1]:
            if p == q and i != j and abs((t + b) / 2 - (t2 + b2) / 2) <= 6 and left2 >= e - 2 and text.strip():
                right[p, i] = min(right.get((p, i), (1e9, 0)), (left2 - e, j))
            if p == q and 0 < t - t2 <= 30 and abs(left - left2) < 120:
                low[p, i] = min(low.get((p, i), (1e9, 0)), (t - t2, j))
    assert {(x["page"], x["ix"]): x["right_ix"] for x in layout.right_of(df).collect()} == {k: v[1] for k, v in right.items()}
    assert {(x["page"], x["ix"]): x["below_ix"] for x in layout.below(df).collect()} == {k: v[1] for k, v in low.items()}
    some = df.where(F.col("ix") % 7 == 0)
    assert {x["ix"] for x in layout.right_of(df, probes=some).collect()} == {k[1] for k in right if k[1] % 7 == 0}


def test_plans_meet_neighbours_by_equality(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 9.0, 5.0, 1.0, "a")], "page int, ix int, l double, t double, r double, b double, text string")
    for d in (layout.right_of(df), layout.below(df)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "band" in plan or "y#" in plan
        assert "NestedLoop" not in plan and "Cartesian" not in plan
