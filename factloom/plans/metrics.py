"""Queries that score decisions, sets and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lexemes import MONTHS_ES
from factloom.operators import coverage, documents
from factloom.operators import metrics as M
from factloom.plans.registry import Tables, query
from factloom.sources.shared import dealt

_O = """o AS (SELECT l_orderkey, l_returnflag AS mode, l_linestatus AS stratum, l_shipinstruct_ AS family, CASE gold WHEN 'CONFIRMED_VALUE' THEN CASE WHEN dec = 'CONFIRMED' AND eq THEN 'TP' WHEN dec = 'CONFIRMED' THEN 'FP_WRONG_VALUE' ELSE 'FN' END WHEN 'CONFLICT' THEN CASE WHEN dec = 'CONFLICT' THEN 'CONFLICT_OK' WHEN dec = 'CONFIRMED' THEN 'FP_CONFLICT_DENIED' ELSE 'FN' END ELSE CASE WHEN dec = 'CONFIRMED' THEN 'FP_INVENTED' WHEN dec = 'CONFLICT' THEN 'INCORRECT_STATUS' ELSE 'TN' END END AS outcome
FROM (SELECT *, l_linenumber % 2 AS l_shipinstruct_, list_extract(['CONFIRMED_VALUE','CONFIRMED_VALUE','CONFLICT','MISSING'], CAST(l_partkey % 4 AS INT) + 1) AS gold, list_extract(['CONFIRMED','CONFIRMED','CONFLICT','MISSING',NULL], CAST(l_suppkey % 5 AS INT) + 1) AS dec, l_quantity > 20 AS eq FROM lineitem))"""


def _scored(t: Tables) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    gold = pick(("CONFIRMED_VALUE", "CONFIRMED_VALUE", "CONFLICT", "MISSING"), F.col("l_partkey") % 4)
    decision = pick(("CONFIRMED", "CONFIRMED", "CONFLICT", "MISSING", None), F.col("l_suppkey") % 5)
    return t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("stratum"), (F.col("l_linenumber") % 2).alias("family"), M.outcome(gold, decision, F.col("l_quantity") > 20).alias("outcome"))


@query(f"WITH {_O} SELECT mode, outcome, count(*) AS n FROM o GROUP BY 1, 2")
def outcome_matrix(t: Tables) -> DataFrame:
    return _scored(t).groupBy("mode", "outcome").agg(F.count("*").alias("n"))


_PRF = "count(*) AS n, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome IN ('FP_WRONG_VALUE', 'FP_INVENTED', 'FP_CONFLICT_DENIED')) AS fp, count(*) FILTER (outcome IN ('FN', 'FP_WRONG_VALUE')) AS fn"


@query(f"""WITH {_O}, g AS (SELECT mode, stratum, family, GROUPING(mode, stratum, family) AS "grouping", {_PRF}, count(*) FILTER (outcome IN ('TP', 'TN', 'CONFLICT_OK')) AS ok FROM o GROUP BY GROUPING SETS ((), (mode), (stratum), (family)))
SELECT mode, stratum, family, "grouping", n, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, ok / n AS completeness FROM g""")
def prf_grouping_sets(t: Tables) -> DataFrame:
    return M.prf(_scored(t), [[], ["mode"], ["stratum"], ["family"]])


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand) FILTER (l_quantity > 20)) AS pred, list_sort(list(DISTINCT p_brand) FILTER (l_linenumber <= 3)) AS gold FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
c AS (SELECT l_orderkey, coalesce(pred, []) AS pred, coalesce(gold, []) AS gold FROM s),
n AS (SELECT *, len(list_intersect(pred, gold)) AS tp FROM c), m AS (SELECT *, len(pred) - tp AS fp, len(gold) - tp AS fn FROM n)
SELECT l_orderkey, tp, fp, fn, CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 'NOT_APPLICABLE' WHEN len(pred) = 0 THEN 'MISSING' WHEN tp = 0 THEN 'DISJOINT' WHEN fp = 0 AND fn = 0 THEN 'EXACT' WHEN fp = 0 THEN 'PARTIAL' ELSE 'SUPERSET_WITH_ERROR' END AS kind FROM m""")
def set_match_scoring(t: Tables) -> DataFrame:
    """Brands of an order's large lines against those of its first lines."""
    d = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = d.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 20, F.col("p_brand"))).alias("pred"), F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("p_brand"))).alias("gold"))
    return g.select("l_orderkey", M.set_match(F.col("pred"), F.col("gold")).alias("m")).select("l_orderkey", "m.*")


def _ratios(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("value").cast("decimal(18,2)"))).alias("a"), F.sum(F.when(F.col("event_type") == "view", F.col("value").cast("decimal(18,2)"))).alias("b"))
    return g.where("a > 0 and b > 0").select("user_id", (F.col("user_id") % 5).alias("slice"), (F.col("a").cast("double") / F.col("b").cast("double")).alias("ratio"))


_RATIO = "r AS (SELECT user_id, user_id % 5 AS slice, CAST(a AS DOUBLE) / CAST(b AS DOUBLE) AS ratio FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS a, sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) WHERE a > 0 AND b > 0)"


@query(f"WITH {_RATIO} SELECT slice, count(*) AS n, round(median(ratio), 9) AS median, count(*) FILTER (ratio < 1) AS faster, round(list_sort(list(ratio))[CAST(floor(count(*) * 0.9) AS INT)], 9) AS p90 FROM r GROUP BY 1")
def paired_timing(t: Tables) -> DataFrame:
    """Ratios of two modes' totals of each user: median, ninth decile, and how often the first is less."""
    r = _ratios(t)
    s = M.order_statistics(r, "ratio", "slice").select("slice", F.round("median", 9).alias("median"), F.round("p90", 9).alias("p90"))
    return r.groupBy("slice").agg(F.count("*").alias("n"), F.count_if(F.col("ratio") < 1).alias("faster")).join(s, "slice")


@query(f"""WITH {_RATIO}, {_O}, a AS (SELECT count(*) AS pairs, median(ratio) AS median, count(*) FILTER (ratio < 1) AS faster FROM r), b AS (SELECT {_PRF} FROM o)
SELECT pairs, faster, median <= 0.75 AS time_gate, faster >= 21 AS share_gate, tp / (tp + fp) >= 0.4 AS precision_gate, CASE WHEN pairs < 24 THEN 'INCONCLUSIVE' WHEN median <= 0.75 AND faster >= 21 AND tp / (tp + fp) >= 0.4 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a, b""")
def gates_verdict(t: Tables) -> DataFrame:
    """Gates over timing and quality, one row: two one-row aggregates side by side."""
    r = _ratios(t).withColumn("one", F.lit(1))
    a = r.groupBy("one").agg(F.count("*").alias("pairs"), F.count_if(F.col("ratio") < 1).alias("faster")).join(M.order_statistics(r, "ratio", "one").select("one", F.col("median").alias("m")), "one")
    b = M.prf(_scored(t), [[]] + [["mode"]]).where("grouping = 1").select("precision")
    d = a.join(b.withColumn("one", F.lit(1)), "one").select("pairs", "faster", (F.col("m") <= 0.75).alias("time_gate"), (F.col("faster") >= 21).alias("share_gate"), (F.col("precision") >= 0.4).alias("precision_gate"))
    return d.withColumn("verdict", F.when(F.col("pairs") < 24, "INCONCLUSIVE").when(F.col("time_gate") & F.col("share_gate") & F.col("precision_gate"), "PASS").otherwise("FAIL"))


@query("""
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS truth, toxic AS pred FROM labels), s AS (SELECT count(*) FILTER (truth = 1 AND pred = 0) AS tp, count(*) FILTER (truth = 0 AND pred = 0) AS fp, count(*) FILTER (truth = 1 AND pred = 1) AS fn FROM e)
SELECT tp, fp, fn, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, (tp + fp) / greatest(1, tp + fp + fn) AS coverage FROM s""")
def errata_overlay(t: Tables) -> DataFrame:
    """Scores after later corrections of the truth; empty denominators give 0."""
    errata = t.labels.where("doc_id % 10 = 0").select("doc_id", (1 - F.col("quality")).alias("patched"))
    d = t.labels.join(errata, "doc_id", "left").select(F.coalesce("patched", "quality").alias("truth"), F.col("toxic").alias("pred"))
    n = lambda a, b: F.count_if((F.col("truth") == a) & (F.col("pred") == b))
    s = d.agg(n(1, 0).alias("tp"), n(0, 0).alias("fp"), n(1, 1).alias("fn"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.expr(b)) if a in ("tp", "fp") else F.expr(a) / F.greatest(F.lit(1), F.expr(b))
    return s.withColumns({"precision": rate("tp", "tp + fp"), "recall": rate("tp", "tp + fn"), "coverage": rate("tp + fp", "tp + fp + fn")})


@query("SELECT p_type, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND CAST(l_quantity AS INT) = p_size)) AS covered FROM part GROUP BY 1")
def candidate_coverage(t: Tables) -> DataFrame:
    """Gold units with a candidate of the same field and value."""
    cand = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("p_size")).distinct().withColumn("hit", F.lit(1))
    return t.part.join(cand, ["p_partkey", "p_size"], "left").groupBy("p_type").agg(F.count("*").alias("gold"), F.count("hit").alias("covered"))


# Written forms of a rate, a date and a currency that denote the same.
_CODES = (("EUR", "euros", "euro"), ("USD", "dollars", "US dollar"), ("GBP", "libras", "pound sterling"))


def _written(kind: Column, n: Column, form: Column) -> Column:
    """Number n (0 to 11) as a rate, a date in its month, or a currency, in one of three forms."""
    at = lambda xs, i: F.element_at(F.array(*xs), i.cast("int") + 1)
    month, rate = F.lpad((n + 1).cast("string"), 2, "0"), (n + 1).cast("string")
    rates = at([F.concat(rate, F.lit(".5")), F.concat(rate, F.lit(",50")), F.concat(rate, F.lit(".5 per cent of nominal"))], form)
    dates = at([F.concat(F.lit("2030-"), month, F.lit("-10")), F.concat(F.lit("10/"), month, F.lit("/2030")), F.concat(F.lit("10 de "), at([F.lit(m) for m in MONTHS_ES], n), F.lit(" de 2030"))], form)
    codes = at([F.array(*map(F.lit, c)) for c in _CODES], n % 3)
    return F.when(kind == "rate", rates).when(kind == "date", dates).when(kind == "code", F.element_at(codes, form.cast("int") + 1)).otherwise(F.lit("Reuters"))


def _extracted(line: Column) -> Column:
    """Field and kind of a line by its number; null beyond the fifth, as filters on the field may run before the one on the number."""
    kinds = {"coupon_rate": "rate", "maturity": "date", "currency": "code", "reset_dates": "date", "fixing_rules": "text"}
    return F.get(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind")) for f, k in kinds.items())), line.cast("int") - 1)


@query("""WITH g AS (SELECT p_partkey AS case_id, f.field, CASE WHEN f.kind = 'code' THEN p_size % 12 % 3 ELSE p_size % 12 END AS v FROM part, (VALUES ('coupon_rate', 'rate'), ('maturity', 'date'), ('currency', 'code'), ('reset_fixing', 'date')) AS f(field, kind)),
c AS (SELECT l_partkey AS case_id, list_extract(['coupon_rate', 'maturity', 'currency', 'reset_fixing'], CAST(l_linenumber AS INT)) AS field, CASE WHEN l_linenumber = 3 THEN l_suppkey % 12 % 3 ELSE l_suppkey % 12 END AS v FROM lineitem WHERE l_linenumber <= 4)
SELECT field, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.case_id = g.case_id AND c.field = g.field AND c.v = g.v)) AS covered FROM g GROUP BY 1""")
def gold_coverage(t: Tables) -> DataFrame:
    """Gold values of each part that a candidate from its order lines denotes, however it is written; one field takes two extracted ones."""
    one = lambda field, kind: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"))
    gold = t.part.select("p_partkey", "p_size", F.explode(F.array(one("coupon_rate", "rate"), one("maturity", "date"), one("currency", "code"), one("reset_fixing", "date"))).alias("f"))
    gold = gold.select(F.col("p_partkey").alias("case_id"), "f.field", _written(F.col("f.kind"), F.col("p_size") % 12, F.col("p_partkey") % 3).alias("value"))
    of = _extracted(F.col("l_linenumber"))
    found = t.lineitem.where("l_linenumber <= 5").withColumn("f", of).select(F.col("l_partkey").alias("case_id"), "f.field", _written(F.col("f.kind"), F.col("l_suppkey") % 12, F.col("l_orderkey") % 3).alias("value"))
    return coverage.coverage(coverage.covered(gold, found, documents.SOURCES), "field").select("field", "gold", "covered")


@query("SELECT family, label, prediction, n FROM (SELECT p_brand AS family, p_size % 3 AS label, CAST(floor(p_retailprice) AS INT) % 3 AS prediction, count(*) AS n FROM part GROUP BY 1, 2, 3) WHERE label <> prediction")
def confusion_errors(t: Tables) -> DataFrame:
    """Off-diagonal counts of a confusion matrix."""
    return t.part.groupBy(F.col("p_brand").alias("family"), (F.col("p_size") % 3).alias("label"), (F.floor("p_retailprice").cast("int") % 3).alias("prediction")).agg(F.count("*").alias("n")).where("label <> prediction")


@query()
def clopper_pearson(t: Tables) -> DataFrame:
    """Exact intervals of the share of good documents by language."""
    g = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))
    return g.select("lang", "k", "n", M.interval(F.col("k"), F.col("n")).alias("ci")).select("lang", "k", "n", "ci.*")


@query()
def bootstrap_median(t: Tables) -> DataFrame:
    return M.bootstrap_median(_ratios(t), "ratio", "slice", 42, 2_000)


@query()
def value_equal_multiset(t: Tables) -> DataFrame:
    """Lists of lexemes compared in any order, numbers by value."""
    size = F.col("p_size").cast("string")
    a, b = F.array(size, F.upper("p_brand"), F.lit("2.50")), F.array(F.lit("2,5"), F.concat(size, F.when(F.col("p_partkey") % 3 == 0, ".1").otherwise(".0")), F.lower("p_brand"))
    part = dealt(t.part.select("p_partkey", "p_size", "p_brand"), "p_partkey")  # else one piece of the file is one task of Python
    return part.select("p_partkey", M.same_values_column(a, b).alias("same"))
