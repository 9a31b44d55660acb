"""Queries that score observations against labels by classes, groups of fields, evidence and reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import metrics as M
from factloom.plans.metrics import _O, _PRF, _scored
from factloom.plans.registry import Tables, query

# lines as observations: label, status and kind of values are remainders of their keys
_LABELS, _STATUS = ("PRESENT", "MULTI", "NA", "ABSENT", "OTHER"), ("OBSERVED", "DERIVED", "CONFLICT", "MISSING")
_X = """x AS (SELECT *, CASE WHEN label IN ('PRESENT', 'MULTI') THEN CASE WHEN status = 'MISSING' THEN 'FN' WHEN v IN (1, 3, 4) THEN 'FN_NA' WHEN status = 'CONFLICT' THEN CASE WHEN v IN (2, 5) THEN 'TP' ELSE 'FN' END WHEN v = 0 THEN 'TP_RAW' ELSE 'TP' END
 WHEN label = 'NA' THEN CASE WHEN status = 'MISSING' THEN 'FN' WHEN v IN (1, 3, 4) THEN 'CORRECT_NA' WHEN v IN (2, 5) THEN 'FP' ELSE 'FP_RAW' END WHEN label = 'ABSENT' THEN CASE WHEN status = 'MISSING' THEN 'TN' WHEN v IN (1, 3, 4) THEN 'SPURIOUS_NA' WHEN v IN (2, 5) THEN 'FP' ELSE 'FP_RAW' END ELSE 'UNLABELED' END AS cls
FROM (SELECT l_orderkey AS doc_id, l_returnflag AS stratum, 'F' || CAST(CAST(l_quantity AS INT) % 7 AS VARCHAR) AS field, list_extract(['PRESENT', 'MULTI', 'NA', 'ABSENT', 'OTHER'], CAST(l_partkey % 5 AS INT) + 1) AS label, list_extract(['OBSERVED', 'DERIVED', 'CONFLICT', 'MISSING'], CAST(l_suppkey % 4 AS INT) + 1) AS status, (l_partkey + l_linenumber) % 6 AS v, l_partkey, l_suppkey FROM lineitem))"""
_C = ", ".join(f"count(*) FILTER (cls = '{c}') AS {c.lower()}" for c in M.TAXONOMY[:-1])
_S = "(tp + tp_raw) / nullif(tp + tp_raw + fp + fp_raw + spurious_na, 0) AS precision, (tp + tp_raw) / nullif(tp + tp_raw + fn + fn_na, 0) AS recall, tp + tp_raw + fn + fn_na AS n_present, tn + fp + fp_raw + spurious_na AS n_absent, correct_na AS n_na"


def _observed(t: Tables) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    v = ((F.col("l_partkey") + F.col("l_linenumber")) % 6).cast("int")
    na, none = F.lit("NOT_APPLICABLE"), F.lit(None).cast("string")
    values = F.when(v == 1, F.array(na)).when(v == 2, F.array(F.lit("x"))).when(v == 3, F.array(none)).when(v == 4, F.array().cast("array<string>")).when(v == 5, F.array(na, F.lit("y")))
    d = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("stratum"), F.concat(F.lit("F"), F.col("l_quantity").cast("int") % 7).alias("field"), pick(_LABELS, F.col("l_partkey") % 5).alias("label"), pick(_STATUS, F.col("l_suppkey") % 4).alias("status"), values.alias("values"), "l_partkey", "l_suppkey")
    return d.withColumn("cls", M.taxonomy(F.col("label"), F.col("status"), F.col("values")))


@query(f"WITH {_X}, c AS (SELECT field, count(*) AS n, {_C} FROM x GROUP BY 1) SELECT *, {_S} FROM c")
def taxonomy_scores(t: Tables) -> DataFrame:
    """Classes of observations by field, with precision and recall."""
    return M.taxonomy_scores(_observed(t), "field")


@query(f"WITH {_X}, c AS (SELECT stratum, count(*) AS n, {_C} FROM x GROUP BY 1) SELECT *, {_S} FROM c")
def taxonomy_by_stratum(t: Tables) -> DataFrame:
    return M.taxonomy_scores(_observed(t), "stratum")


_GATES = (("IDENTITY", "F0", 0.3), ("IDENTITY", "F1", 0.3), ("TERMS", "F2", 0.9), ("TERMS", "F3", 0.9), ("TERMS", "F9", 0.9), ("NONE", "F8", 0.5))


@query(f"""WITH {_X}, g(gate, field, threshold) AS (VALUES {', '.join(map(str, _GATES))}), c AS (SELECT gate, max(CAST(threshold AS DOUBLE)) AS threshold, count(*) FILTER (cls IN ('TP', 'TP_RAW')) AS tp, count(*) FILTER (cls IN ('FP', 'FP_RAW', 'SPURIOUS_NA')) AS fp, count(*) FILTER (cls IN ('FN', 'FN_NA')) AS fn FROM g LEFT JOIN x USING (field) GROUP BY 1),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c) SELECT *, CASE WHEN precision >= threshold THEN 'PASS' WHEN precision IS NOT NULL THEN 'FAIL' ELSE 'NO_EVALUABLE' END AS verdict FROM r""")
def grouped_gates(t: Tables) -> DataFrame:
    """Gates of groups of fields; one group has no field that was seen."""
    return M.grouped_gates(M.taxonomy_scores(_observed(t), "field"), t.spark.createDataFrame(list(_GATES), "gate string, field string, threshold double"))


@query(f"""WITH {_X}, e AS (SELECT stratum, l_partkey % 4 <> 0 AND l_suppkey % 9 <> 0 AND l_suppkey % 11 <> 0 AND (l_partkey % 3 <> 0 OR l_suppkey % 2 = 0) AS ok FROM x WHERE v IN (2, 4, 5))
SELECT stratum, count(*) AS total, count(*) FILTER (ok) AS backed, count(*) FILTER (ok) / count(*) AS rate, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS gate FROM e GROUP BY 1""")
def provenance_share(t: Tables) -> DataFrame:
    """Emitted values with evidence: a source, a digest, a page, and an excerpt or a lexeme."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    one = F.struct(F.lit("s").alias("source"), F.when(s % 9 != 0, "sha").alias("snapshot_sha256"), F.when(s % 11 != 0, 1).alias("page"), F.lit("x").alias("extractor"), F.when(p % 3 != 0, "said").otherwise("").alias("excerpt"))
    d = _observed(t).withColumns({"evidence": F.when(p % 4 != 0, F.array(one)).otherwise(F.array().cast("array<struct<source:string,snapshot_sha256:string,page:int,extractor:string,excerpt:string>>")), "extractor": F.lit("x"), "lexeme": F.when(s % 2 == 0, "said")})
    return M.provenance(d, "stratum")


@query(f"""WITH {_X}, d AS (SELECT stratum, doc_id, bool_or(field IN ('F1', 'F4') AND label IN ('PRESENT', 'MULTI') AND cls IN ('TP', 'TP_RAW')) AS delta FROM x GROUP BY 1, 2)
SELECT stratum, count(*) AS n_docs, count(*) FILTER (delta) AS n_delta, count(*) FILTER (delta) / count(*) AS share, CASE WHEN count(*) FILTER (delta) >= 24 THEN 'PASS' ELSE 'FAIL' END AS gate FROM d GROUP BY 1""")
def novelty_share(t: Tables) -> DataFrame:
    """Documents with something found that only documents have."""
    return M.novelty(_observed(t), ("F1", "F4"), "doc_id", "stratum")


@query(f"""WITH {_O}, r AS (SELECT o_custkey % 50 AS reviewer, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 600 ELSE 0 END) AS BIGINT) AS manual_seconds, CAST(sum(CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 600 ELSE 0 END) AS BIGINT) AS assisted_seconds FROM orders GROUP BY 1),
u AS (SELECT l_orderkey % 50 AS reviewer, {_PRF}, count(*) FILTER (outcome IN ('TP', 'TN', 'CONFLICT_OK')) AS ok FROM o GROUP BY 1)
SELECT r.*, n, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, ok / n AS completeness FROM r LEFT JOIN u USING (reviewer)""")
def reviewer_diagnostics(t: Tables) -> DataFrame:
    """Seconds in both modes and quality of each reviewer."""
    k = F.col("o_orderkey") % 2
    reviews = t.orders.select((F.col("o_custkey") % 50).alias("reviewer"), F.when(k == 0, "MANUAL").otherwise("ASSISTED").alias("mode"), (F.col("o_custkey") % 600).alias("seconds"))
    return M.reviewer_diagnostics(reviews, _scored(t).select((F.col("l_orderkey") % 50).alias("reviewer"), "outcome"))


@query("""
SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS same FROM part""")
def value_equal_json(t: Tables) -> DataFrame:
    """Values of several shapes: objects by key, lists in any order, scalars by what they denote, a list never a scalar."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    a = F.when(k == 0, F.concat(F.lit('{"amount": "1000.0", "currency": "EUR", "of": ['), size, F.lit(', "x"]}'))).when(k == 1, F.concat(F.lit('["5 de agosto de 2036", '), size, F.lit("]"))).when(k == 2, F.concat(F.lit('["'), size, F.lit('"]'))).when(k == 3, F.lit('"4.35%"')).when(k == 4, F.lit('{"a": 1}')).otherwise(F.lit("[[1, 2], [3]]"))
    b = F.when(k == 0, F.concat(F.lit('{"currency": "euro", "of": ["X", '), size, F.lit('.0], "amount": "1000"}'))).when(k == 1, F.concat(F.lit("["), size, F.lit(', "2036-08-05"]'))).when(k == 2, F.concat(F.lit('"'), size, F.lit('"'))).when(k == 3, F.lit('"4.35% of the initial nominal investment"')).when(k == 4, F.lit('{"a": 1, "b": 2}')).otherwise(F.lit("[[3], [2, 1]]"))
    return t.part.select("p_partkey", M.same_json_column(a, b).alias("same"))


_W = """w AS (SELECT 'F' || (l_suppkey % 3) AS field, l_returnflag = 'R' AS cold, list_extract(['PRESENT', 'MULTI', 'ABSENT', 'NA'], CAST(l_partkey % 4 AS INT) + 1) AS want, l_partkey % 3 AS g, CASE WHEN l_suppkey % 4 > 1 OR l_suppkey % 7 = 0 THEN [] WHEN l_linenumber % 5 = 1 THEN ['2.5'] WHEN l_linenumber % 5 = 2 THEN ['a', 'c'] WHEN l_linenumber % 5 = 3 THEN [] WHEN CAST(l_quantity AS INT) % 2 = 1 THEN ['b'] ELSE [] END AS pe
FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_partkey % 11 = 0)), k AS (SELECT *, CASE WHEN want = 'ABSENT' THEN 0 WHEN g = 0 THEN CAST(len(pe) > 0 AS INT) WHEN g = 1 THEN len(list_intersect(pe, ['2.5'])) ELSE len(list_intersect(pe, ['a', 'b'])) END AS tp FROM w WHERE want <> 'NA'),
z AS (SELECT *, CASE WHEN want <> 'ABSENT' AND g = 0 THEN 0 ELSE len(pe) - tp END AS fp, CASE WHEN want = 'ABSENT' THEN 0 WHEN g = 0 THEN 1 - tp ELSE g - tp END AS fn FROM k),
s AS (SELECT field, cold, CAST(GROUPING(cold) AS TINYINT) AS "all", count(*) FILTER (want <> 'ABSENT') AS positive_gold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (want = 'ABSENT' AND len(pe) = 0) AS tn, count(*) FILTER (want = 'ABSENT' AND len(pe) > 0) AS invented FROM z GROUP BY GROUPING SETS ((field), (field, cold)))"""


@query(f"WITH {_W} SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, CASE WHEN positive_gold < 5 THEN 'UNDER_5' WHEN positive_gold < 15 THEN '5_TO_14' ELSE '15_AND_MORE' END AS tier FROM s")
def field_scores(t: Tables) -> DataFrame:
    """Fields against values that were wanted, over all and by issuers that were seen before or not."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 5
    gold = F.when(p % 3 == 1, F.array(F.lit("2.50"))).when(p % 3 == 2, F.array(F.lit("A"), F.lit(" b ")))
    values = F.when(n == 1, F.array(F.lit("2,5"))).when(n == 2, F.array(F.lit("A "), F.lit("c"))).when(n == 3, F.array(F.lit("NOT_APPLICABLE"))).when(n == 4, F.array().cast("array<string>"))
    d = t.lineitem.select(F.concat(F.lit("F"), s % 3).alias("field"), (F.col("l_returnflag") == "R").alias("cold"), F.when((F.col("l_linestatus") == "O") & (p % 11 == 0), "LIFECYCLE").alias("scope"), pick(("PRESENT", "MULTI", "ABSENT", "NA"), p % 4).alias("want"), gold.alias("gold"), pick(("OBSERVED", "DERIVED", "CONFLICT", "MISSING"), s % 4).alias("status"), F.when(s % 7 == 0, "VALUE_UNVERIFIED").alias("class"), values.alias("values"), F.when(F.col("l_quantity").cast("int") % 2 == 1, "b").otherwise("").alias("lexeme"))
    return M.field_scores(d)


@query("""WITH r AS (SELECT o_custkey % 40 AS study, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS pairs_, sum(o_orderkey % 5) AS x FROM orders GROUP BY 1),
g AS (SELECT study, CASE WHEN study % 6 = 0 THEN 20 ELSE 30 END AS pairs, CASE WHEN study % 5 = 0 THEN 0.7 ELSE 0.5 END AS m, 20 + study % 3 AS faster, CASE WHEN study % 7 = 0 THEN 0.9 ELSE 0.8 END AS ci, CASE WHEN study % 11 = 0 THEN NULL WHEN study % 4 = 0 THEN 0.95 ELSE 1.0 END AS ap, CASE WHEN study % 8 = 1 THEN 0.1 ELSE 0.9 END AS ar, study % 9 = 0 AS crit, CASE WHEN study % 10 = 3 THEN 0.9 ELSE 1.0 END AS er, study % 13 = 0 AS wrong, study % 17 <> 0 AS frozen FROM r),
h AS (SELECT study, CASE WHEN pairs < 24 THEN 'INCONCLUSIVE' WHEN m <= 0.6 AND faster >= 21 AND ci <= 0.8 THEN 'PASS' ELSE 'FAIL' END AS time, CASE WHEN coalesce(ap, 0) >= 0.99 AND ar >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS quality, CASE WHEN NOT crit AND er = 1 THEN 'PASS' ELSE 'FAIL' END AS safety, CASE WHEN NOT wrong THEN 'PASS' ELSE 'FAIL' END AS evidence, CASE WHEN frozen THEN 'PASS' ELSE 'FAIL' END AS freeze_gate FROM g)
SELECT *, CASE WHEN time = 'INCONCLUSIVE' THEN time WHEN time = 'PASS' AND quality = 'PASS' AND safety = 'PASS' AND evidence = 'PASS' AND freeze_gate = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM h""")
def study_gates(t: Tables) -> DataFrame:
    """All five gates of forty studies, each broken in some of them."""
    k, lit = F.col("study"), lambda x: F.lit(x).cast("double")
    d = t.orders.select((F.col("o_custkey") % 40).alias("study")).distinct()
    d = d.withColumns({
        "pairs": F.when(k % 6 == 0, 20).otherwise(30), "median_ratio": F.when(k % 5 == 0, lit(0.7)).otherwise(lit(0.5)), "faster": 20 + k % 3, "ci_high": F.when(k % 7 == 0, lit(0.9)).otherwise(lit(0.8)), "assisted_precision": F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 4 == 0, lit(0.95)).otherwise(lit(1.0)), "manual_precision": lit(0.98),
        "assisted_recall": F.when(k % 8 == 1, lit(0.1)).otherwise(lit(0.9)), "manual_recall": lit(0.9), "critical_errors": F.when(k % 9 == 0, 1).otherwise(0), "unsupported": F.lit(0), "evidence_rate": F.when(k % 10 == 3, lit(0.9)).otherwise(lit(1.0)), "navigation_rate": lit(0.99), "nav_wrongdoc": F.when(k % 13 == 0, 1).otherwise(0), "frozen": k % 17 != 0,
    })
    return M.study_gates(d).select("study", "time", "quality", "safety", "evidence", F.col("freeze").alias("freeze_gate"), "verdict")


@query(f"""WITH {_O}, r AS (SELECT l_linestatus_ AS stratum, crit, outcome, dec, uns, ev FROM (SELECT o.stratum AS l_linestatus_, o.mode, o.outcome, o.l_orderkey % 6 = 0 AS crit, CASE WHEN o.outcome IN ('TP', 'FP_WRONG_VALUE', 'FP_INVENTED', 'FP_CONFLICT_DENIED') THEN 'CONFIRMED' END AS dec, o.l_orderkey % 50 = 0 AS uns, o.l_orderkey % 4 > 0 AS ev FROM o) WHERE mode = 'R')
SELECT stratum, count(*) FILTER (crit AND outcome IN ('FP_WRONG_VALUE', 'FP_INVENTED', 'FP_CONFLICT_DENIED')) AS critical_errors, count(*) FILTER (uns) AS unsupported, count(*) FILTER (dec = 'CONFIRMED') AS confirmed, count(*) FILTER (dec = 'CONFIRMED' AND ev) AS with_evidence, count(*) FILTER (dec = 'CONFIRMED' AND ev) / nullif(count(*) FILTER (dec = 'CONFIRMED'), 0) AS evidence_rate FROM r GROUP BY 1""")
def safety_scores(t: Tables) -> DataFrame:
    """Critical errors and evidence of assisted units."""
    k = F.col("l_orderkey")
    d = _scored(t).select(F.when(F.col("mode") == "R", "ASSISTED").otherwise("MANUAL").alias("mode"), "stratum", "outcome", (k % 6 == 0).alias("critical"), F.when(F.col("outcome").isin("TP", *M.CRITICAL), "CONFIRMED").alias("decision"), (k % 50 == 0).alias("unsupported"), (k % 4 > 0).alias("evidence_valid"))
    return M.safety(d, "stratum")


@query("""SELECT o_orderpriority AS stratum, CAST(sum(o_custkey % 9) AS BIGINT) AS nav_used, CAST(sum(o_custkey % 9 % 5) AS BIGINT) AS nav_ok, CAST(sum(CASE WHEN o_custkey % 100 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nav_wrongdoc, sum(o_custkey % 9 % 5) / nullif(sum(o_custkey % 9), 0) AS navigation_rate FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1""")
def navigation_rates(t: Tables) -> DataFrame:
    """Navigations of assisted reviews that hold."""
    c = F.col("o_custkey")
    d = t.orders.select(F.when(F.col("o_orderkey") % 2 == 1, "ASSISTED").otherwise("MANUAL").alias("mode"), F.col("o_orderpriority").alias("stratum"), (c % 9).alias("nav_used"), (c % 9 % 5).alias("nav_ok"), F.when(c % 100 == 0, 1).otherwise(0).alias("nav_wrongdoc"))
    return M.navigation_rates(d, "stratum")
