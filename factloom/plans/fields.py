"""Queries that extract labelled fields from short term sheets, one for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import extract, layout, metrics
from factloom.plans.registry import Tables, query
from factloom.sources.shared import dealt


def _sheets(t: Tables) -> DataFrame:
    """Dealt out by order, as a sheet has 13 lines, which files of keys and dates don't show: sheets are read where they lie then."""
    k = F.col("o_orderkey")
    lines = (
        F.lit("Final Terms"), F.when(k % 3 == 0, "(i) Specified Currency: U.S. dollars").otherwise("Divisa: euros"), F.lit("Aggregate Nominal"), F.concat(F.lit("Amount: "), k, F.lit(".000.000 Euros")),
        F.concat(F.lit("Rate of Interest: "), k % 7 + 1, F.lit(".5 per cent")), F.when(k % 4 == 0, "Rate of Interest: 9.25%").otherwise("Nothing else"), F.lit("Maturity Date:"), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.concat(F.lit("Issue Date: 01/02/2020"), F.when(k % 5 == 0, " · Fecha de emisión: 03/02/2020").otherwise("")), F.concat(F.lit("Day Count Fraction: "), F.when(k % 2 == 0, "ACT/ACT ICMA").otherwise("17/99")),
        F.concat(F.lit("ISIN XS"), F.lpad(k.cast("string"), 10, "0")), F.lit("Status of the Notes: Senior Preferred"), F.when(k % 6 == 0, "Put Option: 5 August 2030").when(k % 6 < 4, "Call Option: Not applicable").otherwise("Nothing more"),
    )
    return dealt(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", each=13).select(k.alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


_FIELDS = ", ".join(f"('{n}', {chr(39) + r.section + chr(39) if r.section else 'NULL'})" for n, r in extract.RULES.items())
_ALL = f"""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderdate, CAST(o_orderkey % 7 + 1 AS VARCHAR) || '.5' AS rate FROM orders), f AS (SELECT doc_id, field, section FROM o, (VALUES {_FIELDS}) AS v(field, section)),
x AS (SELECT doc_id, 'currency' AS field, 'DERIVED' AS status, 'anchored' AS class, CASE WHEN doc_id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS value FROM o UNION ALL SELECT doc_id, 'issued_amount', 'DERIVED', 'anchored', CAST(doc_id * 1000000 AS VARCHAR) || '|EUR' FROM o
UNION ALL SELECT doc_id, 'coupon_rate', CASE WHEN doc_id % 4 = 0 THEN 'OBSERVED' ELSE 'DERIVED' END, CASE WHEN doc_id % 4 = 0 THEN 'multi_aspect' ELSE 'anchored' END, rate || CASE WHEN doc_id % 4 = 0 THEN '; 9.25' ELSE '' END FROM o
UNION ALL SELECT doc_id, 'maturity', 'DERIVED', 'anchored', strftime(o_orderdate, '%Y-%m-%d') FROM o UNION ALL SELECT doc_id, 'isin', 'DERIVED', 'anchored', 'XS' || lpad(CAST(doc_id AS VARCHAR), 10, '0') FROM o
UNION ALL SELECT doc_id, 'issue_date', CASE WHEN doc_id % 5 = 0 THEN 'CONFLICT' ELSE 'DERIVED' END, CASE WHEN doc_id % 5 <> 0 THEN 'anchored' END, '2020-02-01' || CASE WHEN doc_id % 5 = 0 THEN '; 2020-02-03' ELSE '' END FROM o
UNION ALL SELECT doc_id, 'day_count', CASE WHEN doc_id % 2 = 0 THEN 'DERIVED' ELSE 'OBSERVED' END, CASE WHEN doc_id % 2 = 0 THEN 'anchored+canonical' ELSE 'unmapped_lexeme' END, CASE WHEN doc_id % 2 = 0 THEN 'ACT_ACT_ICMA' ELSE '' END FROM o
UNION ALL SELECT doc_id, 'ranking', 'DERIVED', 'anchored', 'SENIOR_PREFERRED' FROM o UNION ALL SELECT doc_id, 'subordination', 'OBSERVED', 'raw_only', '' FROM o
UNION ALL SELECT doc_id, 'put_dates', 'DERIVED', 'anchored', '2030-08-05' FROM o WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'call_dates', 'OBSERVED', 'explicit_na', 'NOT_APPLICABLE' FROM o WHERE doc_id % 6 IN (1, 2, 3))"""


@query(f"{_ALL} SELECT doc_id, field, coalesce(status, 'MISSING') AS status, class, value FROM f LEFT JOIN x USING (doc_id, field)")
def extract_fields(t: Tables) -> DataFrame:
    """All fields of each sheet, read from the whole of it."""
    d = _sheets(t)
    blocks = layout.line_blocks(d).withColumnRenamed("block", "text")
    return extract.extract_all(d, blocks).select("doc_id", "field", "status", "class", F.array_join("values", "; ").alias("value"))


@query(f"""{_ALL} SELECT field, coalesce(status, 'MISSING') AS status, CASE WHEN status IS NULL THEN CASE WHEN section = 'exercise' AND doc_id % 6 > 3 THEN 'LOCATION_MISS' ELSE 'PARSING_MISS' END END AS failure, count(*) AS n, count(DISTINCT value) AS n_values
FROM f LEFT JOIN x USING (doc_id, field) GROUP BY 1, 2, 3""")
def extract_failures(t: Tables) -> DataFrame:
    """Outcomes of fields that are read in the regions of their sections, by the kind of failure."""
    d = _sheets(t)
    r = extract.extract_by_section(d, layout.line_blocks(d).withColumnRenamed("block", "text"))
    return r.groupBy("field", "status", "failure").agg(F.count("*").alias("n"), F.count_distinct(F.array_join("values", "; ")).alias("n_values"))


@query(f"""{_ALL}, w AS (SELECT field, coalesce(status, 'MISSING') AS status, class, nullif(value, '') AS value, list_extract(['PRESENT', 'MULTI', 'ABSENT', 'NA'], CAST((doc_id + length(field)) % 4 AS INT) + 1) AS want FROM f LEFT JOIN x USING (doc_id, field)),
k AS (SELECT field, want, status = 'CONFLICT' AS conflict, status IN ('OBSERVED', 'DERIVED') AND coalesce(value, '') <> 'NOT_APPLICABLE' AS got FROM w WHERE want <> 'NA'),
c AS (SELECT field, count(*) FILTER (want <> 'ABSENT' AND got) AS tp, count(*) FILTER (want = 'ABSENT' AND got) AS fp, count(*) FILTER (want <> 'ABSENT' AND NOT got) AS fn, count(*) FILTER (want = 'ABSENT' AND NOT got) AS tn, count(*) FILTER (want <> 'ABSENT' AND conflict) AS of_conflict, CAST(0 AS BIGINT) AS of_xref FROM k GROUP BY 1)
SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, (tp + fp) / greatest(1, tp + fp + fn) AS coverage FROM c""")
def acceptance_metrics(t: Tables) -> DataFrame:
    """Extracted fields of the sheets against what was wanted of them."""
    d = _sheets(t)
    r = extract.extract_all(d, layout.line_blocks(d).withColumnRenamed("block", "text"))
    want = F.element_at(F.array(*map(F.lit, ("PRESENT", "MULTI", "ABSENT", "NA"))), ((F.col("doc_id") + F.length("field")) % 4).cast("int") + 1)
    return metrics.acceptance(r.select("field", "status", "class", F.nullif(F.array_join("values", "; "), F.lit("")).alias("value"), "lexeme", want.alias("want")), "field")


# Documents of four roles, one for each customer: final terms with a line for each field, a securities note with its values in a table, an issue document
# that is read by its boxes, and a supplement, which is not read. `#` stands for ten digits of the customer's key.
_LINES = (
    ("Final Terms", "ISIN: XS#", "Specified Currency: EUR", "Issue Date: 01/02/2020", "Maturity Date: 01/02/2030", "Specified Denomination: EUR 100,000", "Aggregate Nominal Amount: 750.000.000 Euros", "Interest Basis: Fixed Rate", "Rate of Interest: 2.5 per cent", "Floating Rate Option: EURIBOR 3 months",
     "First Margin: +0.75 per cent", "Interest Payment Date(s): 5 August in each year", "Day Count Fraction: ACT/360", "Call Option: 5 August 2028", "Put Option: 6 August 2028", "Business Day Convention: Modified Following Business Day Convention", "First Reset Date: 7 August 2026", "Relevant Screen Page: Reuters",
     "Status of the Notes: Senior Preferred", "Subordinación: Tier 2", "Final Redemption Amount: Par", "Underlying: Euro Stoxx 50", "Knock-in Barrier: 60%", "Autocall: Applicable", "Valuation Date(s): 8 August 2029", "Delivery: Cash", "Participation Rate: 80%", "Cap Rate: 5%", "Strike Price: 100%"),
    ("Securities Note", "Admission to trading", "Day count and rate of interest"),
    ("Issue of notes", "Maturity Date:", "5 August 2036", "Specified Denomination:", "Series: EUR 25.000.000"),
    ("Supplement", "ISIN: XS#"),
)
_CELLS = (("ISIN", "XS#"), ("Strike Price", "", "120%"), ("Cap Rate",), ("Series A", "5%"), ("Business days", "FRN Convention"))
_BOXES = {1: (0.0, 100.0, 50.0, 90.0), 2: (60.0, 100.0, 90.0, 90.0), 3: (0.0, 80.0, 50.0, 70.0), 4: (0.0, 60.0, 50.0, 50.0)}
_DOC_ROLES = ("FINAL_TERMS", "SECURITIES_NOTE", "ISSUE_DOC", "SUPPLEMENT")
_OWN, _FAR = "verified_verbatim", "verified_verbatim_doclevel"
_SAID = [
    *((0, f, _OWN, v) for f, v in (("isin", "XS#"), ("currency", "EUR"), ("issue_date", "2020-02-01"), ("maturity", "2030-02-01"), ("denomination", "100|EUR"), ("issued_amount", "750000000|EUR"), ("coupon_type", "Fixed Rate"), ("coupon_rate", "2.5"), ("benchmark", "EURIBOR 3 months"), ("spread", "0.75"), ("payment_frequency", "ANNUAL"),
      ("day_count", "ACT_360"), ("call_dates", "2028-08-05"), ("put_dates", "2028-08-06"), ("business_day_convention", "Modified Following Business Day Convention"), ("reset_dates", "2026-08-07"), ("fixing_rules", "Reuters"), ("ranking", "SENIOR_PREFERRED"), ("subordination", "TIER_2"), ("redemption_formula", "Par"),
      ("underlying", "Euro Stoxx 50"), ("barrier", "60"), ("autocall", "APPLICABLE"), ("observation_dates", "2029-08-08"), ("settlement_type", "Cash"), ("participation", "80"), ("cap", "5"), ("strike", "100"))),
    *((1, f, _FAR, v) for f, v in (("isin", "XS#"), ("strike", "120"), ("cap", "5"), ("business_day_convention", "FRN Convention"))),
    *((2, f, _OWN, v) for f, v in (("maturity", "2036-08-05"), ("denomination", "25000000|EUR"))),
]
_LOCATED = ((0, "general"), (0, "interest"), (0, "exercise"), (1, "general"), (1, "interest"), (2, "general"))


@query(f"""WITH f(field, section) AS (VALUES {_FIELDS}), x(shape, field, class, value) AS (VALUES {", ".join(map(str, _SAID))}), l(shape, section) AS (VALUES {", ".join(map(str, _LOCATED))})
SELECT c_custkey AS doc_id, f.field, CASE WHEN x.field IS NULL THEN 'MISSING' ELSE 'DERIVED' END AS status, x.class, replace(x.value, '#', lpad(CAST(c_custkey AS VARCHAR), 10, '0')) AS value, CASE WHEN x.field IS NULL THEN CASE WHEN f.section IS NOT NULL AND l.section IS NULL THEN 'LOCATION_MISS' ELSE 'PARSING_MISS' END END AS failure, NULL AS note
FROM customer JOIN f ON c_custkey % 4 < 3 LEFT JOIN x ON x.field = f.field AND x.shape = c_custkey % 4 LEFT JOIN l ON l.section = f.section AND l.shape = c_custkey % 4
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, 'no extractor for role SUPPLEMENT' FROM customer WHERE c_custkey % 4 = 3""")
def extract_documents(t: Tables) -> DataFrame:
    """All fields, read from text, tables and boxes by the sections of each document's role, and verified."""
    k = F.col("c_custkey")
    customers = dealt(t.customer.select("c_custkey"), "c_custkey", each=10)  # a document has about ten blocks, which files of keys don't show
    digits = F.lpad(k.cast("string"), 10, "0")
    docs = customers.select(k.alias("doc_id"), F.get(F.array(*map(F.lit, _DOC_ROLES)), (k % 4).cast("int")).alias("role"))
    lines = F.get(F.array(*(F.array(*map(F.lit, x)) for x in _LINES)), (k % 4).cast("int"))
    boxed = F.try_element_at(F.create_map(*(x for i, b in _BOXES.items() for x in (F.lit(i), F.array(*map(F.lit, b))))), F.when(k % 4 == 2, F.col("ix")))
    blocks = customers.select("c_custkey", F.posexplode(lines).alias("ix", "text")).select(k.alias("doc_id"), F.col("ix").cast("long").alias("ix"), F.floor(F.col("ix") / 10).cast("long").alias("page"), F.replace("text", F.lit("#"), digits).alias("text"), *(F.get(boxed, i).alias(c) for i, c in enumerate("ltrb")))
    rows = customers.where(k % 4 == 1).select(k.alias("doc_id"), F.lit(0).alias("table"), digits.alias("digits"), F.posexplode(F.array(*(F.array(*map(F.lit, x)) for x in _CELLS))).alias("row", "cells"))
    rows = rows.select("doc_id", "table", "row", F.transform("cells", lambda x: F.replace(x, F.lit("#"), F.col("digits"))).alias("cells"))
    r = extract.extract_documents(docs, blocks, rows)
    return r.select("doc_id", "field", "status", "class", F.when(F.size("values") > 0, F.array_join("values", "; ")).alias("value"), "failure", "note")
