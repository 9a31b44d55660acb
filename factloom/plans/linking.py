"""Queries that put every branch of the link rules and of the classifier to each order: what an order's record and candidate look like is a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import classify as C
from factloom.operators import link
from factloom.plans.registry import Tables, query
from factloom.sources.shared import dealt


def _cases(lines: str, names: str) -> list[tuple[str | None, ...]]:
    """Rows of a table written as text: columns between bars, `-` for NULL, `''` for an empty text."""
    rows = [[x.strip() for x in line.split("|")] for line in lines.strip().splitlines()]
    assert all(len(r) == len(names.split()) for r in rows), rows
    return [tuple(None if x == "-" else "" if x == "''" else x for x in r) for r in rows]


# `#` stands for the order's key. Registers: # has an earlier row of another issuer, a supplement of June 2020 (and a later row of it) and one
# of 2030, and a correction without a date; #S has a single row; #Z has none.
_PAIR = "src_family src_role src_number src_register src_suffix src_isin src_issuer src_date src_doc_url cand_type cand_register cand_version cand_isin"
_PAIRS = _cases(
    """
cnmv_ccff | - | - | - | - | - | - | 01/03/2020 | - | folleto | # | base | -
cnmv_ccff | - | # | - | - | - | - | 01/03/2020 | - | folleto | - | base | -
cnmv_ccff | - | # | - | - | - | - | 01/03/2020 | - | folleto | #Z | base | -
cnmv_ccff | - | # | - | - | - | - | 01/03/2020 | - | folleto | # | supplement.1 | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | folleto | # | supplement.1 | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | folleto | # | supplement.9 | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | folleto | # | correction.2 | -
cnmv_ccff | - | # | - | - | - | - | 31/31/2020 | - | folleto | # | supplement.1 | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | folleto | # | base | -
cnmv_ccff | - | # | - | - | - | - | 01/03/2020 | - | folleto | # | base | -
cnmv_ccff | - | #S | - | - | - | - | 01/09/2020 | - | folleto | #S | base | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | folleto | # | - | -
cnmv_ccff | - | #Z | - | - | - | - | 01/09/2020 | - | folleto | #Z | base | -
cnmv_ccff | - | # | - | - | - | - | 01/09/2020 | - | security | # | base | -
cnmv_folletos_emision | SUPLEMENTO | - | # | - | - | - | - | - | folleto | # | - | -
cnmv_folletos_emision | SUPLEMENTO 1 | - | # | .1 | - | - | - | - | folleto | # | - | -
cnmv_folletos_emision | SUPLEMENTO | - | # | .1 | - | - | - | - | folleto | #S | - | -
cnmv_folletos_emision | SUPLEMENTO | - | # | .1 | - | - | - | - | security | # | - | -
cnmv_admision | SUPLEMENTO | - | # | .1 | - | - | - | - | folleto | # | - | -
cnmv_folletos_emision | Modificación | - | # | -2 | - | - | - | - | folleto | # | - | -
cnmv_folletos_emision | MODIFICACION | - | # | -2 | - | - | - | - | folleto | #S | - | -
cnmv_folletos_emision | MODIFICACION | - | # | -2 | - | - | - | - | none | - | - | -
cnmv_admision | - | - | # | - | '' | - | - | - | security | - | - | I1-#
cnmv_admision | - | - | # | - | I1-# | - | - | - | admision_doc | - | - | I1-#
cnmv_admision | - | - | # | - | I2-# | - | - | - | admission | - | - | I2-#
cnmv_admision | - | - | # | - | I2-# | - | - | - | security | - | - | I2-#
cnmv_admision | - | - | # | - | I2-# | - | - | - | security | - | - | I1-#
cnmv_admision | - | - | # | - | I2-# | - | - | - | none | - | - | -
cnmv_admision | SERIE A | - | # | - | - | - | - | - | none | - | - | -
cnmv_folletos_emision | SERIE A | - | # | - | - | - | - | - | venue | - | - | -
cnmv_folletos_emision | SERIE A | - | # | - | - | - | - | http://x | venue | - | - | -
cnmv_folletos_emision | SERIE B | - | # | - | - | - | - | http://x | folleto | #S | - | -
cnmv_folletos_emision | SERIE B | - | # | - | - | - | - | http://x | folleto | # | - | -
cnmv_folletos_emision | SERIE B | - | # | - | - | - | - | - | folleto | # | - | -
cnmv_folletos_emision | SERIE B | - | # | - | - | - | - | - | security | # | - | -
cnmv_folletos_emision | PROGRAMA RENTA FIJA | - | # | - | - | B | - | - | folleto | #Z | - | -
cnmv_folletos_emision | PROGRAMA RENTA FIJA | - | #N | - | - | A | - | - | folleto | # | - | -
cnmv_folletos_emision | PROGRAMA RENTA FIJA | - | # | - | - | B | - | - | folleto | # | - | -
cnmv_folletos_emision | DOC. REGISTRO | - | #N | - | - | B | - | - | folleto | # | - | -
cnmv_folletos_emision | PROGRAMA RENTA FIJA | - | #N | - | - | B | - | - | folleto | # | - | -
cnmv_folletos_emision | PROGRAMA | - | #N | - | - | B | - | - | folleto | # | - | -
portfolio_exchange | - | - | - | - | I9-# | - | - | - | security | - | - | I9-#
portfolio_exchange | - | - | - | - | I9-# | - | - | - | security | - | - | I8-#
portfolio_exchange | - | - | - | - | I9-# | - | - | - | folleto | # | - | -
portfolio_exchange | - | - | - | - | - | - | - | - | none | - | - | -
""",
    _PAIR,
)
# What each of them must give: decision, relation, rule and version, number of items of evidence for and against.
_WANTED = _cases(
    """
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
NO_LINK | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
NO_LINK | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 1 | 1
EXACT_LINK | DEFINES_TERMS_FOR | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 3 | 0
EXACT_LINK | DEFINES_TERMS_FOR | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 3 | 0
EXACT_LINK | DEFINES_TERMS_FOR | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 3 | 0
EXACT_LINK | DEFINES_TERMS_FOR | CNMV_CCFF_EXPLICIT_NUMFOL | 1.1 | 2 | 0
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
AMBIGUOUS | - | CNMV_SUPPLEMENT_SUFFIX | 1.0 | 0 | 1
EXACT_LINK | SUPPLEMENTS | CNMV_SUPPLEMENT_SUFFIX | 1.0 | 2 | 0
NO_LINK | - | CNMV_SUPPLEMENT_SUFFIX | 1.0 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
EXACT_LINK | CORRECTS | CNMV_MODIFICATION_DASH | 1.0 | 2 | 0
NO_LINK | - | CNMV_MODIFICATION_DASH | 1.0 | 0 | 1
NO_LINK | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
AMBIGUOUS | - | CNMV_ADMISSION_ISIN | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_ADMISSION_ISIN | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_ADMISSION_ISIN | 1.1 | 0 | 1
EXACT_LINK | ADMISSION_OF | CNMV_ADMISSION_ISIN | 1.1 | 2 | 0
NO_LINK | - | CNMV_ADMISSION_ISIN | 1.1 | 0 | 1
NO_LINK | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
NO_LINK | - | CNMV_SERIE_NO_DOC | 1.1 | 0 | 1
NO_LINK | - | CNMV_SERIE_NO_DOC | 1.1 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
NO_LINK | - | CNMV_SERIE_NO_DOC | 1.1 | 0 | 1
EXACT_LINK | DEFINES_TERMS_FOR | CNMV_SERIE_NO_DOC | 1.1 | 2 | 0
AMBIGUOUS | - | CNMV_SERIE_NO_DOC | 1.1 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
AMBIGUOUS | - | CNMV_PROGRAMME_SUCCESSION | 1.1 | 0 | 1
NO_LINK | - | CNMV_PROGRAMME_SUCCESSION | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_PROGRAMME_SUCCESSION | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_PROGRAMME_SUCCESSION | 1.1 | 0 | 1
AMBIGUOUS | - | CNMV_PROGRAMME_SUCCESSION | 1.1 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
EXACT_LINK | DEFINES_TERMS_FOR | PSE_INSTRUMENT_DOC | 1.0 | 2 | 0
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
AMBIGUOUS | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
NO_LINK | - | NO_EVIDENCE_FALLBACK | 1.0 | 0 | 1
""",
    "decision relation rule_id rule_version n_positive n_negative",
)
assert len(_PAIRS) == len(_WANTED)
_KNOWN = _cases(
    """
#  | -  | 01/01/2020 | PROGRAMA RENTA FIJA | A | 1
#  | -  | 01/01/2020 | PROGRAMA RENTA FIJA | B | 9
#  | .1 | 01/06/2020 | SUPLEMENTO          | A | 2
#  | .1 | 01/01/2030 | SUPLEMENTO          | A | 3
#  | -2 | -          | MODIFICACION        | A | 4
#S | -  | 01/01/2020 | DOC. REGISTRO       | B | 1
""",
    "register suffix date role issuer ordinal",
)


def _values(rows: list[tuple[str | None, ...]]) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(map(lit, r))})" for i, r in enumerate(rows))


def _spread(t: Tables, rows: list[tuple[str | None, ...]], names: str, each: bool = False) -> DataFrame:
    """A row of the table for each order, or all of them for each, with the order's key in place of `#`."""
    cols = names.split()
    table = t.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "case int, " + ", ".join(f"{c} string" for c in cols))
    orders = dealt(t.orders.select("o_orderkey"), "o_orderkey", each=len(rows) if each else 1)
    orders = orders if each else orders.select("o_orderkey", (F.col("o_orderkey") % len(rows)).cast("int").alias("case"))
    if each:
        d = orders.withColumn("case", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(F.broadcast(table), "case")  # a literal table
    else:
        d = orders.join(F.broadcast(table), "case")
    return d.select("o_orderkey", "case", *(F.replace(c, F.lit("#"), F.col("o_orderkey").cast("string")).alias(c) for c in cols))


@query(f"""
WITH w(k, decision, relation, rule_id, rule_version, n_positive, n_negative) AS (VALUES {_values(_WANTED)})
SELECT o_orderkey, decision, relation, rule_id, rule_version, CAST(n_positive AS INT) AS n_positive, CAST(n_negative AS INT) AS n_negative, CASE decision WHEN 'EXACT_LINK' THEN 'AUTO_LINKED' WHEN 'NO_LINK' THEN 'NO_LINK' ELSE 'REVIEW_REQUIRED' END AS operation FROM orders JOIN w ON k = o_orderkey % {len(_PAIRS)}""")
def link_rules(t: Tables) -> DataFrame:
    """Each branch of each rule, with what is known of registers, versions, supplements and ISINs joined to the pairs."""
    pairs = _spread(t, _PAIRS, _PAIR).withColumn("src_date", L.register_date(F.col("src_date")))
    known = _spread(t, _KNOWN, "register suffix date role issuer ordinal", each=True).withColumns({"date": L.register_date(F.col("date")), "ordinal": F.col("ordinal").cast("int")})
    admissions = t.orders.select(F.explode(F.array(F.concat(F.lit("I1-"), "o_orderkey"), F.concat(F.lit("I1-"), "o_orderkey"), F.concat(F.lit("I2-"), "o_orderkey"))).alias("isin"))
    d = link.adjudicate(link.with_knowledge(pairs, known, admissions))
    return d.select("o_orderkey", "decision", "relation", "rule_id", "rule_version", F.size("positive").alias("n_positive"), F.size("negative").alias("n_negative"), "operation")


_ROW = "surface role_text register denomination value_type number text"
_ROWS = _cases(
    """
CNMV_CCFF | SUPLEMENTO | #.1 | - | - | P# | -
CNMV_CCFF | - | # | - | BONOS | - | Final Terms; Rate of Interest; Maturity Date
CNMV_CCFF | - | # | - | - | - | Base Prospectus. Maturity date
CNMV_CCFF | - | # | - | - | - | Securities Note
CNMV_FOLLETOS_EMISION | 1er Suplemento | # | - | - | - | -
CNMV_FOLLETO_DETAIL | - | #.3 | - | - | - | Suplemento del folleto
CNMV_FOLLETOS_EMISION | Modificación | # | - | - | - | -
CNMV_FOLLETOS_EMISION | - | #-2 | - | - | - | Rectificación
CNMV_FOLLETOS_EMISION | PROGRAMA | # | - | - | - | Risk factors; terms and conditions
CNMV_FOLLETO_DETAIL | - | # | - | - | - | Final terms and risk factors
CNMV_ADMISSION | - | # | Bonos simples | - | - | -
CNMV_ADMISSION | - | # | ACCIONES | - | - | -
CNMV_ADMISSION | - | - | ACCIONES | - | - | Securities Note; admission to trading
CNMV_ADMISSION | - | # | ACCIONES | - | - | Folleto de base
OTHER | - | # | - | - | - | -
OTHER | - | - | - | - | - | Supplement to the prospectus
OTHER | - | #-x.y | - | CÉDULAS | - | Condiciones  finales; importe nominal
OTHER | - | # | - | - | N# | Base Prospectus
OTHER | - | # | - | - | - | Corrección de errores
OTHER | - | # | - | - | - | ~Final terms
""",
    _ROW,
)
_CLASSES = _cases(
    """
FINAL_TERMS | INSTRUMENT_DEFINING | - | HIGH | surface:CNMV_CCFF row = condiciones finales | PROG_P#
FINAL_TERMS | INSTRUMENT_DEFINING | DEBT | HIGH | surface:CNMV_CCFF row = condiciones finales,title:FINAL_TERMS,anchors:2,instrument:DEBT(meta) | PROG_#
FINAL_TERMS | INSTRUMENT_DEFINING | - | HIGH | surface:CNMV_CCFF row = condiciones finales,title:BASE_PROSPECTUS,conflict:meta=FINAL_TERMS!=BASE_PROSPECTUS,anchors:1 | PROG_#
FINAL_TERMS | INSTRUMENT_DEFINING | - | MEDIUM | surface:CNMV_CCFF row = condiciones finales,title:SECURITIES_NOTE,conflict:meta=FINAL_TERMS!=SECURITIES_NOTE,anchors:none -> confidence stays MEDIUM | PROG_#
SUPPLEMENT | LIFECYCLE | - | HIGH | meta:rol=SUPLEMENTO / sufijo .k | PROG_#
SUPPLEMENT | LIFECYCLE | - | HIGH | meta:rol=SUPLEMENTO / sufijo .k,title:SUPPLEMENT | PROG_#
CORRECTION | LIFECYCLE | - | HIGH | meta:rol=MODIFICACION / sufijo -k | PROG_#
CORRECTION | LIFECYCLE | - | HIGH | meta:rol=MODIFICACION / sufijo -k,title:CORRECTION | PROG_#
BASE_PROSPECTUS | INSTRUMENT_DEFINING | - | HIGH | surface:CNMV_FOLLETOS_EMISION row = folleto base,anchors:2 | PROG_#
BASE_PROSPECTUS | INSTRUMENT_DEFINING | - | HIGH | surface:CNMV_FOLLETO_DETAIL row = folleto base,title:FINAL_TERMS,conflict:meta=BASE_PROSPECTUS!=FINAL_TERMS,anchors:1 | PROG_#
SECURITIES_NOTE | INSTRUMENT_DEFINING | DEBT | HIGH | surface:CNMV_ADMISSION,meta:denominacion=Bonos simples | ISSUE_ADM_#
ISSUE_DOC | OUT_OF_SCOPE | - | HIGH | surface:CNMV_ADMISSION | ISSUE_ADM_#
SECURITIES_NOTE | INSTRUMENT_DEFINING | DEBT | HIGH | surface:CNMV_ADMISSION,title:SECURITIES_NOTE,title_overrides_default:securities_note,anchors:1 | -
ISSUE_DOC | OUT_OF_SCOPE | - | MEDIUM | surface:CNMV_ADMISSION,title:BASE_PROSPECTUS,conflict:meta=ISSUE_DOC!=BASE_PROSPECTUS | ISSUE_ADM_#
UNKNOWN | UNKNOWN | - | LOW | fallback:UNKNOWN -> REVIEW_REQUIRED | PROG_#
SUPPLEMENT | LIFECYCLE | - | MEDIUM | title:SUPPLEMENT | -
FINAL_TERMS | INSTRUMENT_DEFINING | DEBT | HIGH | title:FINAL_TERMS,anchors:1,instrument:DEBT(meta) | PROG_#
BASE_PROSPECTUS | INSTRUMENT_DEFINING | - | MEDIUM | title:BASE_PROSPECTUS,anchors:none -> confidence stays MEDIUM | PROG_N#
CORRECTION | UNKNOWN | - | MEDIUM | title:CORRECTION | PROG_#
UNKNOWN | UNKNOWN | - | LOW | fallback:UNKNOWN -> REVIEW_REQUIRED | PROG_#
""",
    "role scope instrument_class confidence signals family_key",
)
assert len(_ROWS) == len(_CLASSES)


@query(f"""
WITH w(k, role, scope, instrument_class, confidence, signals, family_key) AS (VALUES {_values(_CLASSES)})
SELECT o_orderkey, role, scope, instrument_class, confidence, signals, replace(family_key, '#', CAST(o_orderkey AS VARCHAR)) AS family_key FROM orders JOIN w ON k = o_orderkey % {len(_ROWS)}""")
def classify_cases(t: Tables) -> DataFrame:
    """Each branch of the classifier; `~` stands for so much text that what follows is beyond the head."""
    rows = _spread(t, _ROWS, _ROW).withColumn("text", F.replace("text", F.lit("~"), F.lit("x " * (C.HEAD // 2))))
    return C.classify(rows).select("o_orderkey", "role", "scope", "instrument_class", "confidence", F.array_join("signals", ",").alias("signals"), "family_key")
