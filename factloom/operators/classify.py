"""Classification of registry rows into document roles: a cascade over metadata, then titles and anchors in the text's head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Surfaces that rows are acquired from.
FINAL_TERMS_ROWS, PROSPECTUS_ROWS, ADMISSION_ROWS = "CNMV_CCFF", ("CNMV_FOLLETOS_EMISION", "CNMV_FOLLETO_DETAIL"), "CNMV_ADMISSION"
# Titles and obligatory phrases of each role, tried in this order.
TITLES = {
    "FINAL_TERMS": r"(?iu)condiciones\s+finales|final\s+terms|condiciones\s+definitivas",
    "SUPPLEMENT": r"(?iu)suplemento\s+(?:del?\s+)?(?:folleto|al\s+folleto|de\s+base)?|supplement\s+to\s+the\s+(?:base\s+)?prospectus",
    "SECURITIES_NOTE": r"(?iu)nota\s+sobre\s+los\s+valores|securities\s+note",
    "BASE_PROSPECTUS": r"(?iu)folleto\s+de\s+base|base\s+prospectus|documento\s+de\s+registro",
    "CORRECTION": r"(?iu)correcci[oó]n\s+de\s+errores|error\s+note|rectificaci[oó]n",
}
ANCHORS = {
    "FINAL_TERMS": (r"(?iu)tipo\s+de\s+inter[eé]s\s+nominal|rate\s+of\s+interest", r"(?iu)fecha\s+de\s+vencimiento|maturity\s+date", r"(?iu)importe\s+nominal|aggregate\s+(?:nominal|principal)"),
    "SECURITIES_NOTE": (r"(?iu)admisi[oó]n\s+a\s+negociaci[oó]n|admission\s+to\s+trading", r"(?iu)descripci[oó]n\s+de\s+los\s+valores|description\s+of\s+the\s+securities"),
    "BASE_PROSPECTUS": (r"(?iu)factores\s+de\s+riesgo|risk\s+factors", r"(?iu)condiciones\s+de\s+los\s+valores|terms\s+and\s+conditions"),
}
DEBT = r"(?iu)BONOS|OBLIG|C[EÉ]DULAS?|PAGAR[ÉE]S?|RENTA\s+FIJA|FTA\b|TITULIZACI"
# Fixed value: characters of a text that may name its role.
HEAD = 4000
# What the trail of a classification says.
FROM_ROWS, FROM_SUPPLEMENT, FROM_CHANGE, FROM_PROSPECTUS, FROM_ADMISSION = "surface:CNMV_CCFF row = condiciones finales", "meta:rol=SUPLEMENTO / sufijo .k", "meta:rol=MODIFICACION / sufijo -k", "surface:{} row = folleto base", "surface:CNMV_ADMISSION"
NO_ANCHORS, NO_ROLE, DENOMINATION = "anchors:none -> confidence stays MEDIUM", "fallback:UNKNOWN -> REVIEW_REQUIRED", "meta:denominacion="

DEFINING, LIFECYCLE, OUT, UNKNOWN = "INSTRUMENT_DEFINING", "LIFECYCLE", "OUT_OF_SCOPE", "UNKNOWN"


def by_metadata(surface: Column, role: Column, register: Column, denomination: Column) -> Column:
    """struct(role, scope, debt, signal) by a row's metadata; all of them but UNKNOWN are certain."""
    is_ = lambda name, scope, signal, debt=False: F.struct(F.lit(name).alias("role"), F.lit(scope).alias("scope"), F.lit(debt).alias("debt"), F.lit(signal).cast("string").alias("signal"))
    said = F.upper(role)
    return (
        F.when(surface == FINAL_TERMS_ROWS, is_("FINAL_TERMS", DEFINING, FROM_ROWS))
        .when(said.contains("SUPLEMENTO") | register.rlike(r"\.\d+$"), is_("SUPPLEMENT", LIFECYCLE, FROM_SUPPLEMENT))
        .when(said.contains("MODIFICACI") | register.rlike(r"-\d+$"), is_("CORRECTION", LIFECYCLE, FROM_CHANGE))
        .when(surface == PROSPECTUS_ROWS[0], is_("BASE_PROSPECTUS", DEFINING, FROM_PROSPECTUS.format(PROSPECTUS_ROWS[0]))).when(surface == PROSPECTUS_ROWS[1], is_("BASE_PROSPECTUS", DEFINING, FROM_PROSPECTUS.format(PROSPECTUS_ROWS[1])))
        .when((surface == ADMISSION_ROWS) & denomination.rlike(DEBT), is_("SECURITIES_NOTE", DEFINING, FROM_ADMISSION, True))
        .when(surface == ADMISSION_ROWS, is_("ISSUE_DOC", OUT, FROM_ADMISSION))
        .otherwise(is_(UNKNOWN, UNKNOWN, None))
    )


def first_match(patterns: dict[str, str], text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def anchors(role: Column, text: Column) -> Column:
    """How many kinds of obligatory phrases of its role a text has; NULL for roles that have none."""
    out = F.lit(None).cast("int")
    for name, ps in ANCHORS.items():
        out = F.when(role == name, reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in ps))).otherwise(out)
    return out


def family_key(surface: Column, register: Column, number: Column) -> Column:
    """The family of a document by its own evidence: an admission's register, a named programme, or the register's base."""
    some, base = F.when(register != "", register), F.regexp_extract(register, r"^([^.\-]*)", 1)
    return F.when(surface == ADMISSION_ROWS, F.concat(F.lit("ISSUE_ADM_"), some)).when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("PROG_"), number)).when(some.isNotNull(), F.concat(F.lit("PROG_"), base))


def classify(rows: DataFrame) -> DataFrame:
    """Adds role, scope, instrument_class, confidence, signals and family_key to rows of surface, role_text, register, denomination, number, text, and value_type if there is one.

    The first title in the text's head fills an unknown role, makes a securities note of an issue document, or lowers the
    confidence; obligatory phrases raise a middling one.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    surface, denomination = F.coalesce("surface", F.lit("")), filled("denomination")
    head = F.substring(filled("text"), 1, HEAD)
    d = rows.withColumns({"_meta": by_metadata(surface, filled("role_text"), filled("register"), denomination), "_title": first_match(TITLES, head), "_head": head})
    meta, title = F.col("_meta.role"), F.col("_title")
    found, upgraded = (meta == UNKNOWN) & title.isNotNull(), (meta == "ISSUE_DOC") & F.coalesce(title == "SECURITIES_NOTE", F.lit(False))
    conflict = F.coalesce((title != meta) & ~found & ~upgraded, F.lit(False))
    d = d.withColumns({"role": F.when(found | upgraded, title).otherwise(meta), "_found": found, "_upgraded": upgraded, "_conflict": conflict})
    d = d.withColumns({"_anchors": anchors(F.col("role"), F.col("_head")), "_middling": found | conflict})
    role, hits = F.col("role"), F.col("_anchors")
    scope = F.when(F.col("_upgraded"), DEFINING).when(F.col("_meta.scope") != UNKNOWN, F.col("_meta.scope")).when(role == "SUPPLEMENT", LIFECYCLE).when(role.isin("FINAL_TERMS", "SECURITIES_NOTE", "BASE_PROSPECTUS"), DEFINING).otherwise(UNKNOWN)
    confidence = F.when(role == UNKNOWN, "LOW").when(F.col("_middling") & ~F.coalesce(hits > 0, F.lit(False)), "MEDIUM").otherwise("HIGH")
    known = F.col("_meta.debt") | F.col("_upgraded")
    named = F.when(denomination != "", denomination).otherwise(filled("value_type")).rlike(DEBT)
    signals = F.array(
        F.col("_meta.signal"), F.when(F.col("_meta.debt"), F.concat(F.lit(DENOMINATION), F.substring(denomination, 1, 40))), F.concat(F.lit("title:"), title), F.when(F.col("_upgraded"), F.lit("title_overrides_default:securities_note")),
        F.when(F.col("_conflict"), F.concat(F.lit("conflict:meta="), meta, F.lit("!="), title)), F.when(hits > 0, F.concat(F.lit("anchors:"), hits.cast("string"))).when((hits == 0) & F.col("_middling"), F.lit(NO_ANCHORS)),
        F.when(named & ~known, F.lit("instrument:DEBT(meta)")), F.when(role == UNKNOWN, F.lit(NO_ROLE)),
    )
    return d.select(*rows.columns, "role", scope.alias("scope"), F.when(known | named, "DEBT").alias("instrument_class"), confidence.alias("confidence"), F.array_compact(signals).alias("signals"), family_key(surface, F.col("register"), F.col("number")).alias("family_key"))


def document_of_record(r: dict[str, Column], head: Column) -> Column:
    """struct of what the classifier reads, from an acquired record and its text's head."""
    return F.struct(r["acquisition_surface"].alias("surface"), r["rol"].alias("role_text"), r["registro_oficial"].alias("register"), r["denominacion"].alias("denomination"), r["tipo_valor"].alias("value_type"), r["numfol"].alias("number"), F.substring(head, 1, HEAD).alias("text"))


def lifecycle(edges: DataFrame, register: str = "register", target: str = "target") -> DataFrame:
    """Adds relation: a `.k` register supplements, a `-k` one modifies the document of its base register, no other."""
    base, r = F.regexp_extract(register, r"^([^.\-]+)", 1), F.col(register)
    return edges.withColumn("relation", F.when(base == F.col(target), F.when(r.rlike(r"\.\d+$"), "SUPPLEMENTS").when(r.rlike(r"-\d+$"), "MODIFIES")))
