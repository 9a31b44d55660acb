"""Tri-state linkage of source records to candidates: an ordered ladder of rules, the first decision wins, none is forced.

What is known of registers (rows, versions, supplements, siblings of an ISIN) is joined to the pairs first; a rule is then an
expression over one row. Every decision carries the rule, its version, and evidence for and against.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexemes as L

EXACT, NO_LINK, AMBIGUOUS = "EXACT_LINK", "NO_LINK", "AMBIGUOUS"
# Families of source records, roles of programmes, types of candidates that an admission may be linked to.
FINAL_TERMS, PROSPECTUS, ADMISSION, PORTFOLIO = "cnmv_ccff", "cnmv_folletos_emision", "cnmv_admision", "portfolio_exchange"
PROGRAMMES = ("PROGRAMA RENTA FIJA", "DOC. REGISTRO UNIVERSAL", "DOC. REGISTRO")
ADMITTED = ("security", "admission", "admision_doc")
COLUMNS = (
    "src_family", "src_key", "src_role", "src_number", "src_register", "src_suffix", "src_isin", "src_issuer", "src_date", "src_doc_url", "cand_type", "cand_key", "cand_register", "cand_version", "cand_isin",
    "cand_date", "earlier_supplements", "cand_known", "cand_issuer", "cand_role", "isin_siblings",
)


def _said(*parts: Column | str) -> Column:
    """One item of evidence; what is NULL is written `?`."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column) else F.lit(p) for p in parts))


class Rule:
    """The decisions of one rule, with its name and version in each."""

    def __init__(self, name: str, version: str):
        self.name, self.version = name, version

    def __call__(self, decision: str, relation: str | None = None, pro: tuple[Column, ...] = (), contra: tuple[Column, ...] = ()) -> Column:
        items = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
        return F.struct(F.lit(decision).alias("decision"), F.lit(relation).cast("string").alias("relation"), F.lit(self.name).alias("rule_id"), F.lit(self.version).alias("rule_version"), items(pro).alias("positive"), items(contra).alias("negative"))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def explicit_number(c: dict[str, Column]) -> Column:
    """Final terms that name the prospectus number; later versions and earlier supplements leave it open."""
    d = Rule("CNMV_CCFF_EXPLICIT_NUMFOL", "1.1")
    named = _said("the row names prospectus ", c["src_number"])
    versioned = _filled(c["cand_version"]) & (c["cand_version"] != "base")
    version = _said("version ", c["cand_version"], " of ", c["cand_date"])
    return F.when(
        (c["src_family"] == FINAL_TERMS) & (c["cand_type"] == "folleto"),
        F.when(c["src_number"].isNull(), d(AMBIGUOUS, contra=(F.lit("the row names no prospectus"),)))
        .when(c["cand_register"].isNull(), d(AMBIGUOUS, contra=(F.lit("the candidate has no register"),)))
        .when(c["src_number"] != c["cand_register"], d(NO_LINK, contra=(_said("the row names ", c["src_number"], ", the candidate is ", c["cand_register"]),)))
        .when(versioned & (c["cand_date"].isNull() | c["src_date"].isNull()), d(AMBIGUOUS, contra=(_said(version, " can't be dated"),)))
        .when(versioned & (c["cand_date"] > c["src_date"]), d(NO_LINK, contra=(_said(version, " is later than the row"),)))
        .when(versioned, d(AMBIGUOUS, contra=(_said(version, " may be the one in force or not"),)))
        .when((c["cand_version"] == "base") & (c["earlier_supplements"] > 0), d(AMBIGUOUS, pro=(named,), contra=(_said(c["earlier_supplements"], " supplements are earlier"),)))
        .otherwise(d(EXACT, "DEFINES_TERMS_FOR", pro=(named, F.when(F.coalesce(c["cand_known"], F.lit(False)), F.lit("the register is known"))))),
    )


def supplement_suffix(c: dict[str, Column]) -> Column:
    """A supplement of register X.k belongs to prospectus X."""
    d = Rule("CNMV_SUPPLEMENT_SUFFIX", "1.0")
    return F.when(
        (c["src_family"] == PROSPECTUS) & c["src_role"].startswith("SUPLEMENTO") & (c["cand_type"] == "folleto"),
        F.when(~_filled(c["src_suffix"]), d(AMBIGUOUS, contra=(F.lit("a supplement without a suffix"),)))
        .when(c["src_register"].eqNullSafe(c["cand_register"]), d(EXACT, "SUPPLEMENTS", pro=(_said(c["src_register"], c["src_suffix"], " refers to ", c["src_register"]),)))
        .otherwise(d(NO_LINK, contra=(_said("a supplement of ", c["src_register"], " with ", c["cand_register"]),))),
    )


def modification_dash(c: dict[str, Column]) -> Column:
    """A modification of register X-k corrects document X."""
    d = Rule("CNMV_MODIFICATION_DASH", "1.0")
    return F.when(
        (c["src_family"] == PROSPECTUS) & F.upper(c["src_role"]).contains("MODIFICACI") & (c["cand_type"] == "folleto"),
        F.when(c["src_register"].eqNullSafe(c["cand_register"]), d(EXACT, "CORRECTS", pro=(_said("a modification of ", c["src_register"]),))).otherwise(d(NO_LINK, contra=(_said("a modification of ", c["src_register"], " with ", c["cand_register"]),))),
    )


def admission_isin(c: dict[str, Column]) -> Column:
    """An admission belongs to the security of its ISIN; the ISIN never tells which document it is."""
    d = Rule("CNMV_ADMISSION_ISIN", "1.1")
    return F.when(
        (c["src_family"] == ADMISSION) & c["cand_type"].isin(*ADMITTED),
        F.when(~_filled(c["src_isin"]), d(AMBIGUOUS, contra=(F.lit("the row has no ISIN"),)))
        .when((c["cand_type"] != "security") & (c["isin_siblings"] > 1), d(AMBIGUOUS, contra=(_said(c["isin_siblings"], " admissions share ", c["src_isin"]),)))
        .when(c["cand_type"] != "security", d(AMBIGUOUS, contra=(F.lit("an ISIN names the instrument, not a document"),)))
        .when(c["src_isin"] == c["cand_isin"], d(EXACT, "ADMISSION_OF", pro=(_said("the same ISIN ", c["src_isin"]),)))
        .otherwise(d(NO_LINK, contra=(_said(c["cand_isin"], " is not ", c["src_isin"]),))),
    )


def series(c: dict[str, Column]) -> Column:
    """A row of a fund's series is linked to its prospectus only by a document of its own."""
    d = Rule("CNMV_SERIE_NO_DOC", "1.1")
    folleto, own = c["cand_type"] == "folleto", _filled(c["src_doc_url"])
    return F.when(
        c["src_role"].startswith("SERIE"),
        F.when(c["cand_type"] == "none", d(NO_LINK, contra=(F.lit("a series without a document"),)))
        .when((c["cand_type"] == "venue") & ~own, d(NO_LINK, contra=(F.lit("a series that isn't admitted"),)))
        .when(folleto & ~c["src_register"].eqNullSafe(c["cand_register"]), d(NO_LINK, contra=(_said("a series of ", c["src_register"], " with ", c["cand_register"]),)))
        .when(folleto & own, d(EXACT, "DEFINES_TERMS_FOR", pro=(F.lit("the row links a document of its own"),)))
        .when(folleto, d(AMBIGUOUS, contra=(F.lit("the fund's prospectus is no document of the series"),))),
    )


def succession(c: dict[str, Column]) -> Column:
    """Consecutive programmes of an issuer: no row says that one replaces another."""
    d = Rule("CNMV_PROGRAMME_SUCCESSION", "1.1")
    known = F.coalesce(c["cand_known"], F.lit(False))
    other = c["src_register"].eqNullSafe(c["cand_register"]) | ~c["src_role"].eqNullSafe(c["cand_role"])
    return F.when(
        (c["src_family"] == PROSPECTUS) & (c["cand_type"] == "folleto") & c["src_role"].isin(*PROGRAMMES),
        F.when(~known, d(AMBIGUOUS, contra=(F.lit("the candidate isn't known"),)))
        .when(~c["src_issuer"].eqNullSafe(c["cand_issuer"]), d(NO_LINK, contra=(F.lit("another issuer"),)))
        .when(other, d(AMBIGUOUS, contra=(F.lit("one issuer, but nothing of a succession"),)))
        .otherwise(d(AMBIGUOUS, contra=(_said("one issuer and role; that ", c["cand_register"], " is earlier declares no succession"),))),
    )


def instrument(c: dict[str, Column]) -> Column:
    """A document listed for an instrument belongs to the security of its ISIN; otherwise later rules decide."""
    same = (c["src_family"] == PORTFOLIO) & (c["cand_type"] == "security") & _filled(c["src_isin"]) & (c["src_isin"] == c["cand_isin"])
    return F.when(same, Rule("PSE_INSTRUMENT_DOC", "1.0")(EXACT, "DEFINES_TERMS_FOR", pro=(_said("the instrument's page lists the document under ", c["src_isin"]),)))


def fallback(c: dict[str, Column]) -> Column:
    d = Rule("NO_EVIDENCE_FALLBACK", "1.0")
    return F.when(c["cand_type"] == "none", d(NO_LINK, contra=(F.lit("no candidate"),))).otherwise(d(AMBIGUOUS))


LADDER = (explicit_number, supplement_suffix, modification_dash, admission_isin, series, succession, instrument, fallback)


def family_key(key: Column, register: Column, family: Column) -> Column:
    """The family of a record by its register: an issue of admissions, or a programme under the number without its version."""
    issue = F.coalesce(family == ADMISSION, F.lit(False)) | F.coalesce(key.startswith("ADM_"), F.lit(False))
    some = F.when(register != "", register)
    return F.when(issue, F.concat(F.lit("ISSUE_ADM_"), some)).otherwise(F.concat(F.lit("PROG_"), L.base_register(some)))


def _key(value: Column, rows: DataFrame | None = None) -> Column:
    """A key to join on; with `rows`, one of its own for each row where the value is NULL: it matches nothing either, but such rows don't all go to one task."""
    key = F.concat(F.lit("="), value)
    return key if rows is None else F.coalesce(key, F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string")))


def with_knowledge(pairs: DataFrame, prospectuses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Adds what the rules look up to pairs of src_register, src_date, src_isin, cand_register and cand_version (dates are dates).

    prospectuses: register, suffix, date, role, issuer, ordinal; of one register the last row counts, of one version the
    first. admissions: isin. Adds cand_known, cand_role, cand_issuer, cand_date (of the version), earlier_supplements, isin_siblings.
    """
    known = prospectuses.withColumn("_reg", _key(F.col("register")))
    rows = known.groupBy("_reg").agg(F.max_by(F.struct("role", "issuer"), "ordinal").alias("_row"))
    versions = known.where("suffix is not null").groupBy("_reg", F.col("suffix").alias("_suffix")).agg(F.min_by(F.struct("date"), "ordinal")["date"].alias("cand_date"))
    kind = F.when(F.substring_index("cand_version", ".", 1) == "supplement", ".").otherwise("-")
    d = pairs.withColumns({"_suffix": F.concat(kind, F.regexp_extract("cand_version", r"^[^.]*\.?(.*)$", 1)), "_reg": _key(F.col("cand_register"), pairs), "_isin": _key(F.col("src_isin"), pairs)})
    d = d.join(rows, "_reg", "left").join(versions, ["_reg", "_suffix"], "left")
    supplements = known.where(F.col("suffix").startswith(".") & F.col("date").isNotNull()).groupBy("_reg", "date").agg(F.count("*").alias("n"))
    asked = pairs.where("cand_register is not null and src_date is not null").select(_key(F.col("cand_register")).alias("_reg"), "src_date").distinct()
    earlier = asked.join(supplements, "_reg").where(F.col("date") < F.col("src_date")).groupBy("_reg", "src_date").agg(F.sum("n").alias("earlier_supplements"))
    siblings = admissions.where("isin <> ''").groupBy(_key(F.col("isin")).alias("_isin")).agg(F.count("*").alias("isin_siblings"))
    d = d.join(earlier, ["_reg", "src_date"], "left").join(siblings, "_isin", "left")
    zero = F.lit(0).cast("long")
    return d.select(*pairs.columns, F.col("_row").isNotNull().alias("cand_known"), F.col("_row.role").alias("cand_role"), F.col("_row.issuer").alias("cand_issuer"), "cand_date", F.coalesce("earlier_supplements", zero).alias("earlier_supplements"), F.coalesce("isin_siblings", zero).alias("isin_siblings"))


def adjudicate(pairs: DataFrame) -> DataFrame:
    """Adds decision, relation, rule_id, rule_version, positive and negative evidence, and the operation that follows, to candidate pairs; absent columns count as NULL.

    A pair that stays open is for review, with some evidence against it; one that is linked says on what identity.
    """
    c = {k: F.col(k) if k in pairs.columns else F.lit(None).cast("string") for k in COLUMNS}
    out = pairs.withColumn("_link", F.coalesce(*(rule(c) for rule in LADDER))).select(*pairs.columns, "_link.*")
    exact, no_link = F.col("decision") == EXACT, F.col("decision") == NO_LINK
    none = F.array().cast("array<string>")
    return out.withColumns({
        "operation": F.when(exact, "AUTO_LINKED").when(no_link, "NO_LINK").otherwise("REVIEW_REQUIRED"),
        "positive": F.when(exact, F.concat("positive", F.array(F.lit("identity is explicit")))).when(no_link, none).otherwise(F.col("positive")),
        "negative": F.when(~exact & ~no_link & (F.size("negative") == 0), F.array(F.lit("plausible, but not shown"))).otherwise(F.col("negative")),
        "src_family_key": family_key(c["src_key"], c["src_register"], c["src_family"]),
        "cand_family_key": family_key(F.coalesce(c["cand_key"], c["cand_register"].cast("string")), c["cand_register"].cast("string"), F.lit(None).cast("string")),
    })


# Families of records by the surface that they were acquired from.
SURFACES = {"CNMV_CCFF": FINAL_TERMS, "CNMV_FOLLETOS_EMISION": PROSPECTUS, "CNMV_FOLLETO_DETAIL": PROSPECTUS, "CNMV_ADMISSION": ADMISSION}


def source_of_record(r: dict[str, Column]) -> Column:
    """struct of a source for the rules from an acquired record: its family, register and version apart, a role, and for final terms the number they name."""
    family = F.try_element_at(F.create_map(*(F.lit(x) for kv in SURFACES.items() for x in kv)), r["acquisition_surface"])
    reg = r["registro_oficial"]
    suffix = F.when(reg.contains("."), F.regexp_extract(reg, r"^[^.]*(\..*)$", 1)).otherwise(F.regexp_extract(reg, r"(-[0-9]+)$", 1))
    base = F.substring(reg, F.lit(1), F.length(reg) - F.length(suffix))
    number = F.when(r["acquisition_surface"] == "CNMV_CCFF", r["numfol"])
    return F.struct(family.alias("src_family"), r["source_record_key"].alias("src_key"), F.coalesce(F.nullif(r["denominacion"], F.lit("")), r["document_role"]).alias("src_role"), number.alias("src_number"), base.alias("src_register"), F.nullif(suffix, F.lit("")).alias("src_suffix"), r["isin"].alias("src_isin"), r["issuer"].alias("src_issuer"), L.register_date(r["fecha_registro"]).alias("src_date"), r["document_url"].alias("src_doc_url"))


def candidate(kind: str, register: Column | None = None, isin: Column | None = None, version: Column | None = None) -> Column:
    """struct of a candidate for the rules."""
    some = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(F.lit(kind).alias("cand_type"), some(register).alias("cand_register"), some(isin).alias("cand_isin"), some(version).alias("cand_version"))


def enriched(cases: DataFrame, observed: DataFrame, key: str, *columns: str) -> DataFrame:
    """Cases with the columns of the observation of the same key where their own are NULL or empty."""
    seen = observed.select(key, *(F.col(c).alias("_" + c) for c in columns))
    own = reduce(lambda d, c: d.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), "_" + c)), columns, cases.join(seen, key, "left"))
    return own.drop(*("_" + c for c in columns))


def link_metrics(pairs: DataFrame, label: str = "label", *by: str) -> DataFrame:
    """Precision, recall, coverage, review rate and forced links of adjudicated pairs with labels."""
    auto, exact = F.col("operation") == "AUTO_LINKED", F.col(label) == EXACT
    n = lambda c: F.count_if(c)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), n(auto & exact).alias("tp"), n(auto & ~exact).alias("fp"), n(~auto & exact).alias("fn"),
        n(auto & (F.col(label) == AMBIGUOUS)).alias("forced"), n(F.col("operation") == "REVIEW_REQUIRED").alias("review"),
        F.try_divide(n(auto & exact), n(auto)).alias("precision"), F.try_divide(n(auto & exact), n(exact)).alias("recall"), F.try_divide(n(F.col("operation") == "REVIEW_REQUIRED"), F.count("*")).alias("review_rate"),
    )
