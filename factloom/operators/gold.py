"""Gold units: pointers that hold, rules of a unit, second checks, and the truth that is built of the last units of sealed cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import documents, metrics
from factloom.operators.review import GOLD, first_error, latest

# Critical fields of the review schema.
CRITICAL = ("isin", "currency", "maturity", "coupon_type", "coupon_rate", "call_put_terms", "underlying", "coupon_barrier", "protection_barrier", "redemption")
FIELDS = tuple(f for fields in documents.FAMILIES.values() for f in fields)
ASCII = r"^[\x00-\x7F]*$"


def folded(text: Column) -> Column:
    """Compatibility forms made one, case folded, white space squeezed. ASCII stays in Spark; other text goes to Python by Arrow."""

    def work(x: pd.Series) -> pd.Series:
        return x.map(metrics.canonical_text, na_action="ignore")

    plain = text.rlike(ASCII)
    return F.when(plain, F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))).otherwise(F.pandas_udf(work, "string")(F.when(~plain, text)))


def pointer_error(p: dict[str, Column]) -> Column:
    """What is wrong with an evidence pointer, in the order of the checks; NULL if it holds.

    p: doc_id, authorized, page, bbox (array l, t, r, b), excerpt, sha; of the document doc_sha (of its bytes, NULL: no such document) and known_sha (as
    recorded); of the page width, height, page_text (NULL width: no such page). Box, excerpt and digest may be missing.
    """
    box, at = p["bbox"], lambda i: F.get(p["bbox"], i)
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    inside = (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= p["width"] * 1.02) & (at(3) >= 0) & (at(3) < at(1)) & (at(1) <= p["height"] * 1.02)
    said = F.contains(folded(p["page_text"]), folded(p["excerpt"]))
    return first_error(
        (L.valid_id(p["doc_id"]), "document not found: invalid id"), (p["authorized"], "document not authorized for case"), (p["page"] >= 1, "page must be a positive integer"),
        (box.isNull() | (F.size(box) == 4) & finite, "bbox must contain four finite numbers"), (p["sha"].isNull() | p["sha"].rlike("^[0-9a-f]{64}$"), "invalid sha256"), (p["doc_sha"].isNotNull(), "document not found"),
        (p["known_sha"].isNull() | (p["known_sha"] == p["doc_sha"]), "snapshot sha256 mismatch"), (p["sha"].isNull() | (p["sha"] == p["doc_sha"]), "sha256 mismatch vs source"), (p["width"].isNotNull(), "page out of range"),
        (box.isNull() | inside, "bbox outside page bounds"), (p["excerpt"].isNull() | (p["excerpt"] == "") | said, "excerpt not present in page text"),
    )


def value_in_page(values: Column, pages: Column) -> Column:
    """Whether one of the pointed pages (folded texts) has all words of the values (folded)."""
    words = F.filter(F.flatten(F.transform(values, lambda v: F.split(v, " "))), lambda w: w != "")
    return F.coalesce(F.exists(pages, lambda p: p.isNotNull() & F.forall(words, lambda w: F.contains(p, w))), F.lit(False))


def second_check(method: Column, hits: Column, pages: Column, values: Column, texts: Column, match: Column, raw: Column) -> Column:
    """PASS or why a second check fails: a scan for terms without hits, excerpts on two pages, a value's words on a pointed page, or a text in the raw document.

    hits: how many there are of the terms; pages: numbers pointed to; values, texts: folded, as for value_in_page; match, raw: folded.
    """
    two = F.size(F.array_distinct(pages)) >= 2
    return (
        F.when(method.isNull(), "missing second_check").when(method == "absence_scan", F.when(hits == 0, "PASS").otherwise("absence_scan hits"))
        .when(method == "dual_excerpt", F.when(two, "PASS").otherwise("dual_excerpt needs 2 pages")).when(method == "value_in_page", F.when(value_in_page(values, texts), "PASS").otherwise("value not in page"))
        .when(method == "pdf_text_check", F.when(F.contains(raw, match), "PASS").otherwise("pdf_text_check miss")).otherwise("unknown second_check")
    )


def unit_error(u: dict[str, Column]) -> Column:
    """Which rule a gold unit breaks, in the order of the checks; NULL if it can be recorded.

    u: field, status, has_value, n_pointers, pointer_error (of the first pointer that doesn't hold), method and result of its second check, found (whether
    the value's words are on a pointed page).
    """
    confirmed, critical = u["status"] == "CONFIRMED_VALUE", u["field"].isin(*CRITICAL)
    return F.coalesce(
        first_error(
            (u["field"].isin(*FIELDS), "unknown field"), (u["status"].isin(*GOLD), "not a gold status"), (~confirmed | u["has_value"], "CONFIRMED_VALUE requires a value"), (~confirmed | (u["n_pointers"] > 0), "CONFIRMED_VALUE requires evidence pointer"),
            ((u["status"] != "CONFLICT") | (u["n_pointers"] > 0), "CONFLICT requires evidence of both readings"),
        ),
        F.when(u["pointer_error"].isNotNull(), F.concat(F.lit("BROKEN_EVIDENCE: "), u["pointer_error"])),
        first_error((~critical | F.coalesce(u["result"] == "PASS", F.lit(False)), "critical field requires second_check PASS"), (~critical | ~confirmed | F.coalesce(u["method"] != "value_in_page", F.lit(True)) | u["found"], "second_check value_in_page FAILED")),
    )


def truth_units(sealed: DataFrame, log: DataFrame) -> DataFrame:
    """The last unit of each field of the sealed cases. sealed: case_id; log: case_id, field, ordinal, and what a unit holds."""
    return latest(log.join(sealed.select("case_id").distinct(), "case_id", "left_semi"), "ordinal", "case_id", "field")


def truth_issues(sealed: DataFrame, units: DataFrame, fields: tuple[str, ...] = FIELDS, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """(case_id, field, issue, fields): a case that lacks fields, with their names; a confirmed unit without evidence; a critical one that wasn't verified.

    units: case_id, field, status, n_pointers, critical_verified, one for each case and field. Fields that aren't of the schema are no issue.
    """
    known = units.where(F.col("field").isin(*fields))
    have = known.groupBy("case_id").agg(F.collect_set("field").alias("_have"))  # a schema's fields at most
    lacks = F.array_except(F.array(*map(F.lit, fields)), F.coalesce("_have", F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    missing = sealed.select("case_id").distinct().join(have, "case_id", "left").select("case_id", none.alias("field"), F.lit("missing_fields").alias("issue"), lacks.alias("fields")).where(F.size("fields") > 0)
    found = F.array_compact(F.array(
        F.when((F.col("status") == "CONFIRMED_VALUE") & (F.coalesce("n_pointers", F.lit(0)) == 0), "confirmed_without_evidence"), F.when(F.col("field").isin(*critical) & ~F.coalesce("critical_verified", F.lit(False)), "critical_not_verified"),
    ))
    each = known.select("case_id", "field", F.explode(found).alias("issue")).withColumn("fields", F.lit(None).cast("array<string>"))
    return missing.unionByName(each)


def truth_totals(units: DataFrame, fields: tuple[str, ...] = FIELDS, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Of each status its number of units, and of critical ones those verified."""
    verified = F.col("field").isin(*critical) & F.coalesce("critical_verified", F.lit(False))
    return units.where(F.col("field").isin(*fields)).groupBy("status").agg(F.count("*").alias("n"), F.count_if(verified).alias("critical_verified"))


def authorized(cases: DataFrame, own: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, docs: what a session may open: in MANUAL mode a case's own documents, else those of its graph and those that its candidates' evidence names as well.

    cases: case_id, mode; own, nodes, evidence: case_id, doc_id.
    """
    more = nodes.select("case_id", "doc_id").unionByName(evidence.select("case_id", "doc_id")).join(cases.where("mode <> 'MANUAL'").select("case_id"), "case_id", "left_semi")
    every = own.select("case_id", "doc_id").unionByName(more).where("doc_id is not null")
    return cases.join(every.groupBy("case_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs")), "case_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))


def first_match(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each wanted (key, role; a NULL role: any) the first row (key, role, ordinal, ...), as a struct `match`; NULL without one."""
    by_role = rows.groupBy("key", "role").agg(F.min_by(F.struct("*"), "ordinal").alias("m"), F.min("ordinal").alias("o"))
    by_key = by_role.groupBy("key").agg(F.min_by("m", "o").alias("any"))
    d = wanted.join(by_role.select(F.col("key").alias("_k"), F.col("role").alias("_r"), "m"), (F.col("key") == F.col("_k")) & (F.col("role") == F.col("_r")), "left").drop("_k", "_r").join(by_key, "key", "left")
    return d.select(*wanted.columns, F.when(F.col("role").isNull(), F.col("any")).otherwise(F.col("m")).alias("match"))
