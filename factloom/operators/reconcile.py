"""Reconciliation of observations, differences of captures, and payment schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexemes as L


def reconcile(observations: DataFrame, *subject: str) -> DataFrame:
    """Status of each subject from rows of status and value: MISSING ones don't count; one source, agreement or conflict."""
    seen = F.when(F.col("status") != "MISSING", F.coalesce(F.trim(F.col("value")), F.lit("")))
    n, kinds = F.count(seen), F.count_distinct(seen)
    return observations.groupBy(*subject).agg(n.alias("n_sources"), F.when(n == 0, "MISSING").when(n == 1, "SOURCE_ONLY").when(kinds == 1, "AGREE").otherwise("CONFLICT").alias("status"), F.array_sort(F.collect_set(seen)).alias("values"))


def capture_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Change of each captured page: frames of key, code, raw_sha, rows_sha."""
    a, b = before.alias("a"), after.alias("b")
    new = F.col(f"a.{key}").isNull() & (F.col("b.code") == 200)
    change = F.when(new, "NEW").when(F.col(f"b.{key}").isNull() | (F.col("b.code") != 200), "DISAPPEARED").when(F.col("a.raw_sha") == F.col("b.raw_sha"), "UNCHANGED").when(F.col("a.rows_sha") == F.col("b.rows_sha"), "UPDATED_METADATA").otherwise("UPDATED")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def cells(html: Column, tag: str = "td") -> Column:
    """Contents of all cells, tags and runs of white space as one space, one cell a line."""
    raw = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.array_join(F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))), "\n")


def schedule(months: Column, issue: Column, maturity: Column) -> Column:
    """struct(status, n_dates, last): dates every so many months from the issue, clamped to the month's end."""
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.months_between(maturity, issue) / months).cast("int") + 1)), lambda k: F.add_months(issue, (k * months).cast("int"))), lambda d: d <= maturity)
    last = F.try_element_at(ends, F.lit(-1))
    status = F.when(issue.isNull() | maturity.isNull(), "UNVERIFIABLE").when(maturity <= issue, "INVALID").when(months.isNull(), "UNVERIFIABLE").when(F.size(ends) == 0, "INVALID").when((last != maturity) & (F.datediff(maturity, last) > months * 40), "INVALID").otherwise("VALID")
    some = (issue < maturity) & months.isNotNull()
    return F.struct(status.alias("status"), F.when(some, F.size(ends)).alias("n_dates"), F.when(some, last).alias("last"))


def check_schedule(observations: DataFrame, *doc: str) -> DataFrame:
    """The schedule of each document by its observations (field, value, lexeme) of issue date, maturity and payment frequency: status, n_dates, last.

    A frequency counts as it was written, and by its value only where nothing is.
    """
    of = lambda field, x: F.max(F.when(F.col("field") == field, x))
    written = F.coalesce(F.nullif("lexeme", F.lit("")), F.nullif("value", F.lit("")))
    d = observations.groupBy(*doc).agg(of("issue_date", F.col("value")).alias("issue"), of("maturity", F.col("value")).alias("maturity"), of("payment_frequency", written).alias("frequency"))
    s = schedule(L.schedule_months(F.col("frequency")), F.try_to_date("issue", "yyyy-MM-dd"), F.try_to_date("maturity", "yyyy-MM-dd"))
    return d.select(*doc, s.alias("s")).select(*doc, "s.*")
