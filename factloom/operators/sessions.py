"""Review sessions, agreement of reviewers, support of fields, and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.review import first_error
from factloom.operators.sampling import hash_order


def alternating(cases: DataFrame, session: str, key: str, n: int, seed: int) -> DataFrame:
    """Of each session the first n cases in hash order, in turn assisted and manual: session, key, place, mode, status."""
    w = Window.partitionBy(session).orderBy(hash_order(key, seed), key)
    d = cases.select(session, key).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("place", F.col("place") - 1)  # cut to n before the shuffle
    return d.withColumns({"mode": F.when(F.col("place") % 2 == 0, "ASSISTED").otherwise("MANUAL"), "status": F.lit("PENDING")})


def crossed(assignments: DataFrame, order: DataFrame, warmups: DataFrame, sample: DataFrame) -> DataFrame:
    """Sessions of frozen assignments: reviewer, case_id, warmup, place, mode, status; warm-ups first, all of them assisted.

    assignments: reviewer, case_id, mode; order: reviewer, case_id, place; warmups: reviewer, case_id, place; sample: case_id, warmup.
    """
    none = sample.where("warmup").select("case_id")
    first = warmups.join(none, "case_id", "left_semi").select("reviewer", "case_id", F.lit(True).alias("warmup"), "place", F.lit("ASSISTED").alias("mode"))
    rest = order.join(assignments, ["reviewer", "case_id"]).select("reviewer", "case_id", F.lit(False).alias("warmup"), "place", "mode")
    return first.unionByName(rest).withColumn("status", F.lit("PENDING"))


def assignment_errors(assignments: DataFrame, order: DataFrame, warmups: DataFrame, sample: DataFrame) -> DataFrame:
    """(reviewer, case_id, error) where assignments, order and sample differ as sets, or one names a case twice."""
    held, trial = sample.where("not warmup").select("case_id"), sample.where("warmup").select("case_id")
    twice = lambda d, what: d.groupBy("reviewer", "case_id").agg(F.count("*").alias("n")).where("n > 1").select("reviewer", "case_id", F.lit(f"twice in {what}").alias("error"))
    beyond = lambda d, s, what: d.join(s, "case_id", "left_anti").select("reviewer", "case_id", F.lit(f"{what} is not in the sample").alias("error"))
    seen = assignments.select("reviewer", "case_id").distinct()
    unordered = seen.join(order, ["reviewer", "case_id"], "left_anti").select("reviewer", "case_id", F.lit("without a place").alias("error"))
    unassigned = order.join(seen, ["reviewer", "case_id"], "left_anti").select("reviewer", "case_id", F.lit("without a mode").alias("error"))
    both = trial.join(held, "case_id", "left_semi").select(F.lit(None).cast("string").alias("reviewer"), "case_id", F.lit("in both samples").alias("error"))
    unseen = held.join(seen.select("case_id").distinct(), "case_id", "left_anti").select(F.lit(None).cast("string").alias("reviewer"), "case_id", F.lit("assigned to nobody").alias("error"))
    out = twice(assignments, "assignments")
    for d in (twice(order, "order"), twice(warmups, "warm-ups"), beyond(assignments, held, "assigned case"), beyond(warmups, trial, "warm-up"), unordered, unassigned, both, unseen):
        out = out.unionByName(d)
    return out


def session_errors(items: DataFrame) -> DataFrame:
    """Adds `error` to items (session_id, reviewer_id, current, case_id, mode, status): ids, repeated cases, modes, and an index within the session."""
    w = Window.partitionBy("session_id")
    d = items.withColumns({"_n": F.count("*").over(w), "_same": F.count("*").over(Window.partitionBy("session_id", "case_id"))})
    error = first_error(
        (F.col("session_id").rlike(r"^[A-Za-z0-9_-]{1,100}$"), "invalid session id"), (F.trim("reviewer_id") != "", "invalid reviewer id"), (F.col("case_id").rlike(r"^[A-Za-z0-9_-]{1,200}$") & (F.col("_same") == 1), "invalid or duplicate session case"),
        (F.col("mode").isin("MANUAL", "ASSISTED") & F.col("status").isin("PENDING", "DONE"), "invalid session mode or status"), (F.coalesce("current", F.lit(0)).between(F.lit(0), F.col("_n")), "invalid current session index"),
    )
    return d.withColumn("error", error).drop("_n", "_same")


def agree(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two units (status, value as canonical JSON) say the same."""
    return a["status"].eqNullSafe(b["status"]) & a["value"].eqNullSafe(b["value"])


def agreements(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Units (key, status, value, note) of the first store that the second one shares, with a note that says so."""
    other = b.select(*key, F.col("status").alias("_status"), F.col("value").alias("_value"))
    same = agree({"status": F.col("status"), "value": F.col("value")}, {"status": F.col("_status"), "value": F.col("_value")})
    return a.join(other, list(key)).where(same).drop("_status", "_value").withColumn("note", F.concat(F.coalesce("note", F.lit("")), F.lit(" [both agree]")))


def sealed(units: DataFrame, case: str, fields: int, digest_of: Column) -> DataFrame:
    """Of each case its number of fields, whether it is complete, and if so a digest of its units in order of field."""
    d = units.groupBy(case).agg(F.count_distinct("field").alias("n_fields"), F.array_sort(F.collect_list(F.struct("field", digest_of.alias("unit")))).alias("u"))  # a case has `fields` units
    done = F.col("n_fields") == fields
    return d.select(case, "n_fields", done.alias("sealed"), F.when(done, F.sha2(F.array_join(F.transform("u", lambda x: F.concat_ws("=", x["field"], x["unit"])), "\n"), 256)).alias("seal"))


def support(specs: DataFrame, status: DataFrame) -> DataFrame:
    """Fields with what is supported of them: specs (field, kind, roles) with the status that was set by hand, else UNSUPPORTED_G0."""
    return specs.join(status.select("field", "status", "limits"), "field", "left").withColumns({"status": F.coalesce("status", F.lit("UNSUPPORTED_G0")), "limits": F.coalesce("limits", F.array().cast("array<string>"))})


def document_digest(docs: DataFrame, fetched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds sha256 to doc_id: of the first fetch, else of the sealed candidate that names the document."""
    one = fetched.groupBy("doc_id").agg(F.min_by("sha256", "ordinal").alias("_fetched"))
    other = candidates.groupBy("doc_id").agg(F.min("document_sha256").alias("_sealed"))
    return docs.join(one, "doc_id", "left").join(other, "doc_id", "left").withColumn("sha256", F.coalesce("_fetched", "_sealed")).drop("_fetched", "_sealed")


def with_parsed(manifest: DataFrame, parsed: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a manifest with their results; what was not parsed, or has no result, stays with a note."""
    d = manifest.join(parsed.select(key, F.lit(True).alias("_parsed")), key, "left").join(results.select(key, F.struct(*(c for c in results.columns if c != key)).alias("result")), key, "left")
    note = F.when(F.col("_parsed").isNull(), "NO_PARSED_DOCUMENT").when(F.col("result").isNull(), "INVALID_EVALUATION")
    return d.withColumns({"parsed": F.col("_parsed").isNotNull(), "note": note}).drop("_parsed")


def first_partner(rows: DataFrame, isin: str, key: str) -> DataFrame:
    """Of each ISIN with several rows, the first row and the first other one, in order of the key."""
    d = rows.where(F.col(isin) != "").groupBy(isin).agg(F.min(key).alias("first"), F.count_distinct(key).alias("n")).where("n > 1").drop("n")
    other = rows.join(d, isin).where(F.col(key) > F.col("first")).groupBy(isin, "first").agg(F.min(key).alias("partner"))
    return other.select(isin, "first", "partner")


def remaining(wanted: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a driver that was stopped has yet to do: the rows without a result, once each."""
    return wanted.join(done.select(key), key, "left_anti").dropDuplicates([key])


def frozen_versions(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, version) of lines `name==version`; comments and other lines are none."""
    p = r"^\s*([A-Za-z0-9_.\-]+)==([^\s#;]+)"
    return lines.select(F.lower(F.regexp_extract(line, p, 1)).alias("name"), F.regexp_extract(line, p, 2).alias("version")).where("name <> ''")
