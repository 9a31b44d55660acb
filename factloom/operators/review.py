"""State rebuilt from append-only review logs: latest rows, active time, timing and order checks, constraints."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.stretches import WIDTH, neighbours, running_max

# Kinds of events, and statuses of gold units that are scored.
EVENTS = (
    "CASE_OPENED", "CASE_PAUSED", "CASE_RESUMED", "CASE_SUBMITTED", "FOCUS_LOST", "FOCUS_GAINED", "DOCUMENT_OPENED", "GRAPH_EDGE_FOLLOWED", "EVIDENCE_JUMP", "PDF_SEARCH", "CANDIDATE_CONFIRMED", "CANDIDATE_REJECTED",
    "CANDIDATE_CONFLICT", "MANUAL_FIELD_ADDED", "STATUS_CHANGED", "FIELD_DECISION", "SUBMIT", "UI_ERROR",
)
GOLD = ("CONFIRMED_VALUE", "CONFLICT", "MISSING", "NOT_APPLICABLE")
OPEN, CLOSE = ("CASE_OPENED", "CASE_RESUMED"), ("CASE_PAUSED", "CASE_SUBMITTED")


def latest(log: DataFrame, order: str, *key: str) -> DataFrame:
    """The last row of each key in append order: by a grouped maximum, so a long log of one key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def active_seconds(events: DataFrame, kind: str, ts: str, order: str, *key: str, now: Column | None = None, width: int = WIDTH) -> DataFrame:
    """Microseconds between openers and the closers that follow; an open end lasts until `now`, by default the key's last event.

    Runs of events of one side count as their first. `order` is an integer.
    """
    side = F.when(F.col(kind).isin(*OPEN), 1).when(F.col(kind).isin(*CLOSE), 0)
    d = neighbours(events.select(*key, ts, order, side.alias("_side")).where("_side is not null"), F.col("_side"), order, *key, width=width)
    d = neighbours(d.where("_was is null or _was <> _side").drop("_was", "_next"), F.col(ts), order, *key, width=width).where("_side = 1")
    lasted = lambda end: F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(ts))
    spent = d.groupBy(*key).agg(F.sum(F.when(F.col("_next").isNotNull(), lasted("_next"))).alias("_closed"), F.max(F.when(F.col("_next").isNull(), F.col(ts))).alias("_open"), F.count("*").alias("n_intervals"))
    last = events.groupBy(*(F.col(c).alias("_k_" + c) for c in key)).agg(F.max(ts).alias("_last"))
    d = spent.join(last, reduce(and_, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in key]))
    end = F.greatest(F.lit(0), F.unix_micros(now if now is not None else F.col("_last")) - F.unix_micros("_open"))
    return d.select(*key, (F.coalesce("_closed", F.lit(0)) + F.coalesce(end, F.lit(0))).cast("long").alias("active_us"), "n_intervals")


def timing_status(events: DataFrame, kind: str, ts: str, order: str, *key: str, most_s: float = 300, width: int = WIDTH) -> DataFrame:
    """INVALID_TIMING where a pause isn't followed by an opener or a submission within `most_s`. `order` is an integer."""
    d = events.where(F.col(kind).isin(*OPEN, *CLOSE)).select(*key, ts, order, (F.col(kind) == "CASE_PAUSED").alias("_pause"))
    d = neighbours(d, F.col("_pause"), order, *key, width=width)
    d = neighbours(d.where(~(F.col("_pause") & F.coalesce("_was", F.lit(False)))).drop("_was", "_next"), F.col(ts), order, *key, width=width)
    gap = F.when(F.col("_pause"), F.col("_next").cast("double") - F.col(ts).cast("double"))
    return d.groupBy(*key).agg(F.when(F.coalesce(F.max(gap), F.lit(0.0)) > most_s, "INVALID_TIMING").otherwise("VALID").alias("timing"), F.max(gap).alias("longest_pause"))


def order_violations(events: DataFrame, ts: str, order: str, *key: str, width: int = WIDTH) -> DataFrame:
    """Events earlier than the one before them in the log. `order` is an integer."""
    return neighbours(events, F.struct(F.col(ts).alias("ts")), order, *key, width=width).where(F.col("_was.ts") > F.col(ts)).drop("_was", "_next")


def first_error(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that fails; NULL if all hold. A check on NULL fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks])


def decision_error(d: dict[str, Column]) -> Column:
    """Which rule a decision breaks: value and evidence of what is confirmed, origin of what is found by hand, status of the rest."""
    confirmed = d["decision"] == "CONFIRMED"
    return first_error((d["decision"].isin("CONFIRMED", "CONFLICT", "MISSING", "NOT_APPLICABLE"), "bad decision"), (~confirmed | d["value"].isNotNull(), "confirmed without value"), (~confirmed | (d["n_evidence"] > 0), "confirmed without evidence"), ((d["origin"] != "MANUAL_DISCOVERY") | (d["n_evidence"] > 0), "discovery without evidence"), ((d["origin"] != "FIELD_STATUS") | d["decision"].isin("MISSING", "NOT_APPLICABLE"), "status of a value"))


def value_in_page(tokens: Column, pages: Column) -> Column:
    """Whether one of the pages holds all tokens of a value."""
    return F.exists(pages, lambda p: F.forall(tokens, lambda t: F.contains(F.lower(p), F.lower(t))))


def open_fields(cases: DataFrame, fields: tuple[str, ...], decisions: DataFrame, case: str = "case_id") -> DataFrame:
    """Critical fields of each case without a decision; a review with any can't be submitted."""
    wanted = cases.select(case, F.explode(F.array(*map(F.lit, fields))).alias("field")).distinct()
    return wanted.join(decisions.select(case, "field"), [case, "field"], "left_anti")


def navigation(events: DataFrame, decisions: DataFrame, *key: str) -> DataFrame:
    """Counts of a review: jumps and pointers of decisions as navigation, those that hold, those into documents not allowed, decisions by origin.

    events: key, kind, doc_id, allowed. decisions: key, decision, origin, doc_id, allowed, holds. Jumps without a document don't count.
    """
    none = lambda kind: F.lit(None).cast(kind)
    e = events.select(*key, "kind", none("string").alias("decision"), none("string").alias("origin"), "doc_id", "allowed", F.col("allowed").alias("holds"))
    d = decisions.select(*key, F.lit("DECISION").alias("kind"), "decision", "origin", "doc_id", "allowed", "holds")
    used = F.col("kind").isin("EVIDENCE_JUMP", "DECISION") & F.col("doc_id").isNotNull()
    machine = F.col("origin") == "MACHINE_CANDIDATE"
    return e.unionByName(d).groupBy(*key).agg(
        F.count_if(used).alias("nav_used"), F.count_if(used & F.col("holds")).alias("nav_ok"), F.count_if(used & ~F.col("allowed")).alias("nav_wrongdoc"), F.count_if(F.col("kind") == "DOCUMENT_OPENED").alias("n_opened"),
        F.count_if(F.col("decision") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("origin") == "MANUAL_DISCOVERY").alias("n_manual"), F.count_if(machine & (F.col("decision") == "CONFIRMED")).alias("n_machine_confirmed"), F.count_if(machine & (F.col("decision") == "REJECTED")).alias("n_machine_rejected"),
    )


def masked(cases: DataFrame, mode: str, *hidden: str) -> DataFrame:
    """Cases as a session sees them: in manual mode the columns of the machine's findings are NULL."""
    return cases.withColumns({c: F.when(F.col(mode) != "MANUAL", F.col(c)) for c in hidden})


def event_errors(events: DataFrame, kind: str, ts: str, order: str, *key: str, submitted: str = "CASE_SUBMITTED", width: int = WIDTH) -> DataFrame:
    """Adds `error` to a log: a kind that doesn't exist, an event after the submission, or one earlier than the event before it. `order` is an integer."""
    d = running_max(events, {"_after": F.col(kind) == submitted}, order, *key, width=width)
    d = neighbours(d, F.struct(F.col(ts).alias("ts")), order, *key, width=width)
    error = first_error((F.col(kind).isin(*EVENTS), "unknown event type"), (~F.coalesce("_after", F.lit(False)), "review already submitted"), (F.coalesce(F.col(ts) >= F.col("_was.ts"), F.lit(True)), "earlier than the event before"))
    return d.withColumn("error", error).drop("_after", "_was", "_next")


def candidate_errors(decisions: DataFrame, candidates: DataFrame, takes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds `error` to decisions (case_id, field, decision, origin, candidate_id, value, n_evidence) by the candidates (case_id, candidate_id, field) of their case.

    A machine's candidate must be one of the case and support the field; what was found by hand names none; a status has
    neither candidate nor value. A missing value without a candidate is a status, whatever its origin.
    """
    known = candidates.groupBy("case_id", "candidate_id").agg(F.count("*").alias("_n"), F.min("field").alias("_of"))
    d = decisions.join(known, ["case_id", "candidate_id"], "left")
    fields = F.try_element_at(F.create_map(*(x for k, v in takes.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), F.col("field"))
    none = F.col("decision").isin("MISSING", "NOT_APPLICABLE")
    origin = F.when(F.col("candidate_id").isNull() & none, "FIELD_STATUS").otherwise(F.col("origin"))
    machine, status, hand = (origin == x for x in ("MACHINE_CANDIDATE", "FIELD_STATUS", "MANUAL_DISCOVERY"))
    confirmed = F.col("decision") == "CONFIRMED"
    backed = (F.col("n_evidence") > 0) | (machine & confirmed)  # a candidate brings its own evidence
    error = first_error(
        (fields.isNotNull(), "unknown review field"), (origin.isin("MACHINE_CANDIDATE", "MANUAL_DISCOVERY", "FIELD_STATUS"), "unknown origin"), (~status | (none & F.col("candidate_id").isNull() & F.col("value").isNull()), "status with a value or candidate"),
        (~machine | (F.col("_n") == 1), "unknown candidate"), (~machine | F.array_contains(fields, F.col("_of")), "candidate of another field"), (~hand | F.col("candidate_id").isNull(), "discovery with a candidate"),
        (~confirmed | (F.trim(F.coalesce("value", F.lit(""))) != ""), "confirmed without value"), (~confirmed | backed, "confirmed without evidence"), (~hand | backed, "discovery without evidence"),
    )
    return d.withColumn("error", error).drop("_n", "_of")


def closeouts(reviews: DataFrame, events: DataFrame, decisions: DataFrame, critical: tuple[str, ...], *key: str) -> DataFrame:
    """What a submission records of each review: pauses, lost focus, jumps and errors of its log, its decisions, those made by hand, critical fields left open."""
    kinds = {"pause_count": "CASE_PAUSED", "focus_lost_count": "FOCUS_LOST", "evidence_jumps": "EVIDENCE_JUMP", "ui_errors": "UI_ERROR"}
    e = events.groupBy(*key).agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    d = decisions.groupBy(*key).agg(F.count("*").alias("decisions_count"), F.count_if(F.col("origin") == "MANUAL_DISCOVERY").alias("manual_fields_added"), F.collect_set(F.when(F.col("field").isin(*critical), F.col("field"))).alias("_decided"))
    out = reviews.join(e, list(key), "left").join(d, list(key), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    unresolved = F.array_sort(F.array_except(F.array(*map(F.lit, critical)), F.coalesce("_decided", F.array().cast("array<string>"))))
    return out.select(*key, *map(zero, kinds), zero("decisions_count"), zero("manual_fields_added"), unresolved.alias("unresolved_critical"))


def units(reviews: DataFrame, fields: tuple[str, ...], gold: DataFrame, log: DataFrame) -> DataFrame:
    """Each review once for each field of the schema that has a gold unit of a scored status, with the last decision on it, if any.

    reviews: review_id, case_id; gold: case_id, field, status, value; log: review_id, field, ordinal, decision, value.
    """
    wanted = reviews.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    d = wanted.join(gold.where(F.col("status").isin(*GOLD)).select("case_id", "field", F.col("status").alias("gold_status"), F.col("value").alias("gold_value")), ["case_id", "field"])
    return d.join(latest(log, "ordinal", "review_id", "field").drop("ordinal"), ["review_id", "field"], "left")
