"""Queries over the event log, read as a review log: a case is a user's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import documents, layout, metrics, review
from factloom.plans.registry import Tables, query

_KINDS = {"view": "CASE_OPENED", "signup": "CASE_RESUMED", "error": "CASE_PAUSED", "purchase": "CASE_SUBMITTED", "click": "EVIDENCE_JUMP"}
_E = "e AS (SELECT event_id, ts, user_id, CAST(ts AS DATE) AS day, value, CASE event_type WHEN 'view' THEN 'CASE_OPENED' WHEN 'signup' THEN 'CASE_RESUMED' WHEN 'error' THEN 'CASE_PAUSED' WHEN 'purchase' THEN 'CASE_SUBMITTED' ELSE 'EVIDENCE_JUMP' END AS kind FROM events)"


def _log(t: Tables) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.to_date("ts").alias("day"), "value", kinds[F.col("event_type")].alias("kind"))


@query(f"WITH {_E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id DESC) AS n FROM e) SELECT user_id, kind, event_id, value FROM k WHERE n = 1")
def latest_decision(t: Tables) -> DataFrame:
    return review.latest(_log(t).select("user_id", "kind", "event_id", "value"), "event_id", "user_id", "kind")


@query(f"""WITH {_E}, m AS (SELECT *, max(ts) OVER (PARTITION BY user_id, day) AS final, CASE WHEN kind IN ('CASE_OPENED', 'CASE_RESUMED') THEN 1 WHEN kind <> 'EVIDENCE_JUMP' THEN 0 END AS side FROM e), s AS (SELECT *, lag(side) OVER (PARTITION BY user_id, day ORDER BY event_id) AS was FROM m WHERE side IS NOT NULL),
c AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, day ORDER BY event_id) AS nxt FROM s WHERE was IS NULL OR was <> side)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS n_intervals, CAST(sum(greatest(0, epoch_us(coalesce(nxt, final)) - epoch_us(ts))) AS BIGINT) AS active_us FROM c WHERE side = 1 GROUP BY 1, 2""")
def active_seconds(t: Tables) -> DataFrame:
    d = review.active_seconds(_log(t), "kind", "ts", "event_id", "user_id", "day")
    return d.select("user_id", F.col("day").cast("string").alias("day"), "n_intervals", "active_us")


@query(f"""WITH {_E}, m AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, day ORDER BY event_id) AS was FROM e WHERE kind <> 'EVIDENCE_JUMP'), c AS (SELECT *, CASE WHEN kind = 'CASE_PAUSED' THEN epoch_us(lead(ts) OVER (PARTITION BY user_id, day ORDER BY event_id)) - epoch_us(ts) END AS gap FROM m WHERE NOT (kind = 'CASE_PAUSED' AND coalesce(was, '') = 'CASE_PAUSED'))
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN coalesce(max(gap), 0) > 3e8 THEN 'INVALID_TIMING' ELSE 'VALID' END AS timing, round(max(gap) / 1e6, 3) AS longest_pause FROM c GROUP BY 1, 2""")
def timing_status(t: Tables) -> DataFrame:
    d = review.timing_status(_log(t), "kind", "ts", "event_id", "user_id", "day")
    return d.select("user_id", F.col("day").cast("string").alias("day"), "timing", F.round("longest_pause", 3).alias("longest_pause"))


@query("WITH o AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT event_id, user_id, value FROM o WHERE b > value")
def event_order_violations(t: Tables) -> DataFrame:
    """Events whose value is under the one before, read as a clock that runs back."""
    return review.order_violations(t.events.select("event_id", "user_id", "value"), "value", "event_id", "user_id")


@query(r"""
WITH d AS (SELECT user_id, CASE WHEN event_id % 23 = 0 THEN 'BOGUS' ELSE list_extract(['CONFIRMED','CONFLICT','MISSING','NOT_APPLICABLE'], CAST(event_id % 4 AS INT) + 1) END AS decision, event_id % 5 = 0 AS no_value, event_id % 3 AS n_evidence, list_extract(['MANUAL_DISCOVERY','FIELD_STATUS','MACHINE_CANDIDATE'], CAST(user_id % 3 AS INT) + 1) AS origin FROM events),
e AS (SELECT CASE WHEN decision = 'BOGUS' THEN 'bad decision' WHEN decision = 'CONFIRMED' AND no_value THEN 'confirmed without value' WHEN decision = 'CONFIRMED' AND n_evidence = 0 THEN 'confirmed without evidence' WHEN origin = 'MANUAL_DISCOVERY' AND n_evidence = 0 THEN 'discovery without evidence' WHEN origin = 'FIELD_STATUS' AND decision NOT IN ('MISSING', 'NOT_APPLICABLE') THEN 'status of a value' END AS error FROM d)
SELECT error, count(*) AS n FROM e GROUP BY 1""")
def decision_constraints(t: Tables) -> DataFrame:
    k = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    d = {"decision": F.when(k % 23 == 0, "BOGUS").otherwise(pick(("CONFIRMED", "CONFLICT", "MISSING", "NOT_APPLICABLE"), k % 4)), "value": F.when(k % 5 != 0, F.col("value")), "n_evidence": k % 3, "origin": pick(("MANUAL_DISCOVERY", "FIELD_STATUS", "MACHINE_CANDIDATE"), F.col("user_id") % 3)}
    return t.events.select(review.decision_error(d).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS case_id, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS ok, count(*) FILTER (l_partkey % 50 = 0) AS wrong_document, count(*) FILTER (l_returnflag <> 'R') / count(*) AS rate FROM lineitem GROUP BY 1")
def evidence_audit(t: Tables) -> DataFrame:
    """Pointers of each case that hold, and those into a wrong document."""
    ok = F.col("l_returnflag") != "R"
    return t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(F.col("l_partkey") % 50 == 0).alias("wrong_document"), F.try_divide(F.count_if(ok), F.count("*")).alias("rate"))


def _truth_issues(cases: DataFrame, units: DataFrame) -> DataFrame:
    s = cases.select("doc_id").join(units, "doc_id", "left")
    return s.select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "unevidenced").when(F.col("toxic") == 1, "unverified").otherwise("complete").alias("issue"))


@query("""
SELECT d.doc_id, CASE WHEN u.doc_id IS NULL THEN 'missing' WHEN quality = 0 THEN 'unevidenced' WHEN toxic = 1 THEN 'unverified' ELSE 'complete' END AS issue FROM documents d LEFT JOIN labels u ON u.doc_id = d.doc_id""")
def truth_issues_all(t: Tables) -> DataFrame:
    """Issues of all documents."""
    return _truth_issues(t.documents, t.labels)


@query("""
SELECT a.doc_id, a.quality AS first, CASE WHEN a.doc_id % 6 = 0 THEN 1 - a.quality ELSE a.quality END AS second FROM labels a WHERE a.doc_id % 6 = 0""")
def joint_gold_diff(t: Tables) -> DataFrame:
    """Units on which two reviewers disagree."""
    a = t.labels.select("doc_id", F.col("quality").alias("first"))
    b = t.labels.select("doc_id", F.when(F.col("doc_id") % 6 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("second"))
    return a.join(b, "doc_id").where(~F.col("first").eqNullSafe(F.col("second")))


@query("""SELECT o_custkey AS case_id, mode, list_sort(list(DISTINCT id)) AS docs FROM (
SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'ASSISTED' ELSE 'MANUAL' END AS mode, 'D' || o_orderkey AS id FROM orders UNION ALL SELECT o_custkey, 'ASSISTED', 'N' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 AND l_quantity > 45) GROUP BY 1, 2""")
def authorized_docs(t: Tables) -> DataFrame:
    """Documents a session may open: a case's own, and in assisted mode those of its graph."""
    mode = F.when(F.col("o_custkey") % 2 == 0, "ASSISTED").otherwise("MANUAL")
    own = t.orders.select(F.col("o_custkey").alias("case_id"), mode.alias("mode"), F.concat(F.lit("D"), F.col("o_orderkey")).alias("id"))
    nodes = t.orders.where("o_custkey % 2 = 0").join(t.lineitem.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), F.lit("ASSISTED").alias("mode"), F.concat(F.lit("N"), F.col("l_partkey")).alias("id"))
    return own.unionByName(nodes).groupBy("case_id", "mode").agg(F.array_sort(F.collect_set("id")).alias("docs"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, [array_to_string(x[1:10], chr(10)), array_to_string(x[11:20], chr(10))] AS pages, list_concat([lower(x[1][1:5])], CASE WHEN doc_id % 3 = 0 THEN ['zzqq'] ELSE [] END) AS tokens FROM l)
SELECT doc_id, len(list_filter(pages, lambda p: len(list_filter(tokens, lambda t: NOT contains(lower(p), t))) = 0)) > 0 AS found FROM p""")
def value_in_page(t: Tables) -> DataFrame:
    """Whether one of two pages that a unit points to holds its value."""
    x = F.split("text", "\n")
    pages = F.array(F.array_join(F.slice(x, 1, 10), "\n"), F.array_join(F.slice(x, 11, 10), "\n"))
    tokens = F.concat(F.array(F.substring(F.get(x, 0), 1, 5)), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("zzqq"))).otherwise(F.array().cast("array<string>")))
    return t.documents.select("doc_id", review.value_in_page(tokens, pages).alias("found"))


@query("SELECT c_custkey AS case_id, field FROM customer, (VALUES ('F0'), ('F1'), ('F2')) AS v(field) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND 'F' || (o_orderkey % 4) = field)")
def submission_gaps(t: Tables) -> DataFrame:
    """Critical fields of each customer's case that no order decides."""
    decided = t.orders.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("F"), F.col("o_orderkey") % 4).alias("field"))
    return review.open_fields(t.customer.select(F.col("c_custkey").alias("case_id")), ("F0", "F1", "F2"), decided)


@query(f"""WITH {_E}, j AS (SELECT user_id, kind, CASE WHEN event_id % 5 <> 0 THEN event_id % 10 END AS doc, NULL AS decision, NULL AS origin, event_id % 10 < 7 AS allowed, event_id % 10 < 7 AS holds FROM e
UNION ALL SELECT user_id, 'DECISION', event_id % 10, CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' ELSE 'CONFLICT' END, CASE WHEN event_id % 2 = 0 THEN 'MACHINE_CANDIDATE' ELSE 'MANUAL_DISCOVERY' END, event_id % 10 < 7, value > 20 FROM e WHERE kind = 'CASE_SUBMITTED'),
u AS (SELECT *, kind IN ('EVIDENCE_JUMP', 'DECISION') AND doc IS NOT NULL AS used FROM j)
SELECT user_id, count(*) FILTER (used) AS nav_used, count(*) FILTER (used AND holds) AS nav_ok, count(*) FILTER (used AND NOT allowed) AS nav_wrongdoc, count(*) FILTER (kind = 'DOCUMENT_OPENED') AS n_opened, count(*) FILTER (decision = 'CONFIRMED') AS confirmed, count(*) FILTER (origin = 'MANUAL_DISCOVERY') AS n_manual,
count(*) FILTER (origin = 'MACHINE_CANDIDATE' AND decision = 'CONFIRMED') AS n_machine_confirmed, count(*) FILTER (origin = 'MACHINE_CANDIDATE' AND decision = 'REJECTED') AS n_machine_rejected FROM u GROUP BY 1""")
def review_counters(t: Tables) -> DataFrame:
    """Navigation and decisions of each reviewer."""
    e, k = _log(t), F.col("event_id")
    jumps = e.select("user_id", "kind", F.when(k % 5 != 0, k % 10).alias("doc_id"), (k % 10 < 7).alias("allowed"))
    made = F.when(k % 3 == 0, "CONFIRMED").when(k % 3 == 1, "REJECTED").otherwise("CONFLICT")
    decisions = e.where("kind = 'CASE_SUBMITTED'").select("user_id", made.alias("decision"), F.when(k % 2 == 0, "MACHINE_CANDIDATE").otherwise("MANUAL_DISCOVERY").alias("origin"), (k % 10).alias("doc_id"), (k % 10 < 7).alias("allowed"), (F.col("value") > 20).alias("holds"))
    return review.navigation(jumps, decisions, "user_id")


@query("SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'ASSISTED' ELSE 'MANUAL' END AS mode, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS graph, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS candidates FROM customer")
def case_payload(t: Tables) -> DataFrame:
    """Cases as a session sees them."""
    d = t.customer.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 2 == 0, "ASSISTED").otherwise("MANUAL").alias("mode"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("graph"), F.col("c_mktsegment").alias("candidates"))
    return review.masked(d, "mode", "graph", "candidates")


_EV = "v AS (SELECT event_id, user_id, value, CASE WHEN event_id % 29 = 0 THEN 'BOGUS' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'CASE_SUBMITTED' ELSE 'PDF_SEARCH' END AS kind FROM events)"


@query(f"""WITH {_EV}, w AS (SELECT *, coalesce(bool_or(kind = 'CASE_SUBMITTED') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM v)
SELECT event_id, CASE WHEN kind = 'BOGUS' THEN 'unknown event type' WHEN late THEN 'review already submitted' WHEN b > value THEN 'earlier than the event before' END AS error FROM w""")
def event_errors(t: Tables) -> DataFrame:
    """Events that a log must refuse; the event's value stands for its time."""
    k = F.col("event_id")
    kind = F.when(k % 29 == 0, "BOGUS").when((F.col("event_type") == "purchase") & (k % 5 == 0), "CASE_SUBMITTED").otherwise("PDF_SEARCH")
    return review.event_errors(t.events.select("event_id", "user_id", "value", kind.alias("kind")), "kind", "value", "event_id", "user_id").select("event_id", "error")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_extract(['isin', 'reset_fixing', 'nothing'], CAST(l_partkey % 7 % 3 AS INT) + 1) AS field, list_extract(['CONFIRMED', 'MISSING', 'CONFLICT'], CAST(l_suppkey % 5 % 3 AS INT) + 1) AS decision, list_extract(['MACHINE_CANDIDATE', 'MANUAL_DISCOVERY', 'FIELD_STATUS', 'ELSE'], CAST(l_partkey % 4 AS INT) + 1) AS origin,
  CASE WHEN l_partkey % 3 > 0 THEN 'c' || l_linenumber % 4 END AS cand, CASE WHEN l_suppkey % 3 > 0 THEN 'v' END AS value, l_suppkey % 2 AS n FROM lineitem),
o AS (SELECT *, CASE WHEN cand IS NULL AND decision = 'MISSING' THEN 'FIELD_STATUS' ELSE origin END AS og FROM d)
SELECT l_partkey, l_suppkey, l_linenumber, CASE WHEN field = 'nothing' THEN 'unknown review field' WHEN og = 'ELSE' THEN 'unknown origin' WHEN og = 'FIELD_STATUS' AND NOT (decision = 'MISSING' AND cand IS NULL AND value IS NULL) THEN 'status with a value or candidate' WHEN og = 'MACHINE_CANDIDATE' AND coalesce(cand, 'c3') IN ('c2', 'c3') THEN 'unknown candidate'
 WHEN og = 'MACHINE_CANDIDATE' AND NOT ((field = 'isin' AND cand = 'c0') OR (field = 'reset_fixing' AND cand = 'c1')) THEN 'candidate of another field' WHEN og = 'MANUAL_DISCOVERY' AND cand IS NOT NULL THEN 'discovery with a candidate' WHEN decision = 'CONFIRMED' AND value IS NULL THEN 'confirmed without value'
 WHEN decision = 'CONFIRMED' AND n = 0 AND og <> 'MACHINE_CANDIDATE' THEN 'confirmed without evidence' WHEN og = 'MANUAL_DISCOVERY' AND n = 0 THEN 'discovery without evidence' END AS error FROM o""")
def candidate_errors(t: Tables) -> DataFrame:
    """Decisions against the candidates of their case: one for isin, one for fixing rules, and one that is there twice."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    d = t.lineitem.select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_partkey", "l_suppkey", pick(("isin", "reset_fixing", "nothing"), p % 7 % 3).alias("field"), pick(("CONFIRMED", "MISSING", "CONFLICT"), s % 5 % 3).alias("decision"), pick(("MACHINE_CANDIDATE", "MANUAL_DISCOVERY", "FIELD_STATUS", "ELSE"), p % 4).alias("origin"), F.when(p % 3 > 0, F.concat(F.lit("c"), F.col("l_linenumber") % 4)).alias("candidate_id"), F.when(s % 3 > 0, "v").alias("value"), (s % 2).alias("n_evidence"))
    one = lambda c, f: F.struct(F.lit(c).alias("candidate_id"), F.lit(f).alias("field"))
    cands = t.orders.select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(one("c0", "isin"), one("c1", "fixing_rules"), one("c2", "isin"), one("c2", "isin"))).alias("c")).select("case_id", "c.*")
    return review.candidate_errors(d, cands, documents.SOURCES).select("l_partkey", "l_suppkey", "l_linenumber", "error")


@query(f"""WITH {_E}, x AS (SELECT user_id, count(*) FILTER (kind = 'CASE_PAUSED') AS pause_count, CAST(0 AS BIGINT) AS focus_lost_count, count(*) FILTER (kind = 'EVIDENCE_JUMP') AS evidence_jumps, CAST(0 AS BIGINT) AS ui_errors FROM e GROUP BY 1),
d AS (SELECT user_id, count(*) AS decisions_count, count(*) FILTER (event_id % 2 = 1) AS manual_fields_added, list(DISTINCT 'F' || (event_id % 6)) AS f FROM e WHERE kind = 'CASE_SUBMITTED' GROUP BY 1)
SELECT x.*, coalesce(decisions_count, 0) AS decisions_count, coalesce(manual_fields_added, 0) AS manual_fields_added, list_filter(['F0', 'F1', 'F5'], lambda c: NOT list_contains(coalesce(f, []), c)) AS unresolved_critical FROM x LEFT JOIN d USING (user_id)""")
def review_closeouts(t: Tables) -> DataFrame:
    """What is recorded of each reviewer's log when it is submitted."""
    e, k = _log(t), F.col("event_id")
    d = e.where("kind = 'CASE_SUBMITTED'").select("user_id", F.concat(F.lit("F"), k % 6).alias("field"), F.when(k % 2 == 1, "MANUAL_DISCOVERY").otherwise("FIELD_STATUS").alias("origin"))
    return review.closeouts(e.select("user_id").distinct(), e, d, ("F0", "F1", "F5"), "user_id")


@query("""WITH r AS (SELECT o_orderkey AS review_id, o_custkey AS case_id FROM orders), g AS (SELECT c_custkey AS case_id, f.field, list_extract(['CONFIRMED_VALUE', 'CONFLICT', 'MISSING', 'NOT_APPLICABLE', 'DRAFT'], CAST((c_custkey + f.i) % 5 AS INT) + 1) AS status, f.i AS v FROM customer, (VALUES (0, 'isin'), (1, 'currency'), (2, 'maturity')) AS f(i, field) WHERE c_custkey % 7 > 0),
l AS (SELECT l_orderkey AS review_id, list_extract(['isin', 'currency', 'maturity'], CAST(l_partkey % 3 AS INT) + 1) AS field, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber * 10 AS o, list_extract(['CONFIRMED', 'CONFLICT', 'MISSING'], CAST(l_suppkey % 3 AS INT) + 1) AS decision, l_suppkey % 2 AS v FROM lineitem),
m AS (SELECT review_id, field, max(o) AS o FROM l GROUP BY 1, 2), z AS (SELECT DISTINCT review_id, field, decision, v FROM l JOIN m USING (review_id, field, o)),
u AS (SELECT g.field, g.status, z.decision, coalesce(z.v = g.v, false) AS eq FROM r JOIN g USING (case_id) LEFT JOIN z USING (review_id, field) WHERE g.status <> 'DRAFT')
SELECT field, CASE status WHEN 'CONFIRMED_VALUE' THEN CASE WHEN decision = 'CONFIRMED' AND eq THEN 'TP' WHEN decision = 'CONFIRMED' THEN 'FP_WRONG_VALUE' ELSE 'FN' END WHEN 'CONFLICT' THEN CASE WHEN decision = 'CONFLICT' THEN 'CONFLICT_OK' WHEN decision = 'CONFIRMED' THEN 'FP_CONFLICT_DENIED' ELSE 'FN' END ELSE CASE WHEN decision = 'CONFIRMED' THEN 'FP_INVENTED' WHEN decision = 'CONFLICT' THEN 'INCORRECT_STATUS' ELSE 'TN' END END AS outcome, count(*) AS n FROM u GROUP BY 1, 2""")
def review_units(t: Tables) -> DataFrame:
    """Reviews by the fields of their schema: gold of a scored status, the last decision, and the outcome, values compared by what they denote."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    fields, c = ("isin", "currency", "maturity"), F.col("c_custkey")
    gold = t.customer.where(c % 7 > 0).select(c.alias("case_id"), F.posexplode(F.array(*map(F.lit, fields))).alias("i", "field")).select("case_id", "field", pick((*review.GOLD, "DRAFT"), (F.col("case_id") + F.col("i")) % 5).alias("status"), F.col("i").cast("string").alias("value"))
    log = t.lineitem.select(F.col("l_orderkey").alias("review_id"), pick(fields, F.col("l_partkey") % 3).alias("field"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 10).alias("ordinal"), pick(("CONFIRMED", "CONFLICT", "MISSING"), F.col("l_suppkey") % 3).alias("decision"), F.concat((F.col("l_suppkey") % 2).cast("string"), F.lit(".0")).alias("value"))
    u = review.units(t.orders.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("case_id")), fields, gold, log)
    same = F.coalesce(metrics.same_json_column(F.col("value"), F.col("gold_value")), F.lit(False))
    return u.select("field", metrics.outcome(F.col("gold_status"), F.col("decision"), same).alias("outcome")).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN u.doc_id IS NULL THEN 'missing' WHEN quality = 0 THEN 'unevidenced' WHEN toxic = 1 THEN 'unverified' ELSE 'complete' END AS issue, lang, count(*) AS n FROM documents d LEFT JOIN labels u ON u.doc_id = d.doc_id GROUP BY 1, 2""")
def truth_totals(t: Tables) -> DataFrame:
    """How many units have each issue, by language."""
    d = _truth_issues(t.documents, t.labels).join(t.documents.select("doc_id", "lang"), "doc_id")
    return d.groupBy("issue", "lang").agg(F.count("*").alias("n"))
