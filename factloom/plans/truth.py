"""Queries over gold: pointers, rules of units, second checks, the truth of sealed cases, sealed records, the guard of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import gold, layout
from factloom.plans.registry import Tables, query
from factloom.sources import files, published
from factloom.sources.shared import dealt
from factloom.streaming import guard


def _pick(xs: tuple, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)


_PAGES = r"""b AS (SELECT doc_id, i - 1 AS ix, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) AS s, unnest(range(1, len(x) + 1)) AS u(i)),
g AS (SELECT doc_id, ix // 10 + 1 AS page, string_agg(line, ' ' ORDER BY ix) AS page_text FROM b GROUP BY 1, 2), z AS (SELECT doc_id, max(page) AS n_pages FROM g GROUP BY 1)"""


@query(rf"""WITH {_PAGES},
d AS (SELECT doc_id, source, lang, sha256(text) AS sha, n_pages, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 9 = 0 THEN 100000 ELSE doc_id % n_pages + 1 END AS page, doc_id % 10 AS k FROM documents JOIN z USING (doc_id)),
p AS (SELECT d.*, page_text, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'zzqq' ELSE '  ' || left(trim(page_text), 12) || '  ' END AS excerpt FROM d LEFT JOIN g USING (doc_id, page))
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'document not found: invalid id' WHEN doc_id % 13 = 0 THEN 'document not authorized for case' WHEN page < 1 THEN 'page must be a positive integer' WHEN k IN (3, 4) THEN 'bbox must contain four finite numbers' WHEN doc_id % 17 = 0 THEN 'invalid sha256'
  WHEN doc_id % 19 = 0 THEN 'document not found' WHEN doc_id % 23 = 0 THEN 'snapshot sha256 mismatch' WHEN doc_id % 29 = 0 THEN 'sha256 mismatch vs source' WHEN page > n_pages THEN 'page out of range' WHEN k IN (5, 6) THEN 'bbox outside page bounds'
  WHEN excerpt IS NOT NULL AND NOT contains(lower(trim(regexp_replace(page_text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g')))) THEN 'excerpt not present in page text' END AS error FROM p""")
def pointer_rules(t: Tables) -> DataFrame:
    """Pointers to all pages of documents, with and without box, excerpt and digest, some broken in one way or several."""
    k = F.col("doc_id")
    docs = t.documents.where("text is not null")
    pages = layout.line_blocks(docs, per_page=10).groupBy("doc_id", (F.col("page") + 1).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ix", "block")))["block"], " ").alias("page_text"))
    d = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.ceil(F.size(F.split("text", "\n")) / 10).alias("n_pages"))
    d = d.withColumn("page", F.when(k % 7 == 0, 0).when(k % 9 == 0, 100000).otherwise(k % F.col("n_pages") + 1).cast("long")).join(pages, ["doc_id", "page"], "left")
    boxes = ([0.0, 90.0, 50.0, 10.0], None, [1.0, 204.0, 102.0, 0.0], [0.0, 90.0, float("nan"), 10.0], [0.0, 90.0, 50.0], [0.0, 90.0, 102.1, 10.0], [50.0, 90.0, 50.0, 10.0], None, [0.0, 1.0, 1.0, 0.0], [99.0, 200.0, 100.0, 199.0])
    box = F.element_at(F.array(*(F.lit(None).cast("array<double>") if b is None else F.array(*map(F.lit, b)) for b in boxes)), (k % 10).cast("int") + 1)
    other = F.sha2(F.lit("other"), 256)
    excerpt = F.when(k % 6 == 0, None).when(k % 4 == 0, "zzqq").otherwise(F.concat(F.lit("  "), F.left(F.trim("page_text"), F.lit(12)), F.lit("  ")))
    p = {
        "doc_id": F.when(k % 11 == 0, "no/id").otherwise(F.concat(F.lit("D"), k)), "authorized": k % 13 != 0, "page": F.col("page"), "bbox": box, "excerpt": excerpt, "sha": F.when(k % 17 == 0, "xyz").when(k % 29 == 0, other).when(k % 2 == 0, F.col("sha")),
        "doc_sha": F.when(k % 19 != 0, F.col("sha")), "known_sha": F.when(k % 23 == 0, other).when(k % 3 == 0, F.col("sha")), "width": F.when(F.col("page_text").isNotNull(), 100.0), "height": F.lit(200.0), "page_text": F.col("page_text"),
    }
    return d.select("doc_id", gold.pointer_error(p).alias("error"))


_ALL = ", ".join(f"'{f}'" for f in (*gold.FIELDS, "nothing"))
_CRIT = ", ".join(f"'{f}'" for f in gold.CRITICAL)
_UNITS = f"""u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_extract([{_ALL}], CAST(l_partkey % {len(gold.FIELDS) + 1} AS INT) + 1) AS field, list_extract(['CONFIRMED_VALUE', 'CONFLICT', 'MISSING', 'NOT_APPLICABLE', 'CONFIRMED_VALUE', 'DRAFT'], CAST(l_suppkey % 6 AS INT) + 1) AS status,
  l_quantity > 5 AS has_value, l_partkey % 3 AS n_pointers, l_quantity > 45 AS broken, list_extract(['value_in_page', 'absence_scan', 'dual_excerpt', NULL], CAST(l_orderkey % 4 AS INT) + 1) AS method, l_returnflag <> 'R' AS passed, l_linestatus = 'O' AS found FROM lineitem)"""


@query(f"""WITH {_UNITS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN field = 'nothing' THEN 'unknown field' WHEN status = 'DRAFT' THEN 'not a gold status' WHEN status = 'CONFIRMED_VALUE' AND NOT has_value THEN 'CONFIRMED_VALUE requires a value' WHEN status = 'CONFIRMED_VALUE' AND n_pointers = 0 THEN 'CONFIRMED_VALUE requires evidence pointer'
 WHEN status = 'CONFLICT' AND n_pointers = 0 THEN 'CONFLICT requires evidence of both readings' WHEN broken AND n_pointers > 0 THEN 'BROKEN_EVIDENCE: page out of range' WHEN field IN ({_CRIT}) AND NOT (passed AND method IS NOT NULL) THEN 'critical field requires second_check PASS'
 WHEN field IN ({_CRIT}) AND method = 'value_in_page' AND status = 'CONFIRMED_VALUE' AND NOT found THEN 'second_check value_in_page FAILED' END AS error FROM u""")
def gold_unit_rules(t: Tables) -> DataFrame:
    """Gold units, one for each order line, by the rule that refuses them."""
    n = F.col("l_partkey") % 3
    method = _pick(("value_in_page", "absence_scan", "dual_excerpt", None), F.col("l_orderkey") % 4)
    u = {
        "field": _pick((*gold.FIELDS, "nothing"), F.col("l_partkey") % (len(gold.FIELDS) + 1)), "status": _pick(("CONFIRMED_VALUE", "CONFLICT", "MISSING", "NOT_APPLICABLE", "CONFIRMED_VALUE", "DRAFT"), F.col("l_suppkey") % 6), "has_value": F.col("l_quantity") > 5, "n_pointers": n,
        "pointer_error": F.when((F.col("l_quantity") > 45) & (n > 0), "page out of range"), "method": method, "result": F.when(method.isNotNull() & (F.col("l_returnflag") != "R"), "PASS"), "found": F.col("l_linestatus") == "O",
    }
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gold.unit_error(u).alias("error"))


_SOME = ("isin", "issuer", "currency", "maturity", "cap")
_LOG = f"""s AS (SELECT o_orderkey AS case_id FROM orders WHERE o_orderstatus <> 'P'), g AS (SELECT l_orderkey AS case_id, list_extract([{', '.join(f"'{f}'" for f in _SOME)}], CAST(l_partkey % 5 AS INT) + 1) AS field, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber AS o,
  list_extract(['CONFIRMED_VALUE', 'CONFLICT', 'MISSING'], CAST(l_suppkey % 3 AS INT) + 1) AS status, CAST(l_quantity AS INT) % 3 AS n_pointers, l_returnflag = 'N' AS verified FROM lineitem WHERE l_orderkey IN (SELECT case_id FROM s)),
u AS (SELECT case_id, field, arg_max(status, o) AS status, arg_max(n_pointers, o) AS n_pointers, arg_max(verified, o) AS verified FROM g GROUP BY 1, 2)"""


def _truth(t: Tables) -> tuple[DataFrame, DataFrame]:
    sealed = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("case_id"))
    lines = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")  # a case's rows together: its last units need no other shuffle
    log = lines.select(F.col("l_orderkey").alias("case_id"), _pick(_SOME, F.col("l_partkey") % 5).alias("field"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("ordinal"), _pick(("CONFIRMED_VALUE", "CONFLICT", "MISSING"), F.col("l_suppkey") % 3).alias("status"), (F.col("l_quantity").cast("int") % 3).alias("n_pointers"), (F.col("l_returnflag") == "N").alias("critical_verified"))
    return sealed, gold.truth_units(sealed, log)


@query(f"""WITH {_LOG}, h AS (SELECT s.case_id, list(field) FILTER (field IS NOT NULL) AS f FROM s LEFT JOIN u USING (case_id) GROUP BY 1)
SELECT case_id, NULL AS field, 'missing_fields' AS issue, list_filter({list(_SOME)}, lambda x: NOT list_contains(coalesce(f, []), x)) AS fields FROM h WHERE len(coalesce(f, [])) < 5
UNION ALL SELECT case_id, field, 'confirmed_without_evidence', NULL FROM u WHERE status = 'CONFIRMED_VALUE' AND n_pointers = 0 UNION ALL SELECT case_id, field, 'critical_not_verified', NULL FROM u WHERE field IN ({_CRIT}) AND NOT verified""")
def truth_case_issues(t: Tables) -> DataFrame:
    """Issues of all sealed orders: fields without a unit, units without evidence, critical ones not verified, by the last unit of each field."""
    return gold.truth_issues(*_truth(t), fields=_SOME)


@query(f"WITH {_LOG} SELECT status, count(*) AS n, count(*) FILTER (verified AND field IN ({_CRIT})) AS critical_verified FROM u GROUP BY 1")
def truth_status_totals(t: Tables) -> DataFrame:
    """How many of the last units have each status, and how many critical ones were verified."""
    return gold.truth_totals(_truth(t)[1], fields=_SOME)


@query("""SELECT o_custkey AS case_id, list_sort(list(DISTINCT id)) AS docs FROM (SELECT o_custkey, 'D' || o_orderkey AS id FROM orders UNION ALL SELECT o_custkey, 'N' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 AND l_quantity > 45
 UNION ALL SELECT o_custkey, 'E' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 AND l_linenumber = 1) GROUP BY 1""")
def session_documents(t: Tables) -> DataFrame:
    """What sessions may open: a case's own documents, and in assisted mode those of its graph and of its candidates' evidence."""
    cases = t.orders.select(F.col("o_custkey").alias("case_id")).distinct().withColumn("mode", F.when(F.col("case_id") % 2 == 0, "ASSISTED").otherwise("MANUAL"))
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda d, c, p: d.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit(p), c).alias("doc_id"))
    return gold.authorized(cases, of(t.orders, "o_orderkey", "D"), of(lines.where("l_quantity > 45"), "l_partkey", "N"), of(lines.where("l_linenumber = 1"), "l_suppkey", "E")).select("case_id", "docs")


@query("""WITH k AS (SELECT l_suppkey AS key, l_returnflag AS role, l_orderkey * 10 + l_linenumber AS o FROM lineitem), a AS (SELECT key, min(o) AS o FROM k GROUP BY 1), r AS (SELECT key, role, min(o) AS o FROM k GROUP BY 1, 2), w AS (SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 1000000 ELSE 0 END AS key, CASE WHEN s_suppkey % 3 > 0 THEN list_extract(['R', 'X'], CAST(s_suppkey % 3 AS INT)) END AS role FROM supplier)
SELECT w.key, w.role, CASE WHEN w.role IS NULL THEN a.o ELSE r.o END AS ordinal FROM w LEFT JOIN a USING (key) LEFT JOIN r ON r.key = w.key AND r.role = w.role""")
def first_matches(t: Tables) -> DataFrame:
    """The first order line of each supplier, of a return flag or of any; some suppliers and flags have none."""
    s = F.col("s_suppkey")
    rows = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    wanted = t.supplier.select((s + F.when(s % 10 == 0, 1000000).otherwise(0)).alias("key"), F.when(s % 3 == 1, "R").when(s % 3 == 2, "X").alias("role"))
    return gold.first_match(rows, wanted).select("key", "role", F.col("match.ordinal").alias("ordinal"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'candidate seal mismatch' WHEN doc_id % 11 = 0 THEN 'candidate seal mismatch' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'candidate content seal mismatch' END AS error FROM documents""")
def sealed_candidates(t: Tables) -> DataFrame:
    """Sealed records of documents: some files were changed, some were never sealed, and some hold other content or another id though the file's digest fits."""
    k = F.col("doc_id")
    id_ = F.concat(F.lit("C"), k)
    body = lambda n, i: F.concat(F.lit('"case_id": "'), i, F.lit('", "lang": '), F.coalesce(F.to_json(F.array("lang")).substr(F.lit(2), F.length(F.to_json(F.array("lang"))) - 2), F.lit("null")), F.lit(', "n_chars": '), n.cast("string"))
    declared = F.sha2(F.concat(F.lit("{"), body(F.col("n_chars"), F.when(k % 3 == 0, "C-other").otherwise(id_)), F.lit("}")), 256)
    n = F.when(k % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    content = F.concat(F.lit("{"), body(n, F.when(k % 3 == 0, "C-other").otherwise(id_)), F.lit(', "candidate_file_sha256": "'), declared, F.lit('"}'))
    d = t.documents.select("doc_id", id_.alias("case_id"), content.alias("content"))
    seals = d.where(k % 11 != 0).select("case_id", F.sha2(F.when(k % 7 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")), 256).alias("sha256"))
    return published.sealed_error(d, seals).select("doc_id", "error")


@query("""SELECT 'N' || doc_id AS name, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'missing' ELSE 'sha mismatch' END AS error FROM documents WHERE text IS NOT NULL AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0)""")
def freeze_check(t: Tables) -> DataFrame:
    """Frozen documents that are missing now, or have other bytes."""
    k = F.col("doc_id")
    d = t.documents.where("text is not null").select("doc_id", "text", F.concat(F.lit("p/"), k).alias("path"))
    frozen = d.select(F.concat(F.lit("N"), k).alias("name"), F.when(k % 13 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.sha2("text", 256).alias("sha256"))
    now = d.where(k % 11 != 0).select("path", F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"))
    return files.freeze_errors(frozen, now)


_EV = "v AS (SELECT event_id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CAST(round(value * 100) AS BIGINT) AS ts, CASE WHEN event_id % 29 = 0 THEN 'BOGUS' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'CASE_SUBMITTED' ELSE 'PDF_SEARCH' END AS kind, event_id % 2 = 0 AS ok FROM events)"


@query(f"""WITH {_EV}, a AS (SELECT *, max(CASE WHEN kind <> 'BOGUS' THEN ts END) OVER w AS latest FROM v WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(bool_or(kind = 'CASE_SUBMITTED' AND ok AND NOT coalesce(ts < latest, false)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM a)
SELECT event_id, CASE WHEN kind = 'BOGUS' THEN 'unknown event_type' WHEN done THEN CASE WHEN kind = 'CASE_SUBMITTED' THEN 'REPEATED' ELSE 'review already submitted' END WHEN ts < latest THEN 'event timestamp precedes previous event' WHEN kind = 'CASE_SUBMITTED' AND NOT ok THEN 'BROKEN_EVIDENCE' ELSE 'ACCEPTED' END AS verdict FROM b""")
def log_guard(t: Tables) -> DataFrame:
    """What the log accepts of each user's events; the value stands for the time, and a submission needs evidence that holds."""
    k = F.col("event_id")
    kind = F.when(k % 29 == 0, "BOGUS").when((F.col("event_type") == "purchase") & (k % 3 == 0), guard.SUBMIT).otherwise("PDF_SEARCH")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    d = t.events.select("event_id", F.col("user_id").alias("key"), seq.alias("seq"), F.round(F.col("value") * 100).cast("long").alias("ts"), kind.alias("kind"), (k % 2 == 0).alias("evidence_ok"))
    return guard.judged(d).select("event_id", "verdict")
