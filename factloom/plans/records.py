"""Queries over registry-like rows: classification, linkage, lifecycles, reconciliation, captures, schedules, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import classify as C
from factloom.operators import link, reconcile, sampling
from factloom.plans.registry import ORACLE_SQL, Tables, query


@query("""
WITH s AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS v FROM orders UNION ALL SELECT o_orderkey, CAST(min(year(l_shipdate)) AS VARCHAR) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
g AS (SELECT o_orderkey, count(v) AS n, count(DISTINCT v) AS k FROM s GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'MISSING' WHEN n = 1 THEN 'SOURCE_ONLY' WHEN k = 1 THEN 'AGREE' ELSE 'CONFLICT' END AS status, count(*) AS n FROM g GROUP BY 1""")
def reconcile_order_total(t: Tables) -> DataFrame:
    """The year of an order by two sources: its own date and its first shipment."""
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.year("l_shipdate")).alias("y"))
    own = t.orders.select("o_orderkey", F.lit("OBSERVED").alias("status"), F.year("o_orderdate").cast("string").alias("value"))
    other = t.orders.select("o_orderkey").join(ship, "o_orderkey", "left").select("o_orderkey", F.when(F.col("y").isNull(), "MISSING").otherwise("OBSERVED").alias("status"), F.col("y").cast("string").alias("value"))
    return reconcile.reconcile(own.unionByName(other), "o_orderkey").groupBy("status").agg(F.count("*").alias("n"))


def _registry(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    reg = k.cast("string")
    return t.orders.select(
        k.alias("row_id"), F.element_at(F.array(*map(F.lit, ("CNMV_CCFF", "CNMV_FOLLETOS_EMISION", "CNMV_ADMISSION", "CNMV_FOLLETO_DETAIL", "OTHER"))), (k % 5).cast("int") + 1).alias("surface"),
        F.when(F.col("o_orderstatus") == "P", "SUPLEMENTO").when(F.col("o_orderpriority").startswith("1"), "MODIFICACION").alias("role_text"),
        F.when(k % 7 == 0, F.concat(reg, F.lit(".1"))).when(k % 11 == 0, F.concat(reg, F.lit("-2"))).otherwise(reg).alias("register"),
        F.when(F.col("o_custkey") % 2 == 0, "BONOS SIMPLES").otherwise("ACCIONES").alias("denomination"), F.when(k % 3 == 0, F.concat(F.lit("N"), F.col("o_custkey"))).alias("number"),
        F.when(F.col("o_custkey") % 4 == 0, "Final Terms. Maturity Date: 2030").when(F.col("o_custkey") % 4 == 1, "Securities Note. Admission to trading").when(F.col("o_custkey") % 4 == 2, "Folleto de base").alias("text"),
    )


@query(r"""
WITH r AS (SELECT o_orderkey AS row_id, list_extract(['CNMV_CCFF','CNMV_FOLLETOS_EMISION','CNMV_ADMISSION','CNMV_FOLLETO_DETAIL','OTHER'], CAST(o_orderkey % 5 AS INT) + 1) AS surface, CASE WHEN o_orderstatus = 'P' THEN 'SUPLEMENTO' WHEN o_orderpriority LIKE '1%' THEN 'MODIFICACION' ELSE '' END AS role_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '.' WHEN o_orderkey % 11 = 0 THEN '-' ELSE '' END AS suffix, o_custkey % 2 = 0 AS debt, CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_custkey END AS number, o_custkey % 4 AS k FROM orders),
m AS (SELECT *, CASE WHEN surface = 'CNMV_CCFF' THEN 'FINAL_TERMS' WHEN role_text = 'SUPLEMENTO' OR suffix = '.' THEN 'SUPPLEMENT' WHEN role_text = 'MODIFICACION' OR suffix = '-' THEN 'CORRECTION' WHEN surface LIKE 'CNMV_FOLLETO%' THEN 'BASE_PROSPECTUS' WHEN surface = 'CNMV_ADMISSION' THEN CASE WHEN debt THEN 'SECURITIES_NOTE' ELSE 'ISSUE_DOC' END ELSE 'UNKNOWN' END AS meta,
  list_extract(['FINAL_TERMS','SECURITIES_NOTE','BASE_PROSPECTUS',NULL], CAST(k AS INT) + 1) AS title FROM r),
p AS (SELECT *, meta = 'SECURITIES_NOTE' AS meta_debt, meta = 'ISSUE_DOC' AND coalesce(title, '') = 'SECURITIES_NOTE' AS upgraded, CASE WHEN meta = 'UNKNOWN' THEN coalesce(title, meta) WHEN meta = 'ISSUE_DOC' AND title = 'SECURITIES_NOTE' THEN title ELSE meta END AS role FROM m),
q AS (SELECT *, title IS NOT NULL AND title <> meta AND meta <> 'UNKNOWN' AND NOT upgraded AS conflict, CASE role WHEN 'FINAL_TERMS' THEN CAST(k = 0 AS INT) WHEN 'SECURITIES_NOTE' THEN CAST(k = 1 AS INT) WHEN 'BASE_PROSPECTUS' THEN 0 END AS anchors FROM p),
z AS (SELECT *, conflict OR (meta = 'UNKNOWN' AND title IS NOT NULL) AS middling FROM q)
SELECT row_id, role, CASE WHEN meta IN ('SUPPLEMENT', 'CORRECTION') THEN 'LIFECYCLE' WHEN role = 'UNKNOWN' THEN 'UNKNOWN' WHEN role = 'ISSUE_DOC' THEN 'OUT_OF_SCOPE' ELSE 'INSTRUMENT_DEFINING' END AS scope, CASE WHEN debt OR upgraded THEN 'DEBT' END AS instrument_class,
  CASE WHEN role = 'UNKNOWN' THEN 'LOW' WHEN middling AND coalesce(anchors, 0) = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  concat_ws(',', CASE meta WHEN 'FINAL_TERMS' THEN 'surface:CNMV_CCFF row = condiciones finales' WHEN 'SUPPLEMENT' THEN 'meta:rol=SUPLEMENTO / sufijo .k' WHEN 'CORRECTION' THEN 'meta:rol=MODIFICACION / sufijo -k' WHEN 'BASE_PROSPECTUS' THEN 'surface:' || surface || ' row = folleto base' WHEN 'UNKNOWN' THEN NULL ELSE 'surface:CNMV_ADMISSION' END, CASE WHEN meta_debt THEN 'meta:denominacion=BONOS SIMPLES' END,
    'title:' || title, CASE WHEN upgraded THEN 'title_overrides_default:securities_note' END, CASE WHEN conflict THEN 'conflict:meta=' || meta || '!=' || title END, CASE WHEN anchors > 0 THEN 'anchors:' || anchors WHEN anchors = 0 AND middling THEN 'anchors:none -> confidence stays MEDIUM' END,
    CASE WHEN debt AND NOT meta_debt AND NOT upgraded THEN 'instrument:DEBT(meta)' END, CASE WHEN role = 'UNKNOWN' THEN 'fallback:UNKNOWN -> REVIEW_REQUIRED' END) AS signals,
  CASE WHEN surface = 'CNMV_ADMISSION' THEN 'ISSUE_ADM_' || row_id || CASE suffix WHEN '.' THEN '.1' WHEN '-' THEN '-2' ELSE '' END ELSE 'PROG_' || coalesce(number, CAST(row_id AS VARCHAR)) END AS family_key FROM z""")
def classify_documents(t: Tables) -> DataFrame:
    return C.classify(_registry(t)).select("row_id", "role", "scope", "instrument_class", "confidence", F.array_join("signals", ",").alias("signals"), "family_key")


@query(ORACLE_SQL["classify_documents"])
def classify_records(t: Tables) -> DataFrame:
    """The same rows, as records that were acquired, put into the classifier's form first."""
    names = {"acquisition_surface": "surface", "rol": "role_text", "registro_oficial": "register", "denominacion": "denomination", "numfol": "number"}
    r = {k: F.col(v) for k, v in names.items()} | {"tipo_valor": F.lit(None).cast("string")}
    d = _registry(t).select("row_id", C.document_of_record(r, F.col("text")).alias("d")).select("row_id", "d.*")
    return C.classify(d).select("row_id", "role", "scope", "instrument_class", "confidence", F.array_join("signals", ",").alias("signals"), "family_key")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'SUPPLEMENTS' ELSE 'MODIFIES' END AS relation FROM lineitem""")
def lifecycle_edges(t: Tables) -> DataFrame:
    """Line k of an order as register X.k or X-k, with its own or another order's number as target."""
    reg = F.concat(F.col("l_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, ".").otherwise("-"), F.col("l_linenumber"))
    target = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.col("l_orderkey"), F.lit("9"))).otherwise(F.col("l_orderkey").cast("string"))
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return C.lifecycle(t.lineitem.select(*own, reg.alias("register"), target.alias("target"))).select(*own, "relation")


def _pairs(t: Tables) -> DataFrame:
    """Orders as final terms, lines as prospectus candidates; candidates shipped before the order count as supplements."""
    src = t.orders.select(F.col("o_orderkey").alias("src_id"), F.col("o_orderdate").alias("src_date"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderkey")).alias("src_number"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("cand_date"))
    early = lines.join(src, (lines["l_orderkey"] == src["src_id"]) & (lines["cand_date"] < src["src_date"]), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("earlier"))
    pairs = src.join(lines, src["src_id"] == lines["l_orderkey"]).join(early, "l_orderkey", "left")
    number = F.col("l_linenumber")
    return pairs.select("src_id", "l_linenumber", "l_partkey", "l_suppkey", F.lit("cnmv_ccff").alias("src_family"), F.lit("").alias("src_role"), "src_number", "src_date", F.lit("folleto").alias("cand_type"), F.when(number == 4, F.col("src_id") + 1).otherwise(F.col("src_id")).alias("cand_register"), F.when(number % 2 == 0, "base").otherwise("1").alias("cand_version"), "cand_date", F.coalesce("earlier", F.lit(0)).alias("earlier_supplements"))


_LINK_SQL = """
WITH e AS (SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate GROUP BY 1),
p AS (SELECT o_orderkey AS src_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_custkey % 9 = 0 THEN 'AMBIGUOUS' WHEN l_linenumber = 4 THEN 'NO_LINK' WHEN l_linenumber % 2 = 1 AND l_shipdate > o_orderdate THEN 'NO_LINK' WHEN l_linenumber % 2 = 1 THEN 'AMBIGUOUS' WHEN coalesce(n, 0) > 0 THEN 'AMBIGUOUS' ELSE 'EXACT_LINK' END AS decision
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN e USING (l_orderkey)),
o AS (SELECT *, CASE decision WHEN 'EXACT_LINK' THEN 'AUTO_LINKED' WHEN 'NO_LINK' THEN 'NO_LINK' ELSE 'REVIEW_REQUIRED' END AS operation FROM p)
"""


@query(_LINK_SQL + "SELECT *, CASE WHEN decision = 'EXACT_LINK' THEN 'DEFINES_TERMS_FOR' END AS relation, 'CNMV_CCFF_EXPLICIT_NUMFOL' AS rule_id FROM o")
def link_adjudicate(t: Tables) -> DataFrame:
    return link.adjudicate(_pairs(t)).select("src_id", "l_linenumber", "l_partkey", "l_suppkey", "decision", "operation", "relation", "rule_id")


@query(_LINK_SQL + """, l AS (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 'NO_LINK' WHEN l_suppkey % 10 = 1 THEN 'AMBIGUOUS' WHEN decision = 'AMBIGUOUS' AND l_suppkey % 2 = 0 THEN 'EXACT_LINK' ELSE decision END AS label FROM o)
SELECT l_linenumber % 3 AS stratum, count(*) AS n, count(*) FILTER (operation = 'AUTO_LINKED' AND label = 'EXACT_LINK') AS tp, count(*) FILTER (operation = 'AUTO_LINKED' AND label <> 'EXACT_LINK') AS fp, count(*) FILTER (operation <> 'AUTO_LINKED' AND label = 'EXACT_LINK') AS fn,
 count(*) FILTER (operation = 'AUTO_LINKED' AND label = 'AMBIGUOUS') AS forced, count(*) FILTER (operation = 'REVIEW_REQUIRED') AS review, count(*) FILTER (operation = 'AUTO_LINKED' AND label = 'EXACT_LINK') / nullif(count(*) FILTER (operation = 'AUTO_LINKED'), 0) AS precision,
 count(*) FILTER (operation = 'AUTO_LINKED' AND label = 'EXACT_LINK') / nullif(count(*) FILTER (label = 'EXACT_LINK'), 0) AS recall, count(*) FILTER (operation = 'REVIEW_REQUIRED') / count(*) AS review_rate FROM l GROUP BY 1""")
def link_operational_metrics(t: Tables) -> DataFrame:
    s = F.col("l_suppkey") % 10
    label = F.when(s == 0, "NO_LINK").when(s == 1, "AMBIGUOUS").when((F.col("decision") == "AMBIGUOUS") & (F.col("l_suppkey") % 2 == 0), "EXACT_LINK").otherwise(F.col("decision"))
    return link.link_metrics(link.adjudicate(_pairs(t)).withColumns({"label": label, "stratum": F.col("l_linenumber") % 3}), "label", "stratum")


@query("""
SELECT o_custkey, a AS earlier, b AS later, role FROM (SELECT o_custkey, o_orderkey AS a, o_orderstatus AS role, lead(o_orderkey) OVER w AS b, lead(o_orderstatus) OVER w AS next_role FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE role = next_role""")
def programme_succession(t: Tables) -> DataFrame:
    """Consecutive orders of a customer with the same role."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = t.orders.select("o_custkey", F.col("o_orderkey").alias("earlier"), F.lead("o_orderkey").over(w).alias("later"), F.col("o_orderstatus").alias("role"), F.lead("o_orderstatus").over(w).alias("next_role"))
    return d.where("role = next_role").drop("next_role")


@query("""
SELECT o_custkey, count(*) AS n_nodes, count(*) FILTER (o_orderstatus = 'O') AS n_base, max(o_orderkey) FILTER (o_orderstatus = 'O') AS base_id, count(*) FILTER (o_orderstatus <> 'O') AS n_edges,
  CASE WHEN max(o_orderkey) FILTER (o_orderstatus = 'O') IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM orders GROUP BY 1""")
def family_graph(t: Tables) -> DataFrame:
    """Orders of a customer as a family: open ones are prospectuses, the last of them is the target of the others."""
    base = F.col("o_orderstatus") == "O"
    target = F.max(F.when(base, F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_nodes"), F.count_if(base).alias("n_base"), target.alias("base_id"), F.count_if(~base).alias("n_edges"), F.when(target.isNull(), "INCOMPLETE").otherwise("COMPLETE").alias("status"))


@query("""
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority <> b.o_orderpriority AND a.o_orderkey < b.o_orderkey AND CAST(a.o_orderdate AS DATE) + INTERVAL 30 DAY >= CAST(b.o_orderdate AS DATE) AND CAST(a.o_orderdate AS DATE) <= CAST(b.o_orderdate AS DATE)
WHERE a.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def hard_negative_pairs(t: Tables) -> DataFrame:
    """Orders of one customer and different programmes within thirty days, but for those used elsewhere."""
    side = lambda p: t.orders.select(F.col("o_orderkey").alias(p + "_key"), F.col("o_custkey").alias(p + "_cust"), F.col("o_orderpriority").alias(p + "_prio"), F.to_date("o_orderdate").alias(p + "_date"))
    used = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    a = side("a").join(used, F.col("a_key") == used["l_orderkey"], "left_anti")
    return a.join(side("b"), F.expr("a_cust = b_cust and a_prio <> b_prio and a_key < b_key and b_date between a_date and date_add(a_date, 30)")).select("a_key", "b_key")


@query("""
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'NEW' WHEN page_id % 10 = 1 THEN 'DISAPPEARED' WHEN page_id % 10 = 2 THEN 'UPDATED_METADATA' WHEN page_id % 10 = 3 THEN CASE WHEN html LIKE '%<p%</p>%' THEN 'UPDATED' ELSE 'UPDATED_METADATA' END ELSE 'UNCHANGED' END AS change FROM pages""")
def capture_diff(t: Tables) -> DataFrame:
    """Pages captured twice, the second time deterministically changed, in the head or in a paragraph."""
    shas = lambda d: d.select("page_id", "code", F.sha2("html", 256).alias("raw_sha"), F.sha2(reconcile.cells(F.col("html"), "p"), 256).alias("rows_sha"))
    k = F.col("page_id") % 10
    before = t.pages.where(k != 0).withColumn("code", F.lit(200))
    changed = F.when(k == 2, F.concat("html", F.lit("<!-- x -->"))).when(k == 3, F.regexp_replace("html", "</p>", " new</p>")).otherwise(F.col("html"))
    after = t.pages.withColumns({"html": changed, "code": F.when(k == 1, 404).otherwise(200)})
    return reconcile.capture_diff(shas(before), shas(after), "page_id")


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS issue, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 3 END AS step, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_custkey % 40 AS INT)) AS DATE) AS maturity FROM orders),
s AS (SELECT *, list_filter(list_transform(range(1, 200), lambda k: CAST(issue + to_months(CAST(k * step AS INT)) AS DATE)), lambda x: x <= maturity) AS e FROM d)
SELECT o_orderkey, CASE WHEN maturity <= issue THEN 'INVALID' WHEN step IS NULL THEN 'UNVERIFIABLE' WHEN len(e) = 0 THEN 'INVALID' WHEN list_last(e) <> maturity AND maturity - list_last(e) > step * 40 THEN 'INVALID' ELSE 'VALID' END AS status,
  CASE WHEN issue < maturity AND step IS NOT NULL THEN CAST(len(e) AS INT) END AS n_dates, CASE WHEN issue < maturity AND step IS NOT NULL THEN CAST(list_last(e) AS VARCHAR) END AS last FROM s""")
def payment_schedule(t: Tables) -> DataFrame:
    """Expected payment dates from frequency phrases, issue and maturity."""
    phrase = F.element_at(F.array(F.lit("each year"), F.lit("semiannually"), F.lit("quarterly"), F.lit("at maturity")), (F.col("o_orderkey") % 4).cast("int") + 1)
    d = t.orders.select("o_orderkey", L.schedule_months(phrase).alias("months"), F.to_date("o_orderdate").alias("issue"), F.add_months(F.to_date("o_orderdate"), (F.col("o_custkey") % 40).cast("int")).alias("maturity"))
    return d.select("o_orderkey", reconcile.schedule(F.col("months"), F.col("issue"), F.col("maturity")).alias("s")).select("o_orderkey", "s.status", "s.n_dates", F.col("s.last").cast("string").alias("last"))


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_custkey), c_custkey) AS k FROM customer),
q AS (SELECT * FROM (VALUES ('BUILDING', 5), ('AUTOMOBILE', 8), ('MACHINERY', 3)) AS v(c_mktsegment, quota))
SELECT c_custkey, c_mktsegment, k FROM r JOIN q USING (c_mktsegment) WHERE k <= quota""")
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", {"BUILDING": 5, "AUTOMOBILE": 8, "MACHINERY": 3}, 7)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('11|' || o_orderkey), o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k = 1 ORDER BY sha256('11|' || o_orderkey), o_orderkey LIMIT 20""")
def distinct_issuer_pick(t: Tables) -> DataFrame:
    """Twenty orders of different customers, in hash order."""
    return sampling.pick(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20, 11)


@query("SELECT item_id FROM benchmark ORDER BY sha256('3|' || item_id), item_id LIMIT (SELECT CAST(round(0.2 * count(*)) AS BIGINT) FROM benchmark)")
def audit_sample(t: Tables) -> DataFrame:
    """A fifth of the items, in hash order."""
    return sampling.share(t.benchmark.select("item_id"), "item_id", 0.2, 3)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (1, 3) OR CAST(o_custkey AS VARCHAR) LIKE '%7' THEN 'SCOUT' ELSE 'HOLDOUT' END AS pool FROM orders""")
def pool_split(t: Tables) -> DataFrame:
    """Two complementary pools by key or register."""
    scout = (F.col("o_orderkey") % 8).isin(1, 3) | F.col("o_custkey").cast("string").endswith("7")
    return t.orders.select("o_orderkey", F.when(scout, "SCOUT").otherwise("HOLDOUT").alias("pool"))


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) FROM events WHERE regexp_matches(props, '"k": ?[0-9]+'))""")
def used_keys_anti(t: Tables) -> DataFrame:
    """Customers whose key occurs in no event's JSON."""
    used = t.events.select(F.explode(F.regexp_extract_all("props", F.lit(r'"k": ?([0-9]+)'), F.lit(1))).alias("k")).select(F.col("k").cast("long")).distinct()
    return t.customer.select("c_custkey").join(used, F.col("c_custkey") == F.col("k"), "left_anti")


@query("SELECT o_orderkey, o_orderkey % 4 AS slice, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS place FROM orders")
def work_split(t: Tables) -> DataFrame:
    """Every n-th row to a worker, with its place there."""
    d = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("slice"))
    return sampling.places(d, "slice", "o_orderkey")


def _assembled(a: DataFrame, b: DataFrame, orders: DataFrame) -> DataFrame:
    cases = a.unionByName(b.join(a, "case_id", "left_anti"))
    docs = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("docs"), F.count("*").alias("n_candidates"))
    return cases.join(docs, "case_id", "left").withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0))})


@query("""
WITH a AS (SELECT c_custkey AS case_id, 'P0' AS origin FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')), b AS (SELECT c_custkey AS case_id, 'DEV' AS origin FROM customer WHERE coalesce(c_mktsegment, '') NOT IN ('AUTOMOBILE', 'BUILDING')),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE case_id NOT IN (SELECT case_id FROM a))
SELECT case_id, origin, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey IS NOT NULL)) AS docs, count(o_orderkey) AS n_candidates FROM u LEFT JOIN orders ON o_custkey = case_id GROUP BY 1, 2""")
def case_assembly_all(t: Tables) -> DataFrame:
    """Two sources that overlap and together have all customers."""
    case, segment = F.col("c_custkey").alias("case_id"), F.coalesce("c_mktsegment", F.lit(""))
    a = t.customer.where(segment.isin("AUTOMOBILE", "BUILDING", "FURNITURE")).select(case, F.lit("P0").alias("origin"))
    b = t.customer.where(~segment.isin("AUTOMOBILE", "BUILDING")).select(case, F.lit("DEV").alias("origin"))
    return _assembled(a, b, t.orders)


@query("SELECT doc_id, sha256(text) AS sha, sha256(text) = CASE WHEN doc_id % 13 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS sealed FROM documents")
def seal_verify(t: Tables) -> DataFrame:
    """Recorded digests against those of the texts as they are."""
    recorded = t.documents.select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("recorded"))
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return now.join(recorded, "doc_id").select("doc_id", "sha", (F.col("sha") == F.col("recorded")).alias("sealed"))


@query("""SELECT c_custkey, '{"acctbal":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',"name":"' || c_name || '","nation":' || c_nationkey || '}' AS manifest, sha256('{"acctbal":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',"name":"' || c_name || '","nation":' || c_nationkey || '}') AS manifest_sha256 FROM customer""")
def manifest_seal(t: Tables) -> DataFrame:
    """Canonical JSON with keys in order, and its digest."""
    own = F.to_json(F.struct(F.round(F.col("c_acctbal") * 100).cast("long").alias("acctbal"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    return t.customer.select("c_custkey", own.alias("manifest"), F.sha2(own, 256).alias("manifest_sha256"))


@query("""WITH u AS (SELECT DISTINCT 'FOL_' || (o_orderkey * 2) AS id FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT DISTINCT 'ADM_' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0) SELECT o_orderkey, 'FOL_' || o_orderkey IN (SELECT id FROM u) AS fol_used, 'ADM_' || o_orderkey IN (SELECT id FROM u) AS adm_used FROM orders""")
def harvested_ids(t: Tables) -> DataFrame:
    """Which records occur anywhere in nested JSON of earlier cases."""
    k = F.col("o_orderkey")
    json = F.concat(F.lit('{"a": [{"b": "see (FOL_'), F.when(k % 3 == 0, (k * 2).cast("string")).otherwise(F.lit("x")), F.lit(') and more"}], "c": "'), F.when(k % 5 == 0, F.concat(F.lit("ADM_"), k)).otherwise(F.lit("XADM_1")), F.lit('"}'))
    used = t.orders.select(F.explode(L.record_ids(json)).alias("id")).distinct().withColumn("used", F.lit(True))
    d = t.orders.select("o_orderkey", F.explode(F.array(F.lit("FOL"), F.lit("ADM"))).alias("kind")).withColumn("id", F.concat_ws("_", "kind", "o_orderkey")).join(used, "id", "left")
    found = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("used"))), F.lit(False))
    return d.groupBy("o_orderkey").agg(found("FOL").alias("fol_used"), found("ADM").alias("adm_used"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '100|EUR' ELSE 'x' END AS k FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '100|EUR' ELSE '100|USD' END WHEN o_orderkey % 4 = 0 THEN 'y' ELSE 'x' END FROM orders),
g AS (SELECT o_orderkey, count(*) AS n_sources, count(DISTINCT k) AS k FROM s GROUP BY 1) SELECT o_orderkey, n_sources, CASE WHEN k = 1 THEN 'AGREE' ELSE 'CONFLICT' END AS status FROM g""")
def reconcile_money(t: Tables) -> DataFrame:
    """Two sources of one fact, some of them money written in two ways."""
    k = F.col("o_orderkey")
    money = F.when(k % 3 == 0, L.norm_money(F.when(F.col("side") == 0, "Nominal: 100 euros").when(k % 2 == 0, "EUR 100").otherwise("USD 100")))
    value = F.when((F.col("side") == 1) & (k % 4 == 0), " y ").otherwise("x ")
    d = t.orders.select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    d = d.select("o_orderkey", F.lit("OBSERVED").alias("status"), L.reconcile_key(value, F.when(money.isNotNull(), F.struct(money["amount"].cast("int").alias("amount"), money["currency"].alias("currency")))).alias("value"))
    return reconcile.reconcile(d, "o_orderkey").select("o_orderkey", "n_sources", "status")
