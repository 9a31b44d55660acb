"""Queries over review sessions, agreement, seals, families of documents, and records turned into inputs of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import extract, graphs, link
from factloom.operators import sessions as S
from factloom.plans.registry import Tables, query


@query("""WITH k AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5|' || c_custkey), c_custkey) - 1 AS place FROM customer)
SELECT c_nationkey, c_custkey, CAST(place AS INT) AS place, CASE WHEN place % 2 = 0 THEN 'ASSISTED' ELSE 'MANUAL' END AS mode, 'PENDING' AS status FROM k WHERE place < 6""")
def alternating_session(t: Tables) -> DataFrame:
    """Six customers of each nation, in turn assisted and manual."""
    return S.alternating(t.customer, "c_nationkey", "c_custkey", 6, 5)


def _frozen(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two reviewers with all customers but a tenth, in crossed modes; some assignments are broken."""
    k = F.col("c_custkey")
    sample = t.customer.select(k.alias("case_id"), (k % 10 == 0).alias("warmup"))
    both = sample.withColumn("reviewer", F.explode(F.array(F.lit("A"), F.lit("B"))))
    c, a = F.col("case_id"), F.col("reviewer") == "A"
    assignments = both.where(~F.col("warmup") & (c % 13 != 0)).select("reviewer", "case_id", F.when((c % 2 == 0) == a, "MANUAL").otherwise("ASSISTED").alias("mode"))
    order = both.where(~F.col("warmup") & (c % 17 != 0)).select("reviewer", "case_id", F.when(a, c).otherwise(-c).alias("place"))
    warmups = both.where((c % 10 == 0) & a | (c % 31 == 0)).select("reviewer", "case_id", c.alias("place"))
    return assignments, order, warmups, sample


_F = """s AS (SELECT c_custkey AS case_id, c_custkey % 10 = 0 AS warmup FROM customer), b AS (SELECT s.*, reviewer FROM s, (VALUES ('A'), ('B')) AS v(reviewer)),
a AS (SELECT reviewer, case_id, CASE WHEN (case_id % 2 = 0) = (reviewer = 'A') THEN 'MANUAL' ELSE 'ASSISTED' END AS mode FROM b WHERE NOT warmup AND case_id % 13 <> 0), o AS (SELECT reviewer, case_id, CASE WHEN reviewer = 'A' THEN case_id ELSE -case_id END AS place FROM b WHERE NOT warmup AND case_id % 17 <> 0),
w AS (SELECT reviewer, case_id, case_id AS place FROM b WHERE (case_id % 10 = 0 AND reviewer = 'A') OR case_id % 31 = 0)"""


@query(f"WITH {_F} SELECT reviewer, case_id, true AS warmup, place, 'ASSISTED' AS mode, 'PENDING' AS status FROM w WHERE case_id % 10 = 0 UNION ALL SELECT reviewer, case_id, false, place, mode, 'PENDING' FROM o JOIN a USING (reviewer, case_id)")
def crossed_session(t: Tables) -> DataFrame:
    """Frozen sessions: warm-ups, then the cases with a mode and a place."""
    return S.crossed(*_frozen(t))


@query(f"""WITH {_F} SELECT reviewer, case_id, 'warm-up is not in the sample' AS error FROM w WHERE case_id % 10 <> 0 UNION ALL SELECT reviewer, case_id, 'without a place' FROM a WHERE case_id % 17 = 0
UNION ALL SELECT reviewer, case_id, 'without a mode' FROM o WHERE case_id % 13 = 0 UNION ALL SELECT NULL, case_id, 'assigned to nobody' FROM s WHERE NOT warmup AND case_id % 13 = 0""")
def assignment_errors(t: Tables) -> DataFrame:
    """Where assignments, order and warm-ups don't match the sample."""
    return S.assignment_errors(*_frozen(t))


@query(r"""WITH i AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 's ' || o_custkey ELSE 's-' || o_custkey END AS session_id, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'R' END AS reviewer_id, CASE WHEN o_custkey % 5 = 0 THEN 1000000 WHEN o_custkey % 5 = 1 THEN NULL ELSE 1 END AS current,
  CASE WHEN o_orderkey % 8 = 0 THEN 'same' WHEN o_orderkey % 9 = 0 THEN 'not valid!' ELSE 'c' || o_orderkey END AS case_id, CASE WHEN o_orderkey % 6 = 0 THEN 'AUTO' ELSE 'MANUAL' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'OPEN' ELSE 'DONE' END AS status FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, count(*) OVER (PARTITION BY session_id, case_id) AS same FROM i)
SELECT o_orderkey, CASE WHEN session_id LIKE 's %' THEN 'invalid session id' WHEN reviewer_id = ' ' THEN 'invalid reviewer id' WHEN case_id LIKE 'not%' OR same > 1 THEN 'invalid or duplicate session case' WHEN mode = 'AUTO' OR status = 'OPEN' THEN 'invalid session mode or status' WHEN coalesce(current, 0) > n THEN 'invalid current session index' END AS error FROM n""")
def session_validation(t: Tables) -> DataFrame:
    """What is wrong with the items of sessions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t.orders.select("o_orderkey", F.concat(F.when(c % 11 == 0, "s ").otherwise("s-"), c).alias("session_id"), F.when(c % 7 == 0, " ").otherwise("R").alias("reviewer_id"), F.when(c % 5 == 0, 1000000).when(c % 5 > 1, 1).alias("current"), F.when(k % 8 == 0, "same").when(k % 9 == 0, "not valid!").otherwise(F.concat(F.lit("c"), k)).alias("case_id"), F.when(k % 6 == 0, "AUTO").otherwise("MANUAL").alias("mode"), F.when(k % 7 == 0, "OPEN").otherwise("DONE").alias("status"))
    return S.session_errors(d).select("o_orderkey", "error")


@query("SELECT doc_id, CAST(quality AS VARCHAR) AS status, CASE WHEN doc_id % 4 > 0 THEN CAST(toxic AS VARCHAR) END AS value, CASE WHEN doc_id % 3 = 0 THEN 'seen' ELSE '' END || ' [both agree]' AS note FROM labels WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 0")
def joint_agreements(t: Tables) -> DataFrame:
    """Units on which two reviewers agree, in status and value."""
    k = F.col("doc_id")
    a = t.labels.select("doc_id", F.col("quality").cast("string").alias("status"), F.when(k % 4 > 0, F.col("toxic").cast("string")).alias("value"), F.when(k % 3 == 0, "seen").alias("note"))
    b = t.labels.select("doc_id", F.when(k % 6 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string").alias("status"), F.when(k % 5 == 0, "other").when(k % 4 > 0, F.col("toxic").cast("string")).alias("value"))
    return S.agreements(a, b, "doc_id")


@query("""WITH u AS (SELECT DISTINCT o_custkey AS case_id, 'f' || (o_orderkey % 3) AS field FROM orders), g AS (SELECT case_id, count(*) AS n_fields, string_agg(field || '=' || sha256(case_id || field), chr(10) ORDER BY field) AS all_ FROM u GROUP BY 1)
SELECT case_id, n_fields, n_fields = 3 AS sealed, CASE WHEN n_fields = 3 THEN sha256(all_) END AS seal FROM g""")
def joint_seal(t: Tables) -> DataFrame:
    """Cases with all fields, sealed by a digest of their units."""
    d = t.orders.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("field")).distinct()
    return S.sealed(d, "case_id", 3, F.sha2(F.concat(F.col("case_id").cast("string"), "field"), 256))


_SPECS = [(n, r.kind) for n, r in extract.RULES.items()]
_SET = [(n, ("SUPPORTED", "PARTIAL")[i % 2], ["tables only"] if i % 2 else []) for i, (n, _) in enumerate(_SPECS) if i % 4 < 3]


@query(f"SELECT o_orderkey, field, kind, coalesce(status, 'UNSUPPORTED_G0') AS status, coalesce(limits, []) AS limits FROM orders, (VALUES {', '.join(f'({i}, {n!r}, {k!r})' for i, (n, k) in enumerate(_SPECS))}) AS s(i, field, kind) LEFT JOIN (VALUES {', '.join(f'({n!r}, {s!r}, CAST({x!r} AS VARCHAR[]))' for n, s, x in _SET)}) AS v(field, status, limits) USING (field) WHERE i = o_orderkey % {len(_SPECS)}")
def field_support(t: Tables) -> DataFrame:
    """What is supported of the field that each order is about."""
    specs = t.spark.createDataFrame([(i, *s) for i, s in enumerate(_SPECS)], "i int, field string, kind string")
    own = t.orders.select("o_orderkey", (F.col("o_orderkey") % len(_SPECS)).cast("int").alias("i")).join(F.broadcast(specs), "i").drop("i")  # a literal table
    return S.support(own, t.spark.createDataFrame(_SET, "field string, status string, limits array<string>")).select("o_orderkey", "field", "kind", "status", "limits")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('f' || doc_id) WHEN doc_id % 2 = 0 THEN sha256('s' || doc_id) END AS sha256 FROM documents""")
def document_digests(t: Tables) -> DataFrame:
    """Digests of documents by their first fetch, else by their sealed candidate."""
    k = F.col("doc_id")
    sha = lambda p: F.sha2(F.concat(F.lit(p), k.cast("string")), 256)
    fetched = t.documents.where(k % 3 == 0).select("doc_id", F.explode(F.array(F.struct(F.lit(2).alias("ordinal"), sha("later").alias("sha256")), F.struct(F.lit(1).alias("ordinal"), sha("f").alias("sha256")))).alias("x")).select("doc_id", "x.*")
    return S.document_digest(t.documents.select("doc_id"), fetched, t.documents.where(k % 2 == 0).select("doc_id", sha("s").alias("document_sha256")))


_NODES = "n AS (SELECT 'FOL_' || o_orderkey AS id, o_custkey AS family, list_extract(['BASE_PROSPECTUS', 'FINAL_TERMS', 'SUPPLEMENT'], CAST(o_orderkey % 3 AS INT) + 1) AS role, o_orderkey AS ordinal FROM orders)"


@query(f"""WITH {_NODES}, p AS (SELECT o_custkey AS family, 'FOL_' || o_orderkey AS source, list_extract(['AUTO_LINKED', 'NO_LINK', 'REVIEW_REQUIRED'], CAST(o_orderkey % 5 % 3 AS INT) + 1) AS decision, CASE WHEN o_orderkey % 2 = 0 THEN 'SUPPLEMENTS' ELSE '' END AS relation, 'R' || (o_orderkey % 4) AS rule_id,
  list_extract(['base_prospectus', 'final_terms', 'family'], CAST(o_orderkey % 7 % 3 AS INT) + 1) AS cand_type, CASE WHEN o_orderkey % 7 % 3 < 2 THEN CAST(o_custkey % 10 AS VARCHAR) END AS cand_number FROM orders),
h AS (SELECT p.source, max(n.ordinal) AS o FROM p JOIN n ON n.family = p.family AND n.id <> p.source AND contains(n.id, p.cand_number) AND n.role = CASE WHEN cand_type LIKE 'base%' THEN 'BASE_PROSPECTUS' WHEN cand_type LIKE 'final%' THEN 'FINAL_TERMS' END GROUP BY 1),
f AS (SELECT family, min(ordinal) AS o FROM n WHERE role = 'BASE_PROSPECTUS' GROUP BY 1)
SELECT p.family, p.source, 'FOL_' || coalesce(h.o, f.o) AS target, CASE WHEN relation = '' THEN 'RELATES_TO' ELSE relation END AS relation, decision AS state, rule_id FROM p LEFT JOIN h USING (source) LEFT JOIN f ON f.family = p.family AND cand_type = 'family' WHERE decision <> 'NO_LINK' AND coalesce(h.o, f.o) IS NOT NULL""")
def family_edges(t: Tables) -> DataFrame:
    """Edges between the documents of a family, by a number in the target's id and its role, or to the first base prospectus."""
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    id_ = F.concat(F.lit("FOL_"), k)
    nodes = t.orders.select(id_.alias("id"), F.col("o_custkey").alias("family"), pick(("BASE_PROSPECTUS", "FINAL_TERMS", "SUPPLEMENT"), k % 3).alias("role"), k.alias("ordinal"))
    p = t.orders.select(id_.alias("source"), pick(("AUTO_LINKED", "NO_LINK", "REVIEW_REQUIRED"), k % 5 % 3).alias("decision"), F.when(k % 2 == 0, "SUPPLEMENTS").otherwise("").alias("relation"), F.concat(F.lit("R"), k % 4).alias("rule_id"), pick(("base_prospectus", "final_terms", "family"), k % 7 % 3).alias("cand_type"), F.when(k % 7 % 3 < 2, (F.col("o_custkey") % 10).cast("string")).alias("cand_number"))
    return graphs.family_edges(nodes, p)


@query("SELECT isin, min(p_partkey) AS first, list_sort(list(p_partkey))[2] AS partner FROM (SELECT *, p_brand || p_size AS isin FROM part WHERE p_size > 3) GROUP BY 1 HAVING count(*) > 1")
def isin_partners(t: Tables) -> DataFrame:
    """The first two of several rows with one ISIN."""
    return S.first_partner(t.part.select("p_partkey", F.when(F.col("p_size") > 3, F.concat("p_brand", F.col("p_size"))).otherwise("").alias("isin")), "isin", "p_partkey")


@query("""SELECT o_orderkey, list_extract(['cnmv_ccff', 'cnmv_folletos_emision', 'cnmv_folletos_emision', 'cnmv_admision', NULL], CAST(o_orderkey % 5 AS INT) + 1) AS src_family, o_orderkey || CASE WHEN o_orderkey % 4 = 3 THEN '-x' ELSE '' END AS src_register, CASE o_orderkey % 4 WHEN 0 THEN '.12' WHEN 1 THEN '-2' END AS src_suffix,
 CASE WHEN o_orderkey % 3 = 0 THEN 'PROGRAMA' ELSE 'ROLE' END AS src_role, CASE WHEN o_orderkey % 5 = 0 THEN 'N' || o_orderkey END AS src_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS src_date, 'folleto' AS cand_type, CAST(o_orderkey AS VARCHAR) AS cand_register, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'own' END AS issuer FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def link_sources(t: Tables) -> DataFrame:
    """Acquired records as sources of the rules, issuers filled in from what was observed elsewhere."""
    k = F.col("o_orderkey")
    surface = F.element_at(F.array(*map(F.lit, ("CNMV_CCFF", "CNMV_FOLLETOS_EMISION", "CNMV_FOLLETO_DETAIL", "CNMV_ADMISSION", "OTHER"))), (k % 5).cast("int") + 1)
    r = {"acquisition_surface": surface, "registro_oficial": F.concat(k, F.when(k % 4 == 0, ".12").when(k % 4 == 1, "-2").when(k % 4 == 3, "-x").otherwise("")), "source_record_key": F.concat(F.lit("K"), k), "denominacion": F.when(k % 3 == 0, "PROGRAMA").otherwise(""), "document_role": F.lit("ROLE"), "issuer": F.lit("x"), "isin": F.lit("y"), "document_url": F.lit("z"), "numfol": F.concat(F.lit("N"), k), "fecha_registro": F.date_format("o_orderdate", "dd/MM/yyyy")}
    own = t.orders.select("o_orderkey", "o_custkey", F.when(k % 2 == 1, "own").otherwise("").alias("issuer"), link.source_of_record(r).alias("s"), link.candidate("folleto", k.cast("string")).alias("c"))
    seen = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("issuer"))
    d = link.enriched(own, seen, "o_custkey", "issuer")
    return d.select("o_orderkey", "s.src_family", "s.src_register", "s.src_suffix", "s.src_role", "s.src_number", F.col("s.src_date").cast("string").alias("src_date"), "c.cand_type", "c.cand_register", "issuer")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0 OR doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_documents(t: Tables) -> DataFrame:
    """Documents that an interrupted run has no result of."""
    return S.remaining(t.documents.select("doc_id"), t.labels.where("doc_id % 3 = 0"))


@query("SELECT 'pkg-' || p_partkey AS name, p_size || '.' || (p_partkey % 10) || '.0' AS version, sha256('pkg-' || p_partkey || '==' || p_size || '.' || (p_partkey % 10) || '.0') AS digest FROM part WHERE p_partkey % 5 > 0")
def environment_freeze(t: Tables) -> DataFrame:
    """Packages with their versions, of lines some of which are comments, and a digest of each."""
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("# Pkg-"), k)).otherwise(F.concat(F.lit(" Pkg-"), k, F.lit("=="), F.col("p_size"), F.lit("."), k % 10, F.lit(".0 # why")))
    d = S.frozen_versions(t.part.select(line.alias("line")))
    return d.withColumn("digest", F.sha2(F.concat_ws("==", "name", "version"), 256))
