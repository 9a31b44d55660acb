"""Queries over families of documents, titles that many issuers share, and rows of one security. A third of the rows and more are of one family and of one title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import graphs
from factloom.plans.registry import Tables, query

_N = """n AS (SELECT 'FOL_' || o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN -1 ELSE o_custkey END AS family, CASE o_orderstatus WHEN 'F' THEN 'BASE_PROSPECTUS' WHEN 'O' THEN 'FINAL_TERMS' ELSE 'ADMISSION' END AS role, o_orderkey AS ordinal,
  CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 'NO_LINK' WHEN o_totalprice > 150000 THEN 'REVIEW_REQUIRED' ELSE 'AUTO_LINKED' END AS decision, CASE WHEN o_totalprice > 200000 THEN 'family' WHEN o_orderstatus = 'F' THEN 'final_terms' ELSE 'base_prospectus' END AS kind, CAST(o_custkey AS VARCHAR) AS number FROM orders)"""
_G = f"""{_N}, i AS (SELECT family, role, id, ordinal FROM n), a AS (SELECT family, id AS source, kind, decision, number FROM n WHERE decision <> 'NO_LINK'),
h AS (SELECT a.source, arg_max(i.id, i.ordinal) AS target FROM a JOIN i ON a.family = i.family AND i.role = CASE a.kind WHEN 'final_terms' THEN 'FINAL_TERMS' WHEN 'base_prospectus' THEN 'BASE_PROSPECTUS' END AND contains(i.id, a.number) AND i.id <> a.source GROUP BY 1),
b AS (SELECT family, arg_min(id, ordinal) AS base FROM i WHERE role = 'BASE_PROSPECTUS' GROUP BY 1),
e AS (SELECT a.family, a.source, coalesce(h.target, CASE WHEN a.kind = 'family' THEN b.base END) AS target, a.decision AS state FROM a LEFT JOIN h USING (source) LEFT JOIN b ON b.family = a.family)"""


def _nodes(t: Tables) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "BASE_PROSPECTUS").when(F.col("o_orderstatus") == "O", "FINAL_TERMS").otherwise("ADMISSION")
    family = F.when(F.col("o_orderpriority") < "3", -1).otherwise(F.col("o_custkey"))
    return t.orders.select(F.concat(F.lit("FOL_"), "o_orderkey").alias("id"), family.alias("family"), role.alias("role"), F.col("o_orderkey").alias("ordinal"), "o_orderpriority", "o_totalprice", "o_custkey")


def _edges(nodes: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    decision = F.when(F.contains("o_orderpriority", F.lit("HIGH")), "NO_LINK").when(price > 150000, "REVIEW_REQUIRED").otherwise("AUTO_LINKED")
    kind = F.when(price > 200000, "family").when(F.col("role") == "BASE_PROSPECTUS", "final_terms").otherwise("base_prospectus")
    p = nodes.select(F.col("id").alias("source"), decision.alias("decision"), F.lit("").alias("relation"), F.lit("R").alias("rule_id"), kind.alias("cand_type"), F.col("o_custkey").cast("string").alias("cand_number"))
    return graphs.family_edges(nodes, p)


@query(f"WITH {_G} SELECT family, source, target, state FROM e WHERE target IS NOT NULL")
def family_targets(t: Tables) -> DataFrame:
    """Edges of families, of which one has two fifths of all documents."""
    return _edges(_nodes(t)).select("family", "source", "target", "state")


@query(f"""WITH {_G}, g AS (SELECT family, count(*) AS n_edges, count(*) FILTER (state = 'REVIEW_REQUIRED') AS n_review FROM e WHERE target IS NOT NULL GROUP BY 1), f AS (SELECT family, count(*) AS n_nodes, list(DISTINCT role) AS roles FROM n GROUP BY 1),
c AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'FOL_' ELSE 'X_' END || l_orderkey AS doc_id FROM lineitem GROUP BY 1),
m AS (SELECT c.doc_id, n.family, n_nodes, n_edges, n_review, CASE WHEN n.family IS NULL THEN ['FAMILY_UNKNOWN'] WHEN n.role = 'FINAL_TERMS' THEN list_filter(['BASE_PROSPECTUS', 'ADMISSION'], lambda x: NOT list_contains(roles, x)) ELSE [] END AS missing
  FROM c LEFT JOIN n ON n.id = c.doc_id LEFT JOIN f ON f.family = n.family LEFT JOIN g ON g.family = n.family)
SELECT doc_id, family, CASE WHEN len(missing) = 0 AND n_edges > 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_review, 0) AS n_review, missing FROM m""")
def family_status(t: Tables) -> DataFrame:
    """Status of each case's family: documents that are missing, nodes and edges; some cases are of no family."""
    nodes = _nodes(t)
    cases = t.lineitem.select(F.concat(F.when(F.col("l_returnflag") == "R", "FOL_").otherwise("X_"), "l_orderkey").alias("doc_id")).distinct()
    return graphs.family_status(cases, nodes, _edges(nodes))


def _titled(t: Tables) -> DataFrame:
    title = F.when(F.col("l_linenumber") <= 2, "PROGRAMA RENTA FIJA").otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    return t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("id"), title.alias("title"), F.col("l_suppkey").alias("issuer"), F.col("l_partkey").alias("register"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'PROGRAMA RENTA FIJA' ELSE l_returnflag || ' ' || l_linestatus END AS title, l_suppkey AS issuer, l_partkey AS register FROM lineitem),
i AS (SELECT title, issuer, min(register) AS least, max(register) AS most, sha256('8|' || issuer) AS h FROM r GROUP BY 1, 2),
n AS (SELECT title, issuer, coalesce(lead(struct_pack(i := issuer, a := least, b := most)) OVER w, first_value(struct_pack(i := issuer, a := least, b := most)) OVER w) AS x FROM i WINDOW w AS (PARTITION BY title ORDER BY h, issuer)),
p AS (SELECT l_orderkey, l_linenumber, title, issuer, register, x.i AS other_issuer, CASE WHEN x.a <> register THEN x.a WHEN x.b <> register THEN x.b END AS other_register FROM r JOIN n USING (title, issuer) WHERE x.i <> issuer)
SELECT * FROM p WHERE other_register IS NOT NULL""")
def title_negatives(t: Tables) -> DataFrame:
    """For each line a part of another supplier under the same title; one title has half of all lines."""
    return graphs.title_negatives(_titled(t)).select("id.*", "title", "issuer", "register", "other_issuer", "other_register")


@query("""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size > 3 THEN p_brand || p_size ELSE '' END AS isin FROM part), w AS (SELECT isin, p_partkey AS earlier, lead(p_partkey) OVER (PARTITION BY isin ORDER BY p_partkey) AS later FROM p WHERE isin <> '')
SELECT * FROM w WHERE later IS NOT NULL""")
def isin_successors(t: Tables) -> DataFrame:
    """Consecutive rows of one security."""
    isin: Column = F.when(F.col("p_size") > 3, F.concat("p_brand", F.col("p_size"))).otherwise("")
    return graphs.consecutive(t.part.select("p_partkey", isin.alias("isin")), "isin", "p_partkey").select("isin", F.col("a.p_partkey").alias("earlier"), F.col("b.p_partkey").alias("later"))
