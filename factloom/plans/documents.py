"""Queries over parsed documents, one for each order, and over pointers, candidates and registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import documents as D
from factloom.operators import extract, layout, reconcile, sessions
from factloom.plans.registry import Tables, query
from factloom.sources import files
from factloom.sources.shared import dealt


def _parsed(t: Tables) -> DataFrame:
    """A parser's JSON: two pages, by number or as a list, texts of which one has no page and one an unknown one, a table for even orders, and a key with its value."""
    k = F.col("o_orderkey").cast("string")
    on = lambda page, box="": f'"prov": [{{"page_no": {page}{box}}}]'
    pages = F.when(F.col("o_orderkey") % 3 == 0, '"pages": [{"page_no": 1, "size": {"width": 100, "height": 200}}, {"size": {"width": 100, "height": 200}}]').otherwise('"pages": {"1": {"page_no": 1, "size": {"width": 100, "height": 200}}, "2": {"size": {"width": 100, "height": 200}}}')
    first = on(1, ', "bbox": {"l": 1.5, "t": 90, "r": 50, "b": 80, "coord_origin": "BOTTOMLEFT"}')
    texts = F.concat(F.lit('"texts": [{"self_ref": "#/texts/0", "label": "title", "text": "Order '), k, F.lit('", "level": 1, "parent": {"$ref": "#/body"}, ' + first + '}, {"self_ref": "#/texts/1", "label": "text", "text": "x", "parent": {"$ref": "#/texts/0"}, ' + on(9) + '}, {"self_ref": "#/texts/2", "label": "section_header", "text": "y", ' + on(2) + '}, {"self_ref": "#/texts/3", "label": "odd", "text": null}]'))
    cells = ", ".join(f'{{"text": "{x}", "start_row_offset_idx": {r}, "start_col_offset_idx": {c}{b}}}' for x, r, c, b in (("a", 0, 0, ', "bbox": {"l": 1, "t": 9, "r": 5, "b": 8}'), ("b", 0, 1, ""), ("c", 1, 0, ""), ("d", 1, 1, "")))
    table = F.lit(', "tables": [{"self_ref": "#/tables/0", ' + on(2) + ', "data": {"table_cells": [' + cells + "]}}]")
    json = F.concat(F.lit("{"), pages, F.lit(", "), texts, F.when(F.col("o_orderkey") % 2 == 0, table).otherwise(F.lit("")), F.lit(', "key_value_items": [{"key": {"text": "Total", ' + on(1) + '}, "value": {"text": "'), k, F.lit('", ' + on(1) + "}}]}"))
    orders = dealt(t.orders.select("o_orderkey"), "o_orderkey", each=len(_NEXT))  # by document before there is any JSON: parsed and related where they lie
    return orders.select(F.col("o_orderkey").alias("doc_id"), json.alias("json"))


_BLOCKS = """(VALUES (1, 'texts/0', 'HEADING', 'Order #', 'body', NULL, NULL, NULL, 1), (1, 'texts/1', 'TEXT', 'x', 'texts/0', NULL, NULL, NULL, NULL), (2, 'texts/2', 'HEADING', 'y', NULL, NULL, NULL, NULL, NULL), (1, 'texts/3', 'OTHER', '', NULL, NULL, NULL, NULL, NULL), (2, 'tables/0', 'OTHER', '', NULL, NULL, NULL, NULL, NULL),
(2, 'tables/0/cell/0', 'TABLE_CELL', 'a', 'tables/0', 'tables/0', 0, 0, NULL), (2, 'tables/0/cell/1', 'TABLE_CELL', 'b', 'tables/0', 'tables/0', 0, 1, NULL), (2, 'tables/0/cell/2', 'TABLE_CELL', 'c', 'tables/0', 'tables/0', 1, 0, NULL), (2, 'tables/0/cell/3', 'TABLE_CELL', 'd', 'tables/0', 'tables/0', 1, 1, NULL),
(1, 'key_value_items/0/key', 'OTHER', 'Total', NULL, 'key_value_items/0', NULL, NULL, NULL), (1, 'key_value_items/0/val', 'OTHER', '#', NULL, 'key_value_items/0', NULL, NULL, NULL)) AS v(page, block_id, block_type, text, parent, table_id, "row", col, level)"""


@query(f"""SELECT o_orderkey AS doc_id, page, block_id, block_type, replace(text, '#', CAST(o_orderkey AS VARCHAR)) AS text, CASE block_id WHEN 'texts/0' THEN 1.5 WHEN 'tables/0/cell/0' THEN 1.0 END AS l, CASE block_id WHEN 'texts/0' THEN 80.0 WHEN 'tables/0/cell/0' THEN 8.0 END AS b, parent, table_id, "row", col, level
FROM orders, {_BLOCKS} WHERE o_orderkey % 2 = 0 OR block_id NOT LIKE 'tables/%'""")
def parsed_blocks(t: Tables) -> DataFrame:
    """Blocks of parsed documents, each on its page."""
    return D.from_parsed(_parsed(t)).select("doc_id", "page", "block_id", "block_type", "text", "l", "b", "parent", "table_id", "row", "col", "level")


_NEXT = ("texts/0", "texts/1", "texts/3", "key_value_items/0/key", "key_value_items/0/val", "texts/2", "tables/0", *(f"tables/0/cell/{i}" for i in range(4)))
_CELL = [f"tables/0/cell/{i}" for i in range(4)]
_RELATIONS = [
    *(("NEXT_TO", a, b, "geometry") for a, b in zip(_NEXT, _NEXT[1:], strict=False)), ("CONTAINS", "body", "texts/0", "backend"), ("CONTAINS", "texts/0", "texts/1", "backend"), *(("CONTAINS", "tables/0", c, "backend") for c in _CELL),
    *(("SAME_ROW", _CELL[a], _CELL[b], "table") for a, b in ((0, 1), (1, 0), (2, 3), (3, 2))), *(("SAME_COLUMN", _CELL[a], _CELL[b], "table") for a, b in ((0, 2), (2, 0), (1, 3), (3, 1))),
    *(("UNDER_HEADING", "texts/0", x, "reading_order") for x in _NEXT[1:5]), *(("UNDER_HEADING", "texts/2", x, "reading_order") for x in _NEXT[6:]),
]


@query(f"SELECT o_orderkey AS doc_id, type, a, b, origin FROM orders, (VALUES {', '.join(map(str, _RELATIONS))}) AS v(type, a, b, origin) WHERE o_orderkey % 2 = 0 OR b NOT LIKE 'tables/%'")
def ir_relations_all(t: Tables) -> DataFrame:
    """All five relations of parsed documents."""
    return D.relations(D.from_parsed(_parsed(t)))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_linenumber AS INT) END AS page, CASE WHEN l_partkey % 4 > 1 THEN [round(l_extendedprice / 7, 2), round(l_quantity / 7, 2), round(l_extendedprice / 3, 2), round(l_tax / 7, 2)] END AS bbox,
  CASE WHEN l_partkey % 4 = 3 THEN [CAST(0 AS INT), CAST(l_linenumber AS INT)] END AS charspan, CASE WHEN l_partkey % 4 > 0 THEN left(repeat('said ', 80), 300) END AS excerpt FROM lineitem""")
def evidence_pointers(t: Tables) -> DataFrame:
    """The first provenance of an item as a pointer; some have none, or no box, or no span."""
    k = F.col("l_partkey") % 4
    one = F.struct(F.col("l_linenumber").cast("int").alias("page"), *(F.when(k > 1, x).alias(c) for c, x in zip("ltrb", (F.col("l_extendedprice") / 7, F.col("l_quantity") / 7, F.col("l_extendedprice") / 3, F.col("l_tax") / 7), strict=True)), F.when(k == 3, 0).alias("start"), F.when(k == 3, F.col("l_linenumber").cast("int")).alias("end"))
    later = F.struct(F.lit(99).alias("page"), *(F.lit(0.0).alias(c) for c in "ltrb"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    e = D.evidence(F.when(k > 0, F.array(one, later)), F.repeat(F.lit("said "), 80), F.lit("s"), F.lit("k"), F.lit("sha"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.page", "e.bbox", "e.charspan", F.col("e.text_excerpt").alias("excerpt"))


_B = "b AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ix, CAST((i - 1) // 10 AS BIGINT) AS page, x[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i))"


def _boxed(t: Tables) -> DataFrame:
    d = layout.line_blocks(t.documents, per_page=10).withColumnRenamed("block", "text")
    top = 200.0 - (F.col("ix") % 10) * 20
    return d.withColumns({"l": F.lit(10.0), "r": F.when(F.col("ix") % 4 == 1, 150.0).otherwise(90.0), "t": top, "b": F.when(F.col("ix") % 4 == 2, top + 1).otherwise(top - 10)})


@query(rf"""WITH {_B}, s AS (SELECT doc_id AS spec_id, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 9999 ELSE doc_id % ((n + 9) // 10) END AS page, CASE WHEN doc_id % 3 = 0 THEN 'zzqq' ELSE lower(left(trim(x[10 * CAST(doc_id % ((n + 9) // 10) AS INT) + 1]), 6)) END AS match FROM (SELECT doc_id, string_split(text, chr(10)) AS x, len(string_split(text, chr(10))) AS n FROM documents)),
h AS (SELECT spec_id, min(ix) AS ix FROM s JOIN b USING (doc_id, page) WHERE trim(text) <> '' AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(match, '\s+', ' ', 'g')))) GROUP BY 1)
SELECT spec_id, CASE WHEN s.doc_id >= 1000000000 THEN 'no document' WHEN s.page = 9999 THEN 'no page' WHEN h.ix IS NULL THEN 'no block' END AS error, trim(b.text) AS excerpt, CASE WHEN h.ix % 4 NOT IN (1, 2) THEN [10.0, 200.0 - h.ix % 10 * 20, 90.0, 190.0 - h.ix % 10 * 20] END AS bbox
FROM s LEFT JOIN h USING (spec_id) LEFT JOIN b ON b.doc_id = s.doc_id AND b.ix = h.ix""")
def pointer_resolution(t: Tables) -> DataFrame:
    """The block that a page and a text point to, on all pages; some boxes don't lie on their page."""
    k, blocks, lines = F.col("doc_id"), _boxed(t), F.split("text", "\n")
    own = k % F.ceil(F.size(lines) / 10)
    specs = t.documents.select(k.alias("spec_id"), F.when(k % 7 == 0, k + 1000000000).otherwise(k).alias("doc_id"), F.when(k % 5 == 0, 9999).otherwise(own).cast("long").alias("page"), F.when(k % 3 == 0, "zzqq").otherwise(F.lower(F.left(F.trim(F.get(lines, (own * 10).cast("int"))), F.lit(6)))).alias("match"))
    pages = blocks.groupBy("doc_id", "page").agg(F.lit(100.0).alias("width"), F.lit(200.0).alias("height"))
    return D.resolve_pointers(specs, blocks, pages).select("spec_id", "error", "excerpt", "bbox")


@query(f"WITH {_B}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS hit FROM b WHERE regexp_matches(text, '(?i)(le|der) ')) SELECT doc_id, ix, CAST(hit AS INT) AS hit FROM k WHERE hit <= 3")
def find_blocks(t: Tables) -> DataFrame:
    """The first three blocks of each document that a pattern hits."""
    return D.find(layout.line_blocks(t.documents).withColumnRenamed("block", "text"), "(?i)(le|der) ", 3).select("doc_id", "ix", "hit")


@query(f"WITH {_B} SELECT doc_id, greatest(min(ix) - 2, 0) AS lo, max(ix) + 2 AS hi FROM b WHERE text LIKE '%a%' GROUP BY 1")
def covering_ranges(t: Tables) -> DataFrame:
    """From the first to the last of the ranges around hits."""
    hits = layout.line_blocks(t.documents).where(F.contains("block", F.lit("a")))
    return D.covering_range(hits.select("doc_id", F.greatest(F.col("ix") - 2, F.lit(0)).alias("lo"), (F.col("ix") + 2).alias("hi")), "doc_id")


_TAKES = ", ".join(f"('{s}', '{f}', '{fam}')" for fam, schemas in D.FAMILIES.items() for s in schemas for f in D.SOURCES[s])
_FIELDS = tuple(extract.RULES)


@query(f"""WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, list_extract({list(_FIELDS)}, CAST(l_partkey % {len(_FIELDS)} AS INT) + 1) AS field, list_extract(['OBSERVED', 'DERIVED', 'CONFLICT', 'MISSING'], CAST(l_suppkey % 4 AS INT) + 1) AS status FROM lineitem)
SELECT l_partkey, l_suppkey, doc_id || ':' || f.field AS candidate_id, f.field, schema_field, family, status AS observation_status FROM f JOIN (VALUES {_TAKES}) AS m(schema_field, field, family) ON m.field = f.field WHERE status <> 'MISSING' AND l_linenumber % 3 > 0""")
def candidate_projection(t: Tables) -> DataFrame:
    """Observations with a value as candidates, once for each review field that takes them."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    n = F.col("l_linenumber") % 3
    d = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", pick(_FIELDS, F.col("l_partkey") % len(_FIELDS)).alias("field"), pick(("OBSERVED", "DERIVED", "CONFLICT", "MISSING"), F.col("l_suppkey") % 4).alias("status"), F.lit("x").alias("class"), F.when(n == 1, F.array(F.lit("v"))).when(n == 2, F.array(F.lit(""), F.lit("w"))).otherwise(F.array(F.lit(""))).alias("values"), F.struct("l_partkey", "l_suppkey").alias("lexeme"))
    return D.by_schema(D.candidates(d)).select("raw_lexeme.*", "candidate_id", "field", "schema_field", "family", "observation_status")


@query("""WITH f AS (SELECT field, family FROM (VALUES ('isin', 'Identity'), ('maturity', 'Issuance'), ('spread', 'Coupon'), ('redemption', 'Exercise'), ('cap', 'Structured payoff'), ('settlement', 'Legal / settlement'), ('nothing', 'Other')) AS v(field, family))
SELECT o_orderkey, field, family FROM orders, f WHERE field = list_extract(['isin', 'maturity', 'spread', 'redemption', 'cap', 'settlement', 'nothing'], CAST(o_orderkey % 7 AS INT) + 1)""")
def field_families(t: Tables) -> DataFrame:
    field = F.element_at(F.array(*map(F.lit, ("isin", "maturity", "spread", "redemption", "cap", "settlement", "nothing"))), (F.col("o_orderkey") % 7).cast("int") + 1)
    return t.orders.select("o_orderkey", field.alias("field"), D.field_family(field).alias("family"))


def _rows(t: Tables) -> DataFrame:
    """Registry rows of three kinds as HTML, one for each order."""
    k, td = F.col("o_orderkey"), lambda *xs: F.concat(*(F.concat(F.lit("<td>"), x if not isinstance(x, str) else F.lit(x), F.lit("</td>")) for x in xs))
    link, reg = F.concat(F.lit('<a href="x/verdocumento/ver?e='), k, F.lit('">doc</a> <a href="q?nif=A'), k, F.lit('&z=1">nif</a>')), F.concat(k, F.when(k % 4 == 0, ".1").when(k % 4 == 1, "-2").otherwise(""))
    folleto = F.concat(td("01/02/2020", reg, "  An <b>issuer</b> ", "x", "y", "Programa&nbsp;renta", "100"), F.when(k % 2 == 0, td(F.concat(F.lit("ES"), k), "AIAF")).otherwise(""), link)
    ccff = F.concat(td("use", "01/01/2020", "02/01/2020", F.concat(F.lit("CCFF_"), k), "Issuer", "03/01/2020", k.cast("string"), "doc", "Bonos", "200", F.concat(F.lit("XS"), k), "AIAF"), F.lit('<a href="f?NUMFOL='), k, F.lit('&x">p</a>'), link)
    adm = F.concat(td("04/02/2020", k.cast("string"), "Issuer", "x", "y", "Acciones", "300"), F.when(k % 2 == 0, td("IS")).otherwise(""))
    return t.orders.select("o_orderkey", folleto.alias("folleto"), ccff.alias("ccff"), adm.alias("adm"))


@query("""SELECT o_orderkey, 'FOL_' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.1' WHEN 1 THEN '-2' ELSE '' END || '|' || o_orderkey || '|' || CASE o_orderkey % 4 WHEN 0 THEN '.1' WHEN 1 THEN '-2' ELSE '?' END || '|PROGRAMA RENTA|An issuer|A' || o_orderkey || '|01/02/2020|100|' || CASE WHEN o_orderkey % 2 = 0 THEN 'ES' || o_orderkey ELSE '' END || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'AIAF' ELSE '' END || '|https://www.cnmv.es/webservices/verdocumento/ver?e=' || o_orderkey AS folleto,
 'CCFF_' || o_orderkey || '|' || o_orderkey || '|' || o_orderkey || '|Bonos|XS' || o_orderkey || '|https://www.cnmv.es/webservices/verdocumento/ver?e=' || o_orderkey AS ccff, 'ADM_' || o_orderkey || '|' || o_orderkey || '|Issuer|04/02/2020|Acciones|300|' || CASE WHEN o_orderkey % 2 = 0 THEN 'IS' ELSE '' END || '||?' AS adm FROM orders""")
def registry_layouts(t: Tables) -> DataFrame:
    """Records of prospectus, final-terms and admission rows."""
    d, said = _rows(t), lambda r, *names: F.concat_ws("|", *(F.coalesce(r[n], F.lit("?")) for n in names))
    return d.select(
        "o_orderkey", said(files.prospectus_row(F.col("folleto"), F.lit(2020)), "source_record_key", "registro_oficial", "version_suffix", "rol", "emisor", "nif", "fecha_registro", "nominal", "isin", "admision", "doc_url").alias("folleto"),
        said(files.final_terms_row(F.col("ccff")), "source_record_key", "registro_oficial", "numfol_link", "tipo_valor", "isin", "doc_url").alias("ccff"), said(files.admission_row(F.col("adm")), "source_record_key", "registro_oficial", "emisor", "fecha_registro", "denominacion", "nominal", "isin", "mercados", "doc_url").alias("adm"),
    )


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS issue, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 3 END AS step, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_custkey % 40 AS INT)) AS DATE) END AS maturity FROM orders),
s AS (SELECT *, list_filter(list_transform(range(1, 200), lambda k: CAST(issue + to_months(CAST(k * step AS INT)) AS DATE)), lambda x: x <= maturity) AS e FROM d)
SELECT o_orderkey, CASE WHEN maturity IS NULL THEN 'UNVERIFIABLE' WHEN maturity <= issue THEN 'INVALID' WHEN step IS NULL THEN 'UNVERIFIABLE' WHEN len(e) = 0 THEN 'INVALID' WHEN list_last(e) <> maturity AND maturity - list_last(e) > step * 40 THEN 'INVALID' ELSE 'VALID' END AS status,
  CASE WHEN issue < maturity AND step IS NOT NULL THEN CAST(len(e) AS INT) END AS n_dates FROM s""")
def schedule_check(t: Tables) -> DataFrame:
    """Payment dates checked from a document's observations; the written frequency goes before its normal form."""
    k, issue = F.col("o_orderkey"), F.to_date("o_orderdate")
    phrase = F.element_at(F.array(*map(F.lit, ("each year", "semiannually", "quarterly", "at maturity"))), (k % 4).cast("int") + 1)
    maturity = F.when(k % 9 != 0, F.add_months(issue, (F.col("o_custkey") % 40).cast("int")).cast("string"))
    one = lambda field, value, lexeme: F.struct(F.lit(field).alias("field"), value.alias("value"), lexeme.alias("lexeme"))
    none = F.lit(None).cast("string")
    obs = t.orders.select(k.alias("doc_id"), F.explode(F.array(one("issue_date", issue.cast("string"), none), one("maturity", maturity, none), one("payment_frequency", F.when(k % 2 == 0, phrase).otherwise(F.lit("MONTHLY")), F.when(k % 2 == 1, phrase)))).alias("o")).select("doc_id", "o.*")
    return reconcile.check_schedule(obs, "doc_id").select(F.col("doc_id").alias("o_orderkey"), "status", "n_dates")


@query("""SELECT doc_id, doc_id % 5 <> 0 AS parsed, CASE WHEN doc_id % 5 = 0 THEN 'NO_PARSED_DOCUMENT' WHEN doc_id % 7 = 0 THEN 'INVALID_EVALUATION' END AS note, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n FROM documents""")
def holdout_results(t: Tables) -> DataFrame:
    """All documents of a manifest, with results where there are some, else a note."""
    k = F.col("doc_id")
    d = sessions.with_parsed(t.documents.select("doc_id"), t.documents.where(k % 5 != 0), t.documents.where(k % 7 != 0).select("doc_id", "n_chars"))
    return d.select("doc_id", "parsed", "note", F.col("result.n_chars").alias("n"))
