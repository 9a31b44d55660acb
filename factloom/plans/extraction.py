"""Queries over laid-out text: lines as blocks, ten lines as a page, and boxes on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import layout
from factloom.plans.registry import Tables, query
from factloom.sources.shared import tasks

_SECTIONS = {"the": r"(?i)^the\b", "und": r"(?i)(^|[^a-z])und([^a-z]|$)", "de": r"(?i)^de\b"}
_B = "b AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ix, CAST((i - 1) // 10 AS BIGINT) AS page, x[i] AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i))"
_H = "h AS (SELECT b.*, s.section FROM b JOIN (VALUES ('the', '(?i)^the\\b'), ('und', '(?i)(^|[^a-z])und([^a-z]|$)'), ('de', '(?i)^de\\b')) AS s(section, p) ON regexp_matches(block, p))"
_R = "r AS (SELECT doc_id, section, page, greatest(min(ix) - 10, 0) AS lo, max(ix) + 40 AS hi, count(*) AS score FROM h GROUP BY 1, 2, 3)"


@query(f"WITH {_B}, {_H}, {_R} SELECT r.*, (SELECT count(*) FROM b WHERE b.doc_id = r.doc_id AND b.ix >= lo AND b.ix < hi) AS n_blocks FROM r")
def section_grep_regions(t: Tables) -> DataFrame:
    """Regions of three sections with the number of blocks in each."""
    blocks = layout.line_blocks(t.documents)
    r = layout.regions(layout.section_hits(blocks, _SECTIONS))
    last = blocks.groupBy("doc_id").agg(F.max("ix").alias("last"))
    return r.join(last, "doc_id").select("doc_id", "section", "page", "lo", "hi", "score", (F.least(F.col("hi"), F.col("last") + 1) - F.col("lo")).alias("n_blocks"))


@query(f"WITH {_B}, {_H}, {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, page) AS n FROM r) SELECT doc_id, section, page, lo, hi, score FROM k WHERE n = 1")
def best_region_first(t: Tables) -> DataFrame:
    return layout.best_regions(layout.regions(layout.section_hits(layout.line_blocks(t.documents), _SECTIONS)))


@query(f"WITH {_B} SELECT doc_id, page, string_agg(block, chr(10) ORDER BY ix) AS text, count(*) AS n_blocks FROM b GROUP BY 1, 2")
def page_text_concat(t: Tables) -> DataFrame:
    """Texts of pages, blocks in reading order."""
    lines = F.array_sort(F.collect_list(F.struct("ix", "block")))
    return layout.line_blocks(t.documents).groupBy("doc_id", "page").agg(F.array_join(lines["block"], "\n").alias("text"), F.count("*").alias("n_blocks"))


@query(f"""WITH {_B}, p AS (SELECT DISTINCT doc_id, page FROM b WHERE regexp_matches(block, '(?i)(^|[^a-z])und([^a-z]|$)')), l AS (SELECT *, CASE WHEN page - 2 > lag(page) OVER w + 3 OR lag(page) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM l) SELECT doc_id, greatest(min(page) - 2, 0) AS lo, max(page) + 2 AS hi FROM g GROUP BY doc_id, island""")
def prescan_ranges(t: Tables) -> DataFrame:
    """Ranges of pages about those with a word."""
    pages = layout.line_blocks(t.documents).where(F.col("block").rlike(_SECTIONS["und"])).select("doc_id", "page").distinct()
    return layout.islands(pages, 2, "doc_id")


@query(f"WITH {_B}, m AS (SELECT doc_id, ix, left(block, 160) AS excerpt FROM b WHERE contains(lower(block), 'licen')) SELECT * FROM m ORDER BY doc_id, ix LIMIT 100")
def doc_search_topk(t: Tables) -> DataFrame:
    """The first hundred blocks with a text in them, whatever the case."""
    hit = layout.line_blocks(t.documents).where(F.contains(F.lower("block"), F.lit("licen")))
    return hit.select("doc_id", "ix", F.substring("block", 1, 160).alias("excerpt")).orderBy("doc_id", "ix").limit(100)


@query(f"WITH {_B}, {_H}, k AS (SELECT doc_id, section, ix, row_number() OVER (PARTITION BY doc_id, section ORDER BY ix) AS place FROM h) SELECT * FROM k WHERE place <= 10")
def digest_top10(t: Tables) -> DataFrame:
    """The first ten hits of each section in each document."""
    hits = layout.section_hits(layout.line_blocks(t.documents), _SECTIONS).select("doc_id", "section", "ix")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("ix")).cast("long")).where("place <= 10")


@query("SELECT doc_id, term, len(regexp_extract_all(lower(text), term)) AS hits, NOT contains(lower(text), term) AS absent FROM documents, (VALUES ('licen'), ('the '), ('xyzzy')) AS v(term)")
def absence_scan(t: Tables) -> DataFrame:
    """Hits of each term in each document; a gate asks for none."""
    terms = F.explode(F.array(*map(F.lit, ("licen", "the ", "xyzzy"))))
    d = t.documents.select("doc_id", F.lower("text").alias("text"), terms.alias("term"))
    n = F.size(F.regexp_extract_all("text", F.col("term"), F.lit(0))).cast("long")
    return d.select("doc_id", "term", n.alias("hits"), (n == 0).alias("absent"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'zzqqzz' ELSE lower(substr(text, 3, 12)) END AS lexeme, CASE WHEN doc_id % 3 = 0 THEN right(text, 30) ELSE left(text, 40) END AS excerpt, text FROM documents),
k AS (SELECT doc_id, lower(trim(regexp_replace(lexeme, '\\s+', ' ', 'g'))) AS l, lower(trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))) AS e, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM d)
SELECT doc_id, CASE WHEN l IS NULL THEN 'no_lexeme' WHEN contains(e, l) AND contains(t, e) THEN 'verified_verbatim' WHEN contains(t, l) THEN 'verified_verbatim_doclevel' ELSE 'VALUE_UNVERIFIED' END AS verdict FROM k""")
def verbatim_verify(t: Tables) -> DataFrame:
    """Lexemes that stand in their excerpt, elsewhere, or nowhere."""
    k = F.col("doc_id")
    lexeme = F.when(k % 7 == 0, None).when(k % 5 == 0, "zzqqzz").otherwise(F.lower(F.substring("text", 3, 12)))
    excerpt = F.when(k % 3 == 0, F.right("text", F.lit(30))).otherwise(F.left("text", F.lit(40)))
    return t.documents.select("doc_id", layout.verbatim(F.col("text"), lexeme, excerpt, L.verbatim_key).alias("verdict"))


def _boxes(t: Tables) -> DataFrame:
    """Parts on a grid: 5 columns, 20 rows a page, heights that differ a little."""
    k, cell = F.col("p_partkey"), F.col("p_partkey") % 100
    l, top = (cell % 5 * 100).cast("double"), (700 - F.floor(cell / 5) * 12 + k % 3).cast("double")
    return t.part.select(F.floor(k / 100).cast("long").alias("page"), k.alias("ix"), l.alias("l"), top.alias("t"), (l + 60 + F.col("p_size") % 30).alias("r"), (top - 10).alias("b"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("text"))


_X = "x AS (SELECT p_partkey // 100 AS page, p_partkey AS ix, CAST(p_partkey % 100 % 5 * 100 AS DOUBLE) AS l, CAST(700 - (p_partkey % 100) // 5 * 12 + p_partkey % 3 AS DOUBLE) AS t, p_partkey % 100 % 5 * 100 + 60.0 + p_size % 30 AS r, p_partkey % 17 = 0 AS blank FROM part)"


@query(f"WITH {_X}, j AS (SELECT a.page, a.ix, b.ix AS right_ix, row_number() OVER (PARTITION BY a.page, a.ix ORDER BY b.l - a.r, b.ix) AS n FROM x a JOIN x b ON a.page = b.page AND a.ix <> b.ix AND abs(a.t - b.t) <= 6 AND b.l >= a.r - 2 AND NOT b.blank) SELECT page, ix, right_ix FROM j WHERE n = 1")
def spatial_right_of(t: Tables) -> DataFrame:
    return layout.right_of(_boxes(t), tasks=tasks(t.part, 3))


@query(f"WITH {_X}, j AS (SELECT a.page, a.ix, b.ix AS below_ix, row_number() OVER (PARTITION BY a.page, a.ix ORDER BY a.t - b.t, b.ix) AS n FROM x a JOIN x b ON a.page = b.page AND a.t > b.t AND a.t - b.t <= 30 AND abs(a.l - b.l) < 120) SELECT page, ix, below_ix FROM j WHERE n = 1")
def spatial_below(t: Tables) -> DataFrame:
    return layout.below(_boxes(t), tasks=tasks(t.part, 6))


@query("""
SELECT o_orderkey AS doc_id, 0 AS ix, 0 AS page, strftime(o_orderdate, '%Y-%m-%d') AS value, 'INLINE' AS way FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 0, 0, CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 3 = 1 THEN 'NEXT' ELSE 'NONE' END FROM orders WHERE o_orderkey % 3 <> 0""")
def label_value_text(t: Tables) -> DataFrame:
    """Values after a label on the same line, on a later line, or missing."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Maturity Date: "), day)).when(k == 1, F.concat(F.lit("Maturity Date:\n\nCoupon:\n"), day)).otherwise("Maturity Date:\nCoupon:")
    return layout.label_values(layout.line_blocks(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey"), r"(?i)^maturity\s+date\b")


@query("""
SELECT o_orderkey AS "table", CAST(0 AS BIGINT) AS "row", 0 AS col, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 5 <> 0""")
def label_value_table(t: Tables) -> DataFrame:
    """Values beside a label's cell; labels that come three times are a column of data."""
    k = F.col("o_orderkey")
    first = F.array(F.lit("Status"), F.lit(" "), F.when(k % 4 == 0, " ").otherwise(F.col("o_orderstatus")))
    data = F.array(F.lit("Status"), F.lit("x"), F.lit("y"))
    rows = F.when(k % 5 == 0, F.array(data, data, data)).otherwise(F.array(first))
    d = t.orders.select(k.alias("table"), F.posexplode(rows).alias("row", "cells")).select("table", F.col("row").cast("long").alias("row"), F.posexplode("cells").alias("col", "text"))
    return layout.row_values(d, r"(?i)^status\b")


@query("""
WITH v AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || CASE WHEN l_linenumber = 1 THEN '' ELSE l_linestatus END)) AS a FROM lineitem WHERE l_quantity >= 25 GROUP BY 1), n AS (SELECT l_orderkey, count(*) FILTER (l_quantity < 5) AS na FROM lineitem GROUP BY 1),
k AS (SELECT n.l_orderkey, na, coalesce(list_filter(a, lambda x: len(list_filter(a, lambda y: y <> x AND contains(y, x))) = 0), []) AS "values" FROM n LEFT JOIN v USING (l_orderkey))
SELECT l_orderkey, "values", CASE WHEN len("values") = 0 AND na > 0 THEN 'NOT_APPLICABLE' WHEN len("values") = 0 THEN 'MISSING' WHEN len("values") = 1 THEN 'OBSERVED' ELSE 'CONFLICT' END AS status FROM k""")
def resolve_observations(t: Tables) -> DataFrame:
    """One observation of an order from its lines."""
    status = F.when(F.col("l_quantity") < 5, "NOT_APPLICABLE").when(F.col("l_quantity") >= 25, "OBSERVED").otherwise("MISSING")
    value = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_linestatus")))
    return layout.resolve(t.lineitem.select("l_orderkey", status.alias("status"), value.alias("value")), False, "l_orderkey")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)>') AS tags FROM pages), b AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS ix, tags[i] AS tag FROM p, unnest(range(1, len(tags) + 1)) AS u(i)),
w AS (SELECT *, lag(ix) OVER (PARTITION BY page_id ORDER BY ix) AS before, max(CASE WHEN tag = '<h1>' THEN ix END) OVER (PARTITION BY page_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM b)
SELECT page_id, 'NEXT_TO' AS kind, before AS a, ix AS b FROM w WHERE before IS NOT NULL UNION ALL SELECT page_id, 'UNDER_HEADING', ix, heading FROM w WHERE heading IS NOT NULL""")
def ir_relations(t: Tables) -> DataFrame:
    """Relations of a page's blocks: reading order and the latest heading before."""
    blocks = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p|li)>"), F.lit(0))).alias("ix", "tag")).withColumn("ix", F.col("ix").cast("long"))
    w = Window.partitionBy("page_id").orderBy("ix")
    d = blocks.withColumns({"before": F.lag("ix").over(w), "heading": F.last(F.when(F.col("tag") == "<h1>", F.col("ix")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    pair = lambda kind, a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")))
    both = F.array_compact(F.array(pair("NEXT_TO", "before", "ix"), pair("UNDER_HEADING", "ix", "heading")))
    return d.select("page_id", F.explode(both).alias("x")).select("page_id", "x.*")
