"""Parsed documents: evidence pointers, blocks of a common form, relations between them, search, and candidates for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import lexemes as L

# Kinds of blocks by the label that a parser gives them; all others are OTHER.
BLOCK_TYPES = {
    "section_header": "HEADING", "title": "HEADING", "list_item": "LIST_ITEM", "footnote": "FOOTNOTE", "text": "TEXT", "caption": "TEXT", "paragraph": "TEXT", "formula": "TEXT", "page_header": "OTHER", "page_footer": "OTHER", "checkbox_selected": "OTHER", "checkbox_unselected": "OTHER",
    "picture": "OTHER", "document_index": "OTHER", "code": "TEXT", "form": "OTHER", "key_value_region": "OTHER", "grading_scale": "OTHER", "handwritten_text": "TEXT", "empty_value": "OTHER",
}
# Fields of the review schema by family, and the extracted fields that each of them takes candidates from.
FAMILIES = {
    "Identity": ("isin", "issuer"),
    "Issuance": ("currency", "issue_date", "maturity", "denomination", "issued_amount", "ranking", "subordination"),
    "Coupon": ("coupon_type", "coupon_rate", "benchmark", "spread", "payment_frequency", "day_count", "business_day_convention", "reset_fixing"),
    "Exercise": ("call_put_terms", "redemption"),
    "Structured payoff": ("underlying", "observation_schedule", "autocall", "coupon_barrier", "protection_barrier", "strike", "participation", "cap"),
    "Legal / settlement": ("settlement",),
}
SOURCES = {
    "isin": ("isin",), "issuer": (), "currency": ("currency",), "issue_date": ("issue_date",), "maturity": ("maturity",), "denomination": ("denomination",), "issued_amount": ("issued_amount",), "coupon_type": ("coupon_type",), "coupon_rate": ("coupon_rate",),
    "benchmark": ("benchmark",), "spread": ("spread",), "payment_frequency": ("payment_frequency",), "day_count": ("day_count",), "business_day_convention": ("business_day_convention",), "reset_fixing": ("reset_dates", "fixing_rules"),
    "call_put_terms": ("call_dates", "put_dates"), "ranking": ("ranking",), "subordination": ("subordination",), "underlying": ("underlying",), "observation_schedule": ("observation_dates",), "autocall": ("autocall",), "coupon_barrier": ("barrier",),
    "protection_barrier": ("barrier",), "strike": ("strike",), "participation": ("participation",), "cap": ("cap",), "redemption": ("redemption_formula",), "settlement": ("settlement_type",),
}
EXCERPT = 300
# The form of the parser's JSON, as far as it is read.
BOX = "struct<l: double, t: double, r: double, b: double>"
PROV = f"array<struct<page_no: int, bbox: {BOX}>>"
PAGE = "struct<page_no: int, size: struct<width: double, height: double>>"
PARSED = (
    f"struct<pages: variant, texts: array<struct<self_ref: string, label: string, text: string, level: int, parent: struct<`$ref`: string>, prov: {PROV}>>, "
    f"tables: array<struct<self_ref: string, prov: {PROV}, data: struct<table_cells: array<struct<text: string, bbox: {BOX}, start_row_offset_idx: int, start_col_offset_idx: int>>>>>, "
    f"key_value_items: array<struct<key: struct<text: string, prov: {PROV}>, value: struct<text: string, prov: {PROV}>>>>"
)


def field_family(field: Column) -> Column:
    """The family of a review field; `Other` for all else."""
    pairs = [x for family, fields in FAMILIES.items() for f in fields for x in (F.lit(f), F.lit(family))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), field), F.lit("Other"))


def evidence(prov: Column, text: Column, source: Column, key: Column, sha: Column, extractor: str = "parser") -> Column:
    """A pointer to an item by its first provenance (page, l, t, r, b, start, end), NULL without one; boxes to two places, the text's first characters."""
    p = F.get(prov, 0)
    box = F.when(p["l"].isNotNull(), F.array(*(F.round(p[c], 2) for c in "ltrb")))
    return F.when(p.isNotNull(), F.struct(source.alias("source"), key.alias("source_record_key"), sha.alias("snapshot_sha256"), p["page"].alias("page"), box.alias("bbox"), F.when(p["start"].isNotNull(), F.array(p["start"], p["end"])).alias("charspan"), F.substring(F.coalesce(text, F.lit("")), 1, EXCERPT).alias("text_excerpt"), F.lit(extractor).alias("extractor")))


def parsed_pages(pages: Column) -> Column:
    """Numbers of a document's pages in order, which come as an object by number or as a list (a variant)."""
    named = F.transform(F.map_entries(F.try_variant_get(pages, "$", f"map<string, {PAGE}>")), lambda e: F.coalesce(e["value"]["page_no"], e["key"].cast("int")))
    listed = F.transform(F.try_variant_get(pages, "$", f"array<{PAGE}>"), lambda p, i: F.coalesce(p["page_no"], i + 1))
    return F.coalesce(F.when(F.size(listed) > 0, listed), named)


def from_parsed(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Blocks of documents of a parser's JSON: (doc_id, page, block_id, block_type, text, l, t, r, b, parent, table_id, row, col, level, seq).

    Texts, then tables with their cells, then keys and values, each on the page of its first provenance, or on the document's first page if
    that is none of its pages; `seq` is the order in which they are put there. A document is parsed once: all its blocks come out of
    one array.
    """
    parsed = docs.select("doc_id", F.explode(F.array(F.from_json(json_col, PARSED))).alias("d"))  # a generator, so the parse isn't repeated for each use
    d = parsed.select("doc_id", "d.*").withColumn("known", parsed_pages(F.col("pages")))
    none = lambda kind: F.lit(None).cast(kind)
    kind = lambda label: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BLOCK_TYPES.items() for x in kv)), label), F.lit("OTHER"))
    ref = lambda c: F.regexp_replace(c, r"^[#/]+", "")
    page = lambda prov: F.when(F.array_contains("known", F.get(prov, 0)["page_no"]), F.get(prov, 0)["page_no"]).otherwise(F.get("known", 0))

    def block(stage: int, i: Column, k: Column | None, on: Column, id_: Column, type_: Column, text: Column, box: Column, parent: Column | None = None, table: Column | None = None, row: Column | None = None, col: Column | None = None, level: Column | None = None) -> Column:
        or_none = lambda c, t: none(t) if c is None else c.cast(t)
        seq = F.struct(F.lit(stage).alias("stage"), i.cast("int").alias("i"), (F.lit(-1) if k is None else k).cast("int").alias("k"))
        return F.struct(on.alias("page"), id_.alias("block_id"), type_.alias("block_type"), F.coalesce(text, F.lit("")).alias("text"), *(box[c].alias(c) for c in "ltrb"), or_none(parent, "string").alias("parent"), or_none(table, "string").alias("table_id"), or_none(row, "int").alias("row"), or_none(col, "int").alias("col"), or_none(level, "int").alias("level"), seq.alias("seq"))

    other, empty = F.lit("OTHER"), lambda c: F.coalesce(c, F.array())
    texts = F.transform("texts", lambda x, i: block(0, i, None, page(x["prov"]), ref(x["self_ref"]), kind(x["label"]), x["text"], F.get(x["prov"], 0)["bbox"], parent=ref(x["parent"]["$ref"]), level=x["level"]))

    def of_table(x: Column, i: Column) -> Column:
        name = F.concat(F.lit("tables/"), i.cast("string"))
        head = block(1, i, None, page(x["prov"]), ref(x["self_ref"]), other, F.lit(""), F.get(x["prov"], 0)["bbox"])
        cell = lambda c, k: block(1, i, k, page(x["prov"]), F.concat(name, F.lit("/cell/"), k.cast("string")), F.lit("TABLE_CELL"), c["text"], c["bbox"], parent=name, table=name, row=c["start_row_offset_idx"], col=c["start_col_offset_idx"])
        return F.concat(F.array(head), empty(F.transform(x["data"]["table_cells"], cell)))

    def of_pair(x: Column, i: Column) -> Column:
        name = F.concat(F.lit("key_value_items/"), i.cast("string"))
        return F.array(*(block(2, i, F.lit(k), page(x[part]["prov"]), F.concat(name, F.lit(end)), other, x[part]["text"], F.get(x[part]["prov"], 0)["bbox"], table=name) for k, (part, end) in enumerate((("key", "/key"), ("value", "/val")))))

    lists = (texts, F.flatten(F.transform("tables", of_table)), F.flatten(F.transform("key_value_items", of_pair)))
    return d.select("doc_id", F.inline(F.concat(*map(empty, lists)))).where("page is not null")


def relations(blocks: DataFrame, order: str = "seq") -> DataFrame:
    """(doc_id, type, a, b, origin) of blocks (doc_id, page, `order`, block_id, block_type, parent, table_id, row, col).

    NEXT_TO: consecutive in reading order; CONTAINS: a parent; SAME_ROW and SAME_COLUMN: ordered pairs of cells of a
    table, so as many as tables are wide or high; UNDER_HEADING: the heading before a block, whatever its level.
    """
    w = Window.partitionBy("doc_id").orderBy("page", order)
    cell = F.when((F.col("block_type") == "TABLE_CELL") & F.col("table_id").isNotNull(), F.col("block_id"))
    heading = F.last(F.when(F.col("block_type") == "HEADING", F.col("block_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mates = lambda by: F.when(cell.isNotNull() & F.col(by).isNotNull(), F.collect_list(cell).over(Window.partitionBy("doc_id", "table_id", by)))
    d = blocks.withColumns({"_before": F.lag("block_id").over(w), "_heading": heading, "_row": mates("row"), "_col": mates("col")})  # all by document: one shuffle
    own = F.col("block_id")
    one = lambda ok, kind, a, b, origin: F.when(ok, F.struct(F.lit(kind).alias("type"), a.alias("a"), b.alias("b"), F.lit(origin).alias("origin")))
    same = lambda kind, others: F.transform(F.filter(others, lambda x: x != own), lambda x: F.struct(F.lit(kind).alias("type"), own.alias("a"), x.alias("b"), F.lit("table").alias("origin")))
    single = F.array_compact(F.array(
        one(F.col("_before").isNotNull(), "NEXT_TO", F.col("_before"), own, "geometry"), one(F.col("parent") != "", "CONTAINS", F.col("parent"), own, "backend"),
        one((F.col("block_type") != "HEADING") & F.col("_heading").isNotNull(), "UNDER_HEADING", F.col("_heading"), own, "reading_order"),
    ))
    empty = lambda c: F.coalesce(c, F.array())
    return d.select("doc_id", F.inline(F.concat(single, empty(same("SAME_ROW", F.col("_row"))), empty(same("SAME_COLUMN", F.col("_col"))))))


def tables_with(rows: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, table) of tables with a cell that the pattern hits. rows: doc_id, table, row, cells."""
    return rows.where(F.exists("cells", lambda c: F.coalesce(c.rlike(pattern), F.lit(False)))).select("doc_id", "table").distinct()


def find(blocks: DataFrame, pattern: str, most: int = 20) -> DataFrame:
    """The first hits of a pattern in each document, in the order of its blocks (ix)."""
    w = Window.partitionBy("doc_id").orderBy("ix")
    return blocks.where(F.col("text").rlike(pattern)).withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= most)


def covering_range(ranges: DataFrame, *by: str) -> DataFrame:
    """From the least to the greatest page of ranges (lo, hi)."""
    return ranges.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def resolve_pointers(specs: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds to specs (spec_id, doc_id, page, match) the first block of the page that holds the text: excerpt, bbox and error.

    blocks: doc_id, page, ix, text, l, t, r, b (from the bottom); pages: doc_id, page, width, height. A box that doesn't lie on its page
    (two percent over are allowed) is left out. Errors: no document, no page, no block.
    """
    hits = specs.select("spec_id", "doc_id", "page", "match").join(blocks.where(F.trim("text") != ""), ["doc_id", "page"]).where(F.contains(L.verbatim_key(F.col("text")), L.verbatim_key(F.col("match"))))
    first = hits.groupBy("spec_id").agg(F.min_by(F.struct(F.trim("text").alias("excerpt"), "l", "t", "r", "b"), "ix").alias("hit"))
    known = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    d = specs.join(known, "doc_id", "left").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left").join(first, "spec_id", "left")
    h = lambda c: F.col(f"hit.{c}")
    fits = (h("l") >= 0) & (h("b") >= 0) & (h("l") < h("r")) & (h("b") < h("t")) & (h("r") <= F.col("width") * 1.02) & (h("t") <= F.col("height") * 1.02)
    error = F.when(F.col("n_pages").isNull(), "no document").when(F.col("width").isNull(), "no page").when(F.col("hit").isNull(), "no block")
    return d.select(*specs.columns, h("excerpt").alias("excerpt"), F.when(fits, F.array(*map(h, "ltrb"))).alias("bbox"), error.alias("error"))


def candidates(observations: DataFrame) -> DataFrame:
    """What reviewers are offered of observations (doc_id, field, status, class, values, lexeme): those with a value, by id."""
    some = F.col("status").isin("DERIVED", "OBSERVED", "CONFLICT") & (F.size(F.filter("values", lambda v: v.isNotNull() & (v != ""))) > 0)
    return observations.where(some).select(F.concat_ws(":", F.col("doc_id").cast("string"), "field").alias("candidate_id"), "doc_id", "field", F.col("values").alias("value"), F.col("lexeme").alias("raw_lexeme"), F.lit("CANDIDATE").alias("state"), F.col("status").alias("observation_status"), F.col("class").alias("confidence_class"))


def by_schema(found: DataFrame, field: str = "field") -> DataFrame:
    """Candidates once for each review field that takes them, with that field's family; fields that none takes give no row."""
    takes: dict[str, list[str]] = {}
    for schema, fields in SOURCES.items():
        for f in fields:
            takes.setdefault(f, []).append(schema)
    of = F.create_map(*(x for f, schemas in takes.items() for x in (F.lit(f), F.array(*map(F.lit, schemas)))))
    d = found.withColumn("schema_field", F.explode(F.try_element_at(of, F.col(field))))
    return d.withColumn("family", field_family(F.col("schema_field")))
