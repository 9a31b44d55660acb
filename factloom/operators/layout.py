"""Text blocks, regions and cells of laid-out documents, and relations between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import lexemes as L

PAGE = 10  # blocks of a page, where pages are made of lines


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = PAGE) -> DataFrame:
    """doc_id, ix, page, block: a block for each line."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("ix", "block"))
    return d.select("doc_id", F.col("ix").cast("long").alias("ix"), F.floor(F.col("ix") / per_page).cast("long").alias("page"), "block")


def _starts(pattern: str) -> set[str] | None:
    """What a match of a pattern can begin with, in lower case: the letters that open its alternatives; None if they don't tell."""
    m, alternatives, depth, at = re.match(r"\(\?iu?\)", pattern), [""], 0, 0
    body = pattern[m.end():] if m else pattern
    for x in re.findall(r"(?s)\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", body):
        depth += (x == "(") - (x == ")")
        if x == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += x
    out = set()
    for a in alternatives:
        lit = re.match(r"(?:\\b)?([A-Za-z0-9/]+)", a)
        word = lit[1][: -1 if a[lit.end() :][:1] in ("?", "*", "{") else None] if lit else ""
        if len(word) < 2:
            return None
        out.add(word.lower())
    return out


def may_hold(text: Column, pattern: str, lower: Column | None = None) -> Column:
    """False where a text of ASCII has none of the words that matches of a pattern begin with, which is quickly seen; other letters may be forms of ASCII ones."""
    words = _starts(pattern)
    if words is None:
        return F.lit(True)
    out, low = F.octet_length(text) != F.length(text), F.lower(text) if lower is None else lower
    for w in sorted(words):
        out = out | F.contains(low, F.lit(w))
    return out


def section_hits(blocks: DataFrame, sections: dict[str, str], rows: DataFrame | None = None) -> DataFrame:
    """Blocks that match a section's pattern, once for each section; with `rows` (doc_id, page, cells) also their cells, which have no place (ix)."""
    of = lambda x: F.array_compact(F.array(*[F.when(may_hold(x["text"], p, x["low"]) & x["text"].rlike(p), F.lit(s)) for s, p in sections.items()]))
    tests = lambda c: L.let(F.struct(c.alias("text"), F.lower(c).alias("low")), of)
    hits = blocks.withColumn("section", F.explode(tests(F.col("block"))))
    if rows is None:
        return hits
    cells = rows.select("doc_id", "page", F.explode(F.flatten(F.transform("cells", tests))).alias("section"))
    return hits.select("doc_id", "ix", "page", "section").unionByName(cells, allowMissingColumns=True)


def regions(hits: DataFrame, before: int = 10, after: int = 40) -> DataFrame:
    """A region for each page with hits: a range of blocks about them, scored by their number; empty where only cells are hit."""
    lo, hi = F.greatest(F.min("ix") - before, F.lit(0)), F.coalesce(F.max("ix") + after, F.lit(0))
    return hits.groupBy("doc_id", "section", "page").agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("score"))


BIN = 64  # places in a bin


def inside(spans: DataFrame, areas: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """Spans of places (first to last, NULL: no place, so inside all) joined with the areas (lo, up to hi) of the same `by` that hold them whole.

    Bins of places make it an equi-join: an area is there once for each of its bins, and a span is looked for in the bin of its first
    place alone, so no pair comes twice and a long document is dealt out by its bins.
    """
    bins = F.array(F.lit(-1).cast("long"))
    held = F.when(F.col("hi") > F.col("lo"), F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN)))
    a = areas.withColumn("_bin", F.explode(F.concat(bins, F.coalesce(held, F.array().cast("array<bigint>")))))
    s = spans.withColumn("_bin", F.coalesce(F.floor(F.col(first) / BIN), F.lit(-1)))
    fits = F.col(first).isNull() | ((F.col(first) >= F.col("lo")) & (F.col(last) < F.col("hi")))
    return s.join(a, [*by, "_bin"]).where(fits).drop("_bin")


def best_regions(found: DataFrame) -> DataFrame:
    """The region of each document and section with the highest score, the first page of equals."""
    best = F.max_by(F.struct("page", "lo", "hi", "score"), F.struct("score", -F.col("page")))
    return found.groupBy("doc_id", "section").agg(best.alias("r")).select("doc_id", "section", "r.*")


def islands(pages: DataFrame, context: int, *by: str) -> DataFrame:
    """Ranges of pages with `context` pages about each; ranges that touch are one."""
    w = Window.partitionBy(*by).orderBy("page")
    d = pages.withColumn("new", F.when(F.col("page") - context > F.lag("page").over(w) + context + 1, 1).when(F.lag("page").over(w).isNull(), 1).otherwise(0))
    d = d.withColumn("island", F.sum("new").over(w))
    return d.groupBy(*by, "island").agg(F.greatest(F.min("page") - context, F.lit(0)).alias("lo"), (F.max("page") + context).alias("hi")).drop("island")


def label_values(blocks: DataFrame, anchor: str) -> DataFrame:
    """Values of a label that opens a block: what follows its colon, else the next of three blocks that is no label."""
    w = Window.partitionBy("doc_id").orderBy("ix")
    nexts = [F.lead("block", k).over(w) for k in (1, 2, 3)]
    d = blocks.withColumn("nexts", F.array(*nexts)).where(F.col("block").rlike(anchor))
    inline = F.trim(F.regexp_extract("block", r"^[^:]*:\s*(.*)$", 1))
    following = F.filter("nexts", lambda x: x.isNotNull() & (F.trim(x) != "") & ~x.rlike(r":\s*$"))
    value = F.when(inline != "", inline).otherwise(F.try_element_at(following, F.lit(1)))
    return d.select("doc_id", "ix", "page", value.alias("value"), F.when(inline != "", "INLINE").when(value.isNotNull(), "NEXT").otherwise("NONE").alias("way"))


def row_values(cells: DataFrame, anchor: str, repeated: int = 3) -> DataFrame:
    """Values beside a label's cell: the first later cell of the row that isn't blank; a label that is a column's data has none.

    cells: table, row, col, text.
    """
    at = Window.partitionBy("table", "row").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("table", "text")
    some = F.when((F.trim("text") != "") & ~F.col("text").rlike(anchor), F.col("text"))
    d = cells.withColumns({"value": F.first(some, ignorenulls=True).over(at), "times": F.count("*").over(same)})
    return d.where(F.col("text").rlike(anchor) & (F.col("times") < repeated)).select("table", "row", "col", "value")


def _band(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _met(a: DataFrame, b: DataFrame, cell: list[str], tasks: int | None) -> DataFrame:
    """Probes and boxes of the same cell; with `tasks` both are dealt out to so many, however small they are when packed."""
    return (a if tasks is None else a.repartition(tasks, *cell)).join(b if tasks is None else b.repartition(tasks, *cell), cell)


def right_of(boxes: DataFrame, most_dy: float = 6.0, probes: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The nearest box to the right of each on its page, at about the same height. boxes, probes (all boxes by default): page, ix, l, t, r, b, text.

    Heights are bands of `most_dy`: a probe looks into its own and the two about it, so it meets the boxes of its line alone.
    """
    size = most_dy * 1.001  # a little more, so that rounding can't put what is near two bands away
    mid = lambda x: (F.col(x + "t") + F.col(x + "b")) / 2
    a = (boxes if probes is None else probes).select("page", "ix", F.col("r").alias("a_r"), mid("").alias("a_mid")).withColumn("band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: _band(F.col("a_mid"), size) + k)))
    b = boxes.where(F.trim("text") != "").select("page", F.col("ix").alias("b_ix"), F.col("l").alias("b_l"), mid("").alias("b_mid")).withColumn("band", _band(F.col("b_mid"), size))
    pairs = _met(a, b, ["page", "band"], tasks).where((F.col("ix") != F.col("b_ix")) & (F.abs(F.col("a_mid") - F.col("b_mid")) <= most_dy) & (F.col("b_l") >= F.col("a_r") - 2))
    return pairs.groupBy("page", "ix").agg(F.min_by("b_ix", F.struct(F.col("b_l") - F.col("a_r"), F.col("b_ix"))).alias("right_ix"))


def below(boxes: DataFrame, most_dy: float = 30.0, most_dx: float = 120.0, probes: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The nearest box below each on its page, about as far left; tops grow upwards.

    Cells of `most_dy` by `most_dx`: a probe looks into its own, the one below, and those left and right of both.
    """
    dy, dx = most_dy * 1.001, most_dx * 1.001
    a = (boxes if probes is None else probes).select("page", "ix", F.col("t").alias("a_t"), F.col("l").alias("a_l"))
    a = a.withColumn("y", F.explode(F.array(_band(F.col("a_t"), dy), _band(F.col("a_t"), dy) - 1))).withColumn("x", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: _band(F.col("a_l"), dx) + k)))
    b = boxes.select("page", F.col("ix").alias("b_ix"), F.col("t").alias("b_t"), F.col("l").alias("b_l")).withColumns({"y": _band(F.col("b_t"), dy), "x": _band(F.col("b_l"), dx)})
    gap = F.col("a_t") - F.col("b_t")
    pairs = _met(a, b, ["page", "y", "x"], tasks).where((gap > 0) & (gap <= most_dy) & (F.abs(F.col("a_l") - F.col("b_l")) < most_dx))
    return pairs.groupBy("page", "ix").agg(F.min_by("b_ix", F.struct(gap, F.col("b_ix"))).alias("below_ix"))


def verbatim(text: Column, lexeme: Column, excerpt: Column, key) -> Column:
    """Where a lexeme stands: in its own excerpt, elsewhere in the text, or nowhere."""
    return F.when(lexeme.isNull(), "no_lexeme").when(F.contains(key(excerpt), key(lexeme)) & F.contains(key(text), key(excerpt)), "verified_verbatim").when(F.contains(key(text), key(lexeme)), "verified_verbatim_doclevel").otherwise("VALUE_UNVERIFIED")


def resolve(observations: DataFrame, multi: bool, *subject: str) -> DataFrame:
    """One observation of each subject from rows of status and value.

    What doesn't apply is dropped beside others; one value stands; values inside others go; several are a list or a conflict.
    """
    values = F.array_sort(F.collect_set(F.when(F.col("status") == "OBSERVED", F.col("value"))))
    g = observations.groupBy(*subject).agg(values.alias("all"), F.count_if(F.col("status") == "NOT_APPLICABLE").alias("na"))
    kept = F.filter("all", lambda a: ~F.exists("all", lambda b: (b != a) & F.contains(b, a)))
    g = g.withColumn("kept", kept)
    status = F.when((F.size("kept") == 0) & (F.col("na") > 0), "NOT_APPLICABLE").when(F.size("kept") == 0, "MISSING").when((F.size("kept") == 1) | F.lit(multi), "OBSERVED").otherwise("CONFLICT")
    return g.select(*subject, status.alias("status"), F.col("kept").alias("values"))
