"""Graphs of document families, hard negatives by title, and consecutive rows of one security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.sampling import hash_order

# Documents that a case is expected to have, by the role of its own document.
EXPECTED = {"FINAL_TERMS": ("BASE_PROSPECTUS", "ADMISSION"), "ISSUE_DOC": ("ADMISSION",), "SECURITIES_NOTE": ("ADMISSION",)}
LONGEST = 200  # characters of an id


HOT = 1024  # a family with more than so small a part of all rows is hot; there can't be more of them


def _hot(rows: DataFrame) -> list:
    """Families with more than a HOT-th of the rows: HOT at most."""
    sizes = rows.where("family is not null").groupBy("family").agg(F.count("*").alias("n"))
    few = sizes.join(F.broadcast(sizes.agg(F.sum("n").alias("all"))), F.col("n") * HOT > F.col("all"))
    return [r["family"] for r in few.select("family").collect()]


def _by_family(rows: DataFrame, facts: DataFrame, hot: list, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a family): those of hot families by broadcast of their few facts, so that no task gets a whole one, all others by shuffle."""
    if not hot:
        return rows.join(facts, "family", how)
    is_hot = F.coalesce(F.col("family").isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), "family", how).unionByName(rows.where(~is_hot).join(facts, "family", how))


def _role_of(cand_type: Column) -> Column:
    """The role that a candidate's type looks for."""
    return F.when(cand_type.startswith("base"), "BASE_PROSPECTUS").when(cand_type.startswith("final"), "FINAL_TERMS")


def targets_by_number(nodes: DataFrame, asked: DataFrame, hot: list | None = None) -> DataFrame:
    """Adds `target` to asked (family, role, number, source): of the family's nodes of the role whose id holds the number, but for the source, the last.

    nodes: family, id, role, ordinal. The index has each piece of an id that is as long as a number asked for in its family, with the
    last two nodes that have it: a number is looked up by equality, so no family is paired with itself, however large it is.
    """
    hot = _hot(nodes) if hot is None else hot
    sizes = asked.where(F.length("number").between(1, LONGEST)).groupBy("family").agg(F.collect_set(F.length("number")).alias("sizes"))  # at most LONGEST of them
    ids = nodes.where(F.col("role").isin("BASE_PROSPECTUS", "FINAL_TERMS")).groupBy("family", "role", "id").agg(F.max("ordinal").alias("ordinal"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("id") - n + 1, F.lit(1))), lambda i: F.substring(F.col("id"), i, n))
    pieces = _by_family(ids, sizes, hot).select("family", "role", "id", "ordinal", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("id")), cut)))).alias("number"))
    top = Window.partitionBy("family", "role", "number").orderBy(F.desc("ordinal"), F.desc("id"))
    last = pieces.withColumn("_k", F.row_number().over(top)).where("_k <= 2")  # kept to two before the shuffle as well
    index = last.groupBy("family", "role", "number").agg(F.max(F.when(F.col("_k") == 1, F.col("id"))).alias("_last"), F.max(F.when(F.col("_k") == 2, F.col("id"))).alias("_other"))
    d = asked.join(index, ["family", "role", "number"], "left")
    return d.withColumn("target", F.when(F.col("_last") != F.col("source"), F.col("_last")).otherwise(F.col("_other"))).drop("_last", "_other")


def family_edges(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Edges of families' graphs: records (id, family, role, ordinal), predictions (source, decision, relation, rule_id, cand_type, cand_number).

    A candidate `family` without a target by its number leads to the family's first base prospectus. No link, no target: no edge.
    """
    p = predictions.where("decision <> 'NO_LINK'").join(records.select(F.col("id").alias("source"), "family").distinct(), "source")
    p = p.withColumns({"role": _role_of(F.col("cand_type")), "number": F.col("cand_number")})
    hot = _hot(records)
    d = targets_by_number(records.select("family", "id", "role", "ordinal"), p, hot)
    base = records.where("role = 'BASE_PROSPECTUS'").groupBy("family").agg(F.min_by("id", "ordinal").alias("_base"))
    d = _by_family(d, base, hot, "left").withColumn("target", F.coalesce("target", F.when(F.col("cand_type") == "family", F.col("_base")))).where("target is not null")
    return d.select("family", "source", "target", F.coalesce(F.nullif("relation", F.lit("")), F.lit("RELATES_TO")).alias("relation"), F.col("decision").alias("state"), "rule_id")


def family_status(cases: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each case document (doc_id): status, family, nodes and edges of its family's graph, those to be reviewed, and documents that are expected but not there.

    COMPLETE: nothing missing, and an edge at least. A document of no family has FAMILY_UNKNOWN missing.
    """
    own = records.groupBy("family").agg(F.count("*").alias("n_nodes"), F.collect_set("role").alias("_roles"))  # a few roles
    links = edges.groupBy("family").agg(F.count("*").alias("n_edges"), F.count_if(F.col("state") == "REVIEW_REQUIRED").alias("n_review"))
    d = cases.select("doc_id").join(records.select(F.col("id").alias("doc_id"), "family", "role"), "doc_id", "left")
    d = _by_family(d, own.join(links, "family", "left"), _hot(records), "left")  # cases of no family are not hot
    wanted = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("role")), F.array().cast("array<string>"))
    missing = F.when(F.col("family").isNull(), F.array(F.lit("FAMILY_UNKNOWN"))).otherwise(F.array_except(wanted, F.col("_roles")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    status = F.when((F.size(missing) == 0) & (F.col("n_edges") > 0), "COMPLETE").otherwise("INCOMPLETE")
    return d.select("doc_id", "family", status.alias("status"), zero("n_nodes"), zero("n_edges"), zero("n_review"), missing.alias("missing"))


def title_negatives(rows: DataFrame, seed: int = 8) -> DataFrame:
    """A hard negative for each row (id, title, issuer, register): a register of another issuer with the same title, but not the row's own register.

    The issuers of a title are a ring in hash order, and a row takes the next issuer's register (its least, or its greatest where the least is
    the row's own). So there is one pair for each row, and each issuer of a title stands against another one, without all pairs of issuers.
    The ring is put together from the ends of 4,096 stretches of hashes: no title is gathered. A title of one issuer gives no row.
    """
    known = rows.where("title is not null and issuer is not null")
    ring = known.groupBy("title", "issuer").agg(F.min("register").alias("least"), F.max("register").alias("most")).withColumn("h", hash_order("issuer", seed)).withColumn("part", F.substring("h", 1, 3))
    within = Window.partitionBy("title", "part").orderBy("h", "issuer")
    entry = F.struct("issuer", "least", "most")
    d = ring.withColumns({"_next": F.lead(entry).over(within), "_place": F.row_number().over(within)})
    heads = d.where("_place = 1").select("title", "part", entry.alias("head"))
    around = Window.partitionBy("title").orderBy("part")
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("title", "part", F.coalesce(F.lead("head").over(around), first).alias("_jump"))  # at most 4,096 a title
    d = d.join(heads, ["title", "part"]).select("title", "issuer", F.coalesce("_next", "_jump").alias("n")).where("n.issuer <> issuer")
    out = known.join(d, ["title", "issuer"]).withColumn("other_register", F.when(F.col("n.least") != F.col("register"), F.col("n.least")).otherwise(F.nullif(F.col("n.most"), F.col("register"))))
    return out.where("other_register is not null").select("id", "title", "issuer", "register", F.col("n.issuer").alias("other_issuer"), "other_register")


def consecutive(rows: DataFrame, isin: str, *order: str) -> DataFrame:
    """Rows of a security with the next one of the same security, in order."""
    w = Window.partitionBy(isin).orderBy(*order)
    rest = F.struct(*(c for c in rows.columns if c != isin))
    return rows.where(F.col(isin) != "").select(isin, rest.alias("a"), F.lead(rest).over(w).alias("b")).where("b is not null")
