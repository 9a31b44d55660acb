"""Bounded samples, joins that hold where keys are hot, and rows that stay; tables are written to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import new_path, released, shared_dir, table

__all__ = ["SHARE", "WORDS", "bounded_sample", "filtered", "join_groups", "kept_rows", "new_path", "released", "row_hash", "shared_dir", "table", "text_key"]
SHARE = 1024  # groups that hold more than such a part of all rows are hot: there can't be more of them than that
WORDS = 1 << 19  # words of 64 bits of a filter of hashes


def bounded_sample(df: DataFrame, key: str, n: int, by: Column | None = None) -> list:
    """About `n` rows of `df` (per value of `by`), those with the smallest hash of key and content: the same rows at any partitioning.

    Counts first, then reads only rows under a hash threshold, so no group is gathered. Rows that are the same in all columns are
    one, before they leave their task; at most about 1.5 `n` + 100 rows per value reach the driver, also where ids or rows
    repeat. Rows with a null key can't be sampled.
    """
    h = F.shiftrightunsigned(F.xxhash64(key, *[c for c in df.columns if c != key]), 2)
    df = df.where(F.col(key).isNotNull()).withColumns({"_by": F.lit(0) if by is None else by, "_h": h}).where("_by is not null")
    counts = df.groupBy("_by").agg(F.approx_count_distinct("_h", 0.02).alias("count")).collect()  # one row per value
    under = F.lit(False)
    for r in counts:
        under = under | ((F.col("_by") == F.lit(r["_by"])) & (F.col("_h") <= int(min(1.0, (1.3 * n + 60) / max(r["count"], 1)) * (1 << 62))))
    rows = df.where(under).distinct().collect() if counts else []
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (r["_h"], str(r[key]))):
        seen[r["_by"]] = seen.get(r["_by"], 0) + 1
        if seen[r["_by"]] <= n:
            out.append(r)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Rows joined with the groups that they are part of; groups: one row each, a written table, `size` its number of rows.

    Groups with more than a SHARE-th of all rows, so SHARE at most, are joined where their rows lie; the other rows are shuffled.
    total: the sum of all sizes or more, if it is known.
    """
    total = (groups.agg(F.sum(size)).first()[0] or 0) if total is None else total
    hot = F.broadcast(groups.where(F.col(size) > total / SHARE))
    rest = rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col(size) <= total / SHARE), key, how)
    return rows.join(hot, key).unionByName(rest)


def filtered(rows: DataFrame, h: Column, members: DataFrame, member_h: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be one of the members', rows whose hash is none), without a shuffle of the rows.

    The members' hashes are bits of WORDS words, so the filter has at most that many rows, whatever the input; where members are
    more than the bits, it lets most rows through and is of no use, but never wrong. The rows' columns may have
    any names.
    """
    bits = members.select(F.pmod(member_h, F.lit(WORDS * 64)).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = _numbered(rows, {"slot": F.pmod(h, F.lit(WORDS * 64))})
    d = own.withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word", "left")
    hit = F.expr("coalesce(shiftright(bits, cast(slot & 63 as int)) & 1L, 0L) = 1L")
    return _named(d.where(hit), rows), _named(d.where(~hit), rows)


def _numbered(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
    """The columns as c0, c1, ..., whatever they were called, and more columns beside them."""
    return rows.select("*", *more.values()).toDF(*(f"c{i}" for i in range(len(rows.columns))), *more)


def _named(d: DataFrame, rows: DataFrame) -> DataFrame:
    """Only the numbered columns, under the names that they have in `rows`."""
    return d.select(*(f"c{i}" for i in range(len(rows.columns)))).toDF(*rows.columns)


def text_key(text: Column) -> Column:
    """A hash of a text as it is; with the row's id it tells rows apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_hash(id_: Column, key: Column) -> Column:
    return F.xxhash64(id_, key)


def kept_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, columns as they are; verdicts: (doc_id, text_key, kept) of rows, one with `kept` for each that stays.

    Decided by id and text together: another text under the same id is another row. Of rows that are the same in both one stays.
    Rows without a verdict stay. Only rows that may go are shuffled.
    """
    v = verdicts.groupBy("doc_id", "text_key").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    v = table(v.select(F.col("doc_id").alias("v_id"), F.col("text_key").alias("v_key"), "stays"), "verdicts")
    own = _numbered(docs, {"id": F.col(id_col), "key": text_key(F.col(text_col))})  # whatever the columns of docs are called
    maybe, others = filtered(own, row_hash(F.col("id"), F.col("key")), v, row_hash(F.col("v_id"), F.col("v_key")))
    judged = maybe.join(v.hint("merge"), (F.col("key") == F.col("v_key")) & F.col("id").eqNullSafe(F.col("v_id")), "left")
    once = judged.where("stays").dropDuplicates(["id", "key"])
    return _named(others, docs).unionByName(_named(judged.where("stays is null"), docs)).unionByName(_named(once, docs))
