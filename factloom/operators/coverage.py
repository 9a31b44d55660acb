"""Gold values that a candidate covers: candidates that may denote the same are found by keys, and only those are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lexemes import let
from factloom.operators import metrics
from factloom.sources.shared import table

ODD = "odd"  # key of values whose letters can't be told here
MONTHS = {name: f"{i:02d}" for table in (metrics.MONTHS_ES, metrics.MONTHS_EN) for i, name in enumerate(table, 1)}


def _numbers(text: Column) -> Column:
    """The numbers in a text, in order, as doubles: groups of three digits are thousands, of two kinds of separators the last is decimal."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d.,]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"[.,]+$", ""))
    both = lambda t: F.contains(t, F.lit(".")) & F.contains(t, F.lit(","))
    last_dot = lambda t: F.length(F.substring_index(t, ".", -1)) < F.length(F.substring_index(t, ",", -1))
    plain = lambda t: (
        F.when(both(t) & last_dot(t), F.replace(t, F.lit(","), F.lit(""))).when(both(t), F.replace(t, F.lit("."), F.lit("")))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).when(t.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    )
    return F.array_compact(F.transform(tokens, lambda t: F.replace(plain(t), F.lit(","), F.lit(".")).try_cast("double")))


def _date(text: Column) -> Column:
    """Year, month and day of a text that opens with a date, as it is written."""
    part = lambda p, *groups: F.when(text.rlike(p), F.concat_ws("-", *(F.lpad(F.regexp_extract(text, p, g) if isinstance(g, int) else g, n, "0") for g, n in zip(groups, (4, 2, 2), strict=True))))
    month = lambda p, g: F.coalesce(let(F.regexp_extract(text, p, g), lambda name: F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), name)), F.lit("00"))
    worded, english = r"^(\d{1,2})(?: de)? ([a-z]+)(?: de)? (\d{4})\b", r"^([a-z]+) (\d{1,2}),? (\d{4})\b"
    return F.coalesce(part(r"^(\d{4})-(\d{1,2})-(\d{1,2})\b", 1, 2, 3), part(worded, 3, month(worded, 2), 1), part(english, 3, month(english, 1), 2), part(r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b", 3, 2, 1))


def keys(value: Column) -> Column:
    """Keys of a value (canonical JSON text, or plain text) of which any two values that denote the same share one.

    A number, a date, a currency, letters and digits alone, the numbers in order; lists and objects by what they are. Values with characters that
    have compatibility forms, so that letters can't be told here, have one key for all of them.
    """
    text = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    number = F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")
    code = let(text, lambda name: F.try_element_at(F.create_map(*(F.lit(x) for kv in metrics._CODES.items() for x in kv)), name))  # a lookup is rewritten to comparisons, of which each would work its key out
    letters = F.nullif(F.regexp_replace(text, "[^a-z0-9]", ""), F.lit(""))
    shape = F.when(text.startswith("["), "list").when(text.startswith("{"), "object")
    scalar = F.array(F.concat(F.lit("n"), (number + 0.0).cast("string")), F.concat(F.lit("d"), _date(text)), F.concat(F.lit("c"), code), F.concat(F.lit("l"), letters), F.concat(F.lit("s"), F.array_join(F.transform(_numbers(value), lambda x: x.cast("string")), ",")))
    odd = value.rlike(r"[^\x00-\x7FáéíóúüñÁÉÍÓÚÜÑ€]")
    return F.array_distinct(F.array_compact(F.when(shape.isNotNull(), F.array(shape)).otherwise(F.concat(scalar, F.when(odd, F.array(F.lit(ODD))).otherwise(F.array().cast("array<string>"))))))


def _met(d: DataFrame) -> DataFrame:
    """To be joined by shuffle: files' sizes tell nothing of rows that come out of one row, which the driver would hold for a broadcast."""
    return d.hint("merge")


def covered(gold: DataFrame, candidates: DataFrame, takes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds `covered` to gold (case_id, field, value): whether a candidate (case_id, field, value) of its case, of a field that it takes, denotes the same.

    takes: the extracted fields of each field of the schema. Values are text or JSON. Equality is decided by metrics.same_values; only pairs that share a
    key get there, and values that are the same text are settled before. A value that is null is covered by nothing.
    """
    own = F.try_element_at(F.create_map(*(x for k, v in takes.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), F.col("field"))
    g = gold.where("value is not null").select("case_id", F.col("field").alias("schema_field"), F.explode(own).alias("field"), F.col("value").alias("gold_value"), F.struct("case_id", "field", "value").alias("unit")).distinct()
    c = candidates.where("value is not null").select("case_id", "field", F.col("value").alias("found")).distinct()
    odd = F.array_contains("keys", ODD)
    # written, so that filters on keys aren't pushed below `distinct`, where keys would be worked out for each row again
    a, b = (table(d.withColumn("keys", keys(F.col(v))).withColumn("odd", odd), name) for d, v, name in ((g, "gold_value", "gold"), (c, "found", "candidates")))
    settled = table(a.join(_met(b.select("case_id", "field", F.col("found").alias("gold_value"))), ["case_id", "field", "gold_value"], "left_semi").select("unit").distinct(), "settled")
    written, a = a, a.join(_met(settled), "unit", "left_anti")
    by_key = lambda d: d.withColumn("key", F.explode("keys")).withColumn("key", F.xxhash64("key"))  # noqa: E731 - two keys of one hash cost a comparison
    meet = by_key(a).join(_met(by_key(b).select("case_id", "field", "key", "found")), ["case_id", "field", "key"]).select("unit", "gold_value", "found")
    for some, x, y in ((not written.where("odd").isEmpty(), a.where("odd"), b.where("not odd")), (not b.where("odd").isEmpty(), a.where("not odd"), b.where("odd"))):
        if some:
            meet = meet.unionByName(x.drop("keys", "odd").join(_met(y.drop("keys", "odd")), ["case_id", "field"]).select("unit", "gold_value", "found"))
    pairs = meet.where("gold_value <> found").distinct()
    as_json = lambda c: F.when(F.ltrim(c).rlike(r"^[\[{]"), F.concat(F.lit("["), F.col(c), F.lit("]"))).otherwise(F.to_json(F.array(c)))
    equal = pairs.where(metrics.same_json_column(as_json("gold_value"), as_json("found"))).select("unit")
    hit = settled.unionByName(equal).distinct().withColumn("covered", F.lit(True))
    d = gold.withColumn("unit", F.struct("case_id", "field", "value")).join(_met(hit), "unit", "left").drop("unit")
    return d.withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage(units: DataFrame, *by: str) -> DataFrame:
    """Gold units, those covered, and their share."""
    return units.groupBy(*by).agg(F.count("*").alias("gold"), F.count_if("covered").alias("covered")).withColumn("share", F.try_divide("covered", "gold"))
