"""Scores: outcomes of decisions against gold, precision and recall over grouping sets, set matches, gates, intervals."""

from __future__ import annotations

import json
import random
import re
import statistics
import zlib
from functools import cached_property, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.lexemes import MONTHS_EN, MONTHS_ES, scalar_key
from factloom.sources.shared import table

PARTS, SAMPLE = 1024, 1 << 14  # ranges of a group's values, and values that set their ends, about


def outcome(gold: Column, decision: Column, equal: Column) -> Column:
    """The class of a decision (NULL: none) against a gold status."""
    confirmed, conflict = F.coalesce(decision == "CONFIRMED", F.lit(False)), F.coalesce(decision == "CONFLICT", F.lit(False))
    return (
        F.when(gold == "CONFIRMED_VALUE", F.when(confirmed & equal, "TP").when(confirmed, "FP_WRONG_VALUE").otherwise("FN"))
        .when(gold == "CONFLICT", F.when(conflict, "CONFLICT_OK").when(confirmed, "FP_CONFLICT_DENIED").otherwise("FN"))
        .otherwise(F.when(confirmed, "FP_INVENTED").when(conflict, "INCORRECT_STATUS").otherwise("TN"))
    )


def prf(rows: DataFrame, sets: list[list[str]], kind: str = "outcome") -> DataFrame:
    """Precision, recall and completeness in each of several groupings at once; a wrong value counts as false and as missed."""
    keys = [k for i, k in enumerate(c for s in sets for c in s) if k not in [c for s in sets for c in s][:i]]
    is_ = lambda *names: F.count_if(F.col(kind).isin(*names))
    tp, fp, fn = is_("TP"), is_("FP_WRONG_VALUE", "FP_INVENTED", "FP_CONFLICT_DENIED"), is_("FN", "FP_WRONG_VALUE")
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])
    return g.agg(F.grouping_id(*keys).alias("grouping"), F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(is_("TP", "TN", "CONFLICT_OK"), F.count("*")).alias("completeness"))


def set_match(pred: Column, gold: Column) -> Column:
    """struct(tp, fp, fn, kind) of two arrays as sets."""
    tp, fp, fn = (F.size(x).cast("long") for x in (F.array_intersect(pred, gold), F.array_except(pred, gold), F.array_except(gold, pred)))
    kind = F.when((F.size(pred) == 0) & (F.size(gold) == 0), "NOT_APPLICABLE").when(F.size(pred) == 0, "MISSING").when(tp == 0, "DISJOINT").when((fp == 0) & (fn == 0), "EXACT").when(fp == 0, "PARTIAL").otherwise("SUPERSET_WITH_ERROR")
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), kind.alias("kind"))


def accepted(o: dict[str, Column]) -> Column:
    """Whether an observation counts as extracted: it is verified and has a value or a lexeme of its own."""
    seen = o["status"].isin("OBSERVED", "DERIVED") & ~F.coalesce(o["class"].isin("VALUE_UNVERIFIED", "cross_reference"), F.lit(False))
    return F.coalesce(seen & ~F.coalesce(o["value"] == "NOT_APPLICABLE", F.lit(False)) & (o["value"].isNotNull() | (F.coalesce(o["lexeme"], F.lit("")) != "")), F.lit(False))


def acceptance(rows: DataFrame, *by: str) -> DataFrame:
    """Scores of observations (status, class, value, lexeme) against what was wanted: PRESENT, MULTI or ABSENT; NA isn't scored.

    Conflicts, references and what was said not to apply are misses. Empty denominators count as 1.
    """
    o = {c: F.col(c) for c in ("status", "class", "value", "lexeme")}
    got, want = accepted(o), F.col("want")
    miss = F.when(o["status"] == "CONFLICT", "CONFLICT").when(o["class"] == "cross_reference", "XREF").when(o["value"] == "NOT_APPLICABLE", "FN_NA").otherwise("FN")
    d = rows.withColumn("kind", F.when(want.isin("PRESENT", "MULTI"), F.when(got, "TP").otherwise(miss)).when(want == "ABSENT", F.when(got, "FP").otherwise("TN")))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    g = d.where("kind is not null").groupBy(*by).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN", "FN_NA", "CONFLICT", "XREF").alias("fn"), n("TN").alias("tn"), n("CONFLICT").alias("of_conflict"), n("XREF").alias("of_xref"))
    rate = lambda a, b: F.expr(f"({a}) / greatest(1, {b})")
    return g.withColumns({"precision": rate("tp", "tp + fp"), "recall": rate("tp", "tp + fn"), "coverage": rate("tp + fp", "tp + fp + fn")})


def elements(o: dict[str, Column]) -> Column:
    """What an observation (status, class, values, lexeme) claims as keys: its values, without any its lexeme; nothing if it isn't accepted."""
    said = F.filter(F.transform(F.coalesce(o["values"], F.array().cast("array<string>")), lambda v: F.coalesce(scalar_key(v), F.lit(""))), lambda k: k != "")
    lexeme = scalar_key(F.coalesce(o["lexeme"], F.lit("")))
    seen = F.coalesce(o["status"].isin("OBSERVED", "DERIVED"), F.lit(False)) & ~F.coalesce(o["class"].isin("VALUE_UNVERIFIED", "cross_reference"), F.lit(False)) & ~F.coalesce((F.size(o["values"]) == 1) & (F.get(o["values"], 0) == "NOT_APPLICABLE"), F.lit(False))
    none = F.array().cast("array<string>")
    return F.when(~seen, none).when(F.size(said) > 0, said).when(lexeme != "", F.array(lexeme)).otherwise(none)


def field_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Scores of fields over all documents and by `cold`: rows (field, cold, scope, want, gold, status, class, values, lexeme).

    Gold without values asks for any; what is claimed of an ABSENT field is false element by element, and invented. Documents of
    lifecycle scope and fields that don't apply aren't scored.
    """
    pred = elements({c: F.col(c) for c in ("status", "class", "values", "lexeme")})
    gold = F.filter(F.transform(F.coalesce("gold", F.array().cast("array<string>")), lambda v: F.coalesce(scalar_key(v), F.lit(""))), lambda k: k != "")
    d = rows.where(F.col("want").isin("PRESENT", "MULTI", "ABSENT") & ~F.coalesce(F.col("scope") == "LIFECYCLE", F.lit(False))).withColumns({"_pred": pred, "_gold": gold})
    n, some, absent = F.size("_pred").cast("long"), F.size("_pred") > 0, F.col("want") == "ABSENT"
    m, any_ = set_match(F.col("_pred"), F.col("_gold")), F.size("_gold") == 0
    zero, hit = F.lit(0).cast("long"), some.cast("long")
    d = d.withColumns({"_tp": F.when(absent, zero).when(any_, hit).otherwise(m["tp"]), "_fp": F.when(absent, n).when(any_, zero).otherwise(m["fp"]), "_fn": F.when(absent, zero).when(any_, 1 - hit).otherwise(m["fn"]), "_tn": absent & ~some, "_invented": absent & some, "_pos": ~absent})
    g = d.groupingSets([[F.col(c) for c in (*by, "field")], [F.col(c) for c in (*by, "field", "cold")]], *by, "field", "cold").agg(F.grouping("cold").alias("all"), F.count_if("_pos").alias("positive_gold"), F.sum("_tp").alias("tp"), F.sum("_fp").alias("fp"), F.sum("_fn").alias("fn"), F.count_if("_tn").alias("tn"), F.count_if("_invented").alias("invented"))
    return g.withColumns({"precision": F.expr("tp / greatest(1, tp + fp)"), "recall": F.expr("tp / greatest(1, tp + fn)"), "tier": tier(F.col("positive_gold"))})


# Outcomes that change what a critical field means.
CRITICAL = ("FP_WRONG_VALUE", "FP_INVENTED", "FP_CONFLICT_DENIED")


def safety(rows: DataFrame, *by: str) -> DataFrame:
    """Of the assisted units (mode, critical, outcome, decision, unsupported, evidence_valid): critical errors, unsupported confirmations, and the share with valid evidence."""
    confirmed = F.coalesce(F.col("decision") == "CONFIRMED", F.lit(False))
    d = rows.where("mode = 'ASSISTED'").groupBy(*by).agg(F.count_if(F.col("critical") & F.col("outcome").isin(*CRITICAL)).alias("critical_errors"), F.count_if("unsupported").alias("unsupported"), F.count_if(confirmed).alias("confirmed"), F.count_if(confirmed & F.col("evidence_valid")).alias("with_evidence"))
    return d.withColumn("evidence_rate", F.try_divide("with_evidence", "confirmed"))


def navigation_rates(reviews: DataFrame, *by: str) -> DataFrame:
    """Of the assisted reviews (mode, nav_used, nav_ok, nav_wrongdoc): sums, and the share of navigations that hold."""
    d = reviews.where("mode = 'ASSISTED'").groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("nav_used", "nav_ok", "nav_wrongdoc")))
    return d.withColumn("navigation_rate", F.try_divide("nav_ok", "nav_used"))


def study_gates(d: DataFrame) -> DataFrame:
    """Gates of a study and its verdict, each row by itself; too few valid pairs leave the time, and so the verdict, open.

    Columns: pairs, median_ratio, faster, ci_high; assisted and manual precision and recall; critical_errors, unsupported,
    evidence_rate; navigation_rate, nav_wrongdoc; frozen.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    gate = lambda *checks: F.when(reduce(and_, map(no, checks)), "PASS").otherwise("FAIL")
    c = {k: F.col(k) for k in d.columns}
    d = d.withColumns({
        "time": F.when(c["pairs"] < 24, "INCONCLUSIVE").otherwise(gate(c["median_ratio"] <= 0.60, c["faster"] >= 21, c["ci_high"] <= 0.80)),
        "quality": gate(c["assisted_precision"] >= 0.99, c["assisted_precision"] >= c["manual_precision"] - 0.01, c["assisted_recall"] >= c["manual_recall"] - 0.05),
        "safety": gate(c["critical_errors"] == 0, c["unsupported"] == 0, c["evidence_rate"] == 1.0), "evidence": gate(c["navigation_rate"] >= 0.98, c["nav_wrongdoc"] == 0), "freeze": gate(c["frozen"]),
    })
    names = ("time", "quality", "safety", "evidence", "freeze")
    return d.withColumn("verdict", F.when(F.col("time") == "INCONCLUSIVE", "INCONCLUSIVE").when(reduce(and_, (F.col(n) == "PASS" for n in names)), "PASS").otherwise("FAIL"))


def tier(positives: Column) -> Column:
    return F.when(positives < 5, "UNDER_5").when(positives < 15, "5_TO_14").otherwise("15_AND_MORE")


def _parts(d: DataFrame, key: list[str]) -> DataFrame:
    """Counts of equal values in PARTS ranges of each key that hold about as many values each, numbered in order: adds `_part`.

    The ends of the ranges are every so many-th of a sample by hash of at most about SAMPLE distinct values of a key, so what is heaped up or far out
    doesn't matter: a range holds what lies between two neighbours of the sample.
    """
    sizes = d.groupBy(*key).agg(F.count("*").alias("_distinct"))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in key]
    near = d.join(sizes.select(*(F.col(c).alias("_" + c) for c in key), "_distinct"), reduce(and_, same)).drop(*("_" + c for c in key))
    drawn = near.where(F.pmod(F.xxhash64("_v"), F.lit(1 << 30)) < F.lit(float(SAMPLE) * (1 << 30)) / F.col("_distinct"))
    ends = drawn.groupBy(*key).agg(F.array_sort(F.collect_list("_v")).alias("_all")).withColumn("_step", F.greatest(F.lit(1), F.floor(F.size("_all") / PARTS)).cast("int"))
    ends = ends.select(*(F.col(c).alias("_" + c) for c in key), F.filter("_all", lambda x, i: (i % F.col("_step")) == 0).alias("_ends"))
    out = d.join(ends, reduce(and_, same), "left").drop(*("_" + c for c in key))
    # the number of ends up to the value, by halving: at most as many steps as the table of ends has bits
    steps = F.sequence(F.lit(0), F.lit(SAMPLE.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size("_ends"), F.lit(0)).alias("hi"))
    mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
    half = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get("_ends", mid(s)) <= F.col("_v"), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    return out.withColumn("_part", F.aggregate(steps, start, half)["lo"]).drop("_ends")


def _values_at(parts: DataFrame, key: list[str], places: DataFrame, n: int) -> DataFrame:
    """key, `_values`: the values at n places of each key, counted from 1. parts: key, _v, _n, _part; places: key, `_places`.

    Sums over the ranges tell in which of them the places lie, and only those ranges are sorted.
    """
    same = reduce(and_, [F.col(c).eqNullSafe(F.col("_" + c)) for c in key])
    renamed = [F.col(c).alias("_" + c) for c in key]
    sums = parts.groupBy(*key, "_part").agg(F.sum("_n").alias("_sum"))  # PARTS or so of a key
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_sum"))
    held = sums.join(places.select(*renamed, "_places"), same).where(F.exists("_places", lambda p: (p > F.col("_before")) & (p <= F.col("_before") + F.col("_sum"))))
    held = held.select(*renamed, F.col("_part").alias("_p"), "_before", "_places")  # n ranges of a key at most
    near = parts.join(held, same & (F.col("_part") == F.col("_p"))).drop(*("_" + c for c in key))
    near = near.withColumn("_last", F.sum("_n").over(Window.partitionBy(*key, "_part").orderBy("_v")) + F.col("_before"))
    at = lambda i: F.max(F.when((F.col("_last") >= F.get("_places", i)) & (F.col("_last") - F.col("_n") < F.get("_places", i)), F.col("_v")))
    return near.groupBy(*key).agg(F.array(*map(at, range(n))).alias("_values"))


def order_statistics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, ninth decile as the value at place int(0.9 n) of the sorted ones, largest and sum.

    Equal values are counted first. A group's counts are then put into ranges that hold about as many values each, and only the ranges with the places
    asked for are sorted. No group is gathered, and a few values far out, or heaps of near ones, make no range larger.
    """
    if not by:
        return order_statistics(rows.withColumn("_one", F.lit(1)), value, "_one").drop("_one")
    counts = table(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "counts")
    whole = table(counts.groupBy(*by).agg(F.sum("_n").alias("_all"), F.max("_v").alias("most"), F.sum(F.col("_v") * F.col("_n")).alias("total")), "totals")
    places = F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1, F.when(F.col("_all") == 1, 1).otherwise(F.floor(F.col("_all") * 0.9)))
    found = _values_at(table(_parts(counts, list(by)), "parts"), list(by), whole.withColumn("_places", places), 3)
    v = lambda i: F.get("_values", i)
    found = found.select(*(F.col(c).alias("_" + c) for c in by), ((v(0) + v(1)) / 2).alias("median"), v(2).alias("p90"))
    return whole.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col("_" + c)) for c in by])).select(*by, "median", "p90", "most", "total")


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    from math import exp, lgamma, log, log1p

    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    c = lgamma(n + 1)
    return min(1.0, sum(exp(c - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k, n + 1)))


def exact_interval(k: int | None, n: int | None, level: float = 0.95) -> tuple[float | None, float | None]:
    """The exact binomial interval, by bisection on the tail; the ends of 0 and n are 0 and 1."""
    if not n:
        return None, None
    a = (1 - level) / 2

    def root(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if k == 0 else root(lambda p: _tail(k, n, p) - a)), (1.0 if k == n else root(lambda p: a - (1 - _tail(k + 1, n, p))))


def interval(k: Column, n: Column) -> Column:
    """struct(low, high): exact intervals of counts; a row for each group, so few."""

    def work(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    return F.pandas_udf(work, "low double, high double")(k, n)


def bootstrap_median(rows: DataFrame, value: str, by: str, seed: int, times: int = 10_000, most: int = 100_000) -> DataFrame:
    """Median with its bootstrap interval. Groups of up to `most` values are resampled one by one, each in a task; larger ones by `ranked_bootstrap`."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xs, rng = sorted(pdf[value].dropna().tolist()), random.Random(seed)
        meds = sorted(statistics.median(rng.choices(xs, k=len(xs))) for _ in range(times)) if xs else []
        low, high = (meds[int(0.025 * times)], meds[int(0.975 * times) - 1]) if meds else (None, None)
        return pd.DataFrame({by: [key[0]], "n": [len(xs)], "median": [statistics.median(xs) if xs else None], "low": [low], "high": [high]})

    size = table(rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")), "sizes")
    of = lambda test: rows.select(by, value).join(size.where(test), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    small = of(F.col("_n") <= most).groupBy(by).applyInPandas(one, f"{rows.select(by).schema.simpleString()[7:-1]}, n long, median double, low double, high double")
    if size.where(F.col("_n") > most).isEmpty():
        return small
    return small.unionByName(ranked_bootstrap(of(F.col("_n") > most), value, by, seed, times))


def ranked_bootstrap(rows: DataFrame, value: str, by: str, seed: int, times: int = 10_000) -> DataFrame:
    """Median with its bootstrap interval for groups of any size, without a resample of the values.

    Of n draws with replacement from n values in order, the place of the j-th smallest is n times the j-th of n uniform numbers, which is a Beta(j, n - j + 1).
    So a replicate's median is drawn as a place (two neighbouring ones for an even n), a group costs `times` pairs of numbers whatever its size, and only the
    values at the ends of the interval are looked up, by counted ranges. The distribution is that of resampling, so an end differs from the
    exact one by what a finite number of replicates leaves open: it lies between the places of levels 0.025 -+ 3 * sqrt(0.025 * 0.975 / times); for even n
    replicates are put in order by their places, not by the mean of both values, which are neighbours among n.
    """

    def places(n: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for size, name in zip(n, key, strict=True):
            rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
            j = (size + 1) // 2
            u = rng.beta(j, size - j + 1, times)
            v = u if size % 2 else u + (1 - u) * rng.beta(1, size - j, times)
            both = np.clip(np.ceil(np.stack([u, v]) * size), 1, size).astype(np.int64)
            both = both[:, np.lexsort(both[::-1])]
            out.append([*both[:, int(0.025 * times)].tolist(), *both[:, max(int(0.975 * times) - 1, 0)].tolist()])
        return pd.Series(out)

    d = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("_v"))
    counts = table(d.groupBy("g", "_v").agg(F.count("*").alias("_n")), "counts")
    sizes = table(counts.groupBy("g").agg(F.sum("_n").alias("n")), "sizes")
    ends = F.pandas_udf(places, "array<long>")(F.col("n"), F.coalesce(F.col("g").cast("string"), F.lit("")))
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    found = _values_at(table(_parts(counts, ["g"]), "parts"), ["g"], table(sizes.withColumn("_places", F.concat(middle, ends)), "places"), 6)
    mean = lambda i, name: ((F.get("_values", i) + F.get("_values", i + 1)) / 2).alias(name)
    found = found.select(F.col("g").alias("_g"), mean(0, "median"), mean(2, "low"), mean(4, "high"))
    return sizes.join(found, F.col("g").eqNullSafe(F.col("_g"))).select(F.col("g").alias(by), "n", "median", "low", "high")


# Classes of observations against labels.
TAXONOMY = ("TP", "TP_RAW", "FN", "FN_NA", "CORRECT_NA", "FP", "FP_RAW", "TN", "SPURIOUS_NA", "UNLABELED")


def has_value(values: Column) -> Column:
    """Whether an observation has any value but NOT_APPLICABLE; its values are an array, NULL for none at all."""
    return F.coalesce(F.exists(values, lambda v: v.isNotNull() & (v != "NOT_APPLICABLE")), F.lit(False))


def says_na(values: Column) -> Column:
    """Whether it has values and all of them, also of an empty list, are NOT_APPLICABLE or nothing."""
    return F.coalesce(F.forall(values, lambda v: v.isNull() | (v == "NOT_APPLICABLE")), F.lit(False))


def taxonomy(label: Column, status: Column, values: Column) -> Column:
    """The class of an observation against a label: PRESENT, MULTI, NA or ABSENT."""
    missing, real, na = status == "MISSING", has_value(values), says_na(values)
    false = F.when(real, "FP").otherwise("FP_RAW")
    return (
        F.when(label.isin("PRESENT", "MULTI"), F.when(missing, "FN").when(na, "FN_NA").when(status == "CONFLICT", F.when(real, "TP").otherwise("FN")).when(values.isNull(), "TP_RAW").otherwise("TP"))
        .when(label == "NA", F.when(missing, "FN").when(na, "CORRECT_NA").otherwise(false))
        .when(label == "ABSENT", F.when(missing, "TN").when(na, "SPURIOUS_NA").otherwise(false))
        .otherwise("UNLABELED")
    )


def taxonomy_scores(rows: DataFrame, *by: str, kind: str = "cls") -> DataFrame:
    """Counts of each class, precision and recall; NULL where nothing was found or to be found."""
    n = lambda *names: F.count_if(F.col(kind).isin(*names))
    d = rows.groupBy(*by).agg(F.count("*").alias("n"), *(n(c).alias(c.lower()) for c in TAXONOMY[:-1]))
    tp, fp, fn = F.col("tp") + F.col("tp_raw"), F.col("fp") + F.col("fp_raw") + F.col("spurious_na"), F.col("fn") + F.col("fn_na")
    return d.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "n_present": tp + fn, "n_absent": F.col("tn") + fp, "n_na": F.col("correct_na")})


def grouped_gates(scores: DataFrame, gates: DataFrame, field: str = "field") -> DataFrame:
    """Gates of groups of fields: gates (gate, field, threshold), scores of `taxonomy_scores` by field. Without any positive a gate can't be evaluated."""
    d = gates.join(scores, field, "left").groupBy("gate").agg(F.max("threshold").alias("threshold"), *(F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(a) for a, e in (("tp", "tp + tp_raw"), ("fp", "fp + fp_raw + spurious_na"), ("fn", "fn + fn_na"))))
    d = d.withColumns({"precision": F.try_divide("tp", F.expr("tp + fp")), "recall": F.try_divide("tp", F.expr("tp + fn"))})
    return d.withColumn("verdict", F.when(F.col("precision") >= F.col("threshold"), "PASS").when(F.col("precision").isNotNull(), "FAIL").otherwise("NO_EVALUABLE"))


def provenance(rows: DataFrame, *by: str) -> DataFrame:
    """How many emitted values are backed: rows (values, extractor, lexeme, evidence: array of source, snapshot_sha256, page, extractor, excerpt), by their first evidence."""
    e, filled = F.get("evidence", 0), lambda c: F.coalesce(c != "", F.lit(False))
    emitted = has_value(F.col("values")) | (F.size(F.col("values")) == 0)  # an empty list is a value that isn't NOT_APPLICABLE
    ok = filled(F.col("extractor")) & filled(e["source"]) & filled(e["snapshot_sha256"]) & e["page"].isNotNull() & filled(e["extractor"]) & (filled(e["excerpt"]) | filled(F.col("lexeme")))
    d = rows.where(F.coalesce(emitted, F.lit(False))).groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("backed"))
    return d.withColumns({"rate": F.try_divide("backed", "total"), "gate": F.when(F.col("backed") == F.col("total"), "PASS").otherwise("FAIL")})


def novelty(rows: DataFrame, only: tuple[str, ...], doc: str, *by: str, least: int = 24) -> DataFrame:
    """Share of documents with something found that no other source has: a field of `only` that was to be found and was."""
    hit = F.col("field").isin(*only) & F.col("label").isin("PRESENT", "MULTI") & F.col("cls").isin("TP", "TP_RAW")
    d = rows.groupBy(*by, doc).agg(F.max(hit).alias("delta")).groupBy(*by).agg(F.count("*").alias("n_docs"), F.count_if("delta").alias("n_delta"))
    return d.withColumns({"share": F.try_divide("n_delta", "n_docs"), "gate": F.when(F.col("n_delta") >= least, "PASS").otherwise("FAIL")})


def reviewer_diagnostics(reviews: DataFrame, units: DataFrame) -> DataFrame:
    """Of each reviewer the seconds in both modes and the quality of all units: reviews (reviewer, mode, seconds), units (reviewer, outcome)."""
    time = reviews.groupBy("reviewer").agg(*(F.coalesce(F.sum(F.when(is_, F.col("seconds"))), F.lit(0)).alias(name) for name, is_ in (("manual_seconds", F.col("mode") == "MANUAL"), ("assisted_seconds", F.col("mode") != "MANUAL"))))
    return time.join(prf(units, [["reviewer"]]).drop("grouping"), "reviewer", "left")


def canonical_text(text: str | None) -> str | None:
    """Compatibility forms made one, case folded, white space squeezed."""
    import unicodedata

    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


# Names of currencies in values that reviewers write, each with its code.
WRITTEN_CURRENCIES = {
    "eur": ("euro", "euros", "eur"),
    "usd": ("dolar", "dolares", "dolar estadounidense", "dollar", "dollars", "us dollar", "usd", "dólar", "dólares", "dólar estadounidense", "dólares estadounidenses"),
    "gbp": ("libra", "libras", "libra esterlina", "pound", "pounds", "pound sterling", "gbp"),
    "chf": ("franco", "francos", "franco suizo", "swiss franc", "chf"),
    "jpy": ("yen", "yenes", "jpy"),
}
_CODES = {name: code for code, names in WRITTEN_CURRENCIES.items() for name in names}
_TOKEN = re.compile(r"\d[\d.,]*")
_MONTH = {name: i for table in (MONTHS_ES, MONTHS_EN) for i, name in enumerate(table, 1)}
_DATES = [re.compile(p) for p in (r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})\b", r"(?P<d>\d{1,2})(?: de)? (?P<w>[a-z]+)(?: de)? (?P<y>\d{4})\b", r"(?P<w>[a-z]+) (?P<d>\d{1,2}),? (?P<y>\d{4})\b", r"(?P<d>\d{1,2})[/\-](?P<m>\d{1,2})[/\-](?P<y>\d{4})\b")]


def _one_number(token: str) -> float | None:
    """A token of digits and separators: groups of three are thousands, of two kinds of separators the last is decimal."""
    t = token.rstrip(".,")
    if "." in t and "," in t:
        group = min(".,", key=t.rfind)
    else:
        group = next((sep for sep in ".," if re.fullmatch(rf"\d{{1,3}}(\{sep}\d{{3}})+", t)), "")
    try:
        return float((t.replace(group, "") if group else t).replace(",", "."))
    except ValueError:
        return None


class Reading:
    """What a written value may denote; each reading is worked out when it is first asked for."""

    def __init__(self, value: str | None):
        self.raw = value or ""
        self.text = canonical_text(self.raw)

    @cached_property
    def number(self) -> float | None:
        try:
            return float(self.raw.strip().replace(",", "."))
        except ValueError:
            return None

    @cached_property
    def date(self) -> tuple[int, int, int] | None:
        for m in filter(None, (p.match(self.text) for p in _DATES)):
            part = m.groupdict()
            month = _MONTH.get(part["w"]) if "w" in part else int(part["m"])
            if month:
                return int(part["y"]), month, int(part["d"])
        return None

    @cached_property
    def currency(self) -> str | None:
        return _CODES.get(self.text)

    @cached_property
    def letters(self) -> str:
        return re.sub("[^a-z0-9]", "", self.text)

    @cached_property
    def numbers(self) -> list[float]:
        return [n for n in map(_one_number, _TOKEN.findall(self.raw)) if n is not None]

    @cached_property
    def canonical(self) -> str:
        named = self.text
        for name, code in _CODES.items():
            named = re.sub(rf"\b{name}\b", code, named)
        return _TOKEN.sub(lambda m: m[0] if _one_number(m[0]) is None else f"#{_one_number(m[0]):g}#", named)


def same_scalar(a: Reading, b: Reading) -> bool:
    """Whether two values denote the same: the first reading that both have decides; else one may hold the other with the same numbers."""
    if a.number is not None and b.number is not None:
        return a.number == b.number
    if a.text == b.text:
        return True
    if a.date and b.date:
        return a.date == b.date
    if a.currency and b.currency:
        return a.currency == b.currency
    if a.letters and a.letters == b.letters or a.canonical == b.canonical:
        return True
    short, long = sorted((a.canonical, b.canonical), key=len)
    return bool(short) and short in long and a.numbers == b.numbers


def _same(a: object, b: object) -> bool:
    """Whether two values are the same: objects by their keys, lists in any order and as often, each item taking the first equal one that is left, scalars by what they denote."""
    if isinstance(a, dict) or isinstance(b, dict):
        return isinstance(a, dict) and isinstance(b, dict) and a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) != isinstance(b, list):
        return False
    if not isinstance(a, list):
        return same_scalar(*(Reading(None if x is None else json.dumps(x) if isinstance(x, bool) else str(x)) for x in (a, b)))
    left = list(b)
    if len(left) != len(a):
        return False
    for x in a:
        twin = next((i for i, y in enumerate(left) if _same(x, y)), None)
        if twin is None:
            return False
        del left[twin]
    return True


def same_values(a: object, b: object) -> bool:
    """The same, where no list at all counts as an empty one."""
    return _same([] if a is None and isinstance(b, list) else a, [] if b is None and isinstance(a, list) else b)


def _plain_number(json_text: Column) -> Column:
    """The number that a JSON scalar plainly is, as a number or as text with a point or comma; else NULL."""
    return F.when(json_text.rlike(r'^(-?\d{1,15}(\.\d{1,10})?|"-?\d{1,15}([.,]\d{1,10})?")$'), F.translate(json_text, ',"', ".").cast("double"))


def same_json_column(a: Column, b: Column) -> Column:
    """Whether two columns of JSON hold the same values. Equal texts, and pairs of plain numbers, are settled in Spark; what is left goes to Python."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        same = {(x, y): None if x is None or y is None else same_values(json.loads(x), json.loads(y)) for x, y in {*zip(a, b, strict=True)}}  # values come again and again
        return pd.Series([same[xy] for xy in zip(a, b, strict=True)], dtype=object)

    numbers = _plain_number(a).isNotNull() & _plain_number(b).isNotNull()
    rest = (a != b) & ~numbers
    return F.when(a == b, F.lit(True)).when(numbers, _plain_number(a) == _plain_number(b)).otherwise(F.pandas_udf(work, "boolean")(F.when(rest, a), F.when(rest, b)))


def same_values_column(a: Column, b: Column) -> Column:
    """Whether two arrays of strings hold the same values."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_values([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(work, "boolean")(a, b)
