"""URL filters: host and path rules, else a ratio of character language models (operator 3).

Two smoothed variable-order Markov models of characters are learned from URLs that the rules accept and reject. An order-k
estimate is mixed with that of order k - 1 by how many different characters followed the context (Witten-Bell), down to a
uniform distribution. A URL without a rule is judged by the difference of the log-likelihoods divided by its length,
against a limit calibrated on labelled URLs that the models did not learn from.

The models are counts of all labelled URLs (one of CALIBRATED is apart), summed by n-gram, and stay a table: a ratio is worked out for each n-gram of the URLs that are judged,
from the counts of its endings, and joined to them. N-grams that many URLs have are joined by broadcast, the others by
shuffle. Nothing of it is sampled or held by one process.

Null URLs, and those without `://`, have an empty host and path and no rule; null is scored as an empty string. Each row is
judged alone, so repeated rows get the same verdict; an empty table gives none. Without accepted or rejected URLs to
learn from, the difference is 0 and the verdict `allow`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import join_groups, table

ORDER = 5
CALIBRATED = 4  # one of so many is held for calibration
DIGITS = 9  # of a difference, so that the order of its sum is of no account
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: list[tuple[str, str]], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, 'host/path'), a handful."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):  # the longest is tested last, so first of all
        h, slash, rest = r.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Character model: log-probabilities of characters after up to ORDER others."""

    def __init__(self, texts: list[str], alphabet: int, order: int = ORDER):
        self.order, self.alphabet = order, alphabet
        self.after: dict[str, dict[str, int]] = {}
        for t in texts:
            t = "\x02" + t + "\x03"
            for i in range(1, len(t)):
                for k in range(min(order, i) + 1):
                    d = self.after.setdefault(t[i - k : i], {})
                    d[t[i]] = d.get(t[i], 0) + 1
        self.total = {c: sum(d.values()) for c, d in self.after.items()}

    def p(self, context: str, c: str) -> float:
        p = 1 / self.alphabet
        for k in range(len(context) + 1):
            d = self.after.get(context[len(context) - k :])
            if d is None:
                break
            t, n = len(d), self.total[context[len(context) - k :]]
            p = (d.get(c, 0) + t * p) / (n + t)
        return p


def _ends(url: str | None) -> list[str]:
    """Each character of a URL, and its end, with up to ORDER others before it."""
    t = "\x02" + (url or "") + "\x03"
    return [t[max(0, i - ORDER) : i + 1] for i in range(1, len(t))]


@dataclass(frozen=True)
class UrlModel:
    """A model of URLs that are given."""

    accepted: tuple[str, ...]
    rejected: tuple[str, ...]
    limit: float = 0.0


@dataclass(frozen=True)
class Counted:
    """A model of counted n-grams: (gram, yes, no) of all lengths, a written table."""

    grams: DataFrame
    alphabet: int
    limit: float = 0.0

    def difference(self, url: str | None) -> float:
        """Mean log-likelihood difference of a character: over 0 if it is more like the accepted ones. Looks one URL's n-grams up."""
        if not self.alphabet:
            return 0.0
        ends = _ends(url)
        contexts = {g[k:-1] for g in ends for k in range(len(g))}
        models = Markov([], self.alphabet), Markov([], self.alphabet)
        for r in self.grams.where(F.expr("left(gram, length(gram) - 1)").isin(*contexts)).collect():  # at most an alphabet for each
            for m, n in zip(models, (r["yes"], r["no"]), strict=True):
                if n:
                    m.after.setdefault(r["gram"][:-1], {})[r["gram"][-1]] = n
        for m in models:
            m.total = {c: sum(d.values()) for c, d in m.after.items()}
        yes, no = models
        return sum(math.log(yes.p(g[:-1], g[-1])) - math.log(no.p(g[:-1], g[-1])) for g in ends) / len(ends)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = Counter(), Counter()
        for allowed in (True, False):
            long = Counter(g for u, v in zip(batch.column("url").to_pylist(), batch.column("allowed").to_pylist(), strict=True) if v == allowed for g in _ends(u))
            for g, k in long.items():
                for i in range(len(g)):
                    n[not allowed][g[i:]] += k
        grams = [*(n[0] | n[1])]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([n[0][g] for g in grams], pa.int64()), pa.array([n[1][g] for g in grams], pa.int64())], names=["gram", "yes", "no"])


def learned(urls: DataFrame) -> Counted:
    """urls: url, allowed. Without one of the classes there is no alphabet, and every difference is 0."""
    grams = table(urls.mapInArrow(_counted, "gram string, yes long, no long").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "grams")
    letters = grams.where("length(gram) = 1").agg(F.count("*").alias("n"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    return Counted(grams, letters["n"] + 1 if letters["yes"] and letters["no"] else 0)  # the end is one of them; one stands for all others


def _url_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, g, n) for k, u in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), strict=True) for g, n in Counter(_ends(u)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["key", "gram", "n"])


def _ratios(alphabet: int):
    """The log ratio of each n-gram, by the counts of its endings from the shortest on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chain in batch.column("chain").to_pylist():
                logs = []
                for c in ("yes", "no"):
                    p = 1 / alphabet
                    for x in chain:
                        if x["all_" + c]:  # else no longer context was seen either
                            p = ((x[c] or 0) + x["kinds_" + c] * p) / (x["all_" + c] + x["kinds_" + c])
                    logs.append(math.log(p))
                out.append(logs[0] - logs[1])
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("size"), pa.array(out, pa.float64())], names=["gram", "size", "ratio"])

    return work


def differences(urls: DataFrame, model: Counted) -> DataFrame:
    """(key, difference) of each URL; urls: key, url, a written table."""
    parts = table(urls.select("key", "url").mapInArrow(_url_grams, "key long, gram string, n long"), "parts")
    asked = table(parts.groupBy("gram").agg(F.count("*").alias("size")), "asked")
    ends = asked.select("gram", F.posexplode(F.expr("transform(sequence(1, length(gram)), k -> right(gram, k))")).alias("k", "end"))
    kinds = lambda c: [F.sum(c).alias("all_" + c), F.count_if(F.col(c) > 0).alias("kinds_" + c)]
    contexts = model.grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(*kinds("yes"), *kinds("no"))
    own = ends.groupBy("end").agg(F.count("*").alias("times")).withColumn("context", F.expr("left(end, length(end) - 1)"))
    own = table(own.join(model.grams.withColumnRenamed("gram", "end"), "end", "left").join(contexts, "context", "left").drop("context"), "ends")  # a context has an alphabet of ends at most
    link = F.struct("k", "yes", "no", "all_yes", "kinds_yes", "all_no", "kinds_no")
    chains = join_groups(ends, own, ["end"], "times").groupBy("gram").agg(F.array_sort(F.collect_list(link)).alias("chain"))
    ratios = table(chains.join(asked, "gram").select("gram", "size", "chain").mapInArrow(_ratios(model.alphabet), "gram string, size long, ratio double"), "ratios")
    sums = join_groups(parts, ratios, ["gram"], "size").groupBy("key").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("x"))
    return sums.select("key", F.round("x", DIGITS).alias("difference"))


def _ordered(d: DataFrame, *by: str) -> DataFrame:
    """Rows in order, as ranges: `key` has the number of the range above bit 33 and the place in it below."""
    return table(d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("key", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("key", 33))


def _apart(labelled: DataFrame) -> DataFrame:
    """url, allowed, key, and whether a URL is apart: every CALIBRATED-th of its class, in order. labelled: url, allowed, each once."""
    d = _ordered(labelled, "allowed", "url")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("allowed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy("part", "allowed").agg(F.count("*").alias("n"), F.min("key").alias("least")).select("part", "allowed", "least", before.alias("before"))  # a row for each range and class
    return d.join(F.broadcast(starts), ["part", "allowed"]).select("url", "allowed", "key", ((F.col("key") - F.col("least") + F.col("before")) % CALIBRATED == 0).alias("apart"))


def _limit(scored: DataFrame, yes: int, no: int) -> float:
    """Of the points between the differences the one with the fewest errors, each class's share counted alike; of several, the middle. scored: allowed, difference."""
    d = _ordered(scored.groupBy("difference").agg(F.count_if("allowed").alias("yes"), F.count_if(~F.col("allowed")).alias("no")), "difference")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("part").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.max("difference").alias("most"))
    starts = starts.select("part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c + "_before") for c in ("yes", "no")), F.max("most").over(w).alias("last"))  # a row for each range
    w = Window.partitionBy("part").orderBy("key")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(c + "_before") for c in ("yes", "no")}
    last = F.coalesce(F.lag("difference").over(w), "last")
    d = d.join(F.broadcast(starts), "part").select(F.coalesce((F.col("difference") + last) / 2, F.col("difference") - 1).alias("x"), (below["yes"] * no + (no - below["no"]) * yes).alias("errors"))
    top = scored.agg((F.max("difference") + 1).alias("x")).withColumn("errors", F.lit(yes * no).cast("long"))
    points = table(d.unionByName(top), "points")
    least = points.agg(F.min("errors")).first()[0]
    return points.where(F.col("errors") == least).agg(F.percentile_approx("x", 0.5, 10_000)).first()[0]


def fit(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> Counted:
    """Learns from all URLs that a rule accepts or rejects, and calibrates the limit on those of them that are apart."""
    url = F.col(url_col)
    _, verdict = rule_column(rules, host(url), path(url))
    labelled = pages.select(url.alias("url"), (verdict == "allow").alias("allowed")).where("url is not null and allowed is not null").distinct()
    d = table(_apart(labelled), "labelled")
    model = learned(d.where("not apart"))
    held = d.where("apart")
    n = held.agg(F.count_if("allowed").alias("yes"), F.count_if(~F.col("allowed")).alias("no")).first()
    if not model.alphabet or not n["yes"] or not n["no"]:
        return model
    scored = table(held.join(differences(held, model), "key").select("allowed", "difference"), "scored")
    return Counted(model.grams, model.alphabet, _limit(scored, n["yes"], n["no"]))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Counted | UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the difference of each row's URL."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("own"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    if isinstance(model, UrlModel):
        given = [(u, v) for v, us in ((True, model.accepted), (False, model.rejected)) for u in us]
        counted = learned(pages.sparkSession.createDataFrame(given, "url string, allowed boolean"))
        model = Counted(counted.grams, counted.alphabet, model.limit)
    if model.alphabet:
        urls = table(src.groupBy("url").agg(F.count("*").alias("times")).withColumn("key", F.monotonically_increasing_id()), "urls")
        by_url = table(urls.join(differences(urls, model), "key").drop("key"), "differences")
        scored = join_groups(src, by_url, ["url"], "times")
    else:
        scored = src.withColumn("difference", F.lit(0.0))
    h, p = host(F.col("own")), path(F.col("own"))
    rule, verdict = rule_column(rules, h, p)
    by_model = F.when(F.col("difference") >= model.limit, "allow").otherwise("block")
    return scored.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "difference")
