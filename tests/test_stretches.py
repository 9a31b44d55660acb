"""What is worked out by stretches of a log is what one pass over each key gives, wherever stretches end."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import review, stretches
from factloom.streaming import guard

rng = random.Random(9)
T0 = datetime.datetime(2024, 1, 1)
KINDS = (*review.OPEN, *review.CLOSE, "PDF_SEARCH", "NO_SUCH", None)


def log(n=400):
    """A key with most of the rows, a null key, gaps in the order."""
    rows, at, t = [], 0, 0
    for _ in range(n):
        at += rng.choice([1, 1, 2, 40])
        t += rng.choice([0, 5, 100, 400, -30])
        rows.append((rng.choice(["a", "a", "a", "b", None]), at, T0 + datetime.timedelta(seconds=t), rng.choice(KINDS)))
    return rows


@pytest.mark.parametrize("width", [1, 7, 100, 65_536])
def test_neighbours_and_running_max(spark, width):
    rows = log()
    df = spark.createDataFrame(rows, "k string, n long, ts timestamp, kind string").repartition(4)
    got = {r["n"]: (r["_was"], r["_next"]) for r in stretches.neighbours(df, F.col("n"), "n", "k", width=width).collect()}
    top = {r["n"]: (r["m"], r["odd"]) for r in stretches.running_max(df, {"m": F.when(F.col("kind").isNotNull(), F.col("n") % 17), "odd": F.col("n") % 2 == 1}, "n", "k", width=width).collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, (_, n, _, _) in enumerate(own):
            assert got[n] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
            seen = [r[1] % 17 for r in own[:i] if r[3] is not None]
            assert top[n] == (max(seen) if seen else None, max(r[1] % 2 == 1 for r in own[:i]) if i else None)


def test_reviews_by_stretches(spark):
    df = spark.createDataFrame(log(), "k string, n long, ts timestamp, kind string").repartition(4)
    plain = lambda d: sorted(map(str, map(tuple, d.collect())))
    for f in (lambda w: review.active_seconds(df, "kind", "ts", "n", "k", width=w), lambda w: review.timing_status(df, "kind", "ts", "n", "k", width=w), lambda w: review.order_violations(df, "ts", "n", "k", width=w), lambda w: review.event_errors(df, "kind", "ts", "n", "k", width=w)):
        one = plain(f(65_536))
        assert one and plain(f(3)) == one == plain(f(50))
    events = df.select(F.col("k").alias("key"), (F.col("n") - 1).alias("seq"), "kind", F.unix_seconds("ts").alias("ts"), (F.col("n") % 3 > 0).alias("evidence_ok"))
    assert plain(guard.judged(events, width=5)) == plain(guard.judged(events))


def test_active_time_by_hand(spark):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [("a", 1, at(0), "CASE_OPENED"), ("a", 2, at(5), "CASE_OPENED"), ("a", 3, at(10), "CASE_PAUSED"), ("a", 4, at(20), "CASE_RESUMED"), ("a", 9, at(50), "PDF_SEARCH"), ("b", 5, at(0), "CASE_PAUSED"), (None, 6, at(0), "CASE_OPENED"), (None, 7, at(3), "CASE_SUBMITTED")]
    df = spark.createDataFrame(rows, "k string, n long, ts timestamp, kind string")
    for width in (1, 2, 1000):
        got = {r["k"]: (r["active_us"], r["n_intervals"]) for r in review.active_seconds(df, "kind", "ts", "n", "k", width=width).collect()}
        assert got == {"a": (40_000_000, 2), None: (3_000_000, 1)}
    later = {r["k"]: r["active_us"] for r in review.active_seconds(df, "kind", "ts", "n", "k", now=F.lit(at(100))).collect()}
    assert later == {"a": 90_000_000, None: 3_000_000}
