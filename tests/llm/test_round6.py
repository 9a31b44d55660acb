"""What is learned comes from all rows, and texts are shuffled only where ids don't tell."""

import contextlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from factloom.llm import quality, store, urls

rng = random.Random(17)


@contextlib.contextmanager
def without_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def shuffled(spark):
    """Bytes that all tasks so far have written for shuffles."""
    time.sleep(1)  # the listener is behind
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_quality_moves_no_texts(spark):
    """Trusted rows are counted and scored where they lie (their texts were shuffled, 5 MB here)."""
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(100))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 6000, 2)], "doc_id long, quality int")
    docs = store.table(docs, "docs")
    with without_broadcasts(spark):
        before = shuffled(spark)
        quality._totals(docs)
        counts = shuffled(spark) - before  # buckets of as many texts
        quality.fit(docs, labels)
        assert shuffled(spark) - before - counts < 2 * counts + 500_000


@pytest.mark.parametrize("trusted", [5, 150])
def test_quality_counts_behind_a_poor_filter(spark, monkeypatch, trusted):
    """Whatever the filter lets through by mistake is taken off again: rows without an id and rows of other ids."""
    monkeypatch.setattr(store, "WORDS", 4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i % 200, " ".join(rng.choices(words, k=60))) for i in range(260)] + [(None, "null " * 60)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(trusted)], "doc_id long")
    with without_broadcasts(spark):
        got = quality._target(docs, store.table(ids, "ids"))
    want = quality._totals(spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < trusted], "doc_id long, text string"))
    assert np.array_equal(got, want) and want.sum()


def test_urls_learn_from_all(spark):
    """12,000 accepted URLs, of which the models learn from all but a quarter (from 3,750 at most before)."""
    rules = [("allow", "org/"), ("block", "com/de/")]
    rows = [(i, f"http://a.org/{i:05d}") for i in range(12_000)] + [(20_000 + i, f"http://b.com/de/{i:05d}") for i in range(40)]
    model = urls.fit(spark.createDataFrame(rows, "page_id long, url string").repartition(5), rules)
    counts = {r["gram"]: (r["yes"], r["no"]) for r in model.grams.where("gram in ('\x03', 'org/', '00000', '00001', '0001\x03')").collect()}
    ends = [f"{i:05d}" for i in range(12_000) if i % urls.CALIBRATED]
    assert counts["\x03"] == (9000, 30) and counts["org/"] == (9000, 0) and "00000" not in counts and counts["00001"] == (1, 1)
    assert counts["0001\x03"] == (sum(x.endswith("0001") for x in ends), 1)


def test_url_limit_counts_ties_together(spark):
    """URLs with one difference are on one side of the limit, across ranges too."""
    values = [rng.randint(-6, 6) / 4 for _ in range(60)]
    rows = [(x + rng.choice((0, 0.25)) > 0, x) for x in values]
    yes, no = sum(a for a, _ in rows), sum(not a for a, _ in rows)
    got = urls._limit(store.table(spark.createDataFrame(rows, "allowed boolean, difference double").repartition(3), "scored"), yes, no)
    errors = lambda at: sum(x < at for a, x in rows if a) * no + sum(x >= at for a, x in rows if not a) * yes
    assert errors(got) == min(map(errors, [*(x - 0.01 for x in values), 9]))


def test_pipeline_hands_over_small_batches(spark):
    """Each stage bounds the rows that Python gets at once (10,000 whole texts before), whoever writes its result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(2500).repartition(1).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    try:
        for before, most in ((was, corpus_pipeline.BATCH), ("7", 7), ("0", corpus_pipeline.BATCH)):
            spark.conf.set(key, before)
            corpus_pipeline.packed(spark, docs, "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
            assert max(r["n"] for r in sizes.collect()) == most
    finally:
        spark.conf.set(key, was)
