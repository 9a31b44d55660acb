"""Samples stay bounded where ids repeat."""

from pyspark.sql import functions as F

from factloom.llm.store import bounded_sample


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    """Whichever id is the hot one, the rows that reach the driver are few."""
    low = spark.range(3_000).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30))).first()["id"]
    kind, read = type(spark.range(0)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: read.append(collect(self)) or read[-1])
    for content in (F.col("id"), F.lit(0)):  # of one id, rows that differ, and rows that are the same
        hot = F.col("id") < 3_000
        df = spark.range(9_000).select(F.when(hot, low).otherwise(F.col("id")).alias("k"), F.when(hot, content).otherwise(F.col("id")).alias("v"))
        got = bounded_sample(df, "k", 50)
        assert len({(r["k"], r["v"]) for r in got}) == 50 and max(map(len, read)) <= 1.5 * 50 + 100
