"""Shared tables, joins with hot groups, filters without false negatives, and rows that stay."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factloom.llm import store


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master)))


def test_tables_are_released(spark):
    kept = store.table(spark.range(3), "kept")
    with store.released():
        path = store.new_path(spark, "gone")
        spark.range(2).write.parquet(path)
        assert Path(path.removeprefix("file://")).exists()
    assert not Path(path.removeprefix("file://")).exists() and kept.count() == 3


def test_hot_groups(spark):
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"))
    groups = store.table(rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5999"), "groups")
    assert store.join_groups(rows, groups, ["k"], "n").agg(F.count("*"), F.sum("n")).first()[:] == (5999, 4000 * 4000 + 1999)
    left = store.join_groups(rows, groups, ["k"], "n", "left")
    assert left.count() == 6000 and left.where("n is null").count() == 1


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_filter_loses_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(store, "WORDS", words)
    rows, members = spark.range(3000), spark.range(0, 3000, 7)
    maybe, others = store.filtered(rows, F.xxhash64("id"), members, F.xxhash64("id"))
    assert members.join(others, "id").count() == 0 and maybe.count() + others.count() == 3000
    if words > 1:
        assert maybe.count() < 440


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 1), (None, "a", 2), (None, None, 3), (2, "c", 4)], "doc_id long, text string, kept int")
    v = docs.select("doc_id", store.text_key(F.col("text")).alias("text_key"), (F.col("text").isNull() | (F.col("text") == "a")).alias("kept")).where("coalesce(text_key, 0) <> 0")
    got = store.kept_rows(docs, v.where(F.col("doc_id").isNull() | (F.col("doc_id") == 1)))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["kept"]) for r in got.collect()) == [(0, "", 3), (0, "a", 2), (1, "a", 0), (2, "c", 4)]
