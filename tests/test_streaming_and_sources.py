"""Sources, sinks and the streamed event log on small files."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import reconcile
from factloom.sources import files
from factloom.streaming import log

SCHEMA = "k long, v string"


def test_logs(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v": null}\n')
    bad.write_text('{"k": 1, "v": "a"}\n{"k": 2, "v":')
    assert sorted(map(tuple, files.read_log(spark, str(good), SCHEMA).collect())) == [(1, "a"), (2, None)]
    assert files.read_log_strict(spark, str(good), SCHEMA).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_log_strict(spark, str(bad), SCHEMA).collect()


@pytest.mark.parametrize(("encoding", "text"), [("utf-8", "emisión €"), ("cp1252", "emisión “€”"), ("latin-1", "emisión \x81")])
def test_manifest_encodings(spark, tmp_path, encoding, text):
    p, q = tmp_path / "many.json", tmp_path / "one.json"
    p.write_bytes(json.dumps([{"k": 1, "v": text}, {"k": 2}], indent=1, ensure_ascii=False).encode(encoding))
    q.write_bytes(json.dumps({"k": 3, "v": text}, ensure_ascii=False).encode(encoding))
    assert [tuple(r) for r in files.read_manifest(spark, str(p), SCHEMA).collect()] == [(1, text), (2, None)]
    assert [tuple(r) for r in files.read_manifest(spark, str(q), SCHEMA).collect()] == [(3, text)]


def test_append_refuses_what_is_not_finite(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "k long, x double")
    files.append_log(rows, at)
    files.append_log(rows, at)
    assert spark.read.json(at).count() == 4
    with pytest.raises(Exception, match="not a finite number"):
        files.append_log(spark.createDataFrame([(3, float("nan"))], "k long, x double"), at)
    files.replace_table(rows, at + "-table")
    files.replace_table(rows.where("k = 1"), at + "-table")
    assert files.read_replaced(spark, at + "-table").count() == 1


def test_registry_rows(spark):
    html = '<tr><td> 11<b>234</b></td><td>Bonos\n  simples</td><td><a href="/verdocumento?x=1">doc</a> <a href="/e?nif=A1&NUMFOL=77">e</a></td></tr>'
    r = files.registry_record(spark.createDataFrame([(html,), (None,)], "html string"), "html", ["register", "title"]).collect()
    assert (r[0]["register"], r[0]["title"], r[0]["doc_url"], r[0]["nif"], r[0]["numfol"]) == ("11 234", "Bonos simples", "/verdocumento?x=1", "A1", "77")
    assert (r[1]["register"], r[1]["doc_url"]) == (None, None)


def test_capture_diff(spark):
    schema = "k long, code int, raw_sha string, rows_sha string"
    a = spark.createDataFrame([(1, 200, "a", "a"), (2, 200, "a", "a"), (3, 200, "a", "a"), (4, 200, "a", "a"), (5, 200, "a", "a")], schema)
    b = spark.createDataFrame([(1, 200, "a", "a"), (2, 200, "b", "a"), (3, 200, "b", "b"), (4, 404, "a", "a"), (6, 200, "a", "a")], schema)
    got = {r["k"]: r["change"] for r in reconcile.capture_diff(a, b, "k").collect()}
    assert got == {1: "UNCHANGED", 2: "UPDATED_METADATA", 3: "UPDATED", 4: "DISAPPEARED", 5: "DISAPPEARED", 6: "NEW"}


def test_streamed_sessions_equal_batch(spark, tmp_path):
    at = [0, 100, 350, 1000, 1200, 90_000]  # the last event moves the watermark past the others
    rows = spark.createDataFrame([(1, t) for t in at], "k long, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    streamed = log.read_events(spark, f"{tmp_path}/in", rows.schema)
    log.run_available(log.sessions(streamed, "ts", "k"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r["w"]["start"], r["n"]) for r in rows.groupBy("k", F.session_window("ts", "300 seconds").alias("w")).agg(F.count("*").alias("n")).collect())
    assert got == want[:2] and [n for _, n in got] == [3, 2]
