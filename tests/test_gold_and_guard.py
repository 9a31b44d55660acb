"""Pointers and units by literal cases, second checks, truth of sealed cases, versions that are published as a whole, and the log's guard: stream equals batch."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import documents, gold, graphs, metrics
from factloom.sources import files, published
from factloom.streaming import guard

rng = random.Random(12)
TEXT = "The ﬁnal  Terms of 漢字 straße\nIssue Date: 1 May"
GOOD = {"doc_id": "D1", "authorized": True, "page": 1, "bbox": [0.0, 200.0, 102.0, 0.0], "excerpt": "FINAL terms of", "sha": "a" * 64, "doc_sha": "a" * 64, "known_sha": None, "width": 100.0, "height": 200.0, "page_text": TEXT}
KIND = "doc_id string, authorized boolean, page int, bbox array<double>, excerpt string, sha string, doc_sha string, known_sha string, width double, height double, page_text string"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"doc_id": "a/b"}, "document not found: invalid id"), ({"doc_id": None}, "document not found: invalid id"), ({"doc_id": "-a"}, "document not found: invalid id"), ({"doc_id": "a" * 201}, "document not found: invalid id"), ({"authorized": False}, "document not authorized for case"),
    ({"page": 0}, "page must be a positive integer"), ({"page": None}, "page must be a positive integer"), ({"bbox": None}, None), ({"bbox": [1.0, 2.0, 3.0]}, "bbox must contain four finite numbers"), ({"bbox": [0.0, NAN, 1.0, 0.0]}, "bbox must contain four finite numbers"),
    ({"bbox": [0.0, INF, 1.0, 0.0]}, "bbox must contain four finite numbers"), ({"bbox": [0.0, None, 1.0, 0.0]}, "bbox must contain four finite numbers"), ({"bbox": []}, "bbox must contain four finite numbers"), ({"sha": None}, None), ({"sha": "A" * 64}, "invalid sha256"), ({"sha": "b" * 64}, "sha256 mismatch vs source"),
    ({"doc_sha": None}, "document not found"), ({"known_sha": "b" * 64}, "snapshot sha256 mismatch"), ({"known_sha": "a" * 64}, None), ({"width": None, "height": None, "page_text": None}, "page out of range"), ({"bbox": [0.0, 200.0, 102.1, 0.0]}, "bbox outside page bounds"),
    ({"bbox": [0.0, 204.0, 50.0, 0.0]}, None), ({"bbox": [0.0, 204.1, 50.0, 0.0]}, "bbox outside page bounds"), ({"bbox": [5.0, 20.0, 5.0, 0.0]}, "bbox outside page bounds"), ({"bbox": [-1.0, 20.0, 5.0, 0.0]}, "bbox outside page bounds"), ({"bbox": [1.0, 5.0, 5.0, 5.0]}, "bbox outside page bounds"),
    ({"excerpt": None}, None), ({"excerpt": ""}, None), ({"excerpt": "STRASSE issue   date"}, None), ({"excerpt": "fınal"}, "excerpt not present in page text"), ({"excerpt": "no such thing"}, "excerpt not present in page text"), ({"excerpt": "1 may", "page_text": "x 1\t\nMAY y"}, None), ({"excerpt": "no/id", "doc_id": "no/id", "page": 0}, "document not found: invalid id"),
])
def test_pointer_error(spark, change, want):
    p = {**GOOD, **change}
    d = spark.createDataFrame([tuple(p.values())], KIND)
    assert d.select(gold.pointer_error({c: F.col(c) for c in d.columns}).alias("e")).first()["e"] == want


def test_folding_is_that_of_python(spark):
    texts = ["a  B\tc\n", "\x1cx\x1d y ", "ﬁ Ⅻ ß İ", None, "", "plain", "é é"]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(gold.folded(F.col("t")).alias("f")).collect()]
    assert got == [metrics.canonical_text(t) for t in texts]


UNIT = {"field": "isin", "status": "CONFIRMED_VALUE", "has_value": True, "n_pointers": 1, "pointer_error": None, "method": "value_in_page", "result": "PASS", "found": True}


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"field": "x"}, "unknown field"), ({"field": None}, "unknown field"), ({"status": "DRAFT"}, "not a gold status"), ({"has_value": False}, "CONFIRMED_VALUE requires a value"), ({"n_pointers": 0}, "CONFIRMED_VALUE requires evidence pointer"), ({"status": "CONFLICT", "n_pointers": 0}, "CONFLICT requires evidence of both readings"),
    ({"pointer_error": "page out of range"}, "BROKEN_EVIDENCE: page out of range"), ({"result": "FAIL"}, "critical field requires second_check PASS"), ({"result": None, "method": None}, "critical field requires second_check PASS"), ({"found": False}, "second_check value_in_page FAILED"), ({"found": False, "method": "dual_excerpt"}, None), ({"found": False, "status": "MISSING", "n_pointers": 0}, None), ({"field": "issuer", "result": None, "method": None, "found": False}, None),
])
def test_unit_error(spark, change, want):
    u = {**UNIT, **change}
    d = spark.createDataFrame([tuple(u.values())], "field string, status string, has_value boolean, n_pointers int, pointer_error string, method string, result string, found boolean")
    assert d.select(gold.unit_error({c: F.col(c) for c in d.columns}).alias("e")).first()["e"] == want


def test_second_checks(spark):
    rows = [("absence_scan", 0, [1], ["x"], ["t"], None, None, "PASS"), ("absence_scan", 2, [1], ["x"], ["t"], None, None, "absence_scan hits"), ("dual_excerpt", None, [1, 1], [], [], None, None, "dual_excerpt needs 2 pages"), ("dual_excerpt", None, [1, 2], [], [], None, None, "PASS"),
            ("value_in_page", None, [1, 2], ["2 5", "eur"], ["no", "eur 5 and 2"], None, None, "PASS"), ("value_in_page", None, [1, 2], ["2 5"], ["2", "5"], None, None, "value not in page"), ("value_in_page", None, [9], ["2"], [None], None, None, "value not in page"),
            ("pdf_text_check", None, [], [], [], "b c", "a b c", "PASS"), ("pdf_text_check", None, [], [], [], "c b", "a b c", "pdf_text_check miss"), (None, None, [], [], [], None, None, "missing second_check"), ("other", None, [], [], [], None, None, "unknown second_check")]
    d = spark.createDataFrame(rows, "method string, hits int, pages array<int>, vals array<string>, texts array<string>, m string, raw string, want string")
    got = d.select(gold.second_check(*(F.col(c) for c in ("method", "hits", "pages", "vals", "texts", "m", "raw"))).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_truth(spark):
    sealed = spark.createDataFrame([("a",), ("b",), ("b",)], "case_id string")
    log = [("a", "isin", 1, "MISSING", 0, True), ("a", "isin", 2, "CONFIRMED_VALUE", 0, False), ("a", "cap", 1, "MISSING", 0, None), ("a", "old", 1, "MISSING", 0, None), ("c", "isin", 1, "MISSING", 0, True)]
    units = gold.truth_units(sealed, spark.createDataFrame(log, "case_id string, field string, ordinal int, status string, n_pointers int, critical_verified boolean"))
    got = {(r["case_id"], r["field"], r["issue"]): r["fields"] for r in gold.truth_issues(sealed, units, ("isin", "cap", "issuer")).collect()}
    assert got == {("a", None, "missing_fields"): ["issuer"], ("b", None, "missing_fields"): ["isin", "cap", "issuer"], ("a", "isin", "confirmed_without_evidence"): None, ("a", "isin", "critical_not_verified"): None}
    assert {r["status"]: (r["n"], r["critical_verified"]) for r in gold.truth_totals(units, ("isin", "cap")).collect()} == {"CONFIRMED_VALUE": (1, 0), "MISSING": (1, 0)}


def test_tables_with(spark):
    rows = spark.createDataFrame([(1, 0, 0, ["a", None]), (1, 0, 1, ["Total", "b"]), (1, 1, 0, ["x"]), (2, 0, 0, ["subtotal"])], "doc_id int, table int, row int, cells array<string>")
    assert sorted(tuple(r) for r in documents.tables_with(rows, "(?i)total").collect()) == [(1, 0), (2, 0)]


def test_targets_by_number_are_those_of_all_pairs(spark):
    ids = [f"FOL_{rng.randint(0, 999)}{rng.choice(['', '.1', '-A'])}" for _ in range(120)]
    nodes = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice(["BASE_PROSPECTUS", "FINAL_TERMS", "ADMISSION"]), n) for n, i in enumerate(dict.fromkeys(ids))]
    asked = [(k, f, rng.choice(["BASE_PROSPECTUS", "FINAL_TERMS", None]), rng.choice(["1", "12", "7", "99", "FOL_", "", None, "x" * 300, str(rng.randint(0, 999))]), i) for k, (f, i, _, _) in enumerate(nodes * 3)]
    got = graphs.targets_by_number(spark.createDataFrame(nodes, "family int, id string, role string, ordinal int"), spark.createDataFrame(asked, "k int, family int, role string, number string, source string"))
    want = {}
    for k, f, role, number, source in asked:
        hits = [(o, i) for g, i, r, o in nodes if f is not None and g == f and r == role and number and number in i and i != source]
        want[k] = max(hits)[1] if hits else None
    assert {r["k"]: r["target"] for r in got.collect()} == want and sum(x is not None for x in want.values()) > 20


def test_title_negatives_cover_each_issuer(spark):
    rows = [(i, rng.choice(["t", "t", "u", None]), rng.choice([*range(30), None]), rng.randint(0, 9)) for i in range(400)] + [(900, "alone", 1, 1)]
    got = graphs.title_negatives(spark.createDataFrame(rows, "id int, title string, issuer int, register int").repartition(4)).collect()
    registers = {}
    for _, t, s, r in rows:
        registers.setdefault((t, s), set()).add(r)
    assert all(r["issuer"] != r["other_issuer"] and r["register"] != r["other_register"] and r["other_register"] in registers[r["title"], r["other_issuer"]] for r in got)
    assert len({r["id"] for r in got}) == len(got) > 250 and 900 not in {r["id"] for r in got}
    ring = {(r["title"], r["issuer"]): r["other_issuer"] for r in got}
    assert all(len({o for (t, _), o in ring.items() if t == title}) == sum(t == title for t, _ in ring) for title in ("t", "u"))  # each issuer once on the other side


# --- versions


def test_readers_always_see_a_whole_table(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert published.pointer(spark, at) is None
    with pytest.raises(FileNotFoundError):
        published.read(spark, at)
    published.publish(spark.range(3), at, "numbers")
    open_reader = published.read(spark, at)
    seal = published.stage(spark.range(5), at, "numbers")  # between the two steps
    assert published.read(spark, at, check=True).count() == 3
    published.release(spark, at, seal)
    assert published.read(spark, at, "numbers", check=True).count() == 5 and open_reader.count() == 3  # the version before is still there
    published.publish(spark.range(7), at, "numbers")
    assert published.read(spark, at).count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("CURRENT")] == ["CURRENT"]
    with pytest.raises(ValueError, match="holds numbers"):
        published.read(spark, at, "letters")
    now = published.pointer(spark, at)
    spark.range(1, 8).write.mode("overwrite").parquet(f"{at}/{now['version']}")  # other content under the same name
    with pytest.raises(ValueError, match="not what was sealed"):
        published.read(spark, at, check=True)


def test_content_digest_is_of_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    same = published.content_digest(d.repartition(3).select("v", "k"))
    assert same == published.content_digest(d) != published.content_digest(d.distinct())
    assert published.content_digest(d.where("false")) == published.content_digest(spark.createDataFrame([], "k int, v string"))


def test_replaced_table_is_published(spark, tmp_path):
    at = f"{tmp_path}/r"
    for n in (1, 2, 4):
        files.replace_table(spark.range(n), at)
    assert files.read_replaced(spark, at).count() == 4


def test_sealed_records(spark):
    body = {"case_id": "C1", "b": [1, 2.5, None], "a": {"z": "é", "y": True}}
    own = hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    texts = {"C1": json.dumps({**body, published.OWN: own}, indent=1), "C2": json.dumps({**body, published.OWN: own}), "C3": json.dumps({**body, "b": 9, "case_id": "C3", published.OWN: own}), "C4": "[1]", "C5": "{broken", "C6": json.dumps(body), "a/b": "{}", "C7": "{}"}
    seals = [(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items() if k != "C7"]
    got = published.sealed_error(spark.createDataFrame(list(texts.items()), "case_id string, content string"), spark.createDataFrame(seals, "case_id string, sha256 string"))
    content = "candidate content seal mismatch"
    assert {r["case_id"]: r["error"] for r in got.collect()} == {"C1": None, "C2": content, "C3": content, "C4": content, "C5": content, "C6": content, "a/b": "invalid case id", "C7": "candidate seal mismatch"}


def test_kept_manifest_by_schema(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('[{"a": 1, "b": "x"}]')
    assert files.read_manifest_kept(spark, str(p), "a long").columns == ["a"]
    assert files.read_manifest_kept(spark, str(p), "b string").collect()[0][0] == "x"


# --- the guard


def log(n_keys=6, n=40):
    rows = []
    for key in range(n_keys):
        ts = 0
        for seq in range(n):
            ts += rng.choice([0, 1, 5, -3])
            kind = rng.choice(["PDF_SEARCH"] * 6 + ["NO_SUCH", None] + [guard.SUBMIT] * (seq > n // 2))
            rows.append((key, seq, kind, ts, rng.choice([True, False, None])))
    return rows


KINDS = "key long, seq long, kind string, ts long, evidence_ok boolean"


def by_hand(rows):
    out = {}
    for key in {r[0] for r in rows}:
        latest, submitted = None, False
        for _, seq, kind, ts, ok in sorted(set(r for r in rows if r[0] == key), key=lambda r: r[1]):
            if kind not in guard.EVENTS:
                v = guard.UNKNOWN
            elif submitted:
                v = "REPEATED" if kind == guard.SUBMIT else guard.SUBMITTED
            elif latest is not None and ts < latest:
                v = guard.EARLIER
            elif kind == guard.SUBMIT and ok is False:
                v = guard.BROKEN
            else:
                v, latest, submitted = "ACCEPTED", ts, kind == guard.SUBMIT
            out[key, seq] = v
    return out


def test_guard_by_hand(spark):
    rows = log()
    got = {(r["key"], r["seq"]): r["verdict"] for r in guard.judged(spark.createDataFrame(rows + rows[::3], KINDS).repartition(3)).collect()}
    want = by_hand(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(set(want.values())) >= 5
    assert guard.submissions(guard.judged(spark.createDataFrame(rows, KINDS))).groupBy("key").count().where("count > 1").isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    """Over a shuffled log with duplicates, in several batches and with a restart."""
    rows = log(5, 30)
    mixed = rows + rng.sample(rows, 60)
    rng.shuffle(mixed)
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in range(3):
            spark.createDataFrame(mixed[part::3], KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events = spark.readStream.schema(KINDS).parquet(f"{tmp_path}/in")
            q = guard.guard(events).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            if part < 2:
                assert spark.read.parquet(f"{tmp_path}/out").count() < len(rows)
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/out")
    batch = guard.judged(spark.createDataFrame(rows, KINDS)).select("key", "seq", "kind", "ts", "verdict")
    assert sorted(map(str, map(tuple, out.select(batch.columns).collect()))) == sorted(map(str, map(tuple, batch.collect())))


@pytest.mark.parametrize(("text", "want"), [("A", True), ("a_-9", True), ("a" * 200, True), ("a" * 201, False), ("", False), (None, False), ("-a", False), ("_a", False), ("a.b", False), ("a\n", False), ("é", False)])
def test_valid_id(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(L.valid_id(F.col("t")).alias("v")).first()["v"] is want


def test_frozen_modules(spark, tmp_path):
    (tmp_path / "m" / "deep").mkdir(parents=True)
    for name in ("a.py", "deep/b.py", "deep/c.txt"):
        (tmp_path / "m" / name).write_text(name)
    frozen = files.digests(spark, f"file://{tmp_path}/m", "*.py").withColumn("name", F.col("path"))
    rows = {r["path"]: r["sha256"] for r in frozen.collect()}
    assert rows == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.py", "deep/b.py")}
    frozen = spark.createDataFrame([(k, k, v) for k, v in rows.items()], "name string, path string, sha256 string")
    assert files.freeze_errors(frozen, files.digests(spark, f"file://{tmp_path}/m")).isEmpty()
    (tmp_path / "m" / "a.py").write_text("changed")
    (tmp_path / "m" / "deep" / "b.py").unlink()
    assert {r["name"]: r["error"] for r in files.freeze_errors(frozen, files.digests(spark, f"{tmp_path}/m")).collect()} == {"a.py": "sha mismatch", "deep/b.py": "missing"}
