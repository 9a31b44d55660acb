"""Columns of any name stay as they are, readers and samples keep their bounds, licences are found in several spellings, conversations are dealt out."""

import gzip
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, exact_dedup, language, licenses, near, quality, store, warc

rng = random.Random(8)
NAMES = ("_own", "_word", "_slot", "_key", "_stays", "_id", "_n", "_bits", "_rep", "row", "slot", "word", "bits", "stays", "v_id", "v_key", "doc", "id", "key", "n", "text_key", "h1", "node", "root", "salt")


def test_columns_of_any_name(spark):
    """Exact and near dedup return the columns that no user thought of as internal, with their values."""
    words = " ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=90))
    texts = [words, words, words.replace(" ", "\n"), words + " more", "quite another text", None, ""]
    rows = [(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)
    for f in (exact_dedup.deduplicated, near.deduplicated):
        out = f(docs)
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert 0 in got or 3 in got and len(got) < len(texts)
        assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in NAMES)
    maybe, others = store.filtered(docs, F.col("doc_id"), docs.where("doc_id < 3"), F.col("doc_id"))
    assert maybe.columns == others.columns == docs.columns and {r["doc_id"] for r in maybe.collect()} == {0, 1, 2}
    assert quality.keep_good(docs, quality.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))).columns == docs.columns


@pytest.mark.parametrize("window", [7, 1 << 14])
def test_members_by_hand(monkeypatch, window):
    monkeypatch.setattr(warc, "WINDOW", window)
    parts = [b"", b"x" * 100_000, bytes(rng.choices(range(256), k=3000)), b"end"]
    raw = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.members(raw)) == parts and list(warc.members(memoryview(raw))) == parts and not list(warc.members(b""))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(raw[:-3]))


def test_reader_is_linear():
    one = b"".join(gzip.compress(bytes(rng.choices(range(256), k=1500))) for _ in range(400))

    def took(n):
        raw = one * n
        t = time.process_time()
        assert sum(1 for _ in warc.members(raw)) == 400 * n
        return time.process_time() - t

    took(1)
    assert took(16) < 40 * max(took(2), took(2), 1e-3) / 2


def test_read_without_payloads(spark, tmp_path):
    """What op8's query reads: sizes of revisits are those of their responses, whatever is not read."""
    html = ["a" * 50, "b" * 70, "a" * 50, None, "", "a" * 50]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write(warc.deduplicated(pages), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in warc.read(spark, path, with_payload=False).collect()}
    assert got == {0: ("revisit", 5, 50, None), 1: ("response", None, 70, None), 2: ("revisit", 5, 50, None), 3: ("revisit", 4, 0, None), 4: ("response", None, 0, None), 5: ("response", None, 50, None)}


def test_chat_is_not_shuffled_by_conversation(spark):
    """A null conversation with most of the rows is dealt out by its pieces, and its dialogue is that of the SQL."""
    rows = [(None if i % 3 else i % 7, i // 2, rng.choice(["a", "b", "system", None]), rng.choice(["x", "yy", "<|z", None])) for i in range(900)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.rotate(turns)
    con = duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"conv_id": "Int64"}))
    want = con.execute(chat.SQL).df()
    key = lambda r: (str(r[0]), *map(str, r[1:4]))
    got = sorted(([None if x is None else x for x in r] for r in out.collect()), key=key)
    mine = sorted(([None if x != x else int(x) if isinstance(x, float) else x for x in r] for r in want[out.columns].astype(object).where(want[out.columns].notna(), None).values.tolist()), key=key)
    assert [list(map(str, r)) for r in got] == [list(map(str, r)) for r in mine] and any(r[2] > 0 for r in got)
    plan = chat._placed(turns.select(F.lit("k").alias("conv"), "turn", "role", F.col("text").alias("said"), F.lit(False).alias("nameless"), F.lit(0).cast("long").alias("part"), F.lit("t").alias("turn_key"), F.lit("d").alias("digest")), 256)._jdf.queryExecution().executedPlan().toString()
    assert "said" not in "".join(x for x in plan.splitlines() if "hashpartitioning(conv#" in x and "turn_key" not in x)
    assert not [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(conv#" in x and "part#" not in x]


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LETTERS", 1000)
    one = "the thing and that "
    rows = [(i, one * 10, "en") for i in range(40)] + [(100 + i, "été que leur " * 200, "fr") for i in range(3)] + [(200, "kort tekst", "nl"), (201, "lang " * 900, "nl"), (300, None, "xx"), (301, "", "xx")]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(m.text) == {"en", "fr", "nl"} and all(len(t) <= 1000 for t in m.text.values())
    assert m.text["nl"].strip() == "kort tekst" and m.text["fr"].startswith("été que leur") and len(m.text["en"]) > 500
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_long_rows_of_a_language_take_bounded_memory(spark):
    """A hundred labelled rows of a megabyte in each of two languages: LETTERS characters of each are learned from."""
    import resource

    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.when(F.col("id") % 2 == 0, F.concat(F.lit("the "), F.col("id"), F.lit(" thing "))).otherwise("que leur "), 100_000).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    m = language.fit(rows, F.lit(True))
    assert all(0 < len(t) <= language.LETTERS for t in m.text.values())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB, of the driver's Python


def spelt(text):
    return [text, "  " + text.upper().replace(",", " ;").replace(".", " "), f"Copyright (c) 2020 A. B. {text}" if text.lower().startswith(licenses.OPENINGS) else text, f"Copyright 2019-2021 Some Body\nAll rights reserved.\n\n{text.replace('license', 'licence')}"]


def test_every_listed_licence_in_four_spellings(spark):
    """In Spark and in DuckDB; of whole texts, those that this machine has."""
    import pathlib

    names = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "MPL-1.1": "MPL-1.1", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    whole = [(k, p.read_text(errors="replace")) for k, n in names.items() if (p := pathlib.Path("/usr/share/common-licenses") / n).exists()]
    known = [(k, ts[0]) for k, ts in licenses.KNOWN.items()] + whole
    rows = [(n, k, x) for n, (k, x) in enumerate((k, x) for k, t in known for x in spelt(t))]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).collect()}
    want = {n: k for n, k, _ in rows}
    assert {n: got[n] for n in want} == want
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert dict(con.execute(f"SELECT doc_id, license_id FROM ({licenses.SQL})").fetchall()) == want


def test_all_trusted_rows_are_counted(spark, monkeypatch):
    """A bound of trusted rows changes nothing: the target and the limit are of all of them."""
    from factloom.llm import quality

    docs = spark.range(60).selectExpr("id as doc_id", "repeat(concat('w', id, ' and x', id % 7, ' '), 60) as text")
    labels = spark.range(60).selectExpr("id as doc_id", "1 as quality")
    whole = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "TRUSTED", 8)
    assert quality.fit(docs, labels) == whole
