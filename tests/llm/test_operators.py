"""The corpus operators on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import chat, exact_dedup, language, licenses, near, packing, pieces, quality, urls, warc
from factloom.llm.components import components
from factloom.llm.queries import BYTES, PIECES, QUERIES, RULES
from factloom.llm.store import bounded_sample

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdeionrst", k=rng.randint(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


BASE = text(120)
TEXTS = [BASE, BASE, BASE.replace(" ", "\n"), " ".join(BASE.split()[:118]), None, "", "   ", "one two", "one two", text(60), "été 漢字 𝄞 " + text(70), text(9000), "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", float(i), "a") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, lang string, score double, kept string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_language(spark, docs, none):
    train = spark.createDataFrame([(i, " ".join(rng.choices(w, k=80)), k) for i in range(60) for k, w in (("en", ["the", "and", "thing"]), ("fr", ["été", "que", "leur"]))], "doc_id long, text string, lang string")
    m = language.fit(train, F.lit(True))
    got = by_id(language.identify(docs, m))
    assert len(got) == len(TEXTS) and got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und" and got[4]["score"] == 0
    new = spark.createDataFrame([(1, "the thing and the the thing"), (2, "leur été que leur"), (3, "12 34 !")], "doc_id long, text string")
    assert [by_id(language.identify(new, m))[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "fr", "und"]
    assert language.identify(none, m).count() == 0 and language.keep_known(docs, m).columns == docs.columns
    empty = language.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def brute_phrases(learned, t):
    """Longest matches from the left."""
    n = i = 0
    while i < len(t):
        k = 1
        while i + k < len(t) and t[i] in learned and t[i : i + k + 1] in learned:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("lane", [3, 40, 4096])
def test_phrases_by_hand(monkeypatch, lane):
    """The automaton's phrases are those of the definition, wherever stretches end and however many letters there are."""
    monkeypatch.setattr(language, "LANE", lane)
    for letters in ("abc ", "".join(chr(0x4E00 + i) for i in range(200)) + " ab"):
        learned = {k: " ".join("".join(rng.choices(letters, k=n)).split()) for k, n in (("x", 300), ("y", 40))}
        p = language.Parser(learned)
        texts = ["".join(rng.choices(letters + "z", k=rng.randint(0, 200))) for _ in range(20)] + [learned["x"] * 3, "zzz", ""]
        texts = [" ".join(t.split()) for t in texts]
        codes = [p.symbol[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in texts]
        got = p.phrases(np.concatenate(codes), np.cumsum([0, *map(len, codes)]))
        assert got.tolist() == [[brute_phrases(learned[k], t) for t in texts] for k in "xy"]


def test_language_choice_by_hand(spark):
    """Prediction, score and rejection follow from the numbers of phrases."""
    words = {"en": ["the", "and", "thing"], "fr": ["été", "que", "leur"], "zh": ["漢字", "語言", "文"]}
    train = spark.createDataFrame([(i, " ".join(rng.choices(w, k=80)), k) for i in range(30) for k, w in words.items()], "doc_id long, text string, lang string")
    m = language.fit(train, F.lit(True))
    texts = ["the thing QUE", "leur, the été", "文語言 and 文", "ÉTÉ 12 que", "xq zw jv kq pw vy xz qj wk xq zw jv", "", "...", "the " * 3000]
    got = by_id(language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m))
    for i, t in enumerate(texts):
        own = re.sub(r"[^\w]|[\d_]", " ", t.lower())
        own = re.sub(r"\s+", " ", own)
        if not own.strip():
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["known"]) == ("und", 0, False)
            continue
        cost = {k: brute_phrases(x, own) * np.log2(len(x) + 1) / len(own) for k, x in m.text.items()}
        best = min(cost, key=lambda k: (cost[k], k))
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(2 ** (-8 * (c - cost[best])) for c in cost.values()))
        assert got[i]["known"] == (cost[best] - np.log2(len(m.text[best]) + 1) / len(own) <= m.limit)
    assert [got[i]["known"] for i in (3, 4, 7)] == [True, False, True]
    docs = spark.createDataFrame([(1, "the thing", None), (2, texts[4], "en"), (3, "leur que", "de")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang"] for r in language.keep_known(docs, m).collect()} == {1: "en", 3: "de"}


def test_licenses(spark, none):
    mit = "Copyright (c) 2020 A. B.\nAll rights reserved.\n\n" + licenses.MIT.replace("sublicense", "sub-licence").upper()
    got = by_id(licenses.scan(spark.createDataFrame([(1, mit), (2, mit + " x"), (3, None), (4, ""), (5, licenses.ZLIB + "!")], "doc_id long, text string")))
    assert [got[i]["license_id"] for i in range(1, 6)] == ["MIT", None, None, None, "Zlib"] and licenses.scan(none).count() == 0


def test_urls(spark):
    rows = [(i, f"https://a{i}.good.org/docs/page{i}") for i in range(60)] + [(100 + i, f"https://b{i}.com/de/spam{i}?x=1") for i in range(60)]
    odd = [(900, None), (901, ""), (902, "no scheme"), (903, "http://EXAMPLE.org/es/1"), (904, "http://m.example.org/en/1"), (905, "http://org"), (906, "http://new.net/docs/page7"), (907, "http://x.net/de/spam9?x=1"), (908, "a://b.com/fr/x#/de/")]
    pages = spark.createDataFrame(rows + odd, "page_id long, url string")
    m = urls.fit(pages, RULES)
    got = by_id(urls.judge(pages, RULES, m), "page_id")
    assert [got[i]["rule"] for i in (900, 901, 902, 903, 904, 905, 908)] == [None, None, None, "example.org/es/", "example.org/en/1", None, "com/fr/"]
    assert got[903]["host"] == "example.org" and got[905]["path"] == "" and got[904]["verdict"] == "block" and got[902]["host"] == ""
    assert got[906]["verdict"] == "allow" and got[907]["verdict"] == "block"
    assert urls.judge(pages.where("false"), RULES, urls.fit(pages.where("false"), RULES)).count() == 0


def test_markov_sums_to_one():
    m = urls.Markov(["abab", "abc"], 5)
    assert sum(m.p("ab", c) for c in "abc\x03z") == pytest.approx(1)


@pytest.mark.parametrize("huge", [1 << 18, 500])
def test_exact(docs, none, huge):
    got = exact_dedup.exact_dedup(docs, huge=huge).collect()
    assert len(got) == len(TEXTS) + 1
    groups = collections.defaultdict(list)
    for i, t in [*enumerate(TEXTS), (9, TEXTS[9])]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({r["keep_id"] for r in got}) and exact_dedup.exact_dedup(none).count() == 0


def test_fingerprints_compose():
    b = np.frombuffer(bytes(rng.randrange(256) for _ in range(200_000)), np.uint8)
    assert exact_dedup.fingerprint(b)[:2] == exact_dedup.fingerprint(b, 777)[:2]
    h1, h2, s1, s2 = exact_dedup.fingerprint(b[:5000])
    t1, t2, u1, u2 = exact_dedup.fingerprint(b[5000:])
    assert exact_dedup.fingerprint(b)[:2] == ((h1 * u1 + t1) % exact_dedup.P1, (h2 * u2 + t2) % exact_dedup.P2)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (9, 1), (11, 1)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    got = by_id(quality.judge(docs, m))
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert got[0]["kept"] and got[9]["kept"]
    assert quality.judge(none, quality.fit(none, labels)).count() == 0
    assert quality.keep_good(docs, m).columns == docs.columns


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", "x"), (1, 200, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, None, "?"), (None, None, "eve", "!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 3), (1, "bob", 0), (1, "bob", 3), (None, "eve", 0), (None, "eve", -1)}
    r = got[1, "bob", 0]
    spans = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",")]
    assert sorted(r["text"][a : a + n] for a, n in spans) == ["<|im_end|>", "x<|im_end|>"] and "user name=ann\nhé" in r["text"] and r["n_trained"] == 21
    assert got[1, "bob", 3]["at"] == len(r["text"])
    assert chat.rotate(df.where("false")).count() == 0


def test_chat_names(spark):
    """A null role is never the assistant, even if a speaker is called unknown, and no text forges a turn."""
    rows = [(1, 0, "unknown", "I am"), (1, 1, None, "nobody"), (1, 2, "a\nb<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nforged")]
    got = {r["speaker"]: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"unknown", "a b< |im_end|>"}
    r = got["unknown"]
    assert r["text"].startswith("<|im_start|>assistant\nI am<|im_end|>\n<|im_start|>user name=unknown\nnobody<|im_end|>\n") and r["n_trained"] == len("I am<|im_end|>")
    assert all(x["text"].count("<|im_start|>") == x["text"].count("<|im_end|>") == 3 for x in got.values())


def test_chat_pieces(spark):
    """A part with many rows is cut, whatever its turn numbers; pieces in order are the dialogue."""
    rows = [(None, None if i % 3 else i % 2, f"s{i % 2}", f"said {i // 4}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r["speaker"]: r for r in chat.rotate(df, per_part=1 << 40, per_piece=1 << 20).where("part = 0").collect()}
    got = sorted(chat.rotate(df, per_part=1 << 40, per_piece=50).collect(), key=lambda r: (r["speaker"], r["part"], r["piece"]))
    assert max(r["n_turns"] for r in got) == 50 and sum(r["n_turns"] for r in got) == 1400
    for s in ("s0", "s1"):
        own = [r for r in got if r["speaker"] == s]
        assert [r["at"] for r in own] == np.cumsum([0, *(len(r["text"]) for r in own)])[:-1].tolist()
        assert "".join(r["text"] for r in own if r["part"] == 0) == whole[s]["text"]
        for r in own:
            assert all(r["text"][a : a + n].endswith("<|im_end|>") for a, n in (map(int, x.split(":")) for x in r["mask"].split(",") if x))


def test_pieces(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(pieces.piece_digests(docs, PIECES))
    full = by_id(pieces.encode_pieces(docs, PIECES))
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert full[i]["ids"] == ids and full[i]["decoded"] == sp.decode(ids)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert pieces.piece_digests(none, PIECES).count() == 0


def test_pieces_at_random():
    sp, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceModel(PIECES, keep=50)
    letters = "aabcdeéſ  \n\t▁thingoer\r漢字𝄞.,'AZ09\u200b\u3000:;|!?"
    for t in ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + [" " * k for k in range(40)]:
        assert m.encode(t) == sp.encode(t) and m.decode(m.encode(t)) == sp.decode(sp.encode(t)), t


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1"), (2, None, "same"), (5, "http://c/", "same"), (3, "http://b/", "same"), (7, "u", None), (8, "u", ""), (8, "u", ""), (None, "n", "q"), (None, "m", "q"), (9, "a", "z1"), (9, "b", "z2")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "record_type": F.lit(3)})
    want = {0: collections.Counter({(2, 5): 1, (3, 5): 1, (7, 8): 1, (8, 8): 1, (None, None): 1}), 4: collections.Counter({(2, 5): 1, (3, 5): 1}), 100: collections.Counter()}
    for least, revisits in want.items():
        warc.write(warc.deduplicated(pages, least), f"{tmp_path}/{least}", "2025-02-03T04:05:06Z", file_bytes=700)
        got = warc.read(spark, f"{tmp_path}/{least}").collect()
        assert sorted((r["page_id"] or 0, r["payload"]) for r in got) == sorted((i or 0, h or "") for i, _, h in rows)
        assert collections.Counter((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == revisits
        assert all(r["payload_bytes"] == len(r["payload"].encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"].encode()).digest()).decode() for r in got)
        assert len({r["record_id"] for r in got}) == len(rows) and {r["refers_to_record"] for r in got if r["refers_to_record"]} <= {r["record_id"] for r in got if r["record_type"] == "response"}
        for file in tmp_path.glob(f"{least}/part-*"):
            members = list(warc.members(file.read_bytes()))
            heads = [warc.parse(m)[0] for m in members[:-1]]
            assert members[-1] == b"" and heads[0]["warc-type"] == "warcinfo" and all(h["warc-date"] == "2025-02-03T04:05:06Z" for h in heads)
            assert gzip.decompress(file.read_bytes()) == b"".join(members)
    warc.write(warc.deduplicated(pages.where("false")), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    """More than 100 MB of pages: no file is much larger than asked for, and all come back."""
    pages = spark.range(0, 110, numPartitions=4).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda k: F.sha2(F.concat_ws("-", "id", k.cast("string")), 256)), "").alias("html"))
    warc.write(warc.deduplicated(pages), f"{tmp_path}/w", file_bytes=8 << 20)
    sizes = [f.stat().st_size for f in tmp_path.glob("w/part-*")]
    assert max(sizes) < 10 << 20 and len(sizes) > 6
    got = warc.read(spark, f"{tmp_path}/w").select("page_id", F.sha2("payload", 256).alias("sha"), "payload_bytes")
    assert got.exceptAll(pages.select("page_id", F.sha2("html", 256), F.length("html").cast("long"))).count() == 0 and got.agg(F.sum("payload_bytes")).first()[0] > 100 << 20


def test_packing(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, *BYTES).orderBy("doc_id", "start", "sequence_id").collect()
    for i, x in enumerate(TEXTS):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids) * (2 if i == 9 else 1)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack(none, *BYTES).count() == 0
    assert sum(packing.cuts(5000, 1024, 64)) == 5000


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    ids, links, root = sorted(sets), collections.Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.update((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def test_near(spark, docs, none, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(300):  # a chain of changes, and a passage that all share
        w = BASE.split()
        w[(7 * i) % 120] = f"w{i % 40}"
        rows.append((1000 + i, " ".join(w)))
        rows.append((2000 + i, BASE + " " + text(300)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for small, block in ((64, 512), (4, 50)):  # also with many splits, leaders and blocks
        monkeypatch.setattr(near, "SMALL", small)
        monkeypatch.setattr(near, "BLOCK", block)
        got = by_id(near.jaccard_join(df))
        assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == want
    assert near.jaccard_join(none).count() == 0 and near.jaccard_join(docs).count() == len(TEXTS) + 1


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {500: 400}


def test_sample_is_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("b"))
    a, b = (bounded_sample(d, "k", 50, F.col("b")) for d in (df.repartition(7), df.coalesce(1)))
    assert [r["k"] for r in a] == [r["k"] for r in b] and len(a) == 100


def test_exact_rows(spark):
    """Null ids, an id with several texts, and repeated rows: each row is returned, one of each group is kept."""
    rows = [(None, "a b"), (1, "ab"), (5, "x"), (5, "y"), (7, "z"), (8, "x "), (9, "w"), (9, "w"), (None, "n"), (None, "n "), (None, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == collections.Counter([(None, None, 2, True), (1, None, 2, False), (5, 8, 2, False), (8, 8, 2, True), (5, 5, 1, True), (7, 7, 1, True), (9, 9, 2, True), (9, 9, 2, False), (None, None, 2, True), (None, None, 2, False), (3, 3, 2, True), (None, 3, 2, False)])
    left = sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.deduplicated(df).where("text <> ''").collect())
    assert left == [(0, "a b"), (0, "n "), (5, "y"), (7, "z"), (8, "x "), (9, "w")] and exact_dedup.deduplicated(df).count() == 7
    assert corpus_pipeline.exact_copies(spark, spark.createDataFrame([(1, "x"), (5, "x"), (5, "y"), (7, "z")], "doc_id long, text string"), D).count() == 3


def test_exact_collisions(spark, monkeypatch):
    """Texts with equal fingerprints that differ are told apart by the comparison."""
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, *_: docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.length("text").cast("long").alias("n_cp"), F.lit(3).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"), F.sha2("text", 256).alias("text_sha256")))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aaa", "bbb", "aaa", "ccc", "bbb", "aaa"])], "doc_id long, text string")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()} == {0: (0, 3), 1: (1, 2), 2: (0, 3), 3: (3, 1), 4: (1, 2), 5: (0, 3)}


def test_near_rows(spark):
    """Null ids and repeated rows: one of each class stays, and another text under the same id is another row."""
    other, third = text(80), text(90)
    rows = [(None, BASE), (4, BASE + " more"), (4, other), (4, other), (6, other + " x"), (None, third), (None, third), (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("?"))
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in near.jaccard_join(df).collect())
    assert got == collections.Counter([(None, 4, 1, False), (4, 4, 1, True), (4, 4, 2, True), (4, 4, 2, False), (6, 4, 2, False), (None, None, 1, True), (None, None, 1, False), (11, 11, 0, True), (11, 11, 0, True)])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.deduplicated(df).collect()) == sorted([(4, BASE + " more"), (4, other), (0, third), (11, ""), (11, "")])


def test_near_hot_group_with_outliers(spark):
    """A core of near copies and, linked to some of them only, texts that are further from the core's leaders."""
    rows, words = [], text(200).split()
    for i in range(400):
        w = list(words)
        for k in rng.sample(range(200), 1 if i < 300 else 4):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    got = by_id(near.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == brute(rows)


def test_near_recall(spark):
    """All links of the documents at sf0.01, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got, want = by_id(near.jaccard_join(docs)), brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    links = sum(n for _, n in want.values())
    assert sum(min(got[i]["n_links"], n) for i, (_, n) in want.items()) >= 0.999 * links > 0
    assert all(got[i]["n_links"] <= n for i, (_, n) in want.items())


def test_url_verdicts_by_hand(spark):
    """Verdicts without a rule follow from the definition of the models, whatever the limit is."""
    yes, no = ["http://a.org/docs/1", "http://b.org/docs/22"], ["http://x.com/de/spam", "http://y.com/de/win?q=1"]

    def p(texts, context, c, size):
        counts = collections.Counter(t[k + len(context)] for t in texts for k in range(len(t) - len(context)) if t[k : k + len(context)] == context and k + len(context) > 0)
        shorter = p(texts, context[1:], c, size) if context else 1 / size
        n = sum(counts.values())
        return (counts[c] + len(counts) * shorter) / (n + len(counts)) if n else shorter

    size = len(set("".join(yes + no))) + 2
    m = urls.UrlModel(tuple(yes), tuple(no), 0.05)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://new.net/docs/3", "http://z.net/spam?q", "", "ftp://q", None])], "page_id long, url string")
    for r in urls.judge(pages, RULES, m).join(pages, "page_id").collect():
        t, want = "\x02" + (r["url"] or "") + "\x03", 0.0
        for k in range(1, len(t)):
            a, b = (p(["\x02" + x + "\x03" for x in xs], t[max(0, k - urls.ORDER) : k], t[k], size) for xs in (yes, no))
            want += math.log(a) - math.log(b)
        want /= len(t) - 1
        assert r["difference"] == pytest.approx(want) and r["verdict"] == ("allow" if want >= 0.05 else "block")


def test_url_limit_by_hand(spark):
    """The limit has the fewest errors on the URLs held for calibration."""
    rows = [(i, f"https://a{i}.good.org/{'docs' if i % 3 else 'spam'}/p{i}") for i in range(80)] + [(100 + i, f"https://b{i}.com/de/{'spam' if i % 5 else 'docs'}{i}") for i in range(60)]
    m = urls.fit(spark.createDataFrame(rows, "page_id long, url string"), RULES)
    by = {"allow": sorted(u for i, u in rows if i < 80), "block": sorted(u for i, u in rows if i >= 100)}
    held = {v: [m.difference(x) for i, x in enumerate(xs) if not i % urls.CALIBRATED] for v, xs in by.items()}
    errors = lambda limit: sum(x < limit for x in held["allow"]) / len(held["allow"]) + sum(x >= limit for x in held["block"]) / len(held["block"])
    every = sorted(held["allow"] + held["block"])
    assert errors(m.limit) == pytest.approx(min(map(errors, [every[0] - 1, *((a + b) / 2 for a, b in zip(every, every[1:], strict=False)), every[-1] + 1])))


def test_quality_by_hand(spark):
    """Ratio, limit, symbols and verdicts by counting the n-grams of each text."""
    good = [text(80) for _ in range(9)]
    bad = [" ".join(rng.choices(["zig", "zag", "#*", "$$", "qq&", "<b>", *VOCABULARY[:40]], k=80)) for _ in range(12)]
    rows = [*enumerate(good + bad), (None, bad[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int"))
    sample = [r["doc_id"] for r in bounded_sample(spark.range(9).select(F.col("id").alias("doc_id")), "doc_id", quality.TRUSTED)]
    apart = set(sample[:: quality.CALIBRATED])
    arrow = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))

    def buckets(t):
        w = WORD.findall(t)
        one = lambda x, k: quality._buckets(quality.Words(*arrow(x)))[0][k]
        return [one(x, 0) for x in w] + [one(f"{a} {b}", 2) for a, b in zip(w, w[1:], strict=False)]

    grams = {i: buckets(t) for i, t in enumerate(good + bad)}
    raw = collections.Counter(b for _, t in rows for b in (grams[(good + bad).index(t)]))
    target = collections.Counter(b for i in range(9) if i not in apart for b in grams[i])
    size = quality.SMOOTHING * quality.BUCKETS
    ratio = lambda b: math.log((target[b] + quality.SMOOTHING) / (sum(target.values()) + size)) - math.log((raw[b] + quality.SMOOTHING) / (sum(raw.values()) + size))
    score = {i: sum(map(ratio, g)) / len(g) for i, g in grams.items()}
    assert m.limit == pytest.approx(min(score[i] for i in apart) - quality.MARGIN, abs=1e-4)
    for r in quality.judge(docs, m).where("doc_id is not null").collect():
        i = r["doc_id"]
        assert r["score"] == pytest.approx(score[i], abs=1e-4) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", (good + bad)[i]))
        assert r["kept"] == (not r["base_failed"] and score[i] >= m.limit)


def test_packing_classes(spark):
    """Pieces tile their documents, bins of class j hold j pieces, and little is padded."""
    docs = spark.read.parquet(f"{D}/documents.parquet").repartition(3)
    packed = packing.pack(docs, *BYTES).cache()
    rows = packed.collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        bins[r["sequence_id"]].append(r)
    for pieces_ in by.values():
        pieces_.sort()
        assert [s for s, *_ in pieces_] == np.cumsum([0, *(n for _, n, _ in pieces_)])[:-1].tolist() and sum(n for _, n, _ in pieces_) == pieces_[0][2]
    full = sum(len({1024 // r["length"] for r in b}) == 1 and len(b) == 1024 // b[0]["length"] for b in bins.values())
    assert full > 0.5 * len(bins)  # harmonic bins; the others are what tasks had left, end to end
    pad = packing.padding(packed).first()
    want = sum(0 if n & (n - 1) == 0 else 1024 - n for n in (sum(r["length"] for r in b) for b in bins.values()))
    assert (pad["n_sequences"], pad["n_padding"]) == (len(bins), want) and want < 0.02 * pad["n_ids"]


def test_other_columns_and_long_texts(spark, none):
    """Columns with the names of results, and texts of a megabyte, change nothing."""
    long = text(150_000)
    docs = spark.createDataFrame([(1, "ab " + long), (2, "MIT License " + licenses.MIT), (3, None)], "doc_id long, text string").withColumns({c: F.lit("?") for c in ("n_chars", "digest", "license_id", "n_tokens", "ids_sha256", "decoded_sha256", "start", "length", "sequence_id", "root", "node", "text_key", "h1")})
    assert [by_id(licenses.scan(docs))[i]["license_id"] for i in (1, 2, 3)] == [None, "MIT", None]
    assert by_id(pieces.piece_digests(docs, PIECES))[1]["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("ab " + long))
    assert packing.pack(docs, *BYTES).where("doc_id = 1").agg(F.sum("length")).first()[0] == len(Tokenizer.from_file(BYTES[0]).encode("ab " + long, add_special_tokens=False).ids) + 1
    assert near.jaccard_join(docs).count() == exact_dedup.exact_dedup(docs).count() == 3
    pages = spark.createDataFrame([(1, "http://org/" + "x" * 100_000)], "page_id long, url string").withColumns({c: F.lit("?") for c in ("host", "path", "rule", "verdict", "difference")})
    assert urls.judge(pages, RULES, urls.UrlModel((), ())).first()["verdict"] == "allow"
    turns = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "x")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("?") for c in ("part", "piece", "at", "own", "speaker")})
    assert all(len(r["text"]) > len(long) for r in chat.rotate(turns).collect())


def test_models_of_another_kind(tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "MARK", "_")
    with pytest.raises(ValueError, match="no merge-type model"):
        pieces.PieceModel(PIECES)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, D).collect(), docs.schema)
        assert at.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    quality_kept = {r["doc_id"] for r in QUERIES["op5_quality_rules"](spark, D).where("kept").collect()}
    assert set(kept["quality rules"]) == quality_kept
    m = language.fit(spark.createDataFrame([r for r in docs.collect() if r["doc_id"] in quality_kept], docs.schema), ~language.held_out())
    in_some = {r["doc_id"] for r in language.identify(docs, m).where("known").collect()}
    known = {i: t for i, t in kept["quality rules"].items() if i in in_some}
    assert kept["language ID"] == known
    groups = collections.defaultdict(list)
    for i, t in known.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    exact = {min(g)[1] for g in groups.values()}
    assert set(kept["exact dedup"]) == exact
    classes = brute([(i, known[i]) for i in exact])
    assert set(kept["n-gram Jaccard join"]) == {c for c, _ in classes.values()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, D).collect()} == set(kept["n-gram Jaccard join"])
    labels = spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()
    texts = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    long = [r["doc_id"] for r in labels if texts.get(r["doc_id"], 0) >= 50]
    assert sum(i in kept["language ID"] for i in long) >= 0.97 * len(long)
