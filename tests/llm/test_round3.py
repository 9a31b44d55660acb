"""Block products, radix-sorted windows and partial distances against brute force: nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import centroids, negatives, repeats
from factloom.llm.queries import ORACLE_SQL, QUERIES

rng = random.Random(11)
D = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# --- windows


def brute_windows(docs, width):
    """doc_id and text to (n_bytes, n_removed, n_spans, sha256), by a table of all windows; docs in order."""
    seen, out = set(), []
    for key, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        out.append((key, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def noisy(n, letters="abc déf漢\n"):
    return "".join(rng.choices(letters, k=n))


def corpus():
    passage, base = noisy(80), noisy(400)
    docs = [base, base, noisy(50) + passage + noisy(40), passage, passage[:60] + noisy(30), passage + passage, None, "", "short", "x" * 300, "y" + "x" * 200, noisy(3) * 60, base[:200] + "!" + base[200:], base[100:] + base[:100]]
    docs += [noisy(rng.randint(0, 40)) + passage[rng.randint(0, 20) :] + noisy(rng.randint(0, 40)) for _ in range(60)]
    return list(enumerate(docs))


@pytest.mark.parametrize(("width", "gram", "group", "stretch"), [(20, 7, 20_000, 1 << 16), (20, 8, 3, 64), (33, 32, 1, 50), (9, 3, 5, 1000), (12, 1, 4, 200)])
def test_repeats_by_hand(spark, monkeypatch, width, gram, group, stretch):
    monkeypatch.setattr(repeats, "HOT", 1 << 40)  # so that `group` alone decides what is dealt further
    docs = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, h string, spans int").repartition(5)
    assert rows_of(repeats.without_repeats(df, width, gram, group, stretch)) == sorted(map(str, brute_windows(docs, width)))


def test_repeats_of_odd_rows(spark):
    """The same row twice is one document that occurs twice; a null id comes last; ids may be text."""
    t, u = noisy(300), noisy(200)
    docs = [("a", t), ("a", t), ("b", t + u), (None, u), ("c", None), (None, None)]
    got = repeats.without_repeats(spark.createDataFrame(docs, "doc_id string, text string"), 20, 7)
    assert rows_of(got) == sorted(map(str, [brute_windows(docs[:1], 20)[0]] * 2 + brute_windows([docs[0], *docs[2:]], 20)[1:]))
    none = repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_units_cover_every_window_and_follow_content():
    data = np.frombuffer("".join(rng.choices("abcd ", k=5000)).encode(), np.uint8)
    off = np.array([0, 1000, 1000, 1050, 5000])
    for stretch in (1 << 16, 333):
        found = [u for part in repeats.units(data, off, 100, 32, stretch, True) for u in zip(*(part[k].tolist() for k in ("row", "start", "n", "lead", "h", "u1", "u2")), strict=True)]
        windows = sorted((r, s) for r, a, n, *_ in found for s in range(a, a + n - 99))
        assert windows == [(r, s) for r, (a, b) in enumerate(zip(off, off[1:], strict=False)) for s in range(b - a - 99)]
        if stretch == 1 << 16:
            whole = found
    assert sorted(found) == sorted(whole)  # stretches make no difference
    twice = [u for part in repeats.units(np.concatenate([data[:700], data[:700]]), np.array([0, 700, 1400]), prints=True) for u in zip(*(part[k].tolist() for k in ("row", "start", "n", "h", "u1", "u2")), strict=True)]
    assert [u[1:] for u in twice if not u[0]] == [u[1:] for u in twice if u[0]]


def test_equal_windows_by_hand():
    data = np.frombuffer(bytes(rng.choices(b"ab", k=400)) + bytes(8), np.uint8)
    at = np.arange(0, 380)
    group = at % 3
    for width in (8, 11, 16, 20):
        alive, cls = repeats.equal_windows(group, data, at, width)
        got = {}
        for i, c in zip(alive.tolist(), cls.tolist(), strict=True):
            got.setdefault(c, []).append(i)
        want = {}
        for i in at.tolist():
            want.setdefault((group[i], data[i : i + width].tobytes()), []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(x for x in want.values() if len(x) > 1)


# --- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives_=3):
    e = [(i, k, label, [math.floor(256 * float(x)) for x in v]) for k, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, k, label, v in e:
        if i is None or i % every:
            continue
        s = [(j, sum(a * b for a, b in zip(v, w, strict=False)), other == label) for j, m, other, w in e if m != k]
        for p in sorted((x for x in s if x[2]), key=order)[:positives]:
            fit = sorted((x for x in s if not x[2] and 50 * p[1] <= 100 * x[1] <= 95 * p[1]), key=order)[:negatives_]
            out += [(i, p[0], r + 1, n[0], p[1], n[1]) for r, n in enumerate(fit)]
    return sorted(map(str, out))


def vectors(n, dims=10, labels=4, ties=True):
    pick = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(n // 3 if ties else n)]
    return [(i, rng.randrange(labels), rng.choice(pick)) for i in range(n)]


@pytest.mark.parametrize(("anchors", "block", "chunk"), [(256, 2048, 32), (3, 7, 4), (1, 1000, 1), (5, 5, 100)])
def test_negatives_by_hand(spark, anchors, block, chunk):
    rows = vectors(130) + [(7, None, [1.0] * 10), (50, 1, None), (100, 1, [None] * 10), (50, 2, [float("nan")] * 10), (100, 2, [float("inf")] * 10), (None, 1, [0.5] * 10), (100, 3, [0.25] * 10), (100, 3, [0.25] * 10), (50, 1, [0.5] * 3), (0, 2, [])]
    df = spark.createDataFrame([(i, label, v, 1, 2.0) for i, label, v in rows], "vec_id long, label int, embedding array<double>, uid int, score double").repartition(3)
    got = negatives.mine(df, every=10, anchors=anchors, block=block, chunk=chunk)
    want = brute_negatives(rows, 10)
    assert rows_of(got) == want and len(want) > 30


def test_negatives_edges(spark):
    kind = "vec_id long, label long, embedding array<double>"
    assert negatives.mine(spark.createDataFrame([], kind)).count() == 0
    hot = [(i, 0 if i % 3 else 1, [1.0 + (i % 5) / 10, 0.5]) for i in range(120)]  # most rows of one label, many ties
    assert rows_of(negatives.mine(spark.createDataFrame(hot, kind), anchors=2, block=9)) == brute_negatives(hot)
    large = [(0, 1, [60_000.0, 1.0]), (1, 1, [50_000.0, -3.0]), (2, 2, [40_000.0, 9.0])]  # scores beyond what doubles hold
    got = negatives.mine(spark.createDataFrame(large, kind)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256 * (3_000_000_000 - 3), 256 * 256 * (2_400_000_000 + 9))]


# --- centroids


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            if own := [v for (_, v), x in zip(kept, at, strict=True) if x == n]:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    by = {n: sum(d for _, d, m in found if m == n) for n in range(len(c))}
    return sorted(str((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())) for i, d, n in found)


def test_clusters_by_hand(spark):
    pick = [[rng.gauss(0, 1 + j / 9) for j in range(64)] for _ in range(40)]
    rows = [(i, rng.choice(pick)) for i in range(200)] + [(3, None), (4, [1.0] * 63), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64), (7, [float("inf")] * 64), (8, []), (None, [0.5] * 64), (9, [0.0] * 64), (9, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    assert rows_of(centroids.cluster(df)) == brute_clusters(rows)
    few = rows[:5]
    assert rows_of(centroids.cluster(df.where("vec_id < 5 and embedding is not null").limit(0))) == []
    assert rows_of(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == brute_clusters(few)


def test_partial_distances_are_whole_ones_for_survivors():
    x, c = (np.array([[rng.randrange(-9, 9) for _ in range(20)] for _ in range(n)], np.int64) for n in (300, 12))
    c[7] = c[2]  # equal centroids: the smaller number
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    for step in (1, 6, 20):
        at, d = centroids.nearest(x, c, np.argsort(-x.var(0)), step)
        assert (at == full.argmin(1)).all() and (d == full.min(1)).all()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_suffix_dedup", "op13_centroid_clustering"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(want.columns) == cols
    assert rows_of(df.select(*cols)) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_null_id_and_text_in_sql_columns(spark):
    """Counts of what takes no part are zero, not missing."""
    got = repeats.without_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [tuple(r)[1:4] for r in got] == [(0, 0, 0)] * 2 and {r["kept_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert repeats.without_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))).count() == 0
