"""Repeated windows of bytes by a depth-limited radix sort (operator 12).

Every run of `width` bytes of a text is a window, and suffixes are ordered through their first `width` bytes only. The sort goes by
most significant digits, and a group that is down to one suffix is never looked at again.

The first digit is content-defined: of the grams of GRAM bytes in a window, the one with the least hash (the leftmost of equals)
is its anchor. Equal windows have equal anchors at the same place, so windows are dealt by their anchor's hash. Windows in a row with one anchor are
a unit, about one for 32 bytes of text; units stand for their windows until they have to be told apart:

1. Hashes of anchors are counted. Most occur once; units with others go on, through a filter of hashes of bounded size, and the few
   false ones it lets pass are groups of one in the next step.
2. Units with the same anchor meet. Of equal ones (two fingerprints of 64 bits and the length) the first in the order stays and the others
   are repeats as a whole. Groups with more than `group` units are dealt further by fingerprint and salt.
3. Where different units share an anchor, their windows are sorted on their bytes: a digit is the anchor's place, then eight bytes
   at a time up to `width`; what is equal then are exactly the repeated windows. Groups above `group` are dealt by the whole window, in Spark.

Repeats of a document meet its text at the end, which is the one time that texts are shuffled (not those without repeats).

Earlier means a smaller id, then a smaller start. Rows with the same id are ordered by a hash of their texts; rows with the same id and text are one document
that occurs twice: each gives the same row. A null id comes last. Null texts count as empty. Texts shorter than a window have no repeats. Very long
texts are cut into overlapping stretches, whose units are those of the whole. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import store
from factloom.llm.store import filtered, join_groups, row_hash, table, text_key
from factloom.llm.words import mix, slices

WIDTH, GRAM = 100, 32
STRETCH = 1 << 16  # window starts worked on at once; a place in a stretch has to fit 20 bits
GROUP = 20_000  # units with one anchor that one task sorts
HOT = 1 << 16  # groups beyond that and above a HOT-th of all units are dealt further: there can't be more of them than that
_PLACE = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(12)
_BYTE = _rng.integers(1, 1 << 63, (3, 256), dtype=np.uint64) | np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list = []


def _powers(n: int) -> list:
    """(powers of the base, powers of its inverse modulo 2^64) for both fingerprints, at least n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS.clear()
        for base in _BASE:
            both = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            _POWERS.append(tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(x)[:-1]]) for x in both))
    return _POWERS


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram from each byte on, place of the anchor of the window from each byte on)."""
    h, k = _BYTE[2][data], 1
    for bit in bin(gram)[3:]:  # grams of twice as many bytes, and one more where the bit is set
        h = h[:-k] * np.uint64(_BASE[0] + 2 * k) + h[k:] if k < len(h) else h[:0]
        k *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(_BASE[1] + 2 * k) + _BYTE[2][data[k:]][: max(len(h) - 1, 0)]
            k += 1
    h = mix(h)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    n, w = width - gram + 1, 1
    while 2 * w <= n:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < n:
        m = np.minimum(m[: len(m) - (n - w)], m[n - w :])
    return h, (m & _PLACE).astype(np.int64)


def units(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM, stretch: int = STRETCH, prints: bool = False) -> Iterator[dict[str, np.ndarray]]:
    """The units of the rows of a slice: row, start (in the row), n (bytes), lead (bytes before the anchor), h, at (in data); u1 and u2 with prints."""
    starts, reach = len(data) - width + 1, width - gram
    for x in range(0, max(starts, 0), stretch):
        lo, hi = max(0, x - reach - 1), min(starts, x + stretch + reach + 1)
        part = data[lo : hi + width - 1]
        h, place = anchors(part, width, gram)
        at = np.arange(lo, hi)
        row = np.searchsorted(off, at, "right") - 1
        inside = at + width <= off[row + 1]
        key = np.where(inside, place, -1)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(cut[1:], len(key)) - 1 + width
        own = (key[cut] >= 0) & (at[cut] >= x) & (at[cut] < x + stretch)
        cut, end = cut[own], end[own]
        out = {"row": row[cut], "start": at[cut] - off[row[cut]], "n": end - cut, "lead": key[cut] - cut, "h": h[key[cut]].view(np.int64), "at": at[cut]}
        if prints:
            for name, byte, (power, inverse) in zip(("u1", "u2"), _BYTE, _powers(len(part) + 1), strict=False):
                s = np.concatenate([[np.uint64(0)], np.cumsum(byte[part] * power[: len(part)])])
                out[name] = mix((s[end] - s[cut]) * inverse[cut]).view(np.int64)
        yield out


def _has(words: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    slot = h.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _anchor_counts(width: int, gram: int, stretch: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                for u in units(data, off, width, gram, stretch):
                    h, n = np.unique(u["h"], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return work


def _units(words, width: int, gram: int, stretch: int):
    """Units that may be repeated; of units that are the same in one stretch of a document the first, with the starts of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in slices(batch.column("text")):
                for u in units(data, off, width, gram, stretch, True):
                    u = {k: v[x] for x in [np.flatnonzero(_has(words.value, u["h"]))] for k, v in u.items()}
                    order = np.lexsort((u["start"], u["n"], u["u2"], u["u1"], u["row"]))
                    u = {k: v[order] for k, v in u.items()}
                    new = np.ones(len(order), bool)
                    new[1:] = (u["row"][1:] != u["row"][:-1]) | (u["u1"][1:] != u["u1"][:-1]) | (u["u2"][1:] != u["u2"][:-1]) | (u["n"][1:] != u["n"][:-1])
                    first = np.flatnonzero(new)
                    rest = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(new))) - 1)])
                    more = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(u["start"][~new], pa.int64()))
                    who = pa.array(u["row"][first] + i)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_key").take(who), *(pa.array(u[k][first]) for k in ("h", "u1", "u2", "start")), pa.array(u["n"][first], pa.int32()), more], names=["doc_id", "text_key", "h", "u1", "u2", "start", "n", "more"])

    return work


def _with_bytes(words, width: int, gram: int, stretch: int):
    """Units with an anchor that different units share, with their bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in slices(batch.column("text")):
                raw = data.tobytes()
                for u in units(data, off, width, gram, stretch):
                    pick = np.flatnonzero(_has(words.value, u["h"]))
                    who = pa.array(u["row"][pick] + i)
                    text = pa.array([raw[a : a + n] for a, n in zip(u["at"][pick].tolist(), u["n"][pick].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_key").take(who), *(pa.array(u[k][pick]) for k in ("h", "start")), pa.array(u["lead"][pick], pa.int32()), text], names=["doc_id", "text_key", "h", "start", "lead", "bytes"])

    return work


def equal_windows(group: np.ndarray, data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, number of its class) of the windows, given by their group and start in data, that equal another of their group.

    By most significant digits of eight bytes: after each, classes are split, and those down to one window are dropped.
    """
    alive, group = np.arange(len(at)), np.asarray(group)
    digits = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    for depth in range(0, width, 8):
        if depth + 8 <= width:
            digit = np.ascontiguousarray(digits[at[alive] + depth]).view(">u8")[:, 0].astype(np.uint64)
        else:
            digit = np.zeros(len(alive), np.uint64)
            for b in range(depth, width):
                digit = digit << np.uint64(8) | data[at[alive] + b]
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        alive, group = alive[several], group[several]
        if not len(alive):
            break
    return alive, group


def _runs(order: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, bytes) of runs of windows that follow each other, sorted by owner and start."""
    if not len(order):
        return order, start, start
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] != order[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return order[first], start[first], start[last] - start[first] + width


def _later(width: int):
    """Repeated windows of units that share an anchor; input is sorted by anchor, then by the documents' order."""

    def settle(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        doc = t.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        same = np.stack([doc, *(t.column(k).to_numpy() for k in ("h", "text_key", "start"))])
        t = t.take(pa.array(np.flatnonzero(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(0)]))))  # documents that occur twice are one
        raw = [x.as_py() for x in t.column("bytes")]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        h, lead, start = (t.column(k).to_numpy() for k in ("h", "lead", "start"))
        n = np.diff(off) - width + 1
        unit = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        alive, cls = equal_windows(code[unit] * (width + 1) + lead[unit] - step, data, off[unit] + step, width)
        # of each class all but the first: units are in the documents' order, and in a document windows are in that of their starts
        order = np.lexsort((alive, cls))
        alive, cls = alive[order], cls[order]
        later = np.zeros(len(alive), bool)
        later[1:] = cls[1:] == cls[:-1]
        alive = np.sort(alive[later])
        who, a, size = _runs(unit[alive], start[unit[alive]] + step[alive], width)
        return pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(pa.array(who)) for k in ("doc_id", "text_key")), pa.array(a, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "text_key", "start", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column("h").to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            if len(cut):  # anchors before the last one are whole
                yield settle([*held, batch.slice(0, int(cut[-1]))])
                held = [batch.slice(int(cut[-1]))]
            elif len(h) and held and held[-1].column("h")[0].as_py() != h[0]:
                yield settle(held)
                held = [batch]
            elif len(h):
                held.append(batch)
        if held:
            yield settle(held)

    return work


def _windows(width: int):
    """Every window of units, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw, lead, start = (batch.column(k)[r].as_py() for k in ("bytes", "lead", "start"))
                n = len(raw) - width + 1
                who = pa.array([r] * n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_key").take(who), pa.array(range(start, start + n), pa.int64()), pa.array(range(lead, lead - n, -1), pa.int32()), pa.array([raw[i : i + width] for i in range(n)], pa.binary())], names=["doc_id", "text_key", "start", "lead", "window"])

    return work


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans, which may overlap."""
    for batch in batches:
        size, gone, n_spans, sha = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw, kept, at, end, runs = memoryview(text.as_buffer()), hashlib.sha256(), 0, 0, 0
            own = spans.values
            a, n = (own.field(k).to_numpy() for k in ("start", "n")) if own is not None else (np.zeros(0, np.int64),) * 2
            order = np.argsort(a, kind="stable")
            removed = 0
            for s, e in zip(a[order].tolist(), (a + n)[order].tolist(), strict=True):
                if s > end or not runs:
                    runs += 1
                    kept.update(raw[at:s])
                    removed -= s
                    removed += e
                    at = end = e
                elif e > end:
                    removed += e - end
                    at = end = e
            kept.update(raw[at:])
            size.append(len(raw))
            gone.append(removed)
            n_spans.append(runs)
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, n_spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _words(df: DataFrame, h: str):
    """A broadcast filter of the hashes: WORDS words of 64 bits at most, whatever the input."""
    slot = F.pmod(F.col(h), F.lit(store.WORDS * 64))
    rows = df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({h}, {store.WORDS * 64}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(store.WORDS, np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(words)


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, stretch: int = STRETCH) -> DataFrame:
    """doc_id, text_key, start, n: bytes that repeat earlier ones; spans may overlap. docs: doc_id, text_key, text (not null)."""
    texts = docs.where(F.octet_length("text") >= width)
    who = docs.select("doc_id").schema.simpleString()[7:-1] + ", text_key long"
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "start")
    counts = texts.select("text").mapInArrow(_anchor_counts(width, gram, stretch), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = table(counts.where("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > max(group, total // HOT)).select("h", F.ceil(F.col("n") / group).alias("salts")))
    found = texts.mapInArrow(_units(_words(counts, "h"), width, gram, stretch), f"{who}, h long, u1 long, u2 long, start long, n int, more array<long>")
    found = found.join(hot, "h", "left").withColumn("x", F.when(F.col("salts").isNull(), 0).otherwise(F.xxhash64("u1", "u2", F.pmod(F.xxhash64("doc_id", "text_key"), "salts"))))
    met = Window.partitionBy("h", "x")
    same = Window.partitionBy("h", "x", "u1", "u2", "n").orderBy(F.col("doc_id").asc_nulls_last(), "text_key", "start")
    kind = F.struct("u1", "u2", "n")
    found = found.withColumn("mixed", F.min(kind).over(met) != F.max(kind).over(met)).withColumn("first", F.rank().over(same) == 1)  # rows with the same id and text tie
    salted = F.col("salts").isNotNull()
    held = table(found.where(salted | ~F.col("first") | F.col("mixed") | (F.size("more") > 0)).select("doc_id", "text_key", "h", "start", "n", "more", "mixed", "first", F.when(salted & F.col("first"), kind).alias("unit")), "units")
    # the first units of salted groups meet once more: a few for each
    top = held.where("unit is not null").groupBy("h", "unit").agg(F.min(place).alias("_first"))
    top = table(top, "tops")
    several = F.broadcast(top.groupBy("h").agg((F.count("*") > 1).alias("_mixed")))
    again = held.where("unit is not null").join(top, ["h", "unit"]).join(several, "h").withColumn("first", place.eqNullSafe(F.col("_first"))).withColumn("mixed", F.col("_mixed")).select("doc_id", "text_key", "h", "start", "n", "more", "mixed", "first")
    held = held.where("unit is null").drop("unit").unionByName(again)
    out = held.select("doc_id", "text_key", F.explode(F.when(F.col("first"), F.col("more")).otherwise(F.concat(F.array("start"), "more"))).alias("start"), F.col("n").cast("long").alias("n"))
    # windows of different units with one anchor
    mixed = table(held.where("first and mixed").select("h", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("start").alias("_start")).distinct(), "mixed")
    sizes = mixed.groupBy("h").agg(F.count("*").alias("m"))
    large = F.broadcast(table(sizes.where(F.col("m") > max(group, total // HOT)).select("h", F.lit(True).alias("large")), "large"))
    raw = texts.mapInArrow(_with_bytes(_words(mixed, "h"), width, gram, stretch), f"{who}, h long, start long, lead int, bytes binary")
    parts = raw.join(mixed.hint("merge"), (F.col("text_key") == F.col("_key")) & (F.col("start") == F.col("_start")) & F.col("doc_id").eqNullSafe(F.col("_id"))).where(raw["h"] == mixed["h"])
    parts = table(parts.select("doc_id", "text_key", raw["h"].alias("h"), "start", "lead", "bytes").join(large, "h", "left"), "parts")
    small = parts.where("large is null").drop("large").repartition("h").sortWithinPartitions("h", F.col("doc_id").asc_nulls_last(), "text_key", "start")
    out = out.unionByName(small.mapInArrow(_later(width), f"{who}, start long, n long"))
    if parts.where("large").isEmpty():
        return out
    each = table(parts.where("large").mapInArrow(_windows(width), f"{who}, start long, lead int, window binary"), "windows")
    firsts = table(each.groupBy("lead", "window").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1"), "firsts")
    later = join_groups(each, firsts, ["lead", "window"], "_n").where(~place.eqNullSafe(F.col("_first")))
    return out.unionByName(later.select("doc_id", "text_key", "start", F.lit(width).cast("long").alias("n")))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.select("doc_id").schema.simpleString()[7:-1]
    by = spans(src, width, gram, group, stretch).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    by = table(by, "spans")
    maybe, others = filtered(src, row_hash(F.col("doc_id"), F.col("text_key")), by, row_hash(F.col("_id"), F.col("_key")))
    met = maybe.join(by.hint("merge"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "spans")
    zero = F.lit(0).cast("long")
    whole = others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return whole.unionByName(met.mapInArrow(_removed, f"{kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
b AS (SELECT doc_id, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: substr(h, 2 * i + 1, {2 * WIDTH}))) AS x FROM d),
w AS (SELECT doc_id, i, substr(x, 1, 2) AS x, length(x) = {2 * WIDTH} AND row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS later FROM b),
g AS (SELECT doc_id, i, x, coalesce(i - max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < {WIDTH}, false) AS gone FROM w),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
