"""Quality rules by hashed n-gram log-likelihood ratio (operator 5).

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are counted: of the trusted target (all
rows labelled good) and of the raw corpus (all rows, those without an id too). A text's score is the mean
over its n-grams of log p(target) - log p(raw). Every row is judged by the same thresholds: base rules (few words, many
repeated ones), and a score under the limit. The limit is set from the scores of trusted rows that the target was not counted
from (one of CALIBRATED) and lies below all but a fixed share of them.

Counts are gathered as one vector for each task and summed by bucket, where the texts lie: of all rows that a filter of the trusted ids
lets through, less those of the rows that it should have held back, whose texts alone are shuffled. Scores are shuffled without their texts. What reaches the
driver is a table of BUCKETS rows. Null texts count as empty: no words, base rule failed, not
kept. Repeated rows are judged alike. Without trusted rows, the base rules alone decide. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import filtered, table
from factloom.llm.words import Words, slices

BUCKETS = 1 << 16
TRUSTED = 10_000  # a size of trusted rows for tests: all are learned from, however many
PARTS = 1 << 12  # ranges of hashes
CALIBRATED = 4  # one of so many of them sets the limit
SMOOTHING = 0.5  # added to each bucket's count
REJECTED = 0.001  # share of the trusted rows apart under the limit, before the margin
MARGIN = 0.15  # nats an n-gram below that
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[list(b"#*$%&|<>")] = 1
BLANK = b" \t\r\x0b\x0c"


@dataclass(frozen=True)
class QualityModel:
    ratio: bytes  # float32 by bucket
    limit: float


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and each pair of words."""
    row = w.rows()
    pair, inside = w.grams(2)
    shift = np.uint64(64 - 16)
    return np.concatenate([w.hash >> shift, pair[inside] >> shift]).astype(np.int64), np.concatenate([row, row[: len(pair)][inside]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for *_, data, off in slices(batch.column("text")):
            n += np.bincount(_buckets(Words(data, off))[0], minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])


def _totals(texts: DataFrame) -> np.ndarray:
    """Count of each bucket in all texts."""
    out = np.zeros(BUCKETS)
    for r in texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] += r["n"]
    return out


def _maybe(src: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that may have one of some ids, where they lie: all that have, and few others."""
    return filtered(src, F.xxhash64("doc_id"), ids, F.xxhash64("doc_id"))[0]


def _target(src: DataFrame, ids: DataFrame) -> np.ndarray:
    """Count of each bucket in the rows of some ids (one row each, a written table).

    Rows that may be theirs are counted where they lie, and what isn't theirs is taken off again. Ids alone tell which those are; only their
    texts are shuffled. Where the filter holds so little back that they are more than the ids, the ids' own texts are shuffled.
    """
    src = src.where("doc_id is not null")
    maybe = _maybe(src, ids)
    others = table(maybe.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "others")
    own = lambda rows, some: _totals(_maybe(rows, some).join(some, "doc_id", "left_semi"))
    n = others.count()
    if n > ids.count():
        return own(src, ids)
    return _totals(maybe) - own(maybe, others) if n else _totals(maybe)


def _apart(good: DataFrame) -> DataFrame:
    """(doc_id, apart): of all trusted ids in the order of their hashes every CALIBRATED-th is apart. Places are counted within PARTS ranges of hashes."""
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    d = good.withColumns({"_h": h, "_part": F.shiftright(h, 50)})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows at most
    ends = d.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", F.col("doc_id").cast("string"))) - 1 + F.col("_before")
    return d.join(F.broadcast(ends), "_part").select("doc_id", (place % CALIBRATED == 0).alias("apart"))


def _scores(w: Words, ratio: np.ndarray) -> np.ndarray:
    b, row = _buckets(w)
    n = len(w.first) - 1
    return np.bincount(row, ratio[b], n) / np.maximum(np.bincount(row, minlength=n), 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """labels: (doc_id, quality); quality 1 is trusted. Ids are whole numbers."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = table(_apart(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()), "trusted")
    few = good.count() < CALIBRATED
    learned, apart = (good, good) if few else (good.where("not apart"), good.where("apart"))

    raw, target = _totals(src), _target(src, learned)
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS, np.float32).tobytes(), float("-inf"))
    raw, target = raw + SMOOTHING, target + SMOOTHING
    ratio = (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, out = [], []
            for *_, data, off in slices(batch.column("text")):
                w = Words(data, off)
                long.append(w.counts() >= LEAST_WORDS)
                out.append(_scores(w, ratio)[long[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(np.concatenate(long) if long else np.zeros(0, bool))), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    scores = _maybe(src, apart).mapInArrow(scored, "doc_id long, score double").join(apart, "doc_id", "left_semi")
    limit = scores.agg(F.percentile_approx("score", REJECTED, 10_000).alias("x")).first()["x"]
    return QualityModel(ratio.tobytes(), float("-inf") if limit is None else float(limit) - MARGIN)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(data: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of FIELDS and the scores of some texts."""
    w = Words(data, off)
    rows = len(off) - 1
    n_words = w.counts()
    chars = w.sums(w.inside & ((w.bytes & 0xC0) != 0x80))
    three, inside = w.grams(3)
    row = w.rows()
    own = three[inside] ^ (row[: len(three)][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(inside)[twice]
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[at + k] = True
    raw, dup = data.tobytes(), np.zeros(rows, np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(BLANK)]
        dup[i] = len(lines) - len(set(lines))
    counts = {"n_words": n_words, "word_chars": chars, "n_symbols": w.sums(SYMBOLS[w.bytes]), "n_dup_lines": dup, "n_repeat_words": np.bincount(row[covered], minlength=rows)}
    return counts, _scores(w, ratio)


def _judged(col: pa.Array, model: QualityModel, ratio: np.ndarray) -> dict[str, np.ndarray]:
    parts = []
    for *_, data, off in slices(col):
        counts, score = measure(data, off, ratio)
        failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
        parts.append(counts | {"base_failed": failed, "kept": ~failed & (score >= model.limit), "score": score})
    kinds = dict.fromkeys(FIELDS, np.int64) | {"base_failed": bool, "kept": bool, "score": np.float64}
    return {k: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t) for k, t in kinds.items()}


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and the score of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(model.ratio, np.float32)
        for batch in batches:
            got = _judged(batch.column("text"), model, ratio)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, got.values())], names=["doc_id", *got])

    return src.mapInArrow(work, src.select("doc_id").schema.simpleString()[7:-1] + ", " + ", ".join(f"{f} long" for f in FIELDS) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The kept rows, columns as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(model.ratio, np.float32)
        for batch in batches:
            yield batch.filter(pa.array(_judged(batch.column(text_col), model, ratio)["kept"]))

    return docs.mapInArrow(work, docs.schema)
