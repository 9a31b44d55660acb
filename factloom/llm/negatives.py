"""Hard-negative mining by two-dimensional block matrix multiplication (operator 11).

Scores are whole-number inner products of anchors with rows. Both matrices are sharded: rows in blocks of about ROWS, anchors
in blocks of about ANCHORS, and their dimensions in chunks of CHUNK. A shard goes to each tile (i, j) of its block row or block column, as in
SUMMA, in the least whole numbers that hold it. At their tile shards come in order of their chunks: each pair is multiplied and
added as it streams in, so a task holds two tiles, and no score is shuffled or written. An added tile is reduced at once to a few
rows for each anchor, and the last choice among the tiles is a window by anchor.

There are two such products. In the first, blocks hold one label each, and an anchor block meets the blocks of its own label
only: it gives the positives. In the second, all anchors, which now carry their windows of scores, meet all rows. Labels with
many rows have many blocks, so no label is gathered anywhere. The number of scores is anchors times rows, as the operator asks,
and what is shuffled for them are shards: a row once for each block of anchors, an anchor once for each block of rows.

Rows with a null label, a null vector, a null or non-finite component, or one that is too large for exact scores (`largest`) take no part.
Vectors of different lengths are scored as if the shorter one went on with zeros. A null id is no anchor and comes last
in ties. Rows with the same id are rows of their own: an anchor may have its own copy as a positive. An anchor without
positives or without negatives gives no row. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.centroids import whole
from factloom.llm.store import join_groups, table

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
ANCHORS, ROWS, CHUNK = 256, 2048, 32
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max  # stands for a null id in ties


def largest(dims: int) -> int:
    """Components up to this give scores whose hundredfold fits an int64."""
    return math.isqrt((1 << 62) // (100 * max(dims, 1)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: in doubles where no sum can leave 2^53, else in int64."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]  # no least value of its type is there, see _shards
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _shards(chunk: int):
    """Blocks of rows (one row each, `members`) as matrices of a chunk of dimensions each; ids only with the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, label, members in zip(batch.column("block"), batch.column("label"), batch.column("members"), strict=True):
                m = members.values
                ids = m.field("id").fill_null(LAST).to_numpy()
                order = np.lexsort((m.field("uid").to_numpy(), ids))
                v = m.field("v").take(pa.array(order))
                n = np.diff(v.offsets.to_numpy())
                width = max(1, int(n.max()))
                full = np.zeros((len(n), width), np.int64)
                full[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
                facts = np.stack([m.field("uid").to_numpy()[order], ids[order], m.field("label").to_numpy()[order].astype(np.int64)])
                own = m.field("bounds").take(pa.array(order)).to_pylist() if "bounds" in [f.name for f in m.type] else []
                bounds = np.array([[y for x in [*(b or [])] for y in x] for b in own], np.int64).tobytes() if own else b""
                top = int(np.abs(full).max(initial=0))
                size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
                full = full.astype(f"i{size}")
                for k in range(0, width, chunk):
                    part = full[:, k : k + chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([label.as_py()], pa.int64()), pa.array([k // chunk], pa.int32()), pa.array([len(n)], pa.int32()), pa.array([size], pa.int32()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary()), pa.array([facts.tobytes() if not k else None], pa.binary()), pa.array([bounds if not k else None], pa.binary())], names=["block", "label", "k", "n", "size", "part", "facts", "bounds"])

    return work


SHARD = "block long, label long, k int, n int, size int, part binary, facts binary, bounds binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(scores, anchors' facts, rows' facts, bounds) of each tile, of shards sorted by tile, chunk and side: two tiles are held at a time."""
    key = total = held = None
    facts: dict[str, np.ndarray] = {}
    done = lambda: (total, facts["a"].reshape(3, -1), facts["b"].reshape(3, -1), facts["bounds"])
    for batch in batches:
        for r in range(batch.num_rows):
            at = {name: batch.column(name)[r] for name in batch.schema.names}
            own, k, b = (at["i"].as_py(), at["j"].as_py()), at["k"].as_py(), at["side"].as_py()
            if own != key:
                if key:
                    yield done()
                key, total, held, facts = own, None, None, {}
            part = np.frombuffer(at["part"].as_buffer(), f"i{at['size'].as_py()}").reshape(at["n"].as_py(), -1)
            if not k:  # every block has a first chunk
                facts["b" if b else "a"] = np.frombuffer(at["facts"].as_buffer(), np.int64)
                if not b:
                    facts["bounds"] = np.frombuffer(at["bounds"].as_buffer(), np.int64)
            if not b:
                held = k, part
            elif held and held[0] == k:  # beyond the shorter vectors there are only zeros
                w = min(held[1].shape[1], part.shape[1])
                tile = _product(held[1][:, :w], part[:, :w])
                total = tile if total is None else np.add(total, tile, out=total)
    if key:
        yield done()


def _highest(scores: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n times (rows that have one left, column and score of their highest); of equal ones the first column, so the smaller id."""
    for _ in range(n):
        col = scores.argmax(1)
        top = scores[np.arange(len(scores)), col]
        row = np.flatnonzero(top > NONE)
        if not len(row):
            return
        yield row, col[row], top[row]
        scores[row, col[row]] = NONE


def _out(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)


def _positives(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, a, b, _ in _added(batches):
            s[(a[0][:, None] == b[0][None]) | (a[2][:, None] != b[2][None])] = NONE
            yield _out([(a[0][r], a[1][r], b[1][c], b[0][c], top) for r, c, top in _highest(s, n)], ["uid", "anchor_id", "id", "other", "score"])

    return work


def _negatives(n: int, positives: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, a, b, bounds in _added(batches):
            bounds, found = bounds.reshape(len(s), positives, 2), []
            s[a[2][:, None] == b[2][None]] = NONE
            for p in range(positives):
                lo, hi = bounds[:, p, 0], bounds[:, p, 1]
                inside = np.where((s >= lo[:, None]) & (s <= hi[:, None]), s, NONE)
                found += [(a[0][r], np.full(len(r), p), b[1][c], b[0][c], top) for r, c, top in _highest(inside, n)]
            yield _out(found, ["uid", "p", "id", "other", "score"])

    return work


def _product_of(a: DataFrame, b: DataFrame, reduce, schema: str) -> DataFrame:
    """Shards to tiles, multiplied, added and reduced there. a, b: shards; an anchors' block meets the rows' blocks of its label."""
    a_blocks, b_blocks = (x.where("k = 0").groupBy("label").agg(F.collect_list("block").alias("blocks")) for x in (a, b))
    left = a.join(b_blocks, "label").select(F.col("block").alias("i"), F.explode("blocks").alias("j"), "k", F.lit(0).alias("side"), "n", "size", "part", "facts", "bounds")
    right = b.join(a_blocks, "label").select(F.explode("blocks").alias("i"), F.col("block").alias("j"), "k", F.lit(1).alias("side"), "n", "size", "part", "facts", F.lit(None).cast("binary").alias("bounds"))
    return left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j", "k", "side").mapInArrow(reduce, schema)


def _blocked(rows: DataFrame, size: int, chunk: int, by_label: bool) -> DataFrame:
    """Shards of blocks of about `size` rows, written once. Blocks are of one label each, or of any rows and then all of label 0."""
    own = F.xxhash64("uid")
    if by_label:
        counts = table(rows.groupBy("label").agg(F.count("*").alias("_n")), "labels")
        d = join_groups(rows, counts, ["label"], "_n").withColumn("block", F.xxhash64("label", F.pmod(own, F.ceil(F.col("_n") / size)))).drop("_n")
    else:
        d = rows.withColumn("block", F.pmod(own, F.lit(max(1, math.ceil(rows.count() / size)))))
    members = F.collect_list(F.struct(*[c for c in d.columns if c != "block"])).alias("members")
    return table(d.groupBy("block").agg((F.first("label") if by_label else F.lit(0)).cast("long").alias("label"), members).mapInArrow(_shards(chunk), SHARD), "shards")


def mine(rows: DataFrame, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", anchors: int = ANCHORS, block: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives of an anchor and a positive are rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).where("label is not null and v is not null")
    dims = src.agg(F.max(F.size("v"))).first()[0] or 1
    src = src.select("id", "label", whole(F.col("v"), scale, largest(dims)).alias("v")).where("v is not null")
    src = table(src.withColumn("uid", F.monotonically_increasing_id()), "rows")  # written: the numbers stay as they are
    asked = src.where(F.col("id") % every == 0)
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    found = _product_of(_blocked(asked, anchors, chunk, True), _blocked(src, block, chunk, True), _positives(positives), "uid long, anchor_id long, id long, other long, score long")
    found = found.withColumn("p", F.row_number().over(best)).where(F.col("p") <= positives).withColumn("p", F.col("p") - 1)
    found = table(found.select("uid", "anchor_id", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score >= low * positive and <= high * positive, as bounds in whole numbers
    lo = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)")
    hi = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    empty = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    by = found.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("p", F.array(lo, hi)))).alias("_m"))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.element_at("_m", p), empty))
    ready = table(asked.join(by, "uid").withColumn("bounds", bounds).drop("_m"), "anchors")
    pairs = _product_of(_blocked(ready, anchors, chunk, False), _blocked(src, block, chunk, False), _negatives(negatives, positives), "uid long, p long, id long, other long, score long")
    best = Window.partitionBy("uid", "p").orderBy(F.desc("score"), "id", "other")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("uid", F.col("p").cast("int").alias("p"), "rank", "id", F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.join(pairs, ["uid", "p"]).select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", "negative_score")


SQL = f"""
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, b.uid AS other, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.uid <> b.uid),
p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST) AS p FROM s WHERE same),
n AS (SELECT p.uid, p.p, p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.uid, p.p ORDER BY s.score DESC, s.id NULLS LAST)::INT AS rank
  FROM p JOIN s ON p.uid = s.uid AND p.p <= {POSITIVES} AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
