"""N-gram Jaccard join by chosen paths (operator 10).

A text's set holds the hashes of its runs of five words; shorter texts are one run. Texts with equal sets are one node, which
is a 64-bit hash of the set's print of 128 bits. Of each set, SKETCH sampled tokens (minima of independent hashes) are kept. In each of
RUNS runs the sets are split by one sampled token; buckets above SMALL are split again by further tokens (the chosen path),
up to DEPTH times. Within small buckets all members are compared by their sketches. Large buckets that splitting doesn't
break up hold sets that are much alike: members are compared with the bucket's leader by an equi-join, and those with nearly the
leader's sketch (HIGH) are done. Whatever is similar to them is at a distance from the leader that LEAD allows for, so it is linked to
the leader too, although it need not be similar to it: groups are compared exactly later. What is left after
LEADERS rounds is compared in square blocks, so there is no cap. RUNS is the number that gives the target recall for a pair
at the threshold.

Pairs whose sketches agree well enough join candidate groups (connected components). In each group all pairs are compared
exactly by their sets, in square blocks of bounded size; no pair is written: a block gives each member its number of links
and one edge into its part of the group. Classes are the components of these exact links. Numbers of links are exact, so the work on
a group of m different texts that are all alike grows with m^2, in blocks that many tasks share; equal texts cost nothing there.

Null texts count as empty. A text without words is similar to no other and is a class by itself. Repeated rows count as
copies; one of them stays. An id with several texts is several rows. Null ids come last in the order, so they name a class
(`class_id` NULL) only if all its ids are null. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.store import filtered, join_groups, kept_rows, row_hash, table, text_key
from factloom.llm.words import Words, mix, slices

WORDS, SIMILAR, RECALL = 5, 0.8, 0.999
SKETCH = 64
SMALL, DEPTH, LEADERS = 64, 2, 2
SIGMAS = 4  # standard errors of a sketch that the bounds below leave
HIGH = 0.97  # share of equal sampled tokens at which the leader stands for a member
BLOCK, BLOCK_TOKENS = 512, 1 << 18  # members and tokens of a block, about: two blocks are compared in some 100 MB
LEAST_TASKS = 16
_A = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + SKETCH, dtype=np.uint64))


def runs(recall: float = RECALL, similar: float = SIMILAR) -> int:
    """Runs that find a pair at the threshold with this probability, if each finds it after DEPTH + 1 splits."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar ** (DEPTH + 1))))


def _surely(share: float) -> float:
    """The share of equal sampled tokens that nearly all pairs of this similarity reach."""
    return share - SIGMAS * math.sqrt(share * (1 - share) / SKETCH)


def low(similar: float = SIMILAR) -> float:
    """Share of equal sampled tokens that makes a candidate."""
    return _surely(similar)


def lead(similar: float = SIMILAR) -> float:
    """The same for a leader and what may be similar to a member that it stands for: distances add up."""
    return _surely(max(0.0, similar - (1 - _surely(HIGH))))


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    w = Words(data, off)
    h, _ = w.grams(k)
    first, out = w.first.tolist(), []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:  # fewer words than a run: all of them are one
            own = np.uint64(b - a)
            for x in w.hash[a:b]:
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(s):
        return 0, 0
    return int(mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))


def _sketched(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                sets = _sets(data, off, k)
                n = np.array([len(s) for s in sets], np.int64)
                sketch = np.zeros((len(sets), SKETCH), np.int32)
                some = np.flatnonzero(n)
                if len(some):
                    flat = np.concatenate([sets[x] for x in some])
                    starts = np.cumsum(n[some]) - n[some]
                    for t in range(SKETCH):
                        sketch[some, t] = (mix(np.minimum.reduceat(flat * _A[t] + _B[t], starts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                p = [_print(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(n), pa.array([x[0] for x in p], pa.int64()), pa.array([x[1] for x in p], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(sketch.reshape(-1)), SKETCH).cast(pa.list_(pa.int32()))], names=["doc_id", "text_key", "n", "p1", "p2", "sketch"])

    return work


def _alike(a: str, b: str) -> Column:
    """Share of equal sampled tokens."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) / {SKETCH}d")


def _labels(adj: np.ndarray) -> np.ndarray:
    """Smallest index of each member's component."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key, of input that is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _bucket_edges(least: float):
    """Edges that connect what is alike in each small bucket (one row each)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for members in batch.column("members"):
                m = members.values
                ids = m.field("node").to_numpy()
                sketch = m.field("sketch").flatten().to_numpy().reshape(-1, SKETCH)
                label = _labels((sketch[:, None] == sketch[None]).mean(2) >= least)
                at = np.flatnonzero(label != np.arange(len(ids)))
                u += ids[at].tolist()
                v += ids[label[at]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return work


def _block_edges(least: float):
    """The same for square blocks of large buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, ["bucket", "i", "j"]):
            ids = t.column("node").to_numpy()
            sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)
            equal = np.zeros((len(ids), len(ids)), np.uint8)
            for c in range(SKETCH):
                equal += sketch[:, c, None] == sketch[None, :, c]
            label = _labels(equal >= least * SKETCH)
            at = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["u", "v"])

    return work


def _blocks(df: DataFrame, blocks: Column, key: str) -> DataFrame:
    """Each row once for each square block (i, j) that it is part of."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def _spread(parts: DataFrame, key: list[str], work: float) -> DataFrame:
    """Rows by key, in as many partitions as there are full pairs of blocks to compare, whatever their bytes."""
    return parts.repartition(min(max(LEAST_TASKS, math.ceil(work)), 1 << 16), *key).sortWithinPartitions(*key)


def candidates(sets: DataFrame, n_runs: int, similar: float = SIMILAR) -> DataFrame:
    """Edges (u, v) that join what is similar by its sketch. sets: node, sketch."""
    total = sets.count() * n_runs
    key = lambda depth: F.expr(f"element_at(sketch, cast(pmod(run + {depth * n_runs}, {SKETCH}) as int) + 1)")
    least = low(similar)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node"))["node"].alias("leader")).where("size > 1")
        return table(join_groups(rows, table(n, "sizes"), ["bucket"], "size", total=total), name)

    rows = sets.select("node", "sketch", F.explode(F.array(*map(F.lit, range(n_runs)))).alias("run"))
    level = counted(table(rows.select("node", "run", F.xxhash64("run", key(0)).alias("bucket")), "runs"), "buckets")
    level = table(level.join(sets.select("node", "sketch"), "node"), "buckets")  # sketches go along from here on
    found, depth = [], 0
    while True:
        small = level.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
        found.append(table(small.select("members").mapInArrow(_bucket_edges(least), "u long, v long").distinct(), "alike"))
        large = level.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH + LEADERS:
            blocks = F.ceil(F.col("size") / BLOCK)
            work = large.where("node = leader").agg(F.sum(blocks * (blocks + 1) / 2)).first()[0] or 0
            parts = _blocks(large, blocks, "bucket").select("bucket", "i", "j", "node", "sketch")
            found.append(table(_spread(parts, ["bucket", "i", "j"], float(work)).mapInArrow(_block_edges(least), "u long, v long").distinct(), "alike"))
            break
        leaders = table(large.where("node = leader").select("bucket", "size", F.col("node").alias("lead"), F.col("sketch").alias("lead_sketch")), "leaders")
        near = join_groups(large.drop("size"), leaders, ["bucket"], "size", total=total).withColumn("alike", _alike("sketch", "lead_sketch"))
        near = table(near.where("node <> lead").select("node", "run", "bucket", "sketch", "lead", "alike", key(depth + 1).alias("token")), "near")
        found.append(near.where(f"alike >= {lead(similar)}").select(F.col("node").alias("u"), F.col("lead").alias("v")))
        depth += 1
        rest = near.where(f"alike < {HIGH}").select("node", "run", "sketch", F.xxhash64("bucket", "token").alias("bucket") if depth <= DEPTH else F.col("bucket"))
        level = counted(rest, "buckets")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _with_sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                names = ["node", "root", "blocks", "copies"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array([s.tobytes() for s in _sets(data, off, k)], pa.binary())], names=[*names, "tokens"])

    return work


def _exact(similar: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, ["root", "i", "j"]):
            ids, pick = np.unique(t.column("node").to_numpy(), return_index=True)  # repeated rows are one
            t = t.take(pick)
            m = len(ids)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
            n, copies = np.array([len(s) for s in sets]), t.column("copies").to_numpy().astype(np.float64)
            tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
            shared = np.bincount(code, minlength=len(tokens)) > 1
            order = np.cumsum(shared) - 1
            row = np.repeat(np.arange(m), n)[shared[code]]
            col = order[code[shared[code]]]
            by_col = np.argsort(col, kind="stable")
            row, col = row[by_col], col[by_col]
            common = np.zeros((m, m), np.float32)
            step = max(256, (1 << 22) // max(m, 1))
            for c in range(0, int(shared.sum()), step):
                a, b = np.searchsorted(col, [c, c + step])
                x = np.zeros((m, step), np.float32)
                x[row[a:b], col[a:b] - c] = 1
                common += x @ x.T
            adj = common >= similar * (n[:, None] + n[None] - common) - 1e-3
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            own = t.column("own").to_numpy()
            if i != j:
                adj &= own[:, None] != own[None]
            np.fill_diagonal(adj, False)
            label = _labels(adj)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label]), pa.array(adj.sum(1).astype(np.int64)), pa.array((adj @ copies).astype(np.int64))], names=["u", "v", "texts", "docs"])

    return work


def verdicts(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, rep_id (smallest id with an equal set), class_id, n_links (similar other rows), n_text_links (other sets), class_size, kept."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.select("doc_id").schema.simpleString()[7:-1]
    sketches = table(src.mapInArrow(_sketched(words), f"{kind}, text_key long, n long, p1 long, p2 long, sketch array<int>"), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    key = ["n", "p1", "p2"]
    sets = sketches.where("n > 0").groupBy(*key).agg(F.min(row).alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))  # equal sets have equal sketches
    sets = table(sets.withColumn("node", F.xxhash64(*key)), "sets")
    n_sets = sets.count()
    nodes = components(candidates(sets, runs(recall, similar), similar))
    groups = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    members = sets.join(groups, "node").select("node", "root", "n", "copies", "rep")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"), F.count("*").alias("nodes"), F.sum("n").alias("tokens"))
    sizes = table(sizes, "sizes")
    members = table(join_groups(members, sizes.drop("tokens"), ["root"], "nodes", total=n_sets).select("node", "root", "copies", "blocks", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key")), "members")
    maybe, _ = filtered(src, row_hash(F.col("doc_id"), F.col("text_key")), members, row_hash(F.col("_id"), F.col("_key")))
    texts = maybe.join(members.hint("merge"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "root", "blocks", "copies", "text")
    whole = texts.mapInArrow(_with_sets(words), "node long, root long, blocks int, copies long, tokens binary")
    parts = _blocks(whole, F.col("blocks"), "root").select("root", "i", "j", "own", "node", "copies", "tokens")
    part = F.greatest(F.pow(F.col("nodes") / BLOCK, 2), F.col("tokens") / BLOCK_TOKENS)  # of a full pair of blocks
    work = sizes.agg(F.sum(F.when(F.col("blocks") > 1, F.expr("blocks * (blocks + 1d) / 2")).otherwise(part))).first()[0] or 0
    linked = table(_spread(parts, ["root", "i", "j"], float(work)).mapInArrow(_exact(similar), "u long, v long, texts long, docs long"), "links")
    links = linked.groupBy(F.col("u").alias("node")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(linked.select("u", "v"))
    by_set = sets.drop("sketch").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_set = table(by_set, "classed")
    best = table(by_set.groupBy("root").agg(F.min("rep").alias("best"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes")), "classes")
    by_set = table(join_groups(by_set, best, ["root"], "nodes", total=n_sets), "classed")
    d = join_groups(sketches.where("n > 0").drop("sketch"), by_set, key, "copies")
    d = d.select("doc_id", "text_key", F.col("rep.doc_id").alias("rep_id"), F.col("best.doc_id").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), "class_size", row.eqNullSafe(F.col("best")).alias("kept"))
    first = d.where("kept").groupBy(*d.columns).agg(F.count("*").cast("int").alias("times")).withColumn("k", F.explode(F.sequence(F.lit(1), "times"))).withColumn("kept", F.col("k") == 1)
    zero, own = F.lit(0).cast("long"), F.col("doc_id")
    wordless = sketches.where("n = 0").select("doc_id", "text_key", own.alias("rep_id"), own.alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return wordless.unionByName(first.select(d.columns)).unionByName(d.where("not kept"))


def jaccard_join(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep_id (smallest id with an equal set), class_id, n_links (similar other rows), n_text_links (other sets), class_size, kept."""
    return verdicts(docs, words, similar, recall, id_col, text_col).drop("text_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, columns as they are."""
    return kept_rows(docs, verdicts(docs, id_col=id_col, text_col=text_col).where("class_size > 1"), id_col, text_col)
