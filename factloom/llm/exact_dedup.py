"""Exact deduplication by composable polynomial fingerprints (operator 4).

Each text, normalised by deleting a set of white space, is hashed as a polynomial in its bytes modulo two primes. A
fingerprint is put together from those of chunks: H(ab) = H(a) * B^len(b) + H(b). Texts above `huge` code points are cut
into chunks that different tasks hash; others are hashed in place. Rows of equal fingerprint and length are counted with a
map-side combine, and every row of a group with several is compared with the group's representative, chunk after chunk;
rows that differ there (a collision) form groups by their SHA-256.

Texts of rows that have no equal fingerprint are not shuffled: a filter of bounded size over the members' hashes picks those
to compare (it lets others through as members grow beyond its bits). They are shuffled twice, to their group's row and to its
representative's text, which is there once for each PER rows of its group; hot groups are joined by broadcast of their
few counts.

Null texts count as empty. Empty texts are equal to one another. Null ids are ids like others and come last in the order, so
they name a group (`keep_id` NULL) only if all ids in it are null. Repeated rows are rows of their own: of rows with the
same id and text each is returned, and at most one of them is kept. An id with several texts is several rows. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import filtered, join_groups, kept_rows, row_hash, table, text_key
from factloom.llm.words import slices

P1, P2, BASE1, BASE2 = (1 << 31) - 1, (1 << 31) - 19, 1_000_003, 7_368_787
CHUNK = 1 << 16  # bytes hashed by one vector product
SPACES = " \t\n\x0b\x0c\r"
HUGE = 1 << 18
PER = 4096  # rows of a group that one copy of the representative's text is compared with, about


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    for i in range(1, n + 1):
        out[i] = int(out[i - 1]) * base % p
    return out


_TABLES: list = []


def fingerprint(data: np.ndarray, chunk: int = CHUNK) -> tuple[int, int, int, int]:
    """Polynomial hashes of bytes modulo two primes, and BASE^len modulo both, combined from chunks."""
    if not _TABLES:
        _TABLES.extend(_powers(b, p, CHUNK) for b, p in ((BASE1, P1), (BASE2, P2)))
    h, s = [0, 0], [1, 1]
    for i in range(0, len(data), chunk):
        part = data[i : i + chunk].astype(np.uint64) + np.uint64(1)
        for k, (p, pw) in enumerate(((P1, _TABLES[0]), (P2, _TABLES[1]))):
            own = int(np.dot(part, pw[len(part) - 1 :: -1] if len(part) <= CHUNK else None) % np.uint64(p))  # under 2^56
            shift = int(pw[len(part)])
            h[k] = (h[k] * shift + own) % p
            s[k] = s[k] * shift % p
    return h[0], h[1], s[0], s[1]


def _strip(raw: bytes) -> bytes:
    return raw.translate(None, SPACES.encode())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_cp, n_bytes, h1, h2, sha = [], [], [], [], []
        for _, _, data, off in slices(batch.column("text")):
            raw, lead = data.tobytes(), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            n_cp.extend((lead[off[1:]] - lead[off[:-1]]).tolist())
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = _strip(raw[a:b])
                f = fingerprint(np.frombuffer(text, np.uint8))
                n_bytes.append(len(text))
                h1.append(f[0])
                h2.append(f[1])
                sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, pa.int64()) for x in (n_cp, n_bytes, h1, h2)), pa.array(sha, pa.string())], names=["doc_id", "text_key", "n_cp", "n_bytes", "h1", "h2", "text_sha256"])


def _cut(huge: int):
    """Chunks of texts, in one pass over each; a cut may part the bytes of a character, as only single bytes are deleted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = memoryview(batch.column("text")[r].as_buffer())
                sha, n_cp = hashlib.sha256(), 0
                for at in range(0, len(raw), huge):
                    part = raw[at : at + huge]
                    sha.update(_strip(bytes(part)))
                    n_cp += int(((np.frombuffer(part, np.uint8) & 0xC0) != 0x80).sum())
                row = [*(batch.column(i).slice(r, 1) for i in (0, 1)), pa.array([n_cp]), pa.array([sha.hexdigest()], pa.string())]
                for k, at in enumerate(range(0, len(raw), huge)):
                    yield pa.RecordBatch.from_arrays([*row, pa.array([k], pa.int32()), pa.array([bytes(raw[at : at + huge])], pa.binary())], names=["doc_id", "text_key", "n_cp", "text_sha256", "k", "part"])

    return work


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in batch.column("part"):
            text = _strip(raw.as_py())
            rows.append((len(text), *fingerprint(np.frombuffer(text, np.uint8))))
        cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *cols], names=[*batch.schema.names[:-1], "n", "h1", "h2", "s1", "s2"])


def _combined(h: str, s: str, p: int):
    return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[s] + x[h]) % F.lit(p))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, text_key, n_cp (code points), n_bytes (normalised), h1, h2, text_sha256 for each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = docs.select("doc_id").schema.simpleString()[7:-1] + ", text_key long"
    small = docs.where(F.length("text") <= huge).mapInArrow(_whole, f"{schema}, n_cp long, n_bytes long, h1 long, h2 long, text_sha256 string")
    # chunks of huge texts go to other tasks; rows with the same id and text give the same chunks, once each and counted
    row = ["doc_id", "text_key", "n_cp", "text_sha256"]
    parts = docs.where(F.length("text") > huge).mapInArrow(_cut(huge), f"{schema}, n_cp long, text_sha256 string, k int, part binary").repartition(F.col("text_key"), F.col("k"))
    hashed = parts.mapInArrow(_chunks, f"{schema}, n_cp long, text_sha256 string, k int, n long, h1 long, h2 long, s1 long, s2 long")
    joined = hashed.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("k", "n", "h1", "h2", "s1", "s2"))).alias("parts"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).cast("int").alias("times"))
    joined = joined.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "text_key", "n_cp", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_bytes"), _combined("h1", "s1", P1).alias("h1"), _combined("h2", "s2", P2).alias("h2"), "text_sha256")
    return small.unionByName(joined)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether text and representative's text agree after normalising, chunk after chunk."""
    for batch in batches:
        same = [_equal(a, b) for a, b in zip(batch.column("text"), batch.column("rep_text"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("text_sha256"), pa.array(same, pa.bool_())], names=["text_key", "text_sha256", "same"])


def _equal(a: pa.Scalar, b: pa.Scalar, chunk: int = CHUNK) -> bool:
    """Streams both texts: keeps at most a chunk of normalised bytes of each."""
    views, rest = [memoryview(x.as_buffer()) for x in (a, b)], [b"", b""]
    at = [0, 0]
    while True:
        for k in (0, 1):
            while len(rest[k]) < chunk and at[k] < len(views[k]):
                rest[k] += _strip(bytes(views[k][at[k] : at[k] + chunk]))
                at[k] += chunk
        n = min(len(rest[0]), len(rest[1]))
        if rest[0][:n] != rest[1][:n]:
            return False
        rest = [rest[0][n:], rest[1][n:]]
        if not n:
            return not rest[0] and not rest[1]


def _differing(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(text_key, text_sha256) of rows whose text isn't that of their group's representative."""
    whose = members.groupBy("doc_id", "text_key", "text_sha256", "rep", "n").agg(F.count("*").alias("_n")).drop("_n")
    whose = whose.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "text_sha256", "rep", F.ceil(F.col("n") / PER).cast("int").alias("copies"))
    maybe, _ = filtered(texts, row_hash(F.col("doc_id"), F.col("text_key")), whose, row_hash(F.col("_id"), F.col("_key")))
    held = maybe.join(whose.hint("merge"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_key")
    held = table(held, "held")
    reps = held.where((F.col("text_key") == F.col("rep.text_key")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))).dropDuplicates(["rep"])
    reps = reps.select("rep", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("text").alias("rep_text"))
    pairs = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(3)), F.col("copies")).cast("int"))
    reps = reps.select(F.xxhash64("rep").alias("_rep"), F.col("rep").alias("_own"), "salt", "rep_text")
    pairs = pairs.withColumn("_rep", F.xxhash64("rep")).join(reps.hint("merge"), ["_rep", "salt"]).where(F.col("rep") == F.col("_own"))
    same = pairs.select("text_key", "text_sha256", "text", "rep_text").mapInArrow(_compare, "text_key long, text_sha256 string, same boolean")
    return same.where("not same").select("text_key", "text_sha256").distinct()


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256 for each row."""
    key, last = ["h1", "h2", "n_bytes"], lambda *more: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", *more)
    prints = table(fingerprints(docs, id_col, text_col, huge), "prints")
    total = prints.count()
    several = table(prints.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("text_key", "doc_id")).alias("rep")).where("n > 1"), "several")
    marked = table(join_groups(prints, several, key, "n", "left", total), "marked")
    members = marked.where("n is not null")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    differ = table(_differing(texts, members), "differ")
    if differ.isEmpty():
        members = members.withColumn("split", F.lit(""))
    else:  # collisions: groups of their own, by digest
        members = members.join(differ.withColumn("split", F.col("text_sha256")), ["text_key", "text_sha256"], "left").withColumn("split", F.coalesce("split", F.lit("")))
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), last().alias("row"))).getField("row")
    groups = table(members.groupBy(*key, "split").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    d = join_groups(members, groups, [*key, "split"], "group_size", total=total).select("doc_id", "text_key", F.col("best.doc_id").alias("keep_id"), "group_size", last().eqNullSafe(F.col("best")).alias("kept"), "text_sha256")
    first = d.where("kept").groupBy(*d.columns).agg(F.count("*").cast("int").alias("times")).withColumn("k", F.explode(F.sequence(F.lit(1), "times"))).withColumn("kept", F.col("k") == 1)
    alone = marked.where("n is null").select("doc_id", "text_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(first.select(d.columns)).unionByName(d.where("not kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row. The longest original stays, then the smallest id."""
    return verdicts(docs, id_col, text_col, huge).drop("text_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, columns as they are."""
    return kept_rows(docs, verdicts(docs, id_col, text_col).where("group_size > 1"), id_col, text_col)
