"""Centroid clustering by partial-distance search (operator 13).

Vectors become whole numbers. In each round a task takes its vectors to the centroids in their order: squared differences are
added up over the dimensions of highest variance first, STEP at a time, and a centroid is abandoned for those vectors whose sum
is strictly above their best so far; survivors finish all dimensions. A task hands on one row of counts and sums for each
centroid, so a round shuffles k rows a task and brings k rows of sums to the driver, whatever the number of vectors; a new
centroid is the exact floor of sum by count. All sums are whole numbers: no order of addition changes a result.

Vectors with another number of components, with a null or non-finite one, or with one beyond LARGEST once scaled (whose
distances wouldn't fit a long) take no part and give no row. Null vectors are such. Rows with the same id are rows of their
own; a null id counts as empty in the hash that picks the first centroids, and of equal hashes the smaller vector comes first.
Fewer vectors than centroids give as many centroids as there are vectors. Ties go to the smaller number. An empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import table

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
STEP = 8  # dimensions between two looks at the best so far
LARGEST = 1 << 27  # 64 * (2 * LARGEST)^2 is under 2^62 + 1


def whole(vec: Column, scale: int, largest: int) -> Column:
    """The vector in whole numbers; null where a component is null, not finite or too large."""
    scaled = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(largest / scale)))
    return F.when(fits, scaled)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of x; of equal ones the smaller number."""
    x, c = np.ascontiguousarray(x[:, order]), centroids[:, order]
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for k in range(len(c)):
        alive, d = np.arange(len(x)), np.zeros(len(x), np.int64)
        for i in range(0, x.shape[1], step):
            diff = x[alive, i : i + step] - c[k, i : i + step]
            d += np.einsum("ij,ij->i", diff, diff)
            on = d <= best[alive]
            if not on.all():
                alive, d = alive[on], d[on]
        better = d < best[alive]
        best[alive[better]], at[alive[better]] = d[better], k
    return at, best


def _sums(centroids: np.ndarray, order: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), centroids.shape[1])
            at, _ = nearest(x, centroids, order)
            found = np.unique(at)
            sums = [x[at == k].sum(0).tolist() for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.bincount(at)[found], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return work


def _placed(centroids: np.ndarray, order: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = nearest(_matrix(batch.column("v"), centroids.shape[1]), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return work


def _totals(df: DataFrame, dims: int, *keys: str) -> list:
    """Sums of the component lists and of n, exact, by key; one row a key."""
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))).collect()


def _by_variance(v: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance: it only decides how soon a centroid is abandoned, so doubles do."""
    r = v.agg(*(F.var_pop(F.col("v")[i]).alias(f"s{i}") for i in range(dims))).first()
    return np.argsort([-(x or 0.0) for x in r], kind="stable")


def cluster(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    src = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(F.size("v") == dims)
    src = table(src.select("vec_id", whole(F.col("v"), scale, LARGEST).alias("v")).where("v is not null"), "vectors")
    kind = src.select("vec_id").schema.simpleString()[7:-1]
    first = src.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"))
    centroids = np.array([r["v"] for r in first.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dims)
    order = _by_variance(src, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in _totals(src.select("v").mapInArrow(_sums(centroids, order), "cluster int, n long, sums array<long>"), dims, "cluster"):
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    placed = table(src.mapInArrow(_placed(centroids, order), f"{kind}, cluster int, distance long"), "placed")
    by = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(i, by[i], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i in by]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same for DuckDB: a pair of common tables for each round."""
    parts = [f"""v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS cluster, v AS c FROM v QUALIFY cluster < {k})"]
    for r in range(rounds + 1):
        dist = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{r} AS (SELECT uid, vec_id, v, cluster, {dist} AS distance FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY distance, cluster) = 1)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
