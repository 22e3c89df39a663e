"""Centroid clustering of embeddings in exact integers, by partial-distance search.

Components become integers, so sums, means and distances are exact and don't depend on how rows are dealt to tasks. The
dimensions are put in order of falling variance over all vectors. A task finds the nearest centroid of its vectors by
adding up squared differences a block of dimensions at a time: the centroid nearest after the first block is measured in
full, and every other one is abandoned once its sum so far is strictly above that; survivors finish all dimensions, so
ties are seen and go to the smaller number. Each round is one pass, in which a task sends a row for each centroid at
most: count, sums and inertia.

Only the centroids (``clusters`` times ``dims`` numbers) and their sums come to the driver. ``vectors`` is read a few times
(rounds + 3), so it should be a written table; the final assignment is written to the shared folder.

Rows whose vector is null, has another number of components, or a null or non-finite one aren't returned. Fewer usable
vectors than centroids give as many centroids as vectors. Equal vectors are assigned alike; of centroids at one distance,
the smaller number wins; of rows with one id, the smaller vector is taken first as a centroid, and a row without id last.
Repeated rows count as often as they occur. Other columns are ignored, whatever their names. An empty table gives no rows. A
component too large for exact 64-bit distances is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common, vectors

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Dimensions added up between two looks at the bounds, and vectors searched together.
BLOCK, TOGETHER = 8, 4096
RESULT = "vec_id long, cluster int, distance long"


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number), and the squared distance to it."""
    found = [_nearest(x[at : at + TOGETHER, order], centroids[:, order]) for at in range(0, len(x), TOGETHER)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def between(row, candidate, at, to):
        apart = x[row, at:to] - centroids[candidate, at:to]
        return np.einsum("ij,ij->i", apart, apart)

    every, dims = np.arange(len(x)), x.shape[1]
    begun = np.stack([between(every, k, 0, BLOCK) for k in range(len(centroids))], 1)
    guess = begun.argmin(axis=1)
    best = begun[every, guess] + between(every, guess, BLOCK, dims)
    row, candidate = np.nonzero(begun <= best[:, None])
    so_far = begun[row, candidate]
    for at in range(BLOCK, dims, BLOCK):
        so_far = so_far + between(row, candidate, at, at + BLOCK)
        near = so_far <= best[row]
        row, candidate, so_far = row[near], candidate[near], so_far[near]
    # the guess survives in every row, so each row has a first one
    by = np.lexsort((candidate, so_far, row))
    by = by[np.unique(row[by], return_index=True)[1]]
    return candidate[by], so_far[by]


def dimension_order(df: DataFrame, column: str, dims: int, scale: int) -> np.ndarray:
    """Dimensions by falling variance over all usable vectors; it decides how soon a centroid is given up, no more."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = vectors.integers(batch.column(0), dims, scale)[1].astype(float)
            n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([float(n)] * dims), pa.array(sums), pa.array(squares)], ["dim", "n", "s", "q"])

    parts = df.select(column).mapInArrow(fold, "dim int, n double, s double, q double")
    rows = parts.groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    spread = {dim: q / max(n, 1) - (s / max(n, 1)) ** 2 for dim, n, s, q in rows}
    return np.array(sorted(range(dims), key=lambda dim: (-spread.get(dim, 0.0), dim)))


def totals(df: DataFrame, column: str, centroids: np.ndarray, order: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid has, and the sums of their components."""
    k, dims = centroids.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = vectors.integers(batch.column(0), dims, scale)[1]
            own = nearest(x, centroids, order)[0]
            n += np.bincount(own, minlength=k)
            for at in np.unique(own):
                sums[at] += x[own == at].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = df.select(column).mapInArrow(fold, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for cluster, dim, count, total in parts.groupBy("cluster", "dim").agg(F.sum("n"), F.sum("s")).collect():
        n[cluster], sums[cluster, dim] = count, total
    return n, sums


def fit(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The centroids after ``rounds`` rounds from the vectors with the smallest SHA-256 of ``seed:id``, and the order of dimensions."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    centroids = vectors.first_vectors(df, column, [digest.asc_nulls_last()], clusters, dims, scale)
    order = dimension_order(df, column, dims, scale) if len(centroids) else np.arange(dims)
    for _ in range(rounds if len(centroids) else 0):
        n, sums = totals(df, column, centroids, order, scale)
        centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    return centroids, order


def assigned(df: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int = SCALE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) of every usable vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = vectors.integers(batch.column(1), centroids.shape[1], scale)
            own, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = df.select(F.col(key).cast("long"), column)
    return found.mapInArrow(assign, RESULT) if len(centroids) else df.sparkSession.createDataFrame([], RESULT)


def clustered(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Each usable vector with its cluster, its squared distance, the inertia of its cluster and of all, and its centroid's digest."""
    spark = df.sparkSession
    centroids, order = fit(df, clusters, rounds, dims, scale, seed)
    found = common.staged(assigned(df, centroids, order, scale))
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a centroid at most
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(k, inertia[k], sum(inertia.values()), digests[k]) for k in sorted(inertia)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS cluster, v AS c
        FROM kept QUALIFY cluster < {CLUSTERS})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT n, min({{'distance': CAST({near} AS BIGINT), 'cluster': cluster}}) AS own FROM kept, c{k} GROUP BY n)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT own.cluster AS cluster, dim, sum(x) AS s, count(*) AS m FROM a{k} JOIN
            (SELECT n, unnest(v) AS x, unnest(range({DIMS})) AS dim FROM kept) USING (n) GROUP BY ALL)""")
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(any_value(m), any_value(c)) AS c FROM c{k} LEFT JOIN
            (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY dim) AS m FROM s{k} GROUP BY cluster) USING (cluster) GROUP BY cluster)""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(own.cluster AS INTEGER) AS cluster, own.distance AS distance,
    CAST(sum(own.distance) OVER (PARTITION BY own.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(own.distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (n) JOIN c{ROUNDS} ON own.cluster = c{ROUNDS}.cluster"""


OP11_SQL = _sql()
