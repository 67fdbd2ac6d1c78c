"""Centroid clustering of integer vectors, exact, by partial-distance search.

A vector's nearest centroid is found by adding up squared differences over the
dimensions of high variance first. The centroid that is nearest on those gets
its full distance, which is the best so far; every other one is given up as
soon as its sum is strictly above that, and only survivors finish all
dimensions. As sums of squares only grow, no nearer centroid is lost, and ties
survive and go to the smaller number.

Each round reads the vectors where they are, sends one row of sums for each
cluster and task, and adds those up by shuffle; the driver holds the centroids.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import tidy
from .common import checkpointed

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Dimensions after which sums are held against the best distance, and vectors that are looked at together.
STEPS, BLOCK = (16, 32), 4096
#: Integers up to here either way have distances that fit a long: 64 * (2 * 2**27)**2 = 2**62.
LARGEST = 1 << 27


def whole_vectors(lists: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists that have exactly ``dimensions`` finite components, and floor(256 x) of those, a row each."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    place = np.flatnonzero(pc.equal(pc.list_value_length(lists), dimensions).fill_null(False).to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(place)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    use = np.isfinite(x).all(axis=1)
    scaled = np.floor(SCALE * x[use])
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE} either way: squared distances wouldn't fit a long")
    return place[use], scaled.astype(np.int64)


def nearest(block: np.ndarray, centroids: np.ndarray, order: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; ``order`` lists the dimensions, those of high variance first."""
    v, c = block[:, order], centroids[:, order]
    cuts = [*(s for s in steps if s < v.shape[1]), v.shape[1]]
    partial = np.empty((len(v), len(c)), np.int64)
    for k in range(len(c)):
        d = v[:, : cuts[0]] - c[k, : cuts[0]]
        partial[:, k] = np.einsum("nd,nd->n", d, d)
    guess = partial.argmin(axis=1)
    d = v - c[guess]
    best = np.einsum("nd,nd->n", d, d)
    row, col = np.nonzero(partial <= best[:, None])
    total = partial[row, col]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        d = v[row, low:high] - c[col, low:high]
        total = total + np.einsum("nd,nd->n", d, d)
        alive = total <= best[row]
        row, col, total = row[alive], col[alive], total[alive]
    # survivors stand in order of row and number; the guess is among them
    first = np.searchsorted(row, np.arange(len(v)))
    least = np.minimum.reduceat(total, first) if len(v) else total
    ties = total == least[row]
    row, col = row[ties], col[ties]
    return col[np.searchsorted(row, np.arange(len(v)))], least


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), BLOCK):
            part = b.slice(at, BLOCK)
            place, block = whole_vectors(part.column(column))
            yield part, place, block


def _sum_columns() -> list[str]:
    return [f"s{i}" for i in range(DIMENSIONS)]


def _start(base: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """The first centroids, and the dimensions by falling variance: one pass, a row of moments and ``clusters`` rows from each task."""
    schema = "_hash string, _n long, _v array<long>, _s array<double>, _q array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        lowest: list[tuple[str, list[int]]] = []
        for part, place, block in _blocks(batches, 1):
            n, s, q = n + len(block), s + block.sum(axis=0), q + (block.astype(float) ** 2).sum(axis=0)
            ids = part.column(0).cast(pa.string()).fill_null("").take(pa.array(place)).to_pylist()
            hashes = [hashlib.sha256(b"2:" + i.encode()).hexdigest() for i in ids]
            near = heapq.nsmallest(clusters, range(len(hashes)), key=hashes.__getitem__)
            if len(near) == clusters:  # equal hashes at the edge are told apart by their vectors
                near = [i for i, h in enumerate(hashes) if h <= hashes[near[-1]]]
            lowest = heapq.nsmallest(clusters, lowest + [(hashes[i], block[i].tolist()) for i in near])
        rows = [(h, 0, v, None, None) for h, v in lowest] + [(None, n, None, s.tolist(), q.tolist())]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_hash", "_n", "_v", "_s", "_q"])

    found = checkpointed(base.mapInArrow(tidy(run), schema))
    moments = found.filter("_hash is null").select("_n", F.posexplode(F.arrays_zip("_s", "_q")).alias("dim", "m")).groupBy("dim").agg(F.sum("_n"), F.sum("m._s"), F.sum("m._q")).collect()
    variance = np.zeros(DIMENSIONS)
    for dim, n, s, q in moments:
        variance[dim] = q / n - (s / n) ** 2 if n else 0.0
    seeds = found.filter("_hash is not null").orderBy("_hash", "_v").limit(clusters).select("_v").collect()
    return np.array([r[0] for r in seeds], np.int64).reshape(-1, DIMENSIONS), np.argsort(-variance, kind="stable")


def _round(base: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one assignment of all vectors: floors of exact means, empty clusters as they were."""
    columns = _sum_columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, _, block in _blocks(batches, 0):
            cluster, _ = nearest(block, centroids, order)
            np.add.at(sums, cluster, block)
            n += np.bincount(cluster, minlength=len(centroids))
        has = np.flatnonzero(n)
        arrays = [pa.array(has, pa.int32()), pa.array(n[has], pa.int64()), *(pa.array(sums[has, i], pa.int64()) for i in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", *columns])

    sent = base.select("_v").mapInArrow(tidy(run), "cluster int, n long, " + ", ".join(f"{c} long" for c in columns))
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *columns]]  # a row for each cluster
    new = centroids.copy()
    for r in sent.groupBy("cluster").agg(*wide).collect():
        new[r["cluster"]] = [int(r[c]) // int(r["n"]) for c in columns]
    return new


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly 64 components, none of them null or not finite;
    null, shorter and longer ones have no row. Components become floor(256 x);
    one beyond 2**19 either way is an error, as distances wouldn't fit a long.
    Centroids start as the ``clusters`` kept vectors of smallest SHA-256 of
    ``2:<id>`` (a null id is empty; equal hashes go by their vectors), or all
    where there are fewer. Repeated rows and ids are clustered like others. An
    empty table gives an empty result. Only the two named columns are read, once
    a round, so pass a stored table.
    """
    base = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    centroids, order = _start(base, clusters)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(base, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, place, block in _blocks(batches, 1):
            if len(place):
                cluster, distance = nearest(block, centroids, order)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["_id", "cluster", "distance"])

    spark, kind = vectors.sparkSession, base.schema["_id"].dataType.simpleString()
    assigned = checkpointed(base.mapInArrow(tidy(run), f"_id {kind}, cluster int, distance long"))
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = sum(inertia.values())
    known = [(k, inertia.get(k, 0), total, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k in range(len(centroids))]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid, so the bound is ``clusters``
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
