"""Centroid clustering of integer vectors with Elkan's bounds.

A vector's row carries an upper bound on the distance to its centroid and a lower bound on that to
each centroid, from one round to the next. When centroids move, bounds move with them, and a
distance is computed only where neither a lower bound nor half the distance between two centroids
proves that the centroid is farther.

Ties go to the smaller number, so pruning is strict and rounding conservative: upper bounds are
rounded up and lower ones down to 32 bits, and a centroid is skipped only if it is farther for
certain. All distances are exact integers; bounds never enter a result.

Each round reads the rows, writes them with new bounds, and in the same pass writes each task's
sums for each centroid (at most k rows a task, under ``kind=sums``). Spark adds these up, and only
the k sums reach the driver. Sums are made of 32-bit limbs, so that they hold any integer exactly.
Two rounds' tables exist at a time, in the folder that the cluster shares; the older is deleted.

Defined cases: a vector with another number of components, a null or a non-finite one is left out,
and so is a null vector (a component of 2^128 or more, which 32-bit floats don't have, counts as non-finite). A null vec_id comes last among starts and is clustered like any other.
Repeated rows are clustered each. With fewer vectors than k all are starts. Equal centroids: the smaller
number wins, the other stays empty and in its place. A distance or inertia over 63 bits (components over
some 10^8) is null, while the assignment is still exact. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import shared_folder

SIZE, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMBS, BASE = 6, 32
#: Vectors and centroids within this bound have squared distances that 64-bit integers hold.
SAFE = 1 << 27
LONG = (1 << 63) - 1
STATE = "vec_id long, vector array<double>, cluster int, upper float, lower array<float>, distance string, n long, limbs array<long>, kind string"
NAMES = [part.split()[0] for part in STATE.split(", ")]


def kept(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): whole vectors as integers, held in doubles, which are exact for them."""
    each = F.transform("embedding", lambda x: x.cast("double"))
    whole = (F.size("embedding") == size) & F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**128))
    # rint keeps what lies beyond the integers of floor()'s long; such numbers are whole already
    integer = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(F.rint(x * scale))
    return embeddings.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(each, integer).alias("vector"))


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return [[int(x) for x in row[0]] for row in rows]


def whole(vectors: np.ndarray) -> np.ndarray:
    """As 64-bit integers where squared distances fit them, as Python's integers where not."""
    if not vectors.size or np.abs(vectors).max() < SAFE:
        return vectors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in vectors], dtype=object)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows."""
    d = a - b
    return (d * d).sum(axis=-1)


def above(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def assign(vectors: np.ndarray, centroids: np.ndarray, moved: np.ndarray, between: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, squared distance to it, upper, lower) and how many distances were computed.

    moved: bounds (from above) on each centroid's last move; between: (from below) on half the distance
    of each two centroids. Rows with cluster -1 have no bounds yet. Squared distances that no bound asked for are -1.
    """
    n, k = len(vectors), len(centroids)
    cluster, done = cluster.copy(), 0
    best = np.full(n, -1, dtype=vectors.dtype)
    fresh = cluster < 0
    cluster[fresh] = 0
    upper = np.where(fresh, np.float32(np.inf), above(upper.astype(np.float64) + moved[cluster]))
    lower = np.where(fresh[:, None], np.float32(0), below(lower.astype(np.float64) - moved))
    off = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
    open_ = np.flatnonzero(fresh | (upper >= off.min(axis=1, initial=np.inf)[cluster]))
    # a vector that the bounds do not settle first gets its exact distance
    best[open_] = squares(vectors[open_], centroids[cluster[open_]])
    exact = root(best[open_])
    upper[open_], lower[open_, cluster[open_]] = above(exact), below(exact)
    done += len(open_)
    for c in range(k):
        own = cluster[open_]
        ask = open_[(own != c) & (lower[open_, c] <= upper[open_]) & (between[own, c] <= upper[open_])]
        if not len(ask):
            continue
        d = squares(vectors[ask], centroids[c])
        done += len(ask)
        lower[ask, c] = below(root(d))
        nearer = (d < best[ask]) | ((d == best[ask]) & (c < cluster[ask]))
        won = ask[nearer.astype(bool)]
        best[won], cluster[won] = d[nearer.astype(bool)], c
        upper[won] = above(root(best[won]))
    return cluster, best, upper, lower, done


def limbs(x: int) -> list[int]:
    """x = sum of limbs[i] << 32 i; all but the last are not negative."""
    return [(x >> BASE * i) & ((1 << BASE) - 1) for i in range(LIMBS - 1)] + [x >> BASE * (LIMBS - 1)]


def value(parts: list[int]) -> int:
    return sum(int(p) << BASE * i for i, p in enumerate(parts))


def one_round(rows: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, last: bool, path: str) -> None:
    """Writes rows with new clusters and bounds, and sums; the last round's rows have exact distances and no vectors."""
    now = whole(np.array(centroids, dtype=object).reshape(len(centroids), -1).astype(np.float64))
    then = whole(np.array(before if before else centroids, dtype=object).reshape(len(centroids), -1).astype(np.float64))
    moved = above(root(squares(now, then))).astype(np.float64) if before else np.zeros(len(now))
    half = below(np.array([root(squares(now, c)) for c in now]) / 2).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = now.shape
        count, total, inertia, distances = [0] * k, [[0] * width for _ in range(k)], [0] * k, 0
        for batch in batches:
            n = len(batch)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            vectors = whole(flat)
            near = now if vectors.dtype == now.dtype else now.astype(object)
            vectors = vectors if near.dtype == vectors.dtype else vectors.astype(object)
            bounds = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            cluster, best, upper, lower, asked = assign(vectors, near, moved, half, batch.column(2).to_numpy(), batch.column(3).to_numpy(), bounds)
            distances += asked
            if last:
                left = np.flatnonzero(best < 0)
                best[left] = squares(vectors[left], near[cluster[left]])
            for c in np.unique(cluster):
                own = cluster == c
                count[c] += int(own.sum())
                if last:
                    inertia[c] += sum(min(d, LONG + 1) for d in best[own].tolist())  # past 63 bits the inertia is null
                else:
                    total[c] = [a + int(b) for a, b in zip(total[c], vectors[own].sum(axis=0))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.nulls(n, pa.list_(pa.float64())) if last else batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()),
                pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(lower.ravel(), pa.float32())),
                pa.array([str(d) for d in best.tolist()] if last else [None] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(["rows"] * n),
            ], names=NAMES)
        sums = [(c, count[c], [x for v in ([inertia[c]] if last else total[c]) for x in limbs(v)]) for c in range(k) if count[c]]
        sums.append((-1, distances, []))
        m = len(sums)
        empty = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.float64()), pa.float32(), pa.list_(pa.float32()), pa.string())]
        yield pa.RecordBatch.from_arrays([empty[0], empty[1], pa.array([s[0] for s in sums], pa.int32()), *empty[2:], pa.array([s[1] for s in sums], pa.int64()), pa.array([s[2] for s in sums], pa.list_(pa.int64())), pa.array(["sums"] * m)], names=NAMES)

    rows.mapInArrow(run, STATE).write.partitionBy("kind").parquet(path)


def summed(sums: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Each centroid's number of vectors and exact sums; at -1 the number of distances computed."""
    parts = sums.select("cluster", "n", F.posexplode_outer("limbs").alias("at", "limb")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("limb").alias("limb"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for c, at, n, limb in parts.collect():  # k x components x limbs
        found.setdefault(c, (n, {}))[1][at or 0] = limb or 0
    return {c: (n, [value([p.get(i + j, 0) for j in range(LIMBS)]) for i in range(0, max(p) + 1, LIMBS)]) for c, (n, p) in found.items()}


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]], list[int | None], list[int]]:
    """Rows (vec_id, cluster, distance), the final centroids, each one's inertia, and the distances computed in each round."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings, size, scale)
    centroids = starts(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), [], [], []
    rows = vectors.select("vec_id", "vector", F.lit(-1).alias("cluster"), F.lit(0).cast("float").alias("upper"), F.array_repeat(F.lit(0).cast("float"), len(centroids)).alias("lower"))
    before, inertia, asked = None, {}, []
    base, old = f"{shared_folder(spark)}/elkan-{uuid4().hex}", []
    for i in range(rounds + 1):
        path = f"{base}/{i}"
        one_round(rows, centroids, before, i == rounds, path)
        state = spark.read.schema(STATE).parquet(path)
        found = summed(state.filter("kind = 'sums'"))
        asked.append(found.pop(-1)[0])
        rows = state.filter("kind = 'rows'").select("vec_id", "vector", "cluster", "upper", "lower")
        if i == rounds:
            inertia = {c: s[0] for c, (_, s) in found.items()}
        else:
            before, centroids = centroids, [[s // found[c][0] for s in found[c][1]] if c in found else old_one for c, old_one in enumerate(centroids)]
        old.append(path)
        if len(old) > 1:  # the round before is read no more
            gone = spark._jvm.org.apache.hadoop.fs.Path(old.pop(0))
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    out = state.filter("kind = 'rows'").select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"))
    return out, centroids, [inertia.get(c, 0) for c in range(len(centroids))], asked


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): one row per vector."""
    rows, centroids, inertia, _ = cluster(embeddings, k, rounds, size, scale, seed)
    spark = embeddings.sparkSession
    fits = lambda x: x if x <= LONG else None
    table = [(c, fits(inertia[c]), fits(sum(inertia)), ",".join(map(str, centroid))) for c, centroid in enumerate(centroids)]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
