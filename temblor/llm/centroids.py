"""Operator 13: clustering by centroids, with exact integers.

A vector's components are the integers floor(scale * x).  The squared distance to
centroid c is |v|^2 - 2 v.c + |c|^2, and |v|^2 is the same for all of a vector's centroids, so that a
float32 matrix product v.c ranks them.  Its error has a rigorous bound that holds for any order of the
sums (gamma_n |v||c| of floating-point analysis, n the dimension, with two more roundings for what float32 can't hold), so
that each centroid's rank lies in an interval.  A centroid whose interval begins beyond the end of another's
can't be the nearest; where more than one is left, their distances are computed again in 64-bit integers,
and of equals the smallest number wins.  The result is that of exact arithmetic throughout.

Each round is one map over the vectors that gives at most ``k`` rows a task (sums and
counts of components as whole numbers), summed by cluster and component on the cluster; the driver receives
``k * dims`` sums and sends the centroids back: both are bounded by parameters, not by the rows.  Vectors are
never shuffled, and nothing is kept between rounds but the centroids, so that a lost executor costs its tasks only.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or not finite; others give no row.
Components beyond 2**27 either way, whose distances would not fit 64 bits, count as 2**27.  With fewer than k vectors there are as many
centroids as vectors; an empty table gives an empty result.  Repeated rows are vectors of their own; of rows with one id
the smaller vector starts first.  A null id is hashed as an empty string.  An inertia beyond 64 bits is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches

MOST = 1 << 27
#: Vectors that the kernel takes at a time.
BLOCK = 4096
#: Relative rounding of float32.
U32 = 2.0**-24


@dataclass(frozen=True)
class Nearest:
    """Finds the nearest of ``centroids`` (k x dims whole numbers)."""

    centroids: np.ndarray

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector."""
        parts = [self._block(vectors[a : a + BLOCK]) for a in range(0, len(vectors), BLOCK)]
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of an interval that holds |c|^2 - 2 v.c, for each vector and centroid."""
        n = self.centroids.shape[1] + 2
        gamma = n * U32 / (1 - n * U32)
        v, c = vectors.astype(np.float64), self.centroids.astype(np.float64)
        product = (vectors.astype(np.float32) @ self.centroids.astype(np.float32).T).astype(np.float64)
        square = (c * c).sum(1)
        lengths = np.sqrt((v * v).sum(1))[:, None] * np.sqrt(square)
        # The float64 steps themselves err by far less than the millionth of the bound that is added here.
        error = 2 * gamma * lengths * (1 + 1e-6) + 1e-12 * (square + 2 * np.abs(product))
        middle = square - 2 * product
        return middle - error, middle + error

    def _block(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.bounds(vectors)
        maybe = low <= high.min(1)[:, None]
        found = maybe.argmax(1)
        for i in np.flatnonzero(maybe.sum(1) > 1):
            near = np.flatnonzero(maybe[i])
            apart = self.centroids[near] - vectors[i]
            found[i] = near[(apart * apart).sum(1).argmin()]  # the first of equals
        apart = vectors - self.centroids[found]
        return found.astype(np.int64), (apart * apart).sum(1)


def whole(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, vector) of the kept vectors of a list column, as whole numbers."""
    column = column.cast(pa.list_(pa.float64()))
    length = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), -1)
    rows = np.flatnonzero(length == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.int64)
    values = column.take(pa.array(rows)).flatten()
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    ok = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return rows[ok], np.clip(np.floor(scale * x[ok]), -MOST, MOST).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int, key: str, value: str) -> np.ndarray:
    """The k kept vectors with the smallest hash of ``seed:key``, in its order."""
    x = F.col(value).cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.where(F.coalesce(sound, F.lit(False))).select(digest.alias("h"), x.alias("x")).orderBy("h", "x").limit(k).toArrow()
    return whole(first["x"].combine_chunks(), dims, scale)[1]


def sums(vectors: DataFrame, centroids: np.ndarray, scale: float, value: str) -> tuple[np.ndarray, np.ndarray, list]:
    """(sums of components, counts, inertias) of the vectors nearest to each centroid; inertias as Python integers."""
    k, dims = centroids.shape
    near = vectors.sparkSession.sparkContext.broadcast(Nearest(centroids))

    def partial(batches):
        total, count, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            _, v = whole(batch.column(0), dims, scale)
            number, apart = near.value(v)
            order = np.argsort(number, kind="stable")
            number, v, apart = number[order], v[order], apart[order]
            seen, start = np.unique(number, return_index=True)
            if len(seen):
                total[seen] += np.add.reduceat(v, start, axis=0)
                count += np.bincount(number, minlength=k)
                # A batch has too few rows for the halves of its distances to overflow.
                for c, high, low in zip(seen, np.add.reduceat(apart >> 31, start), np.add.reduceat(apart & (2**31 - 1), start), strict=True):
                    inertia[c] += (int(high) << 31) + int(low)
        seen = np.flatnonzero(count)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(list(total[seen]), pa.list_(pa.int64())), pa.array(count[seen]), pa.array([str(inertia[c]) for c in seen])], names=["c", "total", "n", "inertia"])

    parts = vectors.select(value).mapInArrow(partial, "c long, total array<long>, n long, inertia string")
    # -1 and -2 stand beside the components' places, for the count and the inertia.
    cells = F.concat(F.transform("total", lambda x, i: F.struct(i.alias("at"), x.cast("decimal(38,0)").alias("x"))), F.array(F.struct(F.lit(-1).alias("at"), F.col("n").cast("decimal(38,0)").alias("x")), F.struct(F.lit(-2).alias("at"), F.col("inertia").cast("decimal(38,0)").alias("x"))))
    found = parts.select("c", F.inline(cells)).groupBy("c", "at").agg(F.sum("x").cast("string").alias("x")).toArrow()
    near.unpersist()
    total, count, inertia = np.zeros((k, dims), object), np.zeros(k, object), [0] * k
    for c, at, x in zip(*(found[n].to_pylist() for n in ("c", "at", "x")), strict=True):
        if at >= 0:
            total[c, at] = int(x)
        elif at == -1:
            count[c] = int(x)
        else:
            inertia[c] = int(x)
    return total, count, inertia


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, key: str = "vec_id", value: str = "embedding") -> np.ndarray:
    """The centroids after ``rounds``, each the floor of its vectors' mean; an empty one stays."""
    centroids = first_centroids(vectors, k, dims, scale, seed, key, value)
    for _ in range(rounds if len(centroids) else 0):
        total, count, _ = sums(vectors, centroids, scale, value)
        for c in np.flatnonzero(count):
            centroids[c] = [x // count[c] for x in total[c]]
    return centroids


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    vectors = vectors.select(F.col(key), F.col(value))
    centroids = fit(vectors, k, rounds, dims, scale, seed, key, value)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    _, _, inertia = sums(vectors, centroids, scale, value)
    fits = lambda x: x if x < 2**63 else None
    own, total = pa.array([fits(x) for x in inertia], pa.int64()), fits(sum(inertia))
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    near = vectors.sparkSession.sparkContext.broadcast(Nearest(centroids))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, v = whole(batch.column(1), dims, scale)
        number, apart = near.value(v)
        picked = pa.array(number)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), picked.cast(pa.int32()), pa.array(apart), own.take(picked), pa.array([total] * len(rows), pa.int64()), digests.take(picked)], names=schema.names)

    return map_batches(vectors, assign, schema)


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    near = lambda c: f"SELECT vec_id, x, d.c, d.d FROM (SELECT vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS d FROM v CROSS JOIN {c} c GROUP BY vec_id)"
    steps = [f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS ({near(f'c{r}')}),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))""")
    steps.append(f"a AS ({near(f'c{rounds}')})")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} k USING (c)"""


ORACLE = _oracle()
