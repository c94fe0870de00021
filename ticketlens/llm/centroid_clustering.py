"""Operator 11: centroid clustering with an incremental distance matrix.

Vectors of exactly ``DIMENSIONS`` finite components become whole numbers
(floor of ``SCALE`` times each). The table of state keeps each vector next
to its exact integer dot products with all centroids. A round

1. finds the nearest centroid from the dot products alone: the squared
   distance to centroid c is |x|^2 + |c|^2 - 2 x.c, and |x|^2 is the same
   for all (ties: the smaller number);
2. sums the vectors of each cluster with partial aggregation; a non-empty
   centroid moves to the componentwise floor of sum / count;
3. adds to each dot product what the moved components change: only the
   nonzero changes of a centroid are multiplied. The new state is persisted
   with a reliable checkpoint, so a lost executor costs one round at most.

The driver holds the centroids (clusters x dimensions whole numbers) and
one row of sums per cluster; no row of vectors reaches it. A vector that a
third of all rows share is one partial sum per task. A round without a
change ends the loop, as all later ones would be equal.

Defined cases: vectors of other lengths, null vectors and vectors with a
null or non-finite component are not kept; components are held to
+-``LIMIT`` after scaling, so that distances fit 64 bits; a sum of
distances over 2^63 - 1 is given as that; a null vec_id is kept and is
the last to become a centroid; repeated rows count each; with fewer kept
vectors than centroids, each is one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import cut

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
LIMIT = 1 << 27
MOST = (1 << 63) - 1
ROWS = 4096  # of an Arrow batch: some 300 bytes each


def finite(e: Column) -> Column:
    """Whether a component is a number (nulls, NaN and infinities are not)."""
    return F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False))


def whole(x: Column, scale: int, limit: int) -> Column:
    """The components as whole numbers: floor(scale * x), held to +-limit."""
    return F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * F.lit(float(scale)), F.lit(float(limit))), F.lit(-float(limit)))).cast("int"))


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the vectors that take part, as whole numbers."""
    v = F.col("embedding")
    return vectors.where(v.isNotNull() & (F.size(v) == DIMENSIONS) & F.forall(v, finite)).select("vec_id", whole(v, SCALE, LIMIT).alias("x"))


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The first centroids: the vectors with the least hash of their vec_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(clusters).collect()
    return np.array([r.x for r in first], dtype=np.int64).reshape(len(first), DIMENSIONS)


def products(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact x @ d of whole numbers; by floats where these are exact."""
    if x.size and d.size and float(np.abs(x).max()) * float(np.abs(d).max()) * len(d) < 2 ** 53:
        return (x.astype(np.float64) @ d.astype(np.float64)).astype(np.int64)
    return x @ d


def advanced(state: DataFrame, change: np.ndarray) -> DataFrame:
    """The state with the dot products after centroids moved by ``change``."""
    moved = [(c, np.flatnonzero(d)) for c, d in enumerate(change) if d.any()]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not len(batch):
                continue
            x, dots = matrix(batch.column(1)), matrix(batch.column(3)).copy()
            for c, nonzero in moved:
                dots[:, c] += products(x[:, nonzero], change[c, nonzero])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows_of(dots)], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def rows_of(values: np.ndarray):
    import pyarrow as pa
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def first_state(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, x, norm (squared), dots."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((x * x).sum(axis=1)), rows_of(products(x, centroids.T))], names=["vec_id", "x", "norm", "dots"])

    return rows.mapInArrow(run, f"vec_id {kind}, x array<int>, norm long, dots array<long>")


def cluster_sums(state: DataFrame, centroids: np.ndarray) -> dict:
    """number: [vectors, sum of each component] of the non-empty clusters. A
    task sums what it has read before a row leaves it."""
    norms = (centroids * centroids).sum(axis=1)

    def run(batches):
        import pyarrow as pa
        total = np.zeros((len(norms), DIMENSIONS + 1), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, dots = matrix(batch.column(0)), matrix(batch.column(1))
            number = (norms - 2 * dots).argmin(axis=1)  # the first of equals
            for c in np.unique(number).tolist():
                own = x[number == c]
                total[c] += np.append(len(own), own.sum(axis=0))
        c, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[c, k])], names=["number", "k", "s"])

    out: dict = {}
    for r in state.select("x", "dots").mapInArrow(run, "number int, k int, s long").groupBy("number", "k").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.number, [0] * (DIMENSIONS + 1))[r.k] = r.s
    return out


def nearest(centroids: np.ndarray) -> tuple[Column, Column]:
    """(cluster, squared distance) from the dot products of a row."""
    norms = F.array(*[F.lit(int(n)) for n in (centroids * centroids).sum(axis=1)])
    far = F.zip_with(norms, "dots", lambda n, d: n - F.lit(2) * d)
    return (F.array_position(far, F.array_min(far)) - 1).cast("int"), F.col("norm") + F.array_min(far)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256
    of every kept vector."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    rows = cut(kept(vectors))
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state = cut(first_state(rows, centroids))
    for _ in range(rounds):
        moved = centroids.copy()
        for number, (n, *total) in cluster_sums(state, centroids).items():
            moved[number] = [t // n for t in total]
        change, centroids = moved - centroids, moved
        if not change.any():
            break
        state = cut(advanced(state, change))
    number, distance = nearest(centroids)
    done = state.select("vec_id", number.alias("cluster"), distance.alias("distance"))
    inertia = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    return done.select(
        "vec_id", "cluster", "distance", of_cluster([min(inertia.get(c, 0), MOST) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
