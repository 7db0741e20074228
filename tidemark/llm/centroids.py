"""Centroid clustering with an incremental matrix of exact integer dot products.

Each vector carries its dot products with all centroids. A round takes the argmin of the
squared distances |x|^2 - 2 x.c + |c|^2, sums the components by cluster (partial sums before
the shuffle, one row per cluster after it), and moves each centroid to the floor of its
mean. Dot products are then updated by the components of each centroid that changed and by
these only: x.c' = x.c + sum over changed i of x[i] (c'[i] - c[i]). All of it is integer
arithmetic, so that results depend neither on partitions nor on the order of rows.

The table of vectors, dot products and clusters is written to the shared folder once a
round and the one before it deleted: lost executors repeat tasks of one round. The driver
holds ``k`` centroids and their sums. A cluster with a third of all rows is pre-aggregated
like any other.

Edge cases: vectors that are null, have a null or non-finite component or another number of
components than ``size`` take no part, nor do those whose squared norm in integers exceeds
2^60 (no distance of theirs fits a long); fewer vectors than ``k`` make that many centroids;
equal vectors among the first make equal centroids, of which the smaller number takes all and
the others stay empty and in place; rows with a null vec_id are clustered and come last among
the first centroids; repeated rows are rows each; an empty table gives no rows; an inertia
that does not fit a long is null; other columns than the two named are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, use_checkpoint_dir
from tidemark.llm.vectors import exact_dot, matrix, quantised

STATE = "vec_id {id}, x array<long>, dots array<long>, cluster int, distance long"


class _Rounds:
    """The table of one round after another, of which only the last is kept."""

    def __init__(self, spark):
        use_checkpoint_dir(spark)
        self.spark, self.base, self.path = spark, f"{spark.sparkContext.getCheckpointDir()}/centroids-{uuid.uuid4().hex}", None
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        before, self.path, self.n = self.path, f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(self.path)
        if before:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(self.path)


def updated(x: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``dots`` with ``new`` centroids, by their changed components."""
    out = dots.copy()
    for k in range(len(new)):
        changed = np.flatnonzero(new[k] != old[k])
        if len(changed):
            out[:, k] += exact_dot(x[:, changed], (new[k] - old[k])[None, changed])[:, 0]
    return out


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; ties: the smaller number."""
    norms = np.einsum("ij,ij->i", centroids, centroids)
    cluster = (norms - 2 * dots).argmin(1)
    own = np.einsum("ij,ij->i", x, x)
    return cluster, own + (norms - 2 * dots)[np.arange(len(x)), cluster]


def _assigned(df: DataFrame, kind: str, size: int, new: np.ndarray, old: np.ndarray | None) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("x"), size)
        dots = exact_dot(x, new) if old is None else updated(x, matrix(batch.column("dots"), len(new)), old, new)
        cluster, distance = nearest(x, dots, new)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dots.size + 1, dots.shape[1]), pa.int32()), pa.array(dots.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), flat, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "x", "dots", "cluster", "distance"])

    return df.mapInArrow(by_batch(run), STATE.format(id=kind))


def _means(df: DataFrame, size: int, centroids: np.ndarray) -> np.ndarray:
    sums = df.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(size)]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():  # k rows at most
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, cluster, distance) and the centroids (cluster, centroid array<long>,
    members, cluster_inertia). The first centroids are the ``k`` vectors of the smallest
    sha256 of ``seed:id``."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    kept = df.select(F.col(id_col).alias("vec_id"), F.when(F.size(vector_col) == size, quantised(vector_col, scale)).alias("x")).where("x IS NOT NULL")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), size)
    if not len(centroids):
        kept = kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return kept, spark.createDataFrame([], "cluster int, centroid array<long>, members long, cluster_inertia long")
    tables = _Rounds(spark)
    state, old = tables.keep(_assigned(kept, kind, size, centroids, None)), centroids
    for _ in range(rounds):
        old, centroids = centroids, _means(state, size, centroids)
        state = tables.keep(_assigned(state, kind, size, centroids, old))
    found = {r["cluster"]: r for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.try_sum("distance").alias("s")).collect()}
    rows = [(i, c.tolist(), found[i]["n"] if i in found else 0, found[i]["s"] if i in found else 0) for i, c in enumerate(centroids)]
    return state.select("vec_id", "cluster", "distance"), spark.createDataFrame(rows, "cluster int, centroid array<long>, members long, cluster_inertia long")
