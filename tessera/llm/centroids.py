"""Operator 12: k-means over integer vectors with an incremental matrix of dot products.

Vectors become integers ``floor(scale * x)``.  With every vector stand its squared norm
and its exact dot products with all k centroids, so a squared distance is

    |v|^2 - 2 v.c + |c|^2

and needs no pass over the components.  When centroids move, a dot product changes by
v . (new - old), which only the components that moved enter:

1. one narrow pass reads vectors and dot products, adds the changes of the moved
   components, takes the nearest centroid again and writes the table anew (``materialize``),
2. one grouped sum per component over the clusters, combined before the shuffle, gives the
   next centroids: k rows come to the driver, whatever the table's size.

Rounds after which no component moved change nothing and end the loop.  The former table is
deleted when the next one stands, so two are kept at most; a lost executor costs
its unfinished tasks, since every round starts from a written table.

Sums of products are taken in doubles where they are below 2**53, and in 64-bit integers else.

Defined results: vectors that are null, have another length than ``dim``, or hold null or
non-finite components take no part, nor do those with a component beyond ``most_component``,
whose squared distances 64 bits could not hold; a null id takes part (as an empty string where
ids are hashed); rows that repeat an id are vectors of their own, and where ids tie as starting
centroids the smaller vector comes first; with fewer than k vectors all are centroids; an
empty table gives no rows; an inertia beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

DIM, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Sums of products of doubles are exact below this.
EXACT = 2**53
LONG = 2**63 - 1


def most_component(dim: int) -> int:
    """The largest component for which every squared distance stays within 64 bits."""
    return isqrt(2**60 // dim)


def quantised(vector: Column, dim: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector takes part, and its integer components."""
    x = lambda v: F.floor(v.cast("double") * scale)
    fits = lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) <= float(most_component(dim)))  # noqa: E731  no for NaN and infinity
    whole = lambda v: fits(v) & ~F.isnan(v.cast("double"))
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, whole), F.transform(vector, lambda v: x(v).cast("long"))


def products(vt: np.ndarray, change: np.ndarray, most: int) -> np.ndarray:
    """change . v for every column of ``vt``, over the components that change."""
    moved = np.flatnonzero(change)
    if not len(moved):
        return np.zeros(vt.shape[1], np.int64)
    if most * int(np.abs(change).max()) * len(moved) < EXACT:
        return (change[moved].astype(float) @ vt[moved]).astype(np.int64)
    return change[moved] @ vt[moved].astype(np.int64)


def nearest(norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number of equal ones) and its squared distance; ``dots`` is (k, n)."""
    far = norms - 2 * dots + (centroids * centroids).sum(axis=1)[:, None]
    cluster = far.argmin(axis=0)
    return cluster, far[cluster, np.arange(far.shape[1])]


def _pass(rows: DataFrame, keep: list, before: np.ndarray | None, centroids: np.ndarray, label: str) -> DataFrame:
    """The next state table: dot products brought from ``before`` (None: not there yet) to ``centroids``."""
    dim, k = centroids.shape[1], len(centroids)
    change = centroids if before is None else centroids - before
    schema = StructType([*keep, *StructType.fromDDL("__v array<bigint>, __dots array<bigint>, __cluster int, __distance bigint")])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, named = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            v = named["__v"].flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            vt, most = np.ascontiguousarray(v.T.astype(float)), int(np.abs(v).max())
            dots = np.zeros((k, n), np.int64) if before is None else named["__dots"].flatten().to_numpy(zero_copy_only=False).reshape(n, k).T.copy()
            for c in range(k):
                dots[c] += products(vt, change[c], most)
            cluster, distance = nearest((v * v).sum(axis=1), dots, centroids)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(np.ascontiguousarray(dots.T).ravel()))
            named |= {"__dots": lists, "__cluster": pa.array(cluster.astype(np.int32)), "__distance": pa.array(distance)}
            yield pa.RecordBatch.from_arrays([named[f] for f in schema.names], names=schema.names)

    return common.materialize(rows.mapInArrow(run, schema), label)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty one stays."""
    sums = [F.sum(F.get("__v", F.lit(j))).alias(f"s{j}") for j in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("__cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows
        out[row["__cluster"]] = [row[f"s{j}"] // row["n"] for j in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of each vector.

    The first centroids are the k vectors with the smallest sha256 of ``seed:id``.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    good, v = quantised(F.col(vector), dim, scale)
    kept = vectors.where(good).select(F.col(vec_id).alias("__id"), v.alias("__v"))
    keep = [kept.schema["__id"]]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "__v").limit(k).select("__v").collect()  # k rows
    named = [F.col("__id").alias(vec_id), F.col("__cluster").alias("cluster"), F.col("__distance").alias("distance")]
    if not first:
        nothing = "CAST(NULL AS bigint) cluster_inertia", "CAST(NULL AS bigint) inertia", "CAST(NULL AS string) centroid_sha256", "CAST(NULL AS array<bigint>) centroid"
        return kept.where(F.lit(False)).select(F.col("__id").alias(vec_id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *map(F.expr, nothing))
    centroids = np.array([r[0] for r in first], np.int64)
    state = _pass(kept, keep, None, centroids, "centroids-0")
    for r in range(rounds):
        moved = _means(state, centroids)
        if np.array_equal(moved, centroids):
            break
        former, state = state, _pass(state, keep, centroids, moved, f"centroids-{r + 1}")
        common.release(former)
        centroids = moved
    sums = {r["__cluster"]: int(r["s"]) for r in state.groupBy("__cluster").agg(F.sum(F.col("__distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    fits = lambda x: x if x <= LONG else None
    total = fits(sum(sums.values()))
    facts = [(c, fits(s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, s in sorted(sums.items())]
    small = spark.createDataFrame(facts, "__cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>")  # k rows
    return state.join(F.broadcast(small), "__cluster").select(*named, "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql(dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""v AS MATERIALIZED (SELECT r, j, CAST(floor({scale} * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS q
  FROM (SELECT r, embedding, unnest(range(1, {dim + 1})) AS j FROM kept))""",
        f"chosen AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, j, q FROM chosen JOIN v USING (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, c, distance FROM (SELECT v.r, m.c, sum((v.q - m.q) * (v.q - m.q)) AS distance FROM v JOIN c{i} m USING (j) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, j, CAST(CASE WHEN n IS NULL THEN q ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS q
  FROM c{i} LEFT JOIN (SELECT c, j, count(*) AS n, sum(q) AS s FROM a{i} JOIN v USING (r) GROUP BY c, j) USING (c, j))""")
    return f"""WITH {", ".join(parts)},
hashes AS (SELECT c, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN hashes USING (c)"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": _sql()}
