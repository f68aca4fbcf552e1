"""Centroid clustering of integer vectors with native expressions only.

A vector is kept when it has exactly ``dims`` components, none of them null or
non-finite; component x becomes the integer floor(scale * x).  Distances are
integers: ``zip_with`` squares the differences to a literal centroid array,
``aggregate`` adds them up, and ``array_min`` over structs of (distance,
cluster) picks the nearest centroid, the smaller number on a tie.  One round is
one scan and one aggregate of at most ``k`` rows: the component sums and the
count of each cluster.  New centroids are exact floors of sum / count, taken on
the driver from those ``k`` rows; a centroid without vectors stays.

Nothing but k x dims sums and k ids leaves the tasks, whatever the input, and a
cluster that holds all vectors costs no more than any other.

Defined results.  Null, short, long and non-finite vectors have no row; an
empty table gives none.  Repeated rows and ids are clustered one by one; equal
vectors share their cluster.  Rows of one start hash (repeated ids) are ordered
by their components; a null id never starts a centroid before one that is not
null.  With fewer than ``k`` kept vectors there are as many centroids.  Integers
beyond +-LIMIT are taken as +-LIMIT (|x| over two million), so that a distance
always fits 64 bits; an inertia beyond 64 bits is null.  Extra columns, whatever
their names, are left aside.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
#: 64 x (2 x LIMIT)^2 < 2^63
LIMIT = 1 << 27


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as bigint."""
    edge = float(LIMIT)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x.cast("double") * scale))))


def whole(vector: Column, dims: int = DIMS) -> Column:
    """True for vectors of ``dims`` finite components.  The sum of x * 0 is 0
    only where no component is infinite or NaN; a null makes it null."""
    finite = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * 0.0) == 0.0
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def kept(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v): the integer vectors."""
    return vectors.select(F.col(key).alias("id"), F.col(column).alias("x")).where(whole(F.col("x"), dims)).select("id", integers(F.col("x"), scale).alias("v"))


def start(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors of the k smallest sha256 of ``<seed>:<id>``."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in points.select(at.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid."""
    def to(k: int, c: list[int]) -> Column:
        squares = F.zip_with(v, literal(c), lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("distance"), F.lit(k).alias("cluster"))
    return F.array_min(F.array(*[to(k, c) for k, c in enumerate(centroids)]))


def improve(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: assign, then floor(sum / count) of every cluster with vectors.
    64-bit sums hold 2^36 vectors of the largest components."""
    dims = range(len(centroids[0]))
    sums = points.groupBy(nearest(F.col("v"), centroids)["cluster"].alias("cluster")).agg(
        F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in dims])
    out = list(centroids)
    for r in sums.collect():  # at most one row per centroid
        out[r.cluster] = [r[f"s{i}"] // r.n for i in dims]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE,
            k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256 and the cluster's centroid."""
    points = kept(vectors, key, column, dims, scale)
    centroids = start(points, k, seed)
    if not centroids:
        nothing = points.where("false").select(F.col("id").alias(key))
        return nothing.selectExpr(f"`{key}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "array(0L) AS centroid")
    for _ in range(rounds):
        centroids = improve(points, centroids)
    near = points.select("id", nearest(F.col("v"), centroids).alias("near"))
    rows = C.stored(near.select("id", "near.cluster", "near.distance"), "clusters")
    # distances may add up to more than 64 bits: decimals, then null beyond
    totals = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    about = F.array(*[F.struct(
        F.lit(fits(totals.get(i, 0))).cast("bigint").alias("cluster_inertia"),
        F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()).alias("centroid_sha256"),
        literal(c).alias("centroid")) for i, c in enumerate(centroids)])
    at = about[F.col("cluster")]
    return rows.select(F.col("id").alias(key), "cluster", "distance", at["cluster_inertia"].alias("cluster_inertia"),
                       F.lit(fits(sum(totals.values()))).cast("bigint").alias("inertia"), at["centroid_sha256"].alias("centroid_sha256"), at["centroid"].alias("centroid"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.ensure_checkpoint_dir(spark)
    return cluster(C.table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same with rows of (vector, centroid) and sums per component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row, min(d * {CENTROIDS} + c) // {CENTROIDS} AS distance, min(d * {CENTROIDS} + c) % {CENTROIDS} AS cluster
  FROM (SELECT p.row, k.c, list_sum(list_transform(list_zip(p.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM points p, centroids{r} k)
  GROUP BY row)""")
        if r < rounds:
            steps.append(f"""centroids{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM centroids{r} k LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS v FROM (
      SELECT cluster, i, (s - ((s % n) + n) % n) // n AS x FROM (
        SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points) JOIN near{r} USING (row) GROUP BY cluster, i))
    GROUP BY cluster) m ON k.c = m.cluster)""")
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM points ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CENTROIDS}),
{", ".join(steps)},
inertias AS (SELECT cluster, sum(distance) AS s FROM near{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM inertias)::BIGINT AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN points USING (row) JOIN inertias USING (cluster) JOIN centroids{rounds} k ON k.c = cluster
"""
