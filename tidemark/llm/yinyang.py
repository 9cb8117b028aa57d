"""Exact Lloyd clustering with Yinyang bounds: centroids in groups, a lower bound for each group.

The centroids are put into groups once (a tenth as many groups as centroids), by a small clustering of the centroids
themselves.  A vector's row keeps its centroid, an upper bound of the distance to it, and for each group a lower bound
of the distance to the group's other centroids.  A round first moves the bounds by how far centroids moved; a vector
whose upper bound is below all lower bounds keeps its centroid unseen (global filter); else its own distance is measured
and only groups whose bound is not above it are scanned (group filter), every centroid of them exactly.  Distances are
whole numbers, bounds have room for rounding, and only bounds that are strictly apart skip anything, so ties go to the smaller number as in a full scan.

Vectors and bounds travel together in a table that each round writes anew (the one before goes); centroids are k
rows, sums and counts of which are aggregated with map-side combining, so copies of one vector are no hot spot.

Edge cases: vectors that are null, have other than ``dims`` components, or any null or non-finite one are left out; components beyond
2**27 in size after scaling raise an error (squares wouldn't fit a bigint); a null id hashes as '' ; equal hashes (repeated ids)
are ordered by their vectors; fewer vectors than k give as many centroids; an empty centroid stays; repeated rows count row by
row; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, drop_tables

#: Components that a square of a difference, summed over the dimensions, leaves within a bigint.
MOST = 1 << 27
#: Bounds are moved apart by this share, far more than their rounding.
SLACK = 1e-9
STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower array<double>, scanned int"


def whole_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the usable rows, v being whole numbers."""
    x = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"))
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where((F.size("e") == dims) & ~odd).withColumn("v", F.transform("e", lambda c: F.floor(c * scale)))
    large = F.exists("e", lambda c: F.abs(c) * scale >= MOST)
    return x.select("vec_id", F.when(large, F.raise_error(F.lit("a component is too large"))).otherwise(F.col("v").cast("array<int>")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of '<seed>:<vec_id>'; k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def grouped(centroids: np.ndarray, per_group: int = 10, rounds: int = 5) -> np.ndarray:
    """Each centroid's group, by a few rounds of clustering the centroids; groups without a centroid are left out."""
    n = max(1, len(centroids) // per_group)
    x = centroids.astype(np.float64)
    seeds = x[:: len(x) // n][:n]
    for _ in range(rounds):
        of = ((x[:, None, :] - seeds[None]) ** 2).sum(-1).argmin(1)
        seeds = np.stack([x[of == g].mean(0) if (of == g).any() else seeds[g] for g in range(n)])
    return np.unique(of, return_inverse=True)[1]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact (the terms may wrap around, their sum does not)."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None]


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round for some vectors: (cluster, upper, lower, how many centroids were measured)."""
    n_groups = int(group.max()) + 1
    most = np.array([moved[group == g].max() for g in range(n_groups)])
    cluster, scanned = cluster.copy(), np.zeros(len(x), np.int32)
    new = cluster < 0
    at = np.where(new, 0, cluster)
    upper = np.where(new, np.inf, (upper + moved[at]) * (1 + SLACK))
    lower = np.where(new[:, None], -1.0, lower * (1 - SLACK) - most[None] * (1 + SLACK))
    todo = np.flatnonzero(new | (upper >= lower.min(1)))  # global filter
    if not len(todo):
        return cluster, upper, lower, scanned
    # tightened: the distance to the own centroid (any, for new rows)
    xs, own = x[todo], at[todo]
    best = ((xs - centroids[own]) ** 2).sum(1)
    upper[todo] = np.sqrt(best) * (1 + SLACK)
    scanned[todo] += 1
    open_ = new[todo][:, None] | (upper[todo][:, None] >= lower[todo])  # group filter
    who, old, old_best = own.copy(), own.copy(), best.copy()
    least = np.full((len(todo), n_groups, 2), np.iinfo(np.int64).max)  # a scanned group's two smallest distances
    first = np.full((len(todo), n_groups), -1)
    for g in range(n_groups):
        rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if not len(rows):
            continue
        d = distances(xs[rows], centroids[members])
        scanned[todo[rows]] += len(members)
        near = d.argmin(1)  # the smaller number of equal ones
        first[rows, g] = members[near]
        least[rows, g, 0] = d[np.arange(len(rows)), near]
        if len(members) > 1:
            least[rows, g, 1] = np.partition(d, 1, axis=1)[:, 1]
        better = (least[rows, g, 0] < best[rows]) | ((least[rows, g, 0] == best[rows]) & (members[near] < who[rows]))
        who[rows[better]], best[rows[better]] = members[near][better], least[rows, g, 0][better]
    for g in range(n_groups):
        rows = np.flatnonzero(open_[:, g])
        other = np.where(first[rows, g] == who[rows], least[rows, g, 1], least[rows, g, 0])
        lower[todo[rows], g] = np.sqrt(other.astype(np.float64)) * (1 - SLACK)
        # a centroid that was left behind counts in its group's bound again, where that wasn't scanned
        left = np.flatnonzero(~open_[:, g] & (who != old) & (group[old] == g))
        lower[todo[left], g] = np.minimum(lower[todo[left], g], np.sqrt(old_best[left].astype(np.float64)) * (1 - SLACK))
    cluster[todo], upper[todo] = who, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return cluster, upper, lower, scanned


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one round; ``scanned`` is how many distances a row took."""
    dims, n_groups = centroids.shape[1], int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda i, n, kind: b.column(i).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, n)  # noqa: B023, E731
            x = flat(1, dims, np.int64)
            out = step(x, b.column(2).to_numpy(), b.column(3).to_numpy(), flat(4, n_groups, np.float64), centroids, group, moved)
            columns = [b.column(0), b.column(1), pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), _rows(out[2], pa.float64()), pa.array(out[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each centroid's mean, exactly; k rows come to the driver."""
    dims = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def clustered(vectors: DataFrame, k: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids): every vector's centroid after ``rounds`` rounds and one more assignment."""
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    group = grouped(centroids)
    moved = np.zeros(len(centroids))
    nothing = F.array_repeat(F.lit(0.0), int(group.max()) + 1)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), nothing.alias("lower"), F.lit(0).alias("scanned"))
    before = vectors
    for i in range(rounds + 1):
        state = cut(assigned(state, centroids, group, moved), "state")
        drop_tables(spark, before)
        before = state
        if i < rounds:
            new = means(state, centroids)
            moved = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
            centroids = new
    return state, centroids


def op12(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Every usable vector's cluster and distance, with its cluster's and the whole sum of distances and its centroid's digest."""
    spark = embeddings.sparkSession
    state, centroids = clustered(whole_vectors(embeddings), k, rounds, seed)
    at = spark.createDataFrame([(i, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, c array<bigint>, centroid_sha256 string")
    square = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, d: s + d)
    rows = state.join(F.broadcast(at), "cluster").select("vec_id", "cluster", square.alias("distance"), "centroid_sha256")  # k rows
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    total = sum(r["cluster_inertia"] for r in sums)
    sums = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """The same rows from any SQL engine, by a full scan in every round."""
    distance = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min((d, k)) AS best FROM (SELECT r, k, {distance} AS d FROM x CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT k, list(m ORDER BY j) AS v FROM (SELECT best[2] AS k, j, CAST((sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM x JOIN a{i} USING (r), unnest(generate_series(1, {dims})) AS u(j) GROUP BY 1, 2) GROUP BY k),"
                f"\nc{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))"
            )
    last = f"SELECT vec_id, k AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM x JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.k = best[2]"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
