"""Centroid clustering with bounds that centroid history loosens by net displacement."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.bounds import SLACK, floor_means, lists, matrix, moved_since, scaled, slot_sums, squared
from trigrove.llm.common import discard, materialize, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"

STATE = "vec_id long, q array<int>, cluster int, was int, bounds array<double>, stamps array<int>, distance long, scans long"


def nearest(q: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, stamps: np.ndarray, history: np.ndarray, exact: bool = False):
    """Each row's nearest centroid of the last round, ties to the smaller number.

    ``bounds[i, j]`` is the distance of row i to centroid j as it was in round ``stamps[i, j]``. The distance now
    differs from it by at most that centroid's net displacement since. Centroids that this leaves in doubt are
    measured exactly and stamped anew; with ``exact`` the nearest one always is. ``cluster`` is -1 and stamps are
    -1 at the start. Changes ``bounds`` and ``stamps``; returns clusters, squared distances (0 where not measured)
    and the number of measured distances of each row.
    """
    rows, now, centroids = np.arange(len(q)), len(history) - 1, history[-1]
    drift = moved_since(history)
    found = np.full(bounds.shape, np.iinfo(np.int64).max)

    def measure(which: np.ndarray) -> None:
        for j in range(len(centroids)):
            at = np.flatnonzero(which[:, j])
            if len(at):
                found[at, j] = squared(q[at], centroids[j])
                bounds[at, j], stamps[at, j] = np.sqrt(found[at, j].astype(np.float64)), now

    new = stamps < 0
    if new.any():
        measure(new)
    own = np.where(cluster < 0, found.argmin(axis=1), cluster)

    def doubt() -> np.ndarray:
        loose = drift[stamps, np.arange(len(centroids))]
        upper = bounds[rows, own] + loose[rows, own]
        open_ = bounds - loose <= (upper * (1 + SLACK) + SLACK)[:, None]
        open_[rows, own] = False
        return open_ & (stamps < now)

    first = np.zeros(bounds.shape, bool)
    first[rows, own] = (doubt().any(axis=1) | exact) & (stamps[rows, own] < now)
    measure(first)
    measure(doubt())
    measured = found < np.iinfo(np.int64).max
    out = np.where(measured.any(axis=1), found.argmin(axis=1), own)
    return out, np.where(measured[rows, out], found[rows, out], 0), measured.sum(axis=1)


def step(points: DataFrame, history: np.ndarray, exact: bool = False) -> DataFrame:
    """One assignment of all points, in place: no row leaves its partition."""
    k = history.shape[1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch, "q", np.int64)
            if "bounds" in batch.schema.names:
                was, bounds, stamps = batch.column("cluster").to_numpy(), matrix(batch, "bounds", np.float64).copy(), matrix(batch, "stamps", np.int64).copy()
                scans = batch.column("scans").to_numpy()
            else:
                was, bounds, stamps, scans = np.full(len(q), -1), np.zeros((len(q), k)), np.full((len(q), k), -1), np.zeros(len(q), np.int64)
            cluster, distance, measured = nearest(q, was, bounds, stamps, history, exact)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), lists(bounds), lists(stamps.astype(np.int32)), pa.array(distance), pa.array(scans + measured)],
                names=["vec_id", "q", "cluster", "was", "bounds", "stamps", "distance", "scans"],
            )

    return points.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows that moved in the last step add to the sums and counts of the clusters they joined and left."""

    def both(batch):
        q, to, was = matrix(batch, "q", np.int64), batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
        left = was >= 0
        return np.concatenate([to, was[left]]), np.concatenate([q, -q[left]]), np.concatenate([np.ones(len(to), np.int64), np.full(left.sum(), -1)])

    return slot_sums(state.where("cluster != was"), ["q", "cluster", "was"], k, dim, both)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, embedding, ...)`` -> the points with cluster, distance and scans (measured distances so far), and the centroids of all rounds.

    The points stay in their partitions; each step writes them with their bounds and stamps and drops the table
    before. Only centroids (k * dim numbers a round) meet on the driver, from sums that the moved rows correct.
    Vectors with another number of components, with null or non-finite ones, or with one of 2**27 or more when
    scaled (their squared distances fit no long) take no part. A null vec_id is clustered, but starts no centroid.
    Repeated rows count each; of a repeated vec_id the smaller vector comes first among the starts. With fewer
    than ``k`` usable ids there are as many centroids; with none the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    points = materialize(scaled(own.where(F.size("embedding") == dim), scale, ["vec_id"]))
    start = points.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    if not start:
        return spark.createDataFrame([], STATE), np.zeros((1, 0, dim), np.int64)
    history = np.array([[r["q"] for r in start]], np.int64)
    sums, counts = np.zeros(history.shape[1:], np.int64), np.zeros(history.shape[1], np.int64)
    for _ in range(rounds):
        points, before = materialize(step(points, history)), points
        discard(before)
        more, n = _changes(points, *history.shape[1:])
        sums, counts = sums + more, counts + n
        history = np.concatenate([history, floor_means(sums, counts, history[-1])[None]])
    return materialize(step(points, history, exact=True)), history


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """Each usable vector's cluster, squared distance, the sums of distances of its cluster and of all, and its centroid's hash; see ``cluster``."""
    points, history = cluster(vectors, **settings)
    inertia = {r["cluster"]: r["d"] for r in points.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(j, d, sum(inertia.values()), digest(history[-1, j].tolist())) for j, d in inertia.items()]
    # one row for each centroid
    sides = F.broadcast(points.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return points.select("vec_id", "cluster", "distance").join(sides, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round as a table of its own: distances to all centroids, the nearest, floored means."""
    steps = [
        "kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "pts as materialized (select rid, unnest(range(64)) as i, unnest(q) as x from kept)",
        "c0 as materialized (select k, unnest(range(64)) as i, unnest(q) as c from (select q, row_number() over (order by sha256('3:' || vec_id), q) - 1 as k from kept where vec_id is not null) where k < 8)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select rid, min(struct_pack(d := d, k := k)) as a from (select rid, k, sum((x - c) * (x - c))::bigint as d from pts join c{r} using (i) group by rid, k) group by rid)")
        if r < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            sums = f"select a.k as k, i, sum(x)::bigint as s, count(*) as n from pts join a{r} using (rid) group by 1, 2"
            steps.append(f"c{r + 1} as materialized (select c{r}.k, c{r}.i, coalesce({mean}, c{r}.c) as c from c{r} left join ({sums}) m on m.k = c{r}.k and m.i = c{r}.i)")
    last = f"a{ROUNDS}"
    return (
        "with " + ", ".join(steps) + f""", h as (select k, sha256(string_agg(c::varchar, ',' order by i)) as h from c{ROUNDS} group by k)
select vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, h.h as centroid_sha256
from kept join {last} using (rid) join h on h.k = a.k"""
    )


SQL = _sql()
