"""Centroid clustering and vector codes against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from trigrove.llm import op11_centroids as op11
from trigrove.llm import op13_codes as op13
from trigrove.llm.bounds import moved_since

CLASHING = "q array<int>, codes array<int>, cluster int, bounds array<double>, distance string, error string, slot string"


def whole(v, scale):
    return [math.floor(x * scale) for x in v]


def usable(v, scale):
    return v is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < 2**27 for x in v)


def nearest(q, entries):
    d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in entries]
    return d.index(min(d)), min(d)


def lloyd(points, entries, rounds):
    for _ in range(rounds):
        groups = [[] for _ in entries]
        for q in points:
            groups[nearest(q, entries)[0]].append(q)
        entries = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, entries, strict=True)]
    return entries


def brute_clusters(rows, k, rounds, dim, scale):
    kept = [(i, whole(v, scale)) for i, v in rows if v is not None and len(v) == dim and usable(v, scale)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = lloyd([q for _, q in kept], [q for _, q in start], rounds)
    out = [(i, *nearest(q, centroids)) for i, q in kept]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda c: sum(d for _, x, d in out if x == c)
    return sorted(((i, c, d, of(c), sum(d for *_, d in out), digests[c]) for i, c, d in out), key=str)


def brute_codes(rows, parts, entries, rounds, dim, scale):
    kept = [(i, label, whole(v, scale)) for i, v, label in rows if v is not None and len(v) == dim and usable(v, scale)]
    start = [q for _, q in sorted((i, q) for i, _, q in kept if i is not None)[:entries]]
    w, books, codes, errors = dim // parts, [], [[] for _ in kept], [0] * len(kept)
    for p in range(parts):
        own = [q[p * w : p * w + w] for *_, q in kept]
        book = lloyd(own, [q[p * w : p * w + w] for q in start], rounds)
        books += [x for e in book for x in e]
        for k, q in enumerate(own):
            e, d = nearest(q, book)
            codes[k].append(f"{e:02x}")
            errors[k] += d
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    of = lambda label: sum(e for (_, x, _), e in zip(kept, errors, strict=True) if x == label)
    return sorted(((i, "".join(c), e, of(label), digest) for (i, label, _), c, e in zip(kept, codes, errors, strict=True)), key=str)


def vectors(spark, rows):
    """rows: (vec_id, embedding, label)."""
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], f"vec_id long, embedding array<double>, label int, {CLASHING}")


def odd_rows(dim, n=60, seed=5):
    """Vectors in a few knots with ties, and unusable ones of each kind."""
    r = np.random.default_rng(seed)
    rows = [(k, (r.integers(-3, 4, dim) / 4 + (k % 5)).tolist(), k % 3) for k in range(n)]
    rows += [(0, rows[0][1], 0), (1, rows[2][1], None), (None, rows[3][1], None), (n + 1, None, 1), (n + 2, [], 1), (n + 3, [0.0] * dim, 1), (n + 4, [None] + [0.0] * (dim - 1), 1), (n + 5, [float("nan")] * dim, 1)]
    return rows + [(n + 6, [float("inf")] * dim, 1), (n + 7, [1e30] * dim, 1), (n + 8, [1.0] * (dim - 1), 1), (-7, [-0.0001] * dim, 2)]


@pytest.mark.parametrize("k", [8, 100])
def test_clusters_equal_the_plain_version(spark, k):
    rows = odd_rows(6)
    found = op11.clustered(vectors(spark, rows), k=k, rounds=3, dim=6)
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters([r[:2] for r in rows], k, 3, 6, 1024)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_all_test_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_clusters([(r.vec_id, r.embedding) for r in table.collect()], 8, 10, 64, 1024)
    assert sorted(map(tuple, op11.op11_centroids(spark, sf_dir).collect()), key=str) == want


def test_bounds_leave_distances_out(spark):
    r = np.random.default_rng(1)
    rows = [(k, (r.standard_normal(64) * 0.05 + np.eye(64)[k % 8] * 3).tolist(), 0) for k in range(400)]
    points, history = op11.cluster(vectors(spark, rows))
    scans = points.selectExpr("sum(scans) as n").first()["n"]
    assert history.shape == (11, 8, 64) and scans < 400 * 8 * 11 / 3
    codes, books = op13.compress(vectors(spark, rows), entries=8, rounds=6)
    assert books.shape == (7, 16, 8, 4) and codes.selectExpr("sum(scans) as n").first()["n"] < 400 * 16 * 8 * 7 * 3 / 4


def test_net_displacement_is_never_above_the_summed_drifts():
    history = np.random.default_rng(2).integers(-50, 50, (6, 8, 5))
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(axis=-1))
    summed = np.concatenate([steps[::-1].cumsum(axis=0)[::-1], np.zeros((1, 8))])
    net = moved_since(history)
    assert (net <= summed * (1 + 1e-8)).all() and (net[:-2] < summed[:-2] * 0.95).any()


def test_no_usable_vectors(spark):
    none = vectors(spark, [(1, None, 1), (2, [1.0], 1), (None, [0.5] * 64, 1)])
    for frame in (none, none.limit(0)):
        assert op11.clustered(frame).collect() == [] and op13.compressed(frame).collect() == []


@pytest.mark.parametrize(("entries", "rounds"), [(1, 2), (64, 2), (5, 4)])
def test_codes_equal_the_plain_version(spark, entries, rounds):
    rows = odd_rows(8)
    found = op13.compressed(vectors(spark, rows), parts=4, entries=entries, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, 4, entries, rounds, 8, 256)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_all_test_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_codes([(r.vec_id, r.embedding, r.label) for r in table.collect()], 16, 64, 2, 64, 256)
    assert sorted(map(tuple, op13.op13_codes(spark, sf_dir).collect()), key=str) == want


def test_more_labels_than_are_broadcast(spark):
    rows = odd_rows(8)
    kept, op13.BROADCAST_LABELS = op13.BROADCAST_LABELS, 0
    try:
        found = op13.compressed(vectors(spark, rows), parts=4, entries=4)
        assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, 4, 4, 2, 8, 256)
    finally:
        op13.BROADCAST_LABELS = kept
