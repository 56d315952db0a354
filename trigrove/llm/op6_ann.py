"""Approximate nearest neighbours with a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigrove.llm.common import materialize, table

TREES, BITS, SEED = 96, 64, 11
#: Rows of one block of data and of queries, and the tree entries gathered for a query: GATHER times the root of the block's rows.
BLOCK_ROWS, QUERY_ROWS, GATHER = 16384, 8192, 40


def hash_strings(vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(trees, rows) strings of ``bits`` signs of random projections, first sign in the highest bit of a uint64."""
    planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], bits))
    weights = np.left_shift(np.uint64(1), np.arange(bits - 1, -1, -1, dtype=np.uint64))
    return np.stack([((vectors @ p) > 0) @ weights for p in planes])


class Forest:
    """A sorted array of long hash strings for each tree over the rows of one block."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.args, self.bits = (trees, bits, seed), bits
        codes = hash_strings(vectors, *self.args)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the rows that share the longest prefixes with it.

        Descending is a binary search for the query's prefix in each sorted array; then all trees ascend
        together, one bit at a time, until their matching ranges hold ``least`` entries or the root is reached.
        """
        codes = hash_strings(queries, *self.args)
        trees, n = codes.shape
        low, high = np.zeros((trees, n), np.int64), np.full((trees, n), self.codes.shape[1], np.int64)
        open_ = np.ones(n, bool)
        for depth in range(1, self.bits + 1):
            # from the root downwards: the deepest level whose ranges still hold enough is where ascending stops
            span = np.uint64(self.bits - depth)
            first = (codes >> span) << span
            last = first | ((np.uint64(1) << span) - np.uint64(1))
            lo = np.stack([np.searchsorted(c, f, "left") for c, f in zip(self.codes, first, strict=True)])
            hi = np.stack([np.searchsorted(c, x, "right") for c, x in zip(self.codes, last, strict=True)])
            open_ &= (hi - lo).sum(axis=0) >= least
            if not open_.any():
                break
            low[:, open_], high[:, open_] = lo[:, open_], hi[:, open_]
        for k in range(n):
            yield np.unique(np.concatenate([o[a:b] for o, a, b in zip(self.order, low[:, k], high[:, k], strict=True)]))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, gather: float) -> pd.DataFrame:
    """The k best found rows of a block for each query, by cosine in double precision, ties to the smaller id.

    The forest ascends until it holds gather * sqrt(rows) entries, and for at least 4 * k rows besides the query's own.
    """
    norms, forest = np.linalg.norm(vectors, axis=1), Forest(vectors)
    least = max(int(gather * len(ids) ** 0.5), (4 * k + 1) * TREES)
    out = []
    for q, own, found in zip(query_ids, queries, forest.candidates(queries, least), strict=True):
        found = found[ids[found] != q]
        score = (vectors[found] @ own) / (norms[found] * np.linalg.norm(own))
        if len(found) > 4 * k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= cut], score[score >= cut]
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), q, np.int64), ids[found][best], score[best]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` -> ``(vec_id, v)`` in double; rows without an id, null, empty or zero vectors and vectors with null or non-finite parts go; of repeated ids the smallest vector stays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 5, gather: float = GATHER) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding, ...)`` that ``is_query`` holds for, the k nearest others found.

    Returns query_id, rank, vec_id, score (cosine, double). All rows are indexed, in hash blocks of about
    BLOCK_ROWS rows; every query block meets every data block once, as a stated set of queries against all rows
    in blocks, and each block answers with its k best, so that nothing larger than two blocks is ever together.
    A row moves once for each QUERY_ROWS queries, a query once for each BLOCK_ROWS rows.
    Vectors of different lengths are not compared. Unusable vectors (see ``usable``) take no part. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = materialize(usable(vectors).withColumn("dim", F.size("v")))
    queries = rows.where(is_query)
    blocks, parts = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "block", "part"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return search_block(left["vec_id"].to_numpy(), np.stack(left["v"].to_list()), right["vec_id"].to_numpy(), np.stack(right["v"].to_list()), k, gather)

    found = data.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
