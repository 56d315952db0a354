"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import materialize, table, text_batches

#: At most so many labelled rows are fitted on (those with the smallest hash of doc_id); scoring covers all rows.
SAMPLE_ROWS = 20_000
#: Rows of one shard, which one task learns from in order; small tables have one shard.
SHARD_ROWS = 2_500
#: Rates and penalties of FTRL-proximal; passes of a shard over its rows in the first round, and rounds after it.
ALPHA, BETA, L1, L2, PASSES, ROUNDS = 1.5, 1.0, 5.0, 0.1, 3, 4
#: Lengths of cut words.
STEMS = (4, 5, 6)
#: The coordinate of the constant; features never have it.
BIAS = np.uint64(0)

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 500_000


class Features:
    """The hashed features of a text: words, pairs, threes, and pairs with one or two words between; each counts once.

    Words are runs of letters, digits and ``_`` of the lower-cased text. Longer ones are also taken cut to their
    first STEMS letters, for languages whose words have many endings. Hashes of words are kept, at most
    ``_CACHE_WORDS`` of them. A feature is a 64-bit number; two different ones share it practically never.
    """

    def __init__(self):
        self.cache: dict[str, int] = {}

    def hashes(self, words: list[str], distinct: set[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for w in distinct.difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def grams(self, text: str | None) -> list[np.ndarray]:
        """Hashes of all features of each kind, in the order of the text, repeats included (but of cut words)."""
        words = _WORD.findall((text or "").lower())
        distinct = set(words)
        h = self.hashes(words, distinct)
        after = lambda x, n: (x[: max(0, len(h) - n)] * _MIX) ^ h[n:]
        pairs = after(h, 1)
        kinds = [h, pairs, after(pairs, 2), after(h + np.uint64(2), 2), after(h + np.uint64(4), 3)]
        for n in STEMS:
            cut = {w[:n] for w in distinct if len(w) > n}
            kinds.append(self.hashes(list(cut), cut) + np.uint64(6))
        # the lowest bit is set, so that no feature is BIAS
        return [(x * _MIX) ^ (x >> np.uint64(29)) | np.uint64(1) for x in kinds]

    def of(self, text: str | None) -> np.ndarray:
        """All features, sorted, each once."""
        return np.unique(np.concatenate(self.grams(text)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the state stands for: zero up to L1, else by each coordinate's own rate."""
    out = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, out)


def learn(z: np.ndarray, n: np.ndarray, rows: list[np.ndarray], labels: list[int]) -> None:
    """One pass of FTRL-proximal over rows of coordinates, in order; changes ``z`` and ``n``. The constant is coordinate 0, and has no L1."""
    for at, y in zip(rows, labels, strict=True):
        w = weights(z[at], n[at])
        bias = -z[0] / ((BETA + n[0] ** 0.5) / ALPHA + L2)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
        g2 = g * g
        z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g2
        z[0] += g - ((n[0] + g2) ** 0.5 - n[0] ** 0.5) / ALPHA * bias
        n[0] += g2


@dataclass(frozen=True)
class Model:
    """``keys``: sorted features with a weight; ``values``: their weights; ``bias``. Small enough for every task by its L1 penalty."""

    keys: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, features: Features, texts) -> np.ndarray:
        near = np.zeros(1 << 16, bool)
        near[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            for x in features.grams(text):
                x = x[near[(x >> np.uint64(48)).astype(np.int64)]]
                if len(x) and len(self.keys):
                    x = np.unique(x)
                    at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
                    out[k] += self.values[at][self.keys[at] == x].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["h", "doc_id"], kind="stable")


def _first_round(sample: DataFrame) -> DataFrame:
    """Each shard learns by itself, over all features it has; its features with a weight, and its constant, come out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, features = _ordered(group), Features()
        own = [features.of(t) for t in group["text"]]
        keys, at = np.unique(np.concatenate([np.zeros(1, np.uint64), *own]), return_inverse=True)
        rows, labels = np.split(at[1:], np.cumsum([len(x) for x in own])[:-1]), group["toxic"].tolist()
        z, n = np.zeros(len(keys)), np.zeros(len(keys))
        for _ in range(PASSES):
            learn(z, n, rows, labels)
        some = weights(z, n) != 0
        some[0] = True
        return pd.DataFrame({"key": keys[some].astype(np.int64), "z": z[some], "n": n[some]})

    return sample.groupBy("shard").applyInPandas(run, "key long, z double, n double")


def _hits(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """The sample's rows with the places of their features among ``keys``."""

    def run(batches):
        features = Features()
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                x = features.of(t)
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                rows.append(at[keys[at] == x].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("shard", "h", "doc_id", "toxic")] + [pa.array(rows, pa.list_(pa.int32()))], names=["shard", "h", "doc_id", "toxic", "at"])

    return sample.mapInArrow(run, "shard int, h long, doc_id long, toxic int, at array<int>")


def _round(hits: DataFrame, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shards learn on from the same state; each coordinate moves by the mean of the shards that touched it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = _ordered(group)
        own_z, own_n = z.copy(), n.copy()
        learn(own_z, own_n, [np.asarray(x, np.int64) for x in group["at"]], group["toxic"].tolist())
        some = np.flatnonzero(own_n != n)
        return pd.DataFrame({"k": some, "z": (own_z - z)[some], "n": (own_n - n)[some]})

    moves = hits.groupBy("shard").applyInPandas(run, "k long, z double, n double").groupBy("k").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
    z, n = z.copy(), n.copy()
    z[moves["k"]] += moves["z"]
    n[moves["k"]] += moves["n"]
    return z, n


def fit(sample: DataFrame, rounds: int = ROUNDS) -> Model:
    """``sample(doc_id, toxic, text)`` -> the model.

    The rows are dealt to shards of about SHARD_ROWS by a hash of doc_id. In the first round each shard learns by
    itself; features that have a weight in some shard (few, by the L1 penalty) are the coordinates of the rounds
    that follow, in which all shards start from the mean state. No rows: all texts score 0.5. One label only: the
    constant alone decides.
    """
    n_rows = sample.count()
    if not n_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    shards = -(-n_rows // SHARD_ROWS)
    dealt = materialize(sample.withColumn("h", F.xxhash64("doc_id")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")))
    first = _first_round(dealt).groupBy("key").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas()
    first = first.assign(key=first["key"].to_numpy().astype(np.uint64)).sort_values("key")
    keys, z, n = first["key"].to_numpy(), first["z"].to_numpy().copy(), first["n"].to_numpy().copy()
    hits = materialize(_hits(dealt, keys))
    for _ in range(rounds):
        z, n = _round(hits, z, n)
    w = weights(z, n)
    w[0] = 0.0
    some = w != 0
    return Model(keys[some], w[some], float(-z[0] / ((BETA + n[0] ** 0.5) / ALPHA + L2)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that are not held out: at most SAMPLE_ROWS of them, chosen by hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``_score``, from the whole text."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in batches:
            yield pd.Series(model.score(features, texts.tolist()))

    return docs.select(*keep, score(F.coalesce("text", F.lit(""))).alias("_score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts score as the constant does. A null doc_id is not held out and never labelled. Repeated
    labels of a document: the largest counts. Repeated rows give repeated rows; other columns are ignored.
    """
    model = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(own, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
