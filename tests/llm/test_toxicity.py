"""Toxicity: the learner against a plain version, held-out documents, odd rows."""

import math
import random

import numpy as np
import pytest
from conftest_words import words

from trigrove.llm import op12_toxicity as op12


def plain_ftrl(rows, labels, passes):
    """One coordinate after the other, as the formulas are usually written."""
    z, n = {0: 0.0}, {0: 0.0}

    def weight(k):
        if k == 0:
            return -z[0] / ((op12.BETA + math.sqrt(n[0])) / op12.ALPHA + op12.L2)
        if abs(z.get(k, 0.0)) <= op12.L1:
            return 0.0
        return -(z[k] - math.copysign(op12.L1, z[k])) / ((op12.BETA + math.sqrt(n[k])) / op12.ALPHA + op12.L2)

    for _ in range(passes):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in (0, *row)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k, x in w.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / op12.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * x
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def test_the_learner_equals_the_plain_version():
    r = random.Random(3)
    rows = [sorted(r.sample(range(1, 40), r.randrange(0, 12))) for _ in range(300)]
    labels = [int(5 in x or (7 in x and 9 in x)) for x in rows]
    z, n = np.zeros(40), np.zeros(40)
    for _ in range(3):
        op12.learn(z, n, [np.array(x, np.int64) for x in rows], labels)
    want = plain_ftrl(rows, labels, 3)
    assert np.allclose(op12.weights(z, n)[1:], [want.get(k, 0.0) for k in range(1, 40)])
    assert want[5] > 1 and sum(w == 0 for w in want.values()) > 15


def test_features_of_pairs_and_gaps():
    f = op12.Features()
    one, two = f.of("a b c d"), f.of("A, b!  c d")
    assert (one == two).all() and len(one) == 4 + 3 + 2 + 2 + 1
    assert len(f.of(None)) == len(f.of(" ?! ")) == 0 and len(np.intersect1d(f.of("b a"), f.of("a b"))) == 2
    assert len(np.intersect1d(f.of("a x c"), f.of("a y c"))) == 3 and len(np.intersect1d(f.of("unkindly"), f.of("unkindest"))) == 3
    repeated = f.of("a b " * 500)
    assert len(repeated) < 20 and (repeated != op12.BIAS).all()


def labelled(spark, n=600):
    """Every third text holds one of two words, or one pair of words that are harmless alone."""
    rows, labels = [], []
    for k in range(n):
        text, bad = words(k, 30, 60), k % 3 == 0
        put = ["vile", "rotten", "bad seed"][k % 9 // 3] if bad else ["bad", "seed"][k % 2]
        rows.append((k, f"{text} {put} {words(k + n, 20, 60)}"))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_words_are_learnt_in_one_shard_and_in_several(spark):
    docs, labels = labelled(spark)
    for rows in (op12.SHARD_ROWS, 100):
        kept, op12.SHARD_ROWS = op12.SHARD_ROWS, rows
        try:
            found = op12.toxicity(docs, labels).collect()
            model = op12.train(docs, labels)
        finally:
            op12.SHARD_ROWS = kept
        held = [r for r in found if r.held_out]
        assert len(found) == 600 and len(held) > 80
        assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)
        assert len(model.keys) < 300


def test_held_out_documents(spark):
    docs = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{docs}/labels.parquet").collect()}
    held = [r for r in op12.op12_toxicity(spark, docs).where("held_out").collect() if r.doc_id in truth]
    good = [r for r in held if r.predicted == truth[r.doc_id]]
    assert len(held) > 700 and len(good) >= 0.97 * len(held)
    assert sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.01 * len(held)


def test_labels_of_held_out_documents_change_nothing(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("toxic", op12.F.when(op12.held_out(op12.F.col("doc_id")), 1 - op12.F.col("toxic")).otherwise(op12.F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in op12.toxicity(docs, x).collect()} for x in (labels, turned))
    assert one == pytest.approx(two)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(-20, 20)] + [(None, 1, 1), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = op12.toxicity(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert not any(r.held_out for r in found if r.doc_id is None)
    empty = {r.score for r in found if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert op12.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in op12.toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}
    only = {r.predicted for r in op12.toxicity(odd_docs, labels.where("toxic = 0")).collect()}
    assert only == {0}
