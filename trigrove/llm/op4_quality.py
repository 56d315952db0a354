"""Quality classifier: a sparse ensemble of rules from trees, scored by Spark column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions.once import once
from trigrove.llm.common import materialize, table

#: At most so many labelled rows are fitted on (those with the smallest hash of doc_id); scoring covers all rows.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002


def with_statistics(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """``docs`` with the columns of ``keep`` and statistics of the whole ``text``; null counts as empty.

    Classes of characters are counted by the length that goes when they are taken out, words by one split that the
    others start from. Each step stands behind a generator of one row: else every use would repeat the steps before it.
    """
    blank = r"[\x20\x09-\x0D]+"
    t, words, chars = F.col("_t"), F.col("_words"), F.col("_chars")
    gone = lambda c, pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    lost = lambda c, part: ((F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)).cast("double")
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))

    text = F.coalesce(F.col("text"), F.lit(""))
    split = once(docs.select(*keep, text.alias("_t")), _list=F.split(F.lower(F.btrim(F.col("_t"), F.lit(" \t\n\x0b\x0c\r"))), blank))
    some = F.element_at("_list", 1) != ""
    # two blanks between words: each word has its own
    spaced = F.concat(F.lit(" "), F.array_join("_list", "  "), F.lit(" "))
    counted = once(
        split, _words=F.when(some, F.size("_list")).otherwise(0).cast("double"), _spaced=F.when(some, spaced).otherwise(""), _chars=F.length(t).cast("double"), _lines=F.size(F.split(t, "\n")).cast("double"),
        _distinct=F.size(F.array_distinct("_list")).cast("double"),
    )
    s = F.col("_spaced")
    found = {
        "log_chars": F.log1p(chars), "log_words": F.log1p(words), "chars_per_word": per(chars, words), "words_per_line": per(words, F.col("_lines")),
        "upper": per(gone(t, r"\p{Lu}+"), chars), "marks_per_word": per(gone(t, r"[^\p{L}\p{N}\s.,;:'\"-]+"), words), "bars_per_word": per(lost(s, " | "), words),
        "digits": per(gone(t, r"\p{Nd}+"), chars), "stops_per_word": per(lost(s, ". ") + lost(s, "! ") + lost(s, "? "), words), "short_words": per(gone(s, r" \p{L}{1,3} "), words),
        "distinct_words": per(F.col("_distinct"), words), "distinct_lines": per(F.size(F.array_distinct(F.split(t, "\n"))).cast("double"), F.col("_lines")),
    }
    return once(counted, **{prefix + n: c for n, c in found.items()}).select(*keep, *[prefix + n for n in found])


NAMES = (
    "log_chars", "log_words", "chars_per_word", "words_per_line", "upper", "marks_per_word", "bars_per_word", "digits", "stops_per_word", "short_words", "distinct_words", "distinct_lines",
)

Condition = tuple[int, str, float]


@dataclass(frozen=True)
class RuleModel:
    """``rules``: (weight, conditions on statistics); the score is the logistic of ``base`` and the weights of the rules that hold."""

    base: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.base)
        for weight, conditions in self.rules:
            total = total + F.when(holds(conditions, prefix), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(conditions: tuple[Condition, ...], prefix: str = "") -> Column:
    out = F.lit(True)
    for k, op, at in conditions:
        value = F.col(prefix + NAMES[k])
        out = out & (value <= at if op == "<=" else value > at)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tree_paths(debug: str) -> set[tuple[Condition, ...]]:
    """Every path from the root to an inner node or leaf, as a conjunction, from the printed trees."""
    paths, stack = set(), []
    for line in debug.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            paths.add(tuple(sorted({c for _, c in stack})))
        elif re.match(r" *Tree \d+", line):
            stack = []
    return paths


def fit(labelled: DataFrame, seed: int = 7) -> RuleModel:
    """``labelled(quality, statistics...)``: shallow trees give rules, a logistic regression with an L1 penalty weighs them.

    No rows: every text scores 0.5. One label only: every text scores that label's side (0.01 or 0.99).
    """
    counts = {r["label"]: r["count"] for r in labelled.select(F.col("quality").cast("double").alias("label")).groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel(0.0 if not counts else 4.595 * (1 if next(iter(counts)) > 0 else -1), ())
    rows = VectorAssembler(inputCols=list(NAMES), outputCol="x").transform(labelled.withColumn("label", F.col("quality").cast("double")))
    trees = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.5", seed=seed).fit(rows)
    rules = sorted(tree_paths(trees.toDebugString))
    hits = labelled.select(F.col("quality").cast("double").alias("label"), *[F.when(holds(r), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(hits).select("label", "x").cache()
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(hits)
    hits.unpersist()
    weights = [float(w) for w in lasso.coefficients]
    return RuleModel(float(lasso.intercept), tuple((w, r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Fit on labelled rows that are not held out: at most SAMPLE_ROWS of them, chosen by hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = materialize(with_statistics(texts, ["doc_id", "quality"]).repartition(8, "doc_id").sortWithinPartitions("doc_id"))
    return fit(rows)


def scored(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """``docs`` with the columns of ``keep`` and ``_score``."""
    found = with_statistics(docs, keep, "_s_")
    return found.withColumn("_score", model.score("_s_")).select(*keep, "_score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored like others (all statistics 0 or 1). A null doc_id is not held out and never
    labelled. Repeated labels of a document: the smallest counts. No labels: all scores 0.5. Repeated rows give
    repeated rows; other columns are ignored.
    """
    model = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(own, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``at`` or more."""
    model = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return scored(rows, model, ["row"]).where(F.col("_score") >= at).select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
