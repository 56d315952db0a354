"""Table work around a model that writes triples: prompts, cache, calls, parsing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.operators.cleaning import clean_triples

PROMPTS = {
    "zero_shot": "List the facts of the text as a JSON array of [subject, relation, object].\nText:\n",
    "few_shot": 'List the facts of the text as a JSON array of [subject, relation, object].\nExample: 华为总部位于深圳 -> [["华为", "位于", "深圳"]]\nText:\n',
}


def build_prompts(docs: DataFrame, mode: str = "few_shot") -> DataFrame:
    return docs.withColumn("prompt", F.concat(F.lit(PROMPTS[mode]), F.col("text")))


def cache_keys(docs: DataFrame, mode: str, model: str) -> DataFrame:
    """md5 of ``mode:model:text``."""
    return docs.withColumn("cache_key", F.md5(F.concat_ws(":", F.lit(mode), F.lit(model), F.col("text"))))


def cache_lookup(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored ``triples``, one row of each key that is not stored)."""
    stored = cache.dropDuplicates(["cache_key"])
    return keyed.join(stored, "cache_key"), keyed.join(stored, "cache_key", "left_anti").dropDuplicates(["cache_key"])


def infer_batch(prompts: DataFrame, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """Add ``response``: what ``call`` makes of a batch of prompts; empty for a batch of which the call fails."""

    def run(batches):
        for pdf in batches:
            try:
                answers = [a if isinstance(a, str) else "" for a in call(pdf["prompt"].tolist())]
            except Exception:
                answers = [""] * len(pdf)
            yield pdf.assign(response=pd.Series(answers, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, response string")


def cache_update(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with new ``(cache_key, triples)``; failed calls (null) are not stored, stored keys stay."""
    new = results.where("triples is not null").select("cache_key", "triples").dropDuplicates(["cache_key"])
    return cache.unionByName(new.join(cache, "cache_key", "left_anti"))


def json_body(response: Column) -> Column:
    """From the first ``[`` to the last ``]``, without code fences; null if there are none."""
    bare = F.regexp_replace(response, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))


def raw_model_triples(df: DataFrame, response: str = "response") -> DataFrame:
    """Each three-part item of the JSON array in ``response`` as a row (item, e1, rel, e2); items with nulls go.

    If the array is not valid JSON, whatever looks like ``["a", "b", "c"]`` counts.
    """
    keep = [c for c in df.columns if c != response]
    body = json_body(F.col(response))
    items = F.transform(F.from_json(body, "array<string>"), lambda i: F.from_json(i, "array<string>"))
    three = r'\[\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"\s*\]'
    loose = F.transform(F.regexp_extract_all(response, F.lit(three), F.lit(0)), lambda i: F.from_json(i, "array<string>"))
    rows = df.select(*keep, F.posexplode(F.coalesce(items, loose)).alias("item", "t")).where("size(t) = 3")
    out = rows.select(*keep, "item", F.get("t", 0).alias("e1"), F.get("t", 1).alias("rel"), F.get("t", 2).alias("e2"))
    return out.where("e1 is not null and rel is not null and e2 is not null")


def parse_model_triples(df: DataFrame, response: str = "response") -> DataFrame:
    """``raw_model_triples``, each cleaned."""
    return clean_triples(raw_model_triples(df, response))


def allocate_batch_results(results: DataFrame) -> DataFrame:
    """``results(batch_id, n_texts, rn from 1, ...)``: deal a batch's N results to its texts in order, N div n each, the rest to the last.

    The count of a batch is summed by key; a batch holds what one call returned.
    """
    sizes = results.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    per = F.expr("_n div n_texts")
    text = F.when(per == 0, F.col("n_texts") - 1).otherwise(F.least(F.expr("(rn - 1) div greatest(_n div n_texts, 1)"), F.col("n_texts") - 1))
    return results.join(sizes, "batch_id").withColumn("text_idx", text.cast("int")).drop("_n")
