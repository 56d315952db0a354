"""Checking triples by verdicts from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrove.operators.model import json_body

VERDICT = "struct<index:int,valid:boolean,reason:string,correction:array<string>>"


def validation_batches(triples: DataFrame, source_chars: int = 1000) -> DataFrame:
    """``triples(batch_id, ordinal, e1, rel, e2, source)`` -> batch_id, n, request. Batches are what one request holds."""
    ranked = triples.withColumn("idx", F.row_number().over(Window.partitionBy("batch_id").orderBy("ordinal", "e1", "rel", "e2")))
    line = F.concat(F.col("idx").cast("string"), F.lit(". ["), F.concat_ws(", ", "e1", "rel", "e2"), F.lit("]"))
    packed = ranked.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("ls"), F.min_by("source", "idx").alias("source"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return packed.select("batch_id", F.size("ls").alias("n"), F.concat(text, F.lit("\n---\n"), F.substring(F.coalesce("source", F.lit("")), 1, source_chars)).alias("request"))


def parse_verdicts(df: DataFrame, response: str = "response") -> DataFrame:
    """Each object of the JSON array in ``response`` as a verdict (pos, idx, valid, reason, correction); bad JSON gives none, a missing ``valid`` is true."""
    keep = [c for c in df.columns if c != response]
    items = F.from_json(json_body(F.col(response)), "array<string>")
    rows = df.select(*keep, F.posexplode(items).alias("pos", "item")).select(*keep, "pos", F.from_json("item", VERDICT).alias("v"))
    return rows.where("v.index is not null").select(*keep, "pos", F.col("v.index").alias("idx"), F.coalesce("v.valid", F.lit(True)).alias("valid"), "v.reason", "v.correction")


def apply_verdicts(triples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``triples(batch_id, idx, e1, rel, e2)`` after their verdicts: kept, corrected or dropped; the exact same triple of a batch stays once.

    Verdicts on rows that are not there are ignored; rows without a verdict stay. ``at`` orders the result:
    judged rows as their verdicts, then the others.
    """
    v = verdicts.select("batch_id", "idx", "pos", "valid", "correction")
    met = triples.join(v, ["batch_id", "idx"], "left")
    fixed = (~F.col("valid")) & (F.size("correction") == 3)
    kept = met.where(F.col("valid").isNull() | F.col("valid") | fixed)
    part = lambda k, c: F.when(fixed, F.get("correction", k)).otherwise(F.col(c)).alias(c)
    at = F.struct(F.when(F.col("pos").isNull(), 1).otherwise(0).alias("late"), F.coalesce("pos", "idx").alias("n"))
    rows = kept.select("batch_id", part(0, "e1"), part(1, "rel"), part(2, "e2"), at.alias("at"))
    return rows.groupBy("batch_id", "e1", "rel", "e2").agg(F.min("at").alias("at"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Counts of passed and failed verdicts and of those with a correction, valid or not."""
    return verdicts.agg(F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed"), F.count_if(F.size("correction") > 0).alias("corrected"))
