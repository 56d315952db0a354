"""Upkeep of a triple table: edits, pages, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.functions.numbering import dense_number

TRIPLE = ["e1", "rel", "e2"]


def update_triples(triples: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with a row_id of ``edits(row_id, e1, rel, e2)`` take its values; edits of rows that are not there do nothing."""
    new = edits.dropDuplicates(["row_id"]).select("row_id", F.struct(*TRIPLE).alias("_new"))
    met = triples.join(new, "row_id", "left")
    return met.withColumns({c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in TRIPLE}).select(triples.columns)


def delete_triples(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of ``ids(row_id)``, numbered anew from 0 in their order."""
    rest = triples.join(ids.select("row_id"), "row_id", "left_anti")
    return dense_number(rest.withColumnRenamed("row_id", "_old"), "_old", "row_id", start=0).select(triples.columns)


def add_triples(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows of which all three parts are non-empty; no deduplication."""
    return triples.unionByName(rows.where(" and ".join(f"{c} != ''" for c in TRIPLE)), allowMissingColumns=True)


def clear_triples(triples: DataFrame) -> DataFrame:
    return triples.limit(0)


def triple_stats(triples: DataFrame) -> DataFrame:
    """total, entities (distinct over both ends), relations (= total), relation_types."""
    ends = triples.select(F.explode(F.array("e1", "e2")).alias("name")).agg(F.count_distinct("name").alias("entities"))
    return triples.agg(F.count(F.lit(1)).alias("total"), F.count(F.lit(1)).alias("relations"), F.count_distinct("rel").alias("relation_types")).join(F.broadcast(ends))


def relation_distribution(triples: DataFrame) -> DataFrame:
    """rel, n, first (smallest ordinal), by first appearance."""
    return triples.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).orderBy("first")


def page(triples: DataFrame, number: int, size: int = 20) -> DataFrame:
    """Page ``number`` from 1, in the order of ``ordinal``."""
    return triples.orderBy("ordinal", *TRIPLE).offset((number - 1) * size).limit(size)


def write_pages(triples: DataFrame, path: str, rows_per_group: int = 100_000) -> None:
    """Store the rows with a dense ``row_id`` from 0, by ``ordinal``, clustered by it.

    Files and row groups then hold ranges of ids, which their statistics show to a reader of one page.
    """
    numbered = dense_number(triples, "ordinal", "row_id", tuple(TRIPLE), start=0)
    group_bytes = rows_per_group * 64
    numbered.sortWithinPartitions("row_id").write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def page_by_id(stored_: DataFrame, number: int, size: int = 20) -> DataFrame:
    """Page ``number`` from 1 of a table of ``write_pages``: a range filter that reaches the scan, at any depth."""
    return stored_.where(F.col("row_id").between((number - 1) * size, number * size - 1))


def pages(total: int, size: int = 20) -> int:
    return max(0, (total - 1) // size + 1)


def preview(triples: DataFrame, n: int = 50) -> DataFrame:
    return triples.orderBy("ordinal", *TRIPLE).limit(n)
