"""Documents to triples, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.operators import cleaning, patterns, relations, text


def _ordinal(df: DataFrame) -> DataFrame:
    """Place of a triple in its document: chunk, technique, rule, clause, match; a chunk has fewer clauses and matches than characters, and those are fewer than 100,000."""
    late = F.when(F.col("technique") == "template", 0).otherwise(1)
    n = (((F.col("chunk_idx").cast("long") * 2 + late) * 4096 + F.col("rule_id")) * 100_000 + F.col("clause_idx")) * 100_000 + F.col("match_idx")
    return df.withColumn("ordinal", n)


def extract_triples(docs: DataFrame, size: int = 2000, overlap: int = 200, final_distinct: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, ordinal, e1, rel, e2: chunks, clauses with carried subjects, rules and
    templates, merge by priority, expansion, deduplication, cleaning, in this order, each within its document.

    Cleaning may make equal what deduplication saw as different; ``final_distinct`` takes such rows out.
    """
    chunks = text.chunk_text(docs, size, overlap).select("doc_id", "chunk_idx", F.col("chunk_text").alias("text"))
    clauses = text.carry_subject(chunks)
    found = patterns.rule_extract(clauses).unionByName(patterns.template_extract(clauses))
    merged = relations.merge_by_priority(_ordinal(found))
    expanded = cleaning.expand_conjunctions(merged.select("doc_id", "ordinal", "e1", "rel", "e2"))
    out = cleaning.clean_triples(cleaning.dedupe_normalized(expanded, ("doc_id",)), by_name=False)
    if final_distinct:
        out = out.groupBy("doc_id", "e1", "rel", "e2").agg(F.min("ordinal").alias("ordinal"))
    return out.select("doc_id", "ordinal", "e1", "rel", "e2")
