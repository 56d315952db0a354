"""Documents to chunks, sentences and clauses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.functions import text as tx


def nonblank_documents(docs: DataFrame) -> DataFrame:
    """Drop null texts and those of white space alone."""
    return docs.where(F.col("text").isNotNull() & ~tx.is_blank(F.col("text")))


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters, cut after the last full stop, else line end, else semicolon inside; the
    next one starts ``overlap`` before the cut, or at the cut where that would not get further."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cuts = (text.rfind(mark, start, end) for mark in "。\n；")
            cut = next((c for c in cuts if c != -1), -1)
            end = cut + 1 if cut > start else end
        out.append((start, end))
        start = end if end == len(text) or end - overlap <= start else end - overlap
    return out


def chunk_text(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, chunk_idx, start_pos, end_pos, chunk_text. Blank documents have no chunk."""

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int>>")
    def bounds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_pos": a, "end_pos": b} for a, b in chunk_bounds(t, size, overlap)])

    cut = nonblank_documents(docs).select("doc_id", "text", F.posexplode(bounds("text")).alias("chunk_idx", "b"))
    piece = F.substring("text", F.col("b.start_pos") + 1, F.col("b.end_pos") - F.col("b.start_pos"))
    return cut.select("doc_id", "chunk_idx", "b.start_pos", "b.end_pos", piece.alias("chunk_text"))


def clean_chunks_join(chunks: DataFrame) -> DataFrame:
    """Put a document's chunks together again, a blank line between them; overlaps stay."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["chunk_text"]), "\n\n").alias("text"))


def split_clauses(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, clause_idx, clause: parts between commas, stops and line ends, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, tx.CLAUSE_END), tx.trim), lambda p: p != "")
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(parts).alias("clause_idx", "clause"))


def split_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sent_idx, sent_text: parts that end after a stop, semicolon or line end; blank ones are left out but counted."""
    keep = [c for c in docs.columns if c != text]
    cut = docs.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(tx.SENTENCE), F.lit(0))).alias("sent_idx", "sent_text"))
    return cut.where(~tx.is_blank(F.col("sent_text")))


def clause_subjects(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("subject", tx.clause_subject(F.col("clause")))


def carry_subject(docs: DataFrame, text: str = "text") -> DataFrame:
    """Clauses of which one that starts with 'also', 'and' and the like gets the last subject put before it.

    A fold over the document's clause array, as a subject found in a rewritten clause is carried on in turn.
    """
    parts = F.filter(F.transform(F.split(text, tx.CLAUSE_END), tx.trim), lambda p: p != "")
    nothing = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("subject"))

    def step(state, clause):
        carried = state["subject"].isNotNull() & clause.rlike(tx.CARRY)
        now = F.when(carried, F.concat(state["subject"], F.regexp_replace(clause, tx.CARRY, ""))).otherwise(clause)
        return F.struct(F.concat(state["done"], F.array(now)).alias("done"), F.coalesce(tx.clause_subject(now), state["subject"]).alias("subject"))

    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.aggregate(parts, nothing, step, lambda s: s["done"])).alias("clause_idx", "clause"))
