"""The mentions of a sentence beside its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENT = ["doc_id", "sent_idx"]


def beside_text(mentions: DataFrame, sentences: DataFrame, mention: Column) -> DataFrame:
    """A row for each sentence that has mentions: doc_id, sent_idx, sent_text and ``ms``, all its ``mention`` in their order.

    Both tables go through one shuffle together, by sentence, and no mention is joined with another one: what
    asks for pairs finds them inside ``ms``. A sentence, not a document, is the group, so none grows with the corpus.
    Mentions of sentences without a text go.
    """
    kind = mentions.select(mention.alias("m")).schema["m"].dataType
    one = mentions.select(*SENT, mention.alias("m"), F.lit(None).cast("string").alias("t"))
    two = sentences.select(*SENT, F.lit(None).cast(kind).alias("m"), F.col("sent_text").alias("t"))
    both = one.unionByName(two).groupBy(*SENT).agg(F.array_sort(F.collect_list("m")).alias("ms"), F.max("t").alias("sent_text"))
    return both.where((F.size("ms") > 0) & F.col("sent_text").isNotNull())
