"""Which texts hold which words, by an index of short parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.functions.tables import stored

#: Characters of a part; shorter words are parts themselves.
PART = 3


def parts_of(text: Column, size: Column | int) -> Column:
    """All different parts of ``size`` characters; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, size)))


def texts_with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts(text)``, ``words(word)`` -> text, word for every word that stands in a text, once each.

    A word is looked for only in the texts that have its rarest part, as counted in the texts; a word with a part
    that no text has is dropped at once. So a beginning that most words and texts share makes no pairs. Parts that
    no word has never leave the task that cut them when the words' parts are few enough for a broadcast (Spark
    decides by their size). Empty words and nulls go.
    """
    texts = texts.where("text != ''").select("text").distinct()
    words = words.where("word != ''").select("word").distinct()
    cut = stored(words.select("word", F.explode(parts_of(F.col("word"), F.least(F.length("word"), F.lit(PART)))).alias("part")))
    sizes = [r["n"] for r in cut.select(F.length("part").alias("n")).distinct().orderBy("n").collect()]
    if not sizes:
        return texts.select("text", F.col("text").alias("word")).limit(0)
    found = texts.select("text", F.explode(F.concat(*[parts_of(F.col("text"), n) for n in sizes])).alias("part"))
    found = stored(found.join(cut.select("part").distinct(), "part", "left_semi"))
    often = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = cut.join(often, "part", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("r")).where("r.n > 0")
    return found.join(rarest.select("word", F.col("r.part").alias("part")), "part").where(F.contains("text", F.col("word"))).select("text", "word")
