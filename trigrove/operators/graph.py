"""Triples as a graph of nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.functions.numbering import dense_number
from trigrove.operators.grams import texts_with_words

# The colours that nodes take in turn.
PALETTE = ("#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F", "#BB8FCE", "#85C1E9", "#F0B27A", "#82E0AA")
NODE_SIZE = 20
#: So many keywords at most are sent to all tasks; more go through an index of short parts.
BROADCAST_WORDS = 1000


def graph_nodes(triples: DataFrame) -> DataFrame:
    """Both ends as ``name``. Hub names are reduced before the shuffle."""
    return triples.select(F.explode(F.array("e1", "e2")).alias("name")).where("name is not null").distinct()


def graph_edges(triples: DataFrame) -> DataFrame:
    return triples.where("e1 is not null and rel is not null and e2 is not null").select(F.col("e1").alias("entity1"), F.col("rel").alias("relation"), F.col("e2").alias("entity2")).distinct()


def merge_nodes(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes(name)`` with the triples' ends; merging again adds nothing."""
    return nodes.unionByName(graph_nodes(triples).join(nodes, "name", "left_anti"))


def merge_edges(triples: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges(entity1, relation, entity2)`` with the triples; edges of other types and loops stay apart."""
    return edges.unionByName(graph_edges(triples).join(edges, ["entity1", "relation", "entity2"], "left_anti"))


def import_plan(triples: DataFrame, batch_size: int = 500) -> DataFrame:
    """Rows per batch and relation type, batches cut in the order of ``ordinal``."""
    numbered = dense_number(triples, "ordinal", "n", ("e1", "rel", "e2"), start=0)
    return numbered.groupBy(F.expr(f"cast(n div {batch_size} as int)").alias("batch"), "rel").agg(F.count(F.lit(1)).alias("n_rows"))


def query_all(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    return edges.join(nodes.select(F.col("name").alias("entity1")), "entity1", "left_semi").join(nodes.select(F.col("name").alias("entity2")), "entity2", "left_semi").select("entity1", "relation", "entity2")


def search_keyword(edges: DataFrame, keyword: str) -> DataFrame:
    """Edges with the keyword in either end, case-sensitive; an empty keyword finds nothing."""
    word = F.lit(keyword)
    return edges.where(F.contains("entity1", word) | F.contains("entity2", word)) if keyword else edges.limit(0)


def search_keywords(edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """``keywords(keyword)`` -> keyword beside each edge that has it in an end, all in one pass.

    Few keywords (counted) are tested against every edge. Otherwise the names that hold a keyword are found by its
    rarest short part, so that a beginning that all names share costs nothing.
    """
    words = keywords.where("keyword != ''").distinct()
    hit = lambda name: F.contains(F.col(name), F.col("keyword"))
    if words.count() <= BROADCAST_WORDS:
        return edges.join(F.broadcast(words), hit("entity1") | hit("entity2"))
    names = edges.select(F.explode(F.array("entity1", "entity2")).alias("text"))
    found = texts_with_words(names, words.select(F.col("keyword").alias("word"))).select(F.col("word").alias("keyword"), F.col("text").alias("name"))
    one = edges.join(found.withColumnRenamed("name", "entity1"), "entity1")
    two = edges.join(found.withColumnRenamed("name", "entity2"), "entity2")
    return one.unionByName(two).select(*edges.columns, "keyword").distinct()


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("n"))


def relation_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n"))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.select("relation").distinct().orderBy("relation")


def _drawn(triples: DataFrame) -> DataFrame:
    return triples.where("e1 != '' and e2 != ''")


def viz_nodes(triples: DataFrame) -> DataFrame:
    """id, idx (from 0, by first appearance; a row's first end before its second), color, size."""
    ends = _drawn(triples).select(F.posexplode(F.array("e1", "e2")).alias("end", "id"), "ordinal")
    first = ends.groupBy("id").agg(F.min(F.col("ordinal") * 2 + F.col("end")).alias("at"))
    numbered = dense_number(first, "at", "idx", ("id",), start=0)
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("idx") % len(PALETTE) + 1).cast("int"))
    return numbered.select("id", "idx", colour.alias("color"), F.lit(NODE_SIZE).alias("size"))


def viz_edges(triples: DataFrame) -> DataFrame:
    """One edge per ordered pair, with the relation of its last row."""
    best = F.max(F.struct("ordinal", "rel")).alias("m")
    return _drawn(triples).groupBy("e1", "e2").agg(best).select(F.col("e1").alias("from"), F.col("e2").alias("to"), F.col("m.rel").alias("label"))


def search_subgraph(triples: DataFrame, keyword: str) -> tuple[DataFrame, DataFrame]:
    """(viz_nodes, viz_edges) of the rows with the keyword in an end."""
    word = F.lit(keyword)
    found = triples.where(F.contains("e1", word) | F.contains("e2", word)) if keyword else triples.limit(0)
    return viz_nodes(found), viz_edges(found)
