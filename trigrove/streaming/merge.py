"""Triple streams: each micro-batch is merged into stored node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trigrove.operators.graph import graph_edges, graph_nodes
from trigrove.sources.store import KeyedStore

#: Schema and keys of the two tables.
NODES, EDGES = ("name string", ["name"]), ("entity1 string, relation string, entity2 string", ["entity1", "relation", "entity2"])


def _add_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        rows = rows.join(spark.read.parquet(path), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def merge_batch(batch: DataFrame, nodes_path: str, edges_path: str) -> None:
    """Add what is new to plain Parquet folders; a batch that is run again after a failure adds nothing twice. Reads both tables whole."""
    _add_new(graph_nodes(batch), nodes_path, ["name"])
    _add_new(graph_edges(batch), edges_path, ["entity1", "relation", "entity2"])


def merge_batch_stored(batch: DataFrame, nodes_path: str, edges_path: str) -> None:
    """The same into two ``KeyedStore`` tables: only buckets that the batch touches are read, and a broken write is never seen."""
    spark = batch.sparkSession
    KeyedStore(spark, nodes_path, *NODES).merge(graph_nodes(batch))
    KeyedStore(spark, edges_path, *EDGES).merge(graph_edges(batch))


def merge_stream(triples: DataFrame, nodes_path: str, edges_path: str, checkpoint: str, merge=merge_batch) -> StreamingQuery:
    """``triples(e1, rel, e2)`` as a stream; runs until all that is there now has been read. ``merge`` chooses the kind of tables."""
    writer = triples.writeStream.foreachBatch(lambda batch, _: merge(batch, nodes_path, edges_path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
