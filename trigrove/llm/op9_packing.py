"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import materialize, numbered, table, text_batches
from trigrove.llm.tokens import word_tokenizer

SEQUENCE, END_ID = 2048, 0
BROADCAST_ROWS = 100_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, path: str, size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """``(doc_id, text)`` -> the pieces of each document: doc_id, piece, start, length, ids_crc32 (and ``ids``, little-endian 32-bit, on request)."""

    text_batches(docs.sparkSession)

    def run(batches):
        encode, end = word_tokenizer(path).ids, np.array([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if ids else [])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def best_fit(runs: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Places for runs of equal lengths: (length, first rank, last rank, first sequence, pieces in each, offset).

    ``runs`` has the number of pieces of each length, at most ``size`` entries however large the corpus is; gaps
    are kept as runs of sequences that have the same room. One bulk step takes a run of pieces, from the longest
    down, to its successor in the sorted gaps (the smallest that is large enough), matches by rank, and puts
    back the gaps that remain. It gives exactly what best-fit decreasing gives one piece at a time.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    places, opened = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    for length in sorted(runs, reverse=True):
        done, total = 0, runs[length]
        while done < total:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first = size, opened
                count = -(-(total - done) // (size // length))
                opened += count
            each = gap // length
            used = min(count, -(-(total - done) // each))
            taken = min(total - done, used * each)
            places.append((length, done, done + taken - 1, first, each, size - gap))
            last = taken - (used - 1) * each
            put(gap - each * length, first, used - 1)
            put(gap - last * length, first + used - 1, 1)
            put(gap, first + used, count - used)
            done += taken
    return places


def place(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a materialized table with doc_id, piece and length)."""
    spark = pieces.sparkSession
    runs = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where(F.col("length").between(1, size)).collect()}
    rows = best_fit(runs, size)
    places = spark.createDataFrame(pd.DataFrame(rows, columns=["length", "lo", "hi", "first", "each", "base"], dtype="int64"), "length long, lo long, hi long, first long, each long, base long")
    if len(rows) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    ranked = numbered(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece"], "_rank", 256)
    met = ranked.alias("p").join(places.alias("q"), (F.col("p.length") == F.col("q.length")) & F.col("_rank").between(F.col("lo"), F.col("hi")))
    turn = F.col("_rank") - F.col("lo")
    sequence = F.col("first") + F.expr("(_rank - lo) div each")
    offset = F.col("base") + F.pmod(turn, F.col("each")) * F.col("p.length")
    return met.select(*[F.col(f"p.{c}") for c in pieces.columns], sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``size`` tokens; one row per piece.

    Each document is its ids and the id 0 after them; null and empty texts are that 0 alone. Only documents of
    more than ``size`` ids are cut. Every row is a document of its own, repeated rows and null doc_ids too. An
    empty table gives an empty result; other columns are ignored. Documents and gaps are sorted as runs of
    equal length: the corpus gives its count of pieces per length (at most ``size`` numbers), the bulk steps
    match runs with runs, and each piece finds its place by its rank in its run, a rank that no task counts alone.
    """
    return place(materialize(pieces_of(docs, path, size, ids)), size)


def sequences(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int, at most ``size``), doc_ids in their order."""
    packed = pack(docs, path, size, ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))

    def unpack(batches):
        for pdf in batches:
            pdf["ids"] = [np.frombuffer(b"".join(bytes(p["ids"]) for p in ps), dtype="<u4").astype(np.int32) for ps in pdf["parts"]]
            pdf["doc_ids"] = [[p["doc_id"] for p in ps] for ps in pdf["parts"]]
            yield pdf[["sequence_id", "ids", "doc_ids"]]

    return packed.groupBy("sequence_id").agg(parts.alias("parts")).mapInPandas(unpack, "sequence_id long, ids array<int>, doc_ids array<long>")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
