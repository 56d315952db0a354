"""A Bloom filter as a small table of 64-bit blocks, joined by block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets in its block; bits for each key; most blocks (8 MB), beyond which more keys pass by mistake.
BITS, BITS_PER_KEY, MOST_BLOCKS = 5, 20, 1 << 20


def blocks_for(keys: int) -> int:
    return max(16, min(MOST_BLOCKS, keys * BITS_PER_KEY // 64))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    other = F.xxhash64(key, F.lit("mask"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * k).bitwiseAND(63).cast("int")) for k in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_table(keys: Column, rows: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of all ``keys`` of ``rows``: at most ``blocks`` rows, combined before the shuffle."""
    return rows.select(block_of(keys, blocks).alias("block"), mask_of(keys).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def possible(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the filter's; none that is gets lost. No shuffle of ``df``."""
    mask = mask_of(F.col(key))
    met = df.withColumn("block", block_of(F.col(key), blocks)).join(F.broadcast(bloom), "block")
    return met.where(F.col("bits").bitwiseAND(mask) == mask).select(df.columns)
