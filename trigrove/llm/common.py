"""Small helpers that the corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="trigrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stage-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of at most ``rows``, so that a worker's memory stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_key(text: Column) -> Column:
    """128-bit identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key`` (of which all rows are equal), with ``copies``: 1, or 2 where there are several.

    Keys that occur once stay where they are: a Bloom filter of the repeated keys (at most BLOOM_BLOCKS blocks, 8 MB)
    lets only those, and the few that it takes for them, go through a shuffle. ``rows`` is evaluated three times.
    """
    many = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    blocks = min(BLOOM_BLOCKS, bloom_size(many.count()))
    marked = rows.withColumn("block", bloom_block(F.col(key), blocks)).join(F.broadcast(bloom_blocks(many, key, blocks)), "block", "left")
    possible = F.coalesce(bloom_has(F.col(key)), F.lit(False))
    rest = [c for c in rows.columns if c != key]
    several = marked.where(possible).groupBy(key).agg(*[F.first(c).alias(c) for c in rest], F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"))
    return marked.where(~possible).select(*rows.columns, F.lit(1).alias("copies")).unionByName(materialize(several.select(*rows.columns, "copies")))


def running_total(df: DataFrame, group: list[str], hashed: Column, ties: list[str], value: Column, out: str, buckets: int = 1024) -> DataFrame:
    """Running sums of ``value`` in each group (no nulls in ``group``), in the order of a 64-bit hash, own value included.

    The hash range is cut into ``buckets`` equal parts: sums per part give each part's offset, and only the rows
    of one part are ever sorted together. A group with a third of all rows is spread over all its parts.
    ``df`` is evaluated twice, so it must be cheap or materialized.
    """
    bits = buckets.bit_length() - 1
    parts = df.withColumn("_h", hashed).withColumn("_v", value.cast("long")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    sums = parts.groupBy(*group, "_b").agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("_r", F.sum("_v").over(inside))
    return summed.join(offsets, [*group, "_b"]).withColumn(out, F.col("_off") + F.col("_r")).drop("_h", "_v", "_b", "_r", "_off")


def numbered(df: DataFrame, group: list[str], hashed: Column, ties: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 in each group, in the order of a 64-bit hash; see ``running_total``."""
    return running_total(df, group, hashed, ties, F.lit(1), out, buckets).withColumn(out, F.col(out) - 1)


BLOOM_WORDS, BLOOM_BLOCKS = 8, 1 << 17


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_masks(key: Column) -> list[Column]:
    """For each of a block's eight 64-bit words, the one bit that a key sets there."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(BLOOM_WORDS)]


def bloom_size(n: int, bits_per_key: int = 16) -> int:
    """Blocks of 512 bits for ``n`` keys, a power of two."""
    return 1 << max(4, math.ceil(math.log2(max(1, n) * bits_per_key / 512)))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table ``(block, w0..w7)``, one 512-bit block per row, pre-aggregated before the shuffle."""
    masks = keys.select(bloom_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(bloom_masks(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOOM_WORDS)])


def bloom_has(key: Column) -> Column:
    """Whether a block's words, joined to the row, hold all bits of the key."""
    inside = None
    for i, mask in enumerate(bloom_masks(key)):
        test = F.col(f"w{i}").bitwiseAND(mask) != 0
        inside = test if inside is None else inside & test
    return inside & key.isNotNull()


def only_keys(df: DataFrame, keys: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """``df`` left-semi ``keys`` on ``key``, with ``extra`` columns of ``keys`` (whose keys must then be unique), and with a Bloom filter that drops most other rows before they are shuffled.

    The filter has at most BLOOM_BLOCKS blocks (8 MB), whatever the number of keys is, so it can be broadcast;
    with very many keys it lets more rows through to the join, which is exact. ``keys`` is evaluated three times.
    """
    blocks = min(BLOOM_BLOCKS, bloom_size(keys.count()))
    bloom = F.broadcast(bloom_blocks(keys, key, blocks))
    met = df.withColumn("block", bloom_block(F.col(key), blocks)).join(bloom, "block").where(bloom_has(F.col(key)))
    # an inner join: the optimizer would put a semi join below the filter
    wanted = keys.select(key, *extra) if extra else keys.select(key).distinct()
    return met.select(df.columns).join(wanted, key).select(*df.columns, *(extra or []))
