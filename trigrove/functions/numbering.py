"""Dense row numbers without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions.tables import stored

#: ``monotonically_increasing_id`` has the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def dense_number(df: DataFrame, order: str, out: str, ties: tuple[str, ...] = (), parts: int | None = None, start: int = 1) -> DataFrame:
    """Number the rows from ``start`` by ``order``, then ``ties`` (together unique, to be repeatable); nulls come first.

    The rows are dealt by range, with bounds from a sample, and each range is sorted, and written with every row's
    range and place. The counts of the ranges then lift each row's place; only these counts meet in one task. A
    value of ``order`` that most rows share is cut by ``ties``. ``df`` is evaluated twice (once for the sample).
    There are as many ranges as shuffles have partitions, unless ``parts`` says otherwise.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, order, *ties).sortWithinPartitions(order, *ties)
    rows = stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lift = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    lifted = rows.withColumn("_part", part).join(F.broadcast(lift), "_part")
    return lifted.withColumn(out, F.col("_lift") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + start).drop("_part", "_at", "_lift")
