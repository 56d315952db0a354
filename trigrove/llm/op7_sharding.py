"""Balanced sharding of linked documents by label propagation under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import materialize, numbered, running_total, table

SHARDS = 8
#: Groups of more than a quota divided by this are placed first, on the driver: fewer than SHARDS * BIG of them, at every size of the table.
BIG = 16


def _facts(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("group"),
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards 0 to ``shards`` - 1 with row counts at most one apart, equal texts together where that leaves room.

    One row per row of ``docs(doc_id, text, ...)``: doc_id, size (UTF-8 bytes + 1), text_crc32, law ('rows'),
    shard, slot (gapless from 0 in each shard), grown_shard (null). Documents with equal texts are linked through
    a hub. Rows are first dealt out evenly in hash order. Only hubs that are placed as a whole hold room: rows of
    the others give way, so hubs may swap places on a table in which every row is linked. Large hubs come first, by
    size, each to the shard with most of its rows among those with room; one that fits nowhere as a whole is cut over
    as few shards as hold it. Then, in each round, every other hub prefers the shard that has most of its rows among
    those with room for all of it, and moves there in hash order while there is room. Rounds end when no hub fits. Rows
    without a link, and those of hubs that fit nowhere, then fill every shard to its quota. Null texts are a group of their
    own; null doc_ids and repeated rows are rows like others; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    facts = materialize(_facts(docs))
    total = facts.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = materialize(facts.groupBy("group").agg(F.count(F.lit(1)).alias("_n")))
    ranked = numbered(facts, [], F.xxhash64("doc_id", "group"), ["doc_id", "group"], "_rank", 4096)
    dealt = ranked.join(groups, "group").select("doc_id", "size", "text_crc32", (F.col("_rank") % shards).cast("int").alias("shard"), F.when(F.col("_n") > 1, F.col("group")).alias("hub"), "_n", "_rank")
    dealt = materialize(dealt)
    large = total // shards // BIG
    room = dict(quota)
    votes = materialize(dealt.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")))
    whole = materialize(votes.groupBy("hub").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("there")))
    cuts = _place_large(whole.where(F.col("all") > large).collect(), room)
    cut = F.broadcast(spark.createDataFrame(cuts, "hub string, start long, end long, shard int"))
    first = numbered(dealt.where(F.col("hub").isNotNull() & (F.col("_n") > large)), ["hub"], F.xxhash64("_rank"), ["_rank"], "_at", 1024).drop("shard")
    first = first.join(cut, "hub").where("_at >= start and _at < end").select("doc_id", "size", "text_crc32", "shard", "_rank")
    waiting, homes = whole.where(F.col("all") <= large), None
    while (granted := _round(waiting, room)) is not None:
        waiting = materialize(waiting.join(granted, "hub", "left_anti"))
        homes = granted if homes is None else homes.unionByName(granted)
    small = dealt.where(F.col("hub").isNotNull() & (F.col("_n") <= large))
    if homes is not None:
        first = first.unionByName(small.join(homes, "hub").select("doc_id", "size", "text_crc32", F.col("target").alias("shard"), "_rank"))
    rest = dealt.where("hub is null").unionByName(small.join(waiting.select("hub"), "hub", "left_semi").select(dealt.columns))
    ends, end = [], 0
    for s in range(shards):
        end += room[s]
        ends.append((s, end))
    alone = numbered(materialize(rest), [], F.when(F.col("hub").isNull(), F.xxhash64("_rank")).otherwise(F.xxhash64("hub")), ["hub", "_rank"], "_free", 4096)
    place = F.lit(None).cast("int")
    for s, end in reversed(ends):
        place = F.when(F.col("_free") < end, F.lit(s)).otherwise(place)
    placed = materialize(first.unionByName(alone.select("doc_id", "size", "text_crc32", place.alias("shard"), "_rank")))
    slots = numbered(placed, ["shard"], F.xxhash64("_rank"), ["_rank"], "slot", 1024)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _place_large(hubs, room: dict[int, int]) -> list[tuple[str, int, int, int]]:
    """(hub, start, end, shard): where the rows of each large hub go, by their number in the hub; ``room`` shrinks."""
    out = []
    for hub in sorted(hubs, key=lambda h: (-h["all"], h["hub"])):
        fits = [s for s in room if room[s] >= hub["all"]]
        order = [max(fits, key=lambda s: (hub["there"].get(s, 0), room[s], -s))] if fits else sorted(room, key=lambda s: (-room[s], s))
        at = 0
        for s in order:
            n = min(room[s], hub["all"] - at)
            if n > 0:
                out.append((hub["hub"], at, at + n, s))
                room[s] -= n
                at += n
    return out


def _round(waiting: DataFrame, room: dict[int, int]) -> DataFrame | None:
    """One round: the hubs that get a place, and which (hub, all, target); ``room`` shrinks. None if no hub fits."""
    free = F.broadcast(waiting.sparkSession.createDataFrame(list(room.items()), "target int, room long"))
    choices = waiting.select("hub", "all", "there", F.explode(F.array(*[F.lit(s) for s in room])).alias("target")).join(free, "target").where("all <= room")
    votes = F.coalesce(F.try_element_at("there", F.col("target")), F.lit(0))
    best = choices.groupBy("hub", "all").agg(F.max(F.struct(votes.alias("n"), F.xxhash64("hub", "target").alias("tie"), "target")).alias("best"))
    movers = materialize(best.select("hub", "all", F.col("best.target").alias("target")))
    summed = running_total(movers, ["target"], F.xxhash64("hub"), ["hub"], F.col("all"), "_sum")
    granted = materialize(summed.join(free, "target").where("_sum <= room").select("hub", "all", "target"))
    taken = granted.groupBy("target").agg(F.sum("all").alias("n")).collect()
    for r in taken:
        room[r["target"]] -= r["n"]
    return granted if taken else None


def cut_edges(placed: DataFrame) -> int:
    """For each group of equal texts, the number of its shards beyond the first, summed."""
    return placed.groupBy("size", "text_crc32").agg((F.count_distinct("shard") - 1).alias("cut")).agg(F.sum("cut")).first()[0] or 0


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
