"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's slot is a hash of its id and text, one of some thousands.  Bytes are
summed per slot, and a map from slot to shard is made from these sums: the
largest slot first, each to the shard with the fewest bytes so far.  The map is
a small table with a version; rebalancing and growing edit it, so only records
of the moved slots move.  Everything but the map's own table is row work: a
record finds its shard by joining the map, whose size is the number of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

SLOTS = 4096
#: Each slot is ranked in so many pieces, so that no window holds a whole slot.
PIECES = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_of(doc: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc, text), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of every slot that has records."""
    sized = docs.select(slot_of(F.col(doc), F.col(text), slots).alias("slot"), size_of(F.col(text)).alias("bytes"))
    return sized.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("records"))


def first_map(spark: SparkSession, sums: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: (version, slot, shard, bytes) of every slot, filled or not.

    Largest slot first to the least loaded shard (ties: the smaller slot, the
    smaller shard).  The fold runs over one row of ``slots`` numbers.
    """
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(sums.select("slot", "bytes"), "slot", "left")
    listed = every.select(F.struct((-F.coalesce("bytes", F.lit(0))).alias("less"), "slot").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.expr("CAST(array() AS ARRAY<INT>)").alias("put"))

    def put(acc: Column, s: Column) -> Column:
        # An empty slot counts as one byte here, so that empty slots are dealt out too.
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: x + F.when(i == at - 1, F.greatest(-s["less"], F.lit(1))).otherwise(F.lit(0)))
        return F.struct(load.alias("load"), F.concat(acc["put"], F.array(at - 1)).alias("put"))

    dealt = listed.select("s", F.aggregate("s", start, put)["put"].alias("put"))
    return dealt.select(F.inline(F.arrays_zip("s", "put"))).select(
        F.lit(1).alias("version"), F.col("s.slot").alias("slot"), F.col("put").alias("shard"), (-F.col("s.less")).alias("bytes"))


def edited_map(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version, for new byte sums and ``shards`` shards (no fewer than before).

    Each shard with more than its share gives away its smallest slots as far as
    it is over; they go, the largest first, to where the share is not reached:
    given slots are laid end to end along the free room of the other shards.
    Slots that stay put keep their shard, and new shards take only moved slots.
    """
    known = current.select("version", "slot", "shard").join(sums.select("slot", F.col("bytes").alias("new_bytes")), "slot", "left").select(
        "version", "slot", "shard", F.coalesce("new_bytes", F.lit(0)).alias("bytes"))
    known = cut_lineage(known)
    fair = (known.agg(F.sum("bytes")).first()[0] or 0) / shards
    loads = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(
        known.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"))
    share = cut_lineage(loads.select("shard", "load", F.lit(float(fair)).alias("share")))
    running = F.expr("sum(bytes) OVER (PARTITION BY shard ORDER BY bytes, slot)")
    marked = known.join(F.broadcast(share), "shard").withColumn("run", running).withColumn("over", F.col("load") - F.col("share"))
    given = marked.where("over > 0 AND run <= over").select("slot", "bytes", F.expr("sum(bytes) OVER (ORDER BY bytes DESC, slot)").alias("upto"))
    # One row a shard: the free room laid end to end.
    ends, taker = 0.0, F.lit(None).cast("int")
    middle = F.col("upto") - F.col("bytes") / 2
    for row in share.where("load < share").orderBy(F.desc("shard")).collect():
        ends += row["share"] - row["load"]
        taker = F.when((middle > ends - (row["share"] - row["load"])) & (middle <= ends), F.lit(row["shard"])).otherwise(taker)
    moved = given.select("slot", taker.alias("to")).where("to IS NOT NULL")
    return known.join(F.broadcast(moved), "slot", "left").select(
        (F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard"), "bytes")


def store_map(map_rows: DataFrame, path: str) -> None:
    """Append one version to the stored maps; earlier versions stay readable."""
    map_rows.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, the newest if none is named."""
    stored = spark.read.schema("slot INT, shard INT, bytes LONG, version INT").parquet(path)
    wanted = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == wanted).select("version", "slot", "shard", "bytes")


def assign(docs: DataFrame, map_rows: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """All rows and columns, with virtual_slot, shard and map_version; no text is shuffled.

    The map has one row per slot (thousands), which bounds the broadcast.
    Repeated rows and rows with null ids or texts have slots like any other.
    A column of the input that has one of the three names is replaced.
    """
    kept = [c for c in docs.columns if c not in ("virtual_slot", "shard", "map_version")]
    slim = map_rows.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    return docs.select(*kept, slot_of(F.col(doc), F.col(text), slots).alias("virtual_slot")).join(F.broadcast(slim), "virtual_slot").select(
        *kept, "virtual_slot", "shard", "map_version")


def placed(docs: DataFrame, map_rows: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS, pieces: int = PIECES) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, place): ``place`` counts a shard's records from 0 without gaps.

    A slot is ranked in ``pieces`` hashed pieces; the counts of all pieces, slots
    times pieces numbers, give the offsets.
    """
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    rows = assign(slim, map_rows, "doc_id", "text", slots).select(
        "doc_id", size_of(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
        "virtual_slot", "shard", F.pmod(F.xxhash64(F.lit("piece"), "doc_id", "text"), F.lit(pieces)).cast("int").alias("piece"))
    counts = rows.groupBy("shard", "virtual_slot", "piece").agg(F.count("*").alias("n"))
    offsets = counts.select("virtual_slot", "piece", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot, piece) - n").alias("offset"))
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY virtual_slot, piece ORDER BY doc_id, text_crc32, size)"))
    return ranked.join(F.broadcast(offsets), ["virtual_slot", "piece"]).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("place"))


def balanced_map(docs: DataFrame, shards: int, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map for these records, written once."""
    return cut_lineage(first_map(docs.sparkSession, slot_bytes(docs, doc, text, slots), shards, slots))
