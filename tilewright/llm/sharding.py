"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards own many points on a ring.  A key belongs to the first point clockwise of
its own position; where that point's shard is full, it goes on clockwise to the
next shard with room.  Capacities bound every load: with ``slack`` 0 they are the
equal shares themselves (counts at most one apart), with more slack fewer keys
leave their own shard, and fewer move when shards come or go.

Keys are admitted in ring order, so only key counts of the arcs between points
are needed to decide: a table whose size is a parameter (``points`` times
``shards``), folded in one row.  Documents are then ranked inside their ring
position, and their rank falls into one of the arc's segments.

Equal rows (doc_id, size and checksum) are merged before any shuffle, so neither a
repeated row nor a common text puts many rows into one task before the end.

Defined results: a null text has size 1 and checksum 0, a null doc_id is a key
like any other, an empty table gives no rows, shards may stay empty when there
are fewer rows than shards.  Slots count from 0 inside each shard without gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import checkpointed


@dataclass(frozen=True)
class Ring:
    """Shards, points of each on the ring, log2 of ring positions, and spare capacity as a share of the equal load."""

    shards: int = 16
    points: int = 64
    bits: int = 14
    slack: float = 0.0


def ring_position(key: Column, bits: int) -> Column:
    """Position of a string on the ring: leading bits of its MD5."""
    return F.shiftright(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def ring_points(spark: SparkSession, ring: Ring) -> DataFrame:
    """One row: the ring's ``points`` as an array of structs (position, shard) in clockwise order."""
    numbers = spark.range(ring.shards * ring.points).select(
        (F.col("id") / ring.points).cast("int").alias("shard"), (F.col("id") % ring.points).cast("int").alias("point"))
    placed = numbers.select(ring_position(F.concat_ws(":", F.lit("shard"), "shard", "point"), ring.bits).alias("position"), "shard")
    taken = placed.groupBy("position").agg(F.min("shard").alias("shard"))
    return taken.agg(F.array_sort(F.collect_list(F.struct("position", "shard"))).alias("points"))


def _arc(points: Column, position: Column) -> Column:
    """Index of the first point at or after a position; past the last one the ring starts anew."""
    passed = F.size(F.filter(points, lambda p: p["position"] < position))
    return F.when(passed == F.size(points), F.lit(0)).otherwise(passed)


def _walk(arc: Column, free: Column) -> Column:
    """Keys of one arc go clockwise through its shards: struct(free, segments of the arc)."""
    start = F.struct(arc["n"].alias("left"), free.alias("free"), F.expr("cast(array() as array<struct<arc:int,shard:int,first:bigint,n:bigint>>)").alias("made"))

    def step(state: Column, shard: Column) -> Column:
        take = F.least(state["left"], F.get(state["free"], shard))
        segment = F.struct(arc["arc"].alias("arc"), shard.alias("shard"), (arc["n"] - state["left"]).alias("first"), take.alias("n"))
        moved = F.struct(
            (state["left"] - take).alias("left"),
            F.transform(state["free"], lambda room, i: F.when(i == shard, room - take).otherwise(room)).alias("free"),
            F.concat(state["made"], F.array(segment)).alias("made"))
        return F.when(take > 0, moved).otherwise(state)

    return F.aggregate(arc["order"], start, step)


def ring_segments(counts: DataFrame, ring: Ring) -> tuple[DataFrame, DataFrame]:
    """From key counts per ring position (position, n): positions with arc and offset, and the arcs' segments.

    Both are bounded by the ring: at most 2^bits positions and about one segment a point.
    """
    points = ring_points(counts.sparkSession, ring)
    placed = counts.crossJoin(F.broadcast(points)).select("position", "n", _arc(F.col("points"), F.col("position")).alias("arc"))
    earlier = Window.partitionBy("arc").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    positions = placed.select("position", "arc", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    arcs = placed.groupBy("arc").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(points))
    owners = F.transform("points", lambda p: p["shard"])
    order = F.array_distinct(F.slice(F.concat(owners, owners), F.col("arc") + 1, F.size("points")))
    one = arcs.select("arc", "n", order.alias("order")).agg(
        F.array_sort(F.collect_list(F.struct("arc", "n", "order"))).alias("arcs"), F.sum("n").alias("total"))
    shard_numbers = F.sequence(F.lit(0), F.lit(ring.shards - 1))
    if ring.slack:
        free = F.transform(shard_numbers, lambda s: F.ceil(F.col("total") * F.lit((1 + ring.slack) / ring.shards)))
    else:
        share, extra = F.floor(F.col("total") / ring.shards), F.col("total") % ring.shards
        free = F.transform(shard_numbers, lambda s: share + F.when(s < extra, 1).otherwise(0))
    start = F.struct(free.alias("free"), F.expr("cast(array() as array<struct<arc:int,shard:int,first:bigint,n:bigint>>)").alias("made"))

    def step(state: Column, arc: Column) -> Column:
        walked = _walk(arc, state["free"])
        return F.transform(F.array(walked), lambda w: F.struct(w["free"].alias("free"), F.concat(state["made"], w["made"]).alias("made")))[0]

    made = one.select(F.aggregate("arcs", start, step)["made"].alias("made")).select(F.inline("made"))
    before = Window.partitionBy("shard").orderBy("arc", "first").rowsBetween(Window.unboundedPreceding, -1)
    segments = made.withColumn("slot", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return positions, segments


def shard_documents(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "text_crc32")
    units = checkpointed(units.withColumn("position", ring_position(key, ring.bits)))

    positions, segments = ring_segments(units.groupBy("position").agg(F.sum("copies").alias("n")), ring)
    by_arc = segments.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("first", "n", "shard", "slot"))).alias("segments"))
    places = positions.join(by_arc, "arc").select("position", "offset", "segments")

    inside = Window.partitionBy("position").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = ranked.join(F.broadcast(places), "position")  # bounded: one row for each ring position
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    each = placed.select("doc_id", "size", "text_crc32", "segments", (F.col("offset") + F.col("before")).alias("first"), copy)
    each = each.withColumn("rank", F.col("first") + F.col("copy"))
    own = F.get(F.filter("segments", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["n"])), 0)
    each = each.withColumn("own", own)
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("rows" if not ring.slack else "bounded").alias("law"), F.col("own.shard").alias("shard"),
        (F.col("own.slot") + F.col("rank") - F.col("own.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
