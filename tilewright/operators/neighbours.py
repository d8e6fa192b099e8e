"""Endpoint pairs: distance and angular neighbours, candidate merge, saved connections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.geometry import hypot, round2
from tilewright.operators.scale import attach, rank_rows, sorted_join

# Endpoint tables: image_id, endpoint_id, x, y, seq (order inside the image).


def _cells(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)})


def _probe(points: DataFrame, others: DataFrame, side: float) -> DataFrame:
    """Pairs within ``side``: each point visits its 3 x 3 cells, then an equi-join."""
    around = F.array(*[F.struct((F.col("_cx") + i).alias("cx"), (F.col("_cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = _cells(points, side).select("image_id", F.col("endpoint_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("seq").alias("a_seq"), F.explode(around).alias("c"))
    left = left.select("*", F.col("c.cx").alias("_cx"), F.col("c.cy").alias("_cy")).drop("c")
    right = _cells(others, side).select("image_id", F.col("endpoint_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("seq").alias("b_seq"), "_cx", "_cy")
    distance = hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return sorted_join(left, right, ["image_id", "_cx", "_cy"]).where(F.col("a") != F.col("b")).withColumn("distance", distance).where(
        F.col("distance") <= side).drop("_cx", "_cy")


def within_distance(points: DataFrame, limit: float) -> DataFrame:
    """All ordered pairs of one image at most ``limit`` apart (cell-bucketed, no cross join)."""
    return _probe(points, points, limit).select("image_id", "a", "b", "distance")


def nearest(points: DataFrame, k: int, limit: float, levels: int = 3) -> DataFrame:
    """Exact ``k`` nearest endpoints within ``limit``, ties by sequence.

    Cells grow by a factor of four per level.  A point with ``k`` neighbours
    inside one cell side is settled there and leaves, so points of a dense
    cluster meet only tiny cells; an integer pixel grid bounds a cell of side s
    to (s + 1)^2 points whatever the image holds.
    """
    order = Window.partitionBy("image_id", "a").orderBy("distance", "b_seq")
    settled, waiting = [], points
    for level in reversed(range(levels)):
        pairs = _probe(waiting, points, limit / 4 ** level)
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if level == 0:
            settled.append(ranked)
            break
        full = ranked.where(F.col("rank") == k).select("image_id", "a")
        settled.append(sorted_join(ranked, full, ["image_id", "a"], "left_semi"))
        waiting = sorted_join(waiting, full.withColumnRenamed("a", "endpoint_id"), ["image_id", "endpoint_id"], "left_anti")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def ring_order(points: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds ``ring`` (0-based place by angle around the image centre) and ``ring_size``.

    Angles are cut into 4096 sectors, so an image with very many endpoints is ranked sector by sector.
    """
    turned = points.withColumn("angle", F.atan2(F.col("y") - height / 2.0, F.col("x") - width / 2.0))
    sector = F.floor((F.col("angle") + math.pi) / (2 * math.pi) * 4096).cast("int")
    ranked = rank_rows(turned, "image_id", ["angle", "seq"], sector, "ring")
    sizes = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("ring_size"))
    return attach(ranked, sizes, "image_id").withColumn("ring", F.col("ring") - 1)


def ring_neighbours(points: DataFrame, reach: int, width: Column, height: Column) -> DataFrame:
    """Pairs of endpoints up to ``reach`` places apart on the circle of angles."""
    ring = ring_order(points, width, height)
    steps = F.sequence(F.lit(1), F.least(F.lit(reach), F.col("ring_size") - 1).cast("int"))
    both = F.flatten(F.transform(steps, lambda s: F.array(F.struct((-s).alias("d"), s.alias("o")), F.struct(s.alias("d"), s.alias("o")))))
    left = ring.where(F.col("ring_size") > 1).select(
        "image_id", F.col("endpoint_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ring").alias("a_ring"), "ring_size",
        F.explode(both).alias("s"))
    left = left.withColumn("ring", F.pmod(F.col("a_ring") + F.col("s.d"), F.col("ring_size")))
    right = ring.select("image_id", F.col("endpoint_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "ring")
    return sorted_join(left, right, ["image_id", "ring"]).where(F.col("a") != F.col("b")).select(
        "image_id", "a", "b", "ax", "ay", "bx", "by", "a_ring", F.col("s.d").alias("step"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("--", F.least(a, b), F.greatest(a, b))


def connection_candidates(
    points: DataFrame, existing: DataFrame, k: int, limit: float, reach: int, width: Column, height: Column,
) -> DataFrame:
    """Candidate connections: both kinds merged per pair, the first found direction kept.

    ``existing``: image_id, a, b of saved connections, which are left out.
    """
    near = nearest(points, k, limit).select(
        "image_id", "a", "b", "ax", "ay", "bx", "by", F.lit("distance").alias("reason"),
        F.struct(F.lit(0).alias("phase"), F.col("a_seq").cast("bigint").alias("outer"), F.col("rank").cast("bigint").alias("inner")).alias("found"))
    found = near
    if reach > 0:
        ring = ring_neighbours(points, reach, width, height)
        inner = F.abs(F.col("step")) * 2 + (F.col("step") > 0).cast("int")
        found = near.unionByName(ring.select(
            "image_id", "a", "b", "ax", "ay", "bx", "by", F.lit("angular").alias("reason"),
            F.struct(F.lit(1).alias("phase"), F.col("a_ring").cast("bigint").alias("outer"), inner.cast("bigint").alias("inner")).alias("found")))
    merged = found.withColumn("id", pair_key(F.col("a"), F.col("b"))).groupBy("image_id", "id").agg(
        F.min_by(F.struct("a", "b", "ax", "ay", "bx", "by"), "found").alias("p"),
        F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason"))
    saved = existing.select("image_id", pair_key(F.col("a"), F.col("b")).alias("id")).distinct()
    distance = round2(hypot(F.col("p.ax") - F.col("p.bx"), F.col("p.ay") - F.col("p.by")))
    return sorted_join(merged, saved, ["image_id", "id"], "left_anti").select(
        "image_id", "id", F.col("p.a").alias("a"), F.col("p.b").alias("b"), distance.alias("distance"), "reason",
        F.col("p.ax").alias("ax"), F.col("p.ay").alias("ay"), F.col("p.bx").alias("bx"), F.col("p.by").alias("by"))


def valid_connections(saved: DataFrame, points: DataFrame) -> DataFrame:
    """Saved curve connections whose two endpoints exist and whose control and tangent are points.

    ``saved``: image_id, id, a, b, route_type, control, tangent (structs, NULL when malformed).
    """
    kept = saved.where((F.col("route_type") == "curve") & F.col("control").isNotNull() & F.col("tangent").isNotNull())
    end = lambda s: points.select("image_id", F.col("endpoint_id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    joined = sorted_join(sorted_join(kept, end("a"), ["image_id", "a"]), end("b"), ["image_id", "b"])
    rounded = F.struct(round2(F.col("tangent.x")).alias("x"), round2(F.col("tangent.y")).alias("y"))
    return joined.withColumn("tangent", rounded)
