"""Sketch lines drawn from the endpoint table: spurs, polylines and the sketch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables
from tilewright.operators import sketch as sk
from tilewright.operators.scale import spread_for_python

KEY = ["image_id", "y", "x"]


def drawn(tables: Tables):
    """Per endpoint a horizontal stroke with a short tail hanging from its middle, on a 250 x 200 canvas."""
    k = F.col("seq")
    x0, y0 = (F.col("x") / 5).cast("int"), (F.col("y") / 5).cast("int")
    length, tail = (9 + k % 8).cast("int"), (2 + k % 6).cast("int")
    stroke = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(y0.alias("y"), (x0 + i).alias("x")))
    hang = F.transform(F.sequence(F.lit(1), tail), lambda i: F.struct((y0 + i).alias("y"), (x0 + 5).alias("x")))
    # Dealt by image before strokes become pixels: a small file is one task, and the pixels of all its rows would be merged there.
    points = spread_for_python(tables.points(), "image_id")
    return points.select("image_id", F.explode(F.concat(stroke, hang)).alias("p")).select("image_id", "p.y", "p.x").distinct()


@check("m16_pruned_skeletons")
def _(spark, sf):
    return sk.prune_spurs(drawn(Tables(spark, sf)), 5)


@check("m16_branch_lengths")
def _(spark, sf):
    return sk.branch_lengths(drawn(Tables(spark, sf)), 40)


@check("m17_polylines")
def _(spark, sf):
    return sk.polylines(drawn(Tables(spark, sf))).select("image_id", "chain", "path")


def _tables(spark, sf):
    tables = Tables(spark, sf)
    pixels = drawn(tables)
    point = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    ends = tables.points().where(F.col("seq") % 3 == 0).select("image_id", (F.col("x") / 5).cast("int").alias("sx"), (F.col("y") / 5).cast("int").alias("sy"), "seq")
    name = lambda x: F.concat(F.lit("e_"), x.cast("string"), F.lit("_"), F.col("sy").cast("string"))
    saved = ends.select(
        "image_id", F.col("seq").alias("id"), name(F.col("sx")).alias("a"), name(F.col("sx") + (9 + F.col("seq") % 8).cast("int")).alias("b"),
        F.lit("curve").alias("route_type"), point.alias("control"), point.alias("tangent"))
    return sk.sketch_tables(pixels, pixels, saved, 4, 4, 60.0, 2, F.lit(250), F.lit(200), smallest=8)


@check("g02_sketch_lines")
def _(spark, sf):
    return _tables(spark, sf)["lines"].select("image_id", "line_id", "stroke_width", "ends", "closed", "color")


@check("g02_sketch_candidates")
def _(spark, sf):
    return _tables(spark, sf)["candidates"].select("image_id", "id", "a", "b", "distance", "reason")
