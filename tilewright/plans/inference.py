"""Image pixels to class mask, heat map and verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import standard_gray
from tilewright.operators import blending as b
from tilewright.operators.scale import attach, spread_for_python
from tilewright.operators.tiling import covering_tiles, pad_for_tiles


@dataclass(frozen=True)
class Inference:
    mask: DataFrame
    tiles: DataFrame
    accepted: DataFrame
    verdicts: DataFrame
    tile_pixels: DataFrame


def infer(gray: DataFrame, tile: int, stride: int, factor: float, score: b.ScoreFunction = b.linear_scores) -> Inference:
    """``gray``: image_id, y, x, h, w, gray (0..255).

    Shuffles: one to gather tiles, one per blended pixel, and small ones per image.
    """
    pad = tile // 2
    values = gray.withColumn("v", standard_gray(F.col("gray"))).select("image_id", "y", "x", "h", "w", "v")
    context = values.groupBy("image_id").agg(
        F.avg("v").alias("context"), F.first("h").alias("ih"), F.first("w").alias("iw"))
    spread = covering_tiles(pad_for_tiles(values, tile), tile, stride)
    arrays = b.tile_arrays(spread_for_python(spread, "image_id", "ty", "tx"), ["image_id", "ty", "tx"], tile, "v")
    scored = b.score_tiles(attach(arrays, context.select("image_id", "context"), "image_id"), tile, score)
    pixels = attach(b.explode_tiles(scored, tile), context.select("image_id", "ih", "iw"), "image_id")
    y, x = F.col("y") - pad, F.col("x") - pad
    pixels = pixels.withColumns({"y": y, "x": x}).withColumn(
        "inside", F.col("y").between(0, F.col("ih") - 1) & F.col("x").between(0, F.col("iw") - 1))
    mask = b.blend(pixels.where("inside"), ["image_id", "y", "x"], b.CLASS_COLUMNS).withColumn("class_index", b.top_class())
    images = mask.groupBy("image_id").agg(
        F.avg((F.col("class_index") == b.TALC_INDEX).cast("double")).alias("talc_ratio"),
        F.avg((F.col("class_index") == b.ORE_INDEX).cast("double")).alias("ore_share"))
    ore = b.tile_ore_ratio(pixels, ["image_id", "ty", "tx", "prob", "ih", "iw"])
    tiles = ore.withColumn(
        "centre_inside", F.col("ty").between(0, F.col("ih") - 1) & F.col("tx").between(0, F.col("iw") - 1)).drop("ih", "iw")
    accepted = b.accepted_tiles(tiles, images, factor)
    return Inference(mask, tiles, accepted, b.image_verdicts(images, accepted), pixels)


def heat_map(run: Inference) -> DataFrame:
    """Blended probability of accepted tiles per covered pixel, clipped to 0..1."""
    chosen = run.accepted.select("image_id", "ty", "tx")
    covered = run.tile_pixels.where("inside").join(chosen, ["image_id", "ty", "tx"], "left_semi")
    return b.blend(covered, ["image_id", "y", "x"], ["prob"]).withColumn(
        "prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob"))))


def verdicts_from_tiles(tiles: DataFrame, factor: float, talc_from: str = "ore_ratio") -> DataFrame:
    """Verdict per image from a table of already scored tiles.

    The image's ore share and talc share are tile means; tiles filter against the
    ore share, then the accepted ones decide.
    """
    images = b.ore_shares(tiles, F.avg((F.col(talc_from) < 0.05).cast("double")).alias("talc_ratio"), F.count(F.lit(1)).alias("n_tiles"))
    return b.image_verdicts(images, b.accepted_tiles(tiles, images, factor))
