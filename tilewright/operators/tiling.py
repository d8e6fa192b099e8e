"""Tile grids, padding, resizing and patch plans.

All of these are narrow: each pixel or image row emits its own targets with
``sequence`` and ``explode``, so no grid is joined and nothing is shuffled
except where an average over pixels is asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.operators.scale import attach, names

# Sizes of the tiling and sampling plans.
TILE, STRIDE, PATCH, MIN_EXTRACT_SCALE = 512, 192, 512, 0.85
ROTATION_RANGE, SCALE_RANGE = (-180.0, 180.0), (0.85, 1.15)


def extract_side(patch: int = PATCH) -> int:
    """Side that still covers a patch after any rotation at the smallest scale."""
    return int(math.ceil(patch * math.sqrt(2.0) / MIN_EXTRACT_SCALE)) + 4


def with_size(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Adds ``h`` and ``w`` measured from the pixels."""
    size = pixels.groupBy(image).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return attach(pixels, size, image)


def patch_grid(images: DataFrame, window: int, stride: int) -> DataFrame:
    """Sliding windows of every image (columns ``w``, ``h``): one row per patch with its running index."""
    per_row = F.size(g.window_starts(F.col("w"), window, stride))
    return (
        images.withColumn("_columns", per_row)
        .select("*", F.posexplode(g.window_starts(F.col("h"), window, stride)).alias("_iy", "y0"))
        .select("*", F.posexplode(g.window_starts(F.col("w"), window, stride)).alias("_ix", "x0"))
        .withColumn("patch_index", F.col("_iy") * F.col("_columns") + F.col("_ix"))
        .drop("_columns", "_iy", "_ix")
    )


def even_picks(total: Column, limit: int) -> Column:
    """Indices rint(linspace(0, total - 1, limit)); all indices when there are at most ``limit``."""
    if limit == 1:
        spread = F.array(F.lit(0))
    else:
        spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: F.rint(
            j * ((total - 1) / F.lit(float(limit - 1)))).cast("int"))
    return F.when(total <= limit, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(spread)


def even_patches(images: DataFrame, window: int, stride: int, limit: int) -> DataFrame:
    """At most ``limit`` evenly spread patches per image, computed by index arithmetic.

    Only the picked patches are ever materialised; no window or count over patches runs.
    """
    ys, xs = g.window_starts(F.col("h"), window, stride), g.window_starts(F.col("w"), window, stride)
    located = images.withColumn("_ys", ys).withColumn("_xs", xs)
    picked = located.select("*", F.explode(even_picks(F.size("_ys") * F.size("_xs"), limit)).alias("patch_index"))
    columns = F.size("_xs")
    return picked.withColumn("y0", F.get("_ys", F.floor(F.col("patch_index") / columns).cast("int"))).withColumn(
        "x0", F.get("_xs", F.col("patch_index") % columns)).drop("_ys", "_xs")


def drift_patches(images: DataFrame, window: int, stride: int, limit: int, image: str = "image_id") -> DataFrame:
    """Evenly spread patches of all images, then the first ``limit`` in (image, patch) order."""
    per_image = max(1, math.ceil(limit / max(images.count(), 1)))
    return even_patches(images, window, stride, per_image).orderBy(image, "patch_index").limit(limit)


def tile_grid(images: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """Tiles of the image padded by half a tile; ``center`` is NULL when it leaves the image."""
    pad = tile // 2
    padded = images.withColumn("_w", F.col("w")).withColumn("_h", F.col("h")).withColumns(
        {"w": F.col("w") + 2 * pad, "h": F.col("h") + 2 * pad})
    tiles = patch_grid(padded, tile, stride).withColumns({"w": F.col("_w"), "h": F.col("_h")}).drop("_w", "_h")
    cx = F.rint(F.col("x0") + (tile / 2 - pad)).cast("int")
    cy = F.rint(F.col("y0") + (tile / 2 - pad)).cast("int")
    inside = (cx >= 0) & (cx < F.col("w")) & (cy >= 0) & (cy < F.col("h"))
    return tiles.withColumn("center", F.when(inside, F.struct(cx.alias("x"), cy.alias("y"))))


def covering_tiles(pixels: DataFrame, tile: int, stride: int) -> DataFrame:
    """Each padded pixel once per tile that holds it (``ty``, ``tx`` and offsets ``dy``, ``dx``)."""
    def axis(position: str, length: str) -> Column:
        return F.filter(g.window_starts(F.col(length), tile, stride), lambda s: (s <= F.col(position)) & (F.col(position) < s + tile))

    return (
        pixels.select("*", F.explode(axis("y", "h")).alias("ty")).select("*", F.explode(axis("x", "w")).alias("tx"))
        .withColumns({"dy": F.col("y") - F.col("ty"), "dx": F.col("x") - F.col("tx")})
    )


def reflect_pad(pixels: DataFrame, top: Column, bottom: Column, left: Column, right: Column) -> DataFrame:
    """Reflect-101 padding of pixel rows carrying ``h`` and ``w``."""
    ys = g.mirrored_targets(F.col("y"), top, bottom, F.col("h"))
    xs = g.mirrored_targets(F.col("x"), left, right, F.col("w"))
    return (
        pixels.withColumns({"_ys": ys, "_xs": xs}).drop("y", "x")
        .select("*", F.explode("_ys").alias("y")).select("*", F.explode("_xs").alias("x"))
        .withColumns({"h": F.col("h") + top + bottom, "w": F.col("w") + left + right}).drop("_ys", "_xs")
    )


def pad_for_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    half = F.lit(tile // 2)
    return reflect_pad(pixels, half, half, half, half)


def pad_to_minimum(pixels: DataFrame, minimum: int) -> DataFrame:
    """Image (and any mask columns on the same rows) padded to at least ``minimum`` per side."""
    more_y = F.greatest(F.lit(minimum) - F.col("h"), F.lit(0))
    more_x = F.greatest(F.lit(minimum) - F.col("w"), F.lit(0))
    top, left = F.floor(more_y / 2).cast("int"), F.floor(more_x / 2).cast("int")
    return reflect_pad(pixels, top, more_y - top, left, more_x - left)


def resize_nearest(pixels: DataFrame, target_h: Column, target_w: Column) -> DataFrame:
    """Nearest-neighbour resize without a join: every pixel emits the targets it is nearest to."""
    ys = g.scaled_targets(F.col("y"), F.col("h"), target_h)
    xs = g.scaled_targets(F.col("x"), F.col("w"), target_w)
    return (
        pixels.withColumns({"_ys": ys, "_xs": xs, "_h": target_h, "_w": target_w}).drop("y", "x", "h", "w")
        .select("*", F.explode("_ys").alias("y")).select("*", F.explode("_xs").alias("x")).drop("_ys", "_xs")
        .withColumnsRenamed({"_h": "h", "_w": "w"})
    )


def shrink_to(pixels: DataFrame, max_side: int, channels, image: str = "image_id", enlarge: bool = False) -> DataFrame:
    """Box-filter downscale so that the longer side is at most ``max_side``; smaller images stay as they are.

    With ``enlarge`` the pixels of smaller images move apart to that side as well; positions between them stay absent.
    """
    scale = F.lit(float(max_side)) / F.greatest("h", "w")
    scale = scale if enlarge else F.least(F.lit(1.0), scale)
    new_h = F.when(scale != 1.0, F.floor(F.col("h") * scale)).otherwise(F.col("h")).cast("int")
    new_w = F.when(scale != 1.0, F.floor(F.col("w") * scale)).otherwise(F.col("w")).cast("int")
    placed = pixels.withColumns({"_h": new_h, "_w": new_w}).withColumns({
        "y": F.floor(F.col("y") * F.col("_h") / F.col("h")).cast("int"),
        "x": F.floor(F.col("x") * F.col("_w") / F.col("w")).cast("int")})
    return placed.groupBy(image, "y", "x", F.col("_h").alias("h"), F.col("_w").alias("w")).agg(
        *[F.avg(c).alias(c) for c in names(channels)])


def crop(pixels: DataFrame, x0: Column, y0: Column, width: Column, height: Column) -> DataFrame:
    """Pixels of a box, moved to its origin."""
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + width) & (F.col("y") >= y0) & (F.col("y") < y0 + height)
    return pixels.where(inside).withColumns({"x": (F.col("x") - x0).cast("int"), "y": (F.col("y") - y0).cast("int")})


def center_crop(pixels: DataFrame, size: int) -> DataFrame:
    x0 = F.greatest(F.floor((F.col("w") - size) / 2), F.lit(0))
    y0 = F.greatest(F.floor((F.col("h") - size) / 2), F.lit(0))
    return crop(pixels, x0, y0, F.lit(size), F.lit(size))


def pool_roi(cells: DataFrame, rois: DataFrame, image: str = "image_id", roi: str | None = None) -> DataFrame:
    """Average feature vector over the cells of each region of interest.

    ``cells``: image, cy, cx, gh, gw, vec.  ``rois``: image, and either u0, v0,
    u1, v1 in unit coordinates or none of them for the whole map.
    """
    keys = [image] + ([roi] if roi else [])
    joined = cells.join(rois, image)
    if "u0" in rois.columns:
        unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
        x0, x1 = g.roi_cells(unit("u0"), unit("u1"), F.col("gw"))
        y0, y1 = g.roi_cells(unit("v0"), unit("v1"), F.col("gh"))
        joined = joined.where((F.col("cx") >= x0) & (F.col("cx") < x1) & (F.col("cy") >= y0) & (F.col("cy") < y1))
    return joined.select(*keys, F.posexplode("vec").alias("dim", "value")).groupBy(*keys, "dim").agg(F.avg("value").alias("value"))


def _draw(seed: int, *keys) -> Column:
    """Uniform number in [0, 1) that depends only on seed and keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def random_patches(images: DataFrame, count: int, seed: int, patch: int = PATCH, image: str = "image_id") -> DataFrame:
    """Seeded safe-rotation patches: extract origin, angle, scale and the patch's box in the global view."""
    side = extract_side(patch)
    planned = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    height, width = F.greatest("h", F.lit(side)), F.greatest("w", F.lit(side))
    key = [F.col(image), F.col("draw")]
    origin = lambda axis, size: F.floor(_draw(seed, F.lit(axis), *key) * (size - side + 1)).cast("int")
    spread = lambda name, lo, hi: F.lit(lo) + _draw(seed, F.lit(name), *key) * (hi - lo)
    drawn = planned.withColumns({
        "x0": origin("x", width), "y0": origin("y", height),
        "angle": spread("angle", *ROTATION_RANGE), "scale": spread("scale", *SCALE_RANGE),
    })
    shift = max((side - patch) // 2, 0)
    roi = g.global_roi(F.col("x0") + shift, F.col("y0") + shift, patch, patch, width, height)
    return drawn.withColumn("roi", F.array(*roi))


# Probability and range of each augmentation step.
AUGMENTATIONS = {
    "heavy": (("flip_x", 0.5), ("flip_y", 0.35), ("turns", 0.5), ("brightness", 0.9, -0.6, 0.6), ("contrast", 0.9, -0.5, 0.5),
              ("gamma", 0.6, 40, 200), ("blur", 0.25), ("holes", 0.3, 1, 6), ("noise", 0.3, 0.02, 0.08)),
    "light": (("flip_x", 0.5), ("flip_y", 0.35), ("turns", 0.5), ("brightness", 0.8, -0.35, 0.35), ("contrast", 0.8, -0.3, 0.3),
              ("gamma", 0.5, 60, 160)),
    "simple": (("flip_x", 0.5), ("flip_y", 0.35), ("turns", 0.5), ("brightness", 0.75, -20, 20), ("contrast", 0.75, 0.8, 1.2),
               ("blur", 0.25), ("noise", 0.25, 8, 8)),
}


def augmentation_plan(patches: DataFrame, keys, seed: int, kind: str = "heavy") -> DataFrame:
    """Deterministic draw per patch and step: NULL means the step is off, a number is its parameter."""
    columns = [F.col(k) for k in names(keys)]
    out = {}
    for name, chance, *bounds in AUGMENTATIONS[kind]:
        shared = "tone" if name in ("brightness", "contrast") else name
        active = _draw(seed, F.lit(shared), *columns) < chance
        amount = _draw(seed + 1, F.lit(name), *columns)
        if name == "turns":
            value = (F.floor(amount * 3) + 1).cast("double")
        elif name == "holes":
            value = (F.floor(amount * (bounds[1] - bounds[0] + 1)) + bounds[0]).cast("double")
        elif bounds:
            value = F.lit(float(bounds[0])) + amount * (bounds[1] - bounds[0])
        else:
            value = F.lit(1.0)
        out[name] = F.when(active, value)
    return patches.withColumns(out)


def apply_geometry(pixels: DataFrame) -> DataFrame:
    """Flips and quarter turns of patches (h, w) as coordinate arithmetic; an odd turn swaps h and w."""
    bottom, right = F.col("h") - 1, F.col("w") - 1
    x = F.when(F.col("flip_x").isNotNull(), right - F.col("x")).otherwise(F.col("x"))
    y = F.when(F.col("flip_y").isNotNull(), bottom - F.col("y")).otherwise(F.col("y"))
    flipped = pixels.withColumns({"x": x, "y": y})
    turn = F.coalesce(F.col("turns"), F.lit(0.0)).cast("int")
    odd = turn % 2 == 1
    return flipped.withColumns({
        "y": F.when(turn == 1, right - F.col("x")).when(turn == 2, bottom - F.col("y")).when(turn == 3, F.col("x")).otherwise(F.col("y")),
        "x": F.when(turn == 1, F.col("y")).when(turn == 2, right - F.col("x")).when(turn == 3, bottom - F.col("y")).otherwise(F.col("x")),
        "h": F.when(odd, F.col("w")).otherwise(F.col("h")), "w": F.when(odd, F.col("h")).otherwise(F.col("w")),
    })


def apply_tone(value: Column) -> Column:
    """Contrast, then brightness (simple plan) of an 8-bit channel, clipped and truncated."""
    scaled = value * F.coalesce(F.col("contrast"), F.lit(1.0)) + F.coalesce(F.col("brightness"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("int")
