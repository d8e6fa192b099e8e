"""Statistics of pixels, masks, components and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import round2
from tilewright.functions.scalar import CLASS_NAMES
from tilewright.operators.scale import attach, names, sorted_join


def class_percentages(pixels: DataFrame, by, name: Column, mask: Column | None = None) -> DataFrame:
    """Percent of every class per image, two decimals; inside ``mask`` if given (0 when it is empty)."""
    counted = F.lit(True) if mask is None else mask
    total = F.sum(F.when(counted, 1))
    share = lambda c: F.coalesce(
        round2(F.sum(F.when(counted & (name == c), 1)) / total * 100.0), F.lit(0.0))
    return pixels.groupBy(*names(by)).agg(*[share(c).alias(c) for c in CLASS_NAMES])


def labelled_tiles(tiles: DataFrame, limit: int = 400, image: str = "image_id") -> DataFrame:
    """Adds ``labelled``: numbers are drawn only on images with at most ``limit`` tiles."""
    counts = tiles.groupBy(image).agg((F.count(F.lit(1)) <= limit).alias("labelled"))
    return attach(tiles, counts, image)


def mask_box(pixels: DataFrame, selected: Column, image: str = "image_id") -> DataFrame:
    """Half-open bounding box of the selected pixels, the whole image when none is selected."""
    on = lambda c: F.when(selected, F.col(c))
    return pixels.groupBy(image).agg(
        F.coalesce(F.min(on("x")), F.lit(0)).alias("x0"), F.coalesce(F.min(on("y")), F.lit(0)).alias("y0"),
        F.coalesce(F.max(on("x")) + 1, F.max("x") + 1).alias("x1"), F.coalesce(F.max(on("y")) + 1, F.max("y") + 1).alias("y1"))


def component_stats(pixels: DataFrame, by, lab=("lab_l", "lab_a", "lab_b"), rgb=("r", "g", "b")) -> DataFrame:
    """Area, half-open box, centroid and mean colours of labelled components."""
    return pixels.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        *[F.avg(c).alias(f"mean_{c}") for c in (*lab, *rgb)])


def band_delta_e(pixels: DataFrame, by, inner: Column, outer: Column, lab=("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Distance of the mean Lab colours of two bands; NULL when a band is empty."""
    means = [(F.avg(F.when(inner, F.col(c))) - F.avg(F.when(outer, F.col(c)))) for c in lab]
    squared = sum((m * m for m in means[1:]), means[0] * means[0])
    return pixels.groupBy(*names(by)).agg(F.sqrt(squared).alias("delta_e"))


def stroke_width(component_px: DataFrame, skeleton_px: DataFrame, by) -> DataFrame:
    """Pixels of a line per skeleton pixel, at least 1; lines without a skeleton have width 1."""
    keys = names(by)
    thin = skeleton_px.groupBy(*keys).agg(F.count(F.lit(1)).alias("_thin"))
    full = component_px.groupBy(*keys).agg(F.count(F.lit(1)).alias("_full"))
    joined = sorted_join(full, thin, keys, "left")
    return joined.select(*keys, F.greatest(F.lit(1.0), F.coalesce(F.col("_full") / F.col("_thin"), F.lit(1.0))).alias("width"))


def segment_width(line_widths: DataFrame, by, width: str = "stroke_width") -> DataFrame:
    return line_widths.groupBy(*names(by)).agg(F.greatest(F.lit(1), F.rint(F.avg(width)).cast("int")).alias("segment_width"))


def batch_header(records: DataFrame, by=()) -> DataFrame:
    """Totals of a batch by status."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return records.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("total_images"), is_("ok").alias("success_count"), is_("skipped").alias("skipped_count"),
        is_("error").alias("failure_count"))


def zscores(rows: DataFrame, by, features) -> DataFrame:
    """Population z-scores per group; a deviation below 1e-6 counts as 1."""
    keys = names(by)
    moments = rows.groupBy(*keys).agg(
        *[F.avg(f).alias(f"_{f}_m") for f in features], *[F.stddev_pop(f).alias(f"_{f}_s") for f in features])
    placed = attach(rows, moments, keys)
    scaled = {
        f: (F.col(f) - F.col(f"_{f}_m")) / F.when(F.col(f"_{f}_s") < 1e-6, F.lit(1.0)).otherwise(F.col(f"_{f}_s"))
        for f in features}
    return placed.withColumns(scaled).drop(*[f"_{f}_{k}" for f in features for k in "ms"])


def box_counts(pixels: DataFrame, boxes: DataFrame, by, sums: dict[str, Column], image: str = "image_id") -> DataFrame:
    """Pixels (and sums of values) inside half-open boxes x0, y0, x1, y1.

    Boxes of an image are gathered on one row (a few per image), so each pixel
    visits only the boxes that hold it and counts combine before the shuffle.
    """
    keys = names(by)
    gathered = boxes.groupBy(image).agg(F.collect_list(F.struct(*keys, "x0", "y0", "x1", "y1")).alias("_boxes"))
    holds = lambda b: (F.col("x") >= b["x0"]) & (F.col("x") < b["x1"]) & (F.col("y") >= b["y0"]) & (F.col("y") < b["y1"])
    hit = attach(pixels, gathered, image).select(
        image, *[c.alias(f"_{n}") for n, c in sums.items()], F.explode(F.filter("_boxes", holds)).alias("_b"))
    return hit.groupBy(image, *[F.col(f"_b.{k}").alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_{n}").alias(n) for n in sums])
