"""Search for the crop that keeps the sketched interior and sheds unwanted dark pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.morphology import deeper_than
from tilewright.operators.scale import attach, cut_lineage

STEPS = 20  # expansions 0/20 .. 20/20


@dataclass(frozen=True)
class CropSettings:
    excluded_max_fraction: float = 0.125
    min_area_ratio: float = 0.50
    erosion_radius: int = 42


def crop_candidates(pixels: DataFrame, boxes: DataFrame, settings: CropSettings, image: str = "image_id") -> DataFrame:
    """All 21 rectangles per image with their counts.

    ``pixels``: interior, talc, excluded (0/1); ``boxes``: half-open x0, y0, x1, y1.
    Rectangles grow from the tight box of the mandatory pixels to the base box,
    so they are nested: a pixel is counted once, at the first rectangle that
    holds it, and 21 sums per image are accumulated.
    """
    deep = attach(deeper_than(pixels, "interior", settings.erosion_radius, "_deep", image), boxes, image)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    deep = cut_lineage(deep.where(inside).select(image, "y", "x", "talc", "excluded", "_deep", "x0", "y0", "x1", "y1"))
    on = F.col("_deep") == 1
    low = lambda c: F.coalesce(F.min(F.when(on, F.col(c))), F.first(f"{c}0"))
    high = lambda c: F.coalesce(F.max(F.when(on, F.col(c))), F.first(f"{c}1") - 1)
    tight = deep.groupBy(image).agg(
        low("x").alias("tx0"), low("y").alias("ty0"), high("x").alias("tx1"), high("y").alias("ty1"), F.first("x0").alias("x0"),
        F.first("y0").alias("y0"), F.first("x1").alias("x1"), F.first("y1").alias("y1"), F.count(F.lit(1)).alias("base_area"),
        F.sum("excluded").cast("bigint").alias("excluded_before"), F.sum("talc").cast("bigint").alias("talc_before"))

    def rect(i):
        t = i / F.lit(float(STEPS))
        near = lambda v: F.rint(v).cast("int")
        return F.struct(
            i.alias("step"), near(F.col("tx0") - t * (F.col("tx0") - F.col("x0"))).alias("left"), near(F.col("ty0") - t * (F.col("ty0") - F.col("y0"))).alias("top"),
            near(F.col("tx1") + t * (F.col("x1") - 1 - F.col("tx1"))).alias("right"), near(F.col("ty1") + t * (F.col("y1") - 1 - F.col("ty1"))).alias("bottom"))

    rects = tight.withColumn("rects", F.transform(F.sequence(F.lit(0), F.lit(STEPS)), rect))
    dark = attach(deep.where((F.col("talc") == 1) | (F.col("excluded") == 1)).select(image, "y", "x", "talc", "excluded"), rects.select(image, "rects"), image)
    first = F.size(F.filter("rects", lambda r: ~(F.col("x").between(r["left"], r["right"]) & F.col("y").between(r["top"], r["bottom"]))))
    counted = dark.groupBy(image, first.alias("step")).agg(F.sum("talc").cast("bigint").alias("talc"), F.sum("excluded").cast("bigint").alias("excluded"))
    packed = counted.groupBy(image).agg(F.collect_list(F.struct("step", "talc", "excluded")).alias("counts"))
    joined = rects.join(packed, image, "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<step:int,talc:bigint,excluded:bigint>>")))
    each = joined.select("*", F.explode("rects").alias("r"))
    upto = lambda name: F.aggregate(
        F.filter("counts", lambda c: c["step"] <= F.col("r.step")), F.lit(0).cast("bigint"), lambda s, c: s + c[name])
    area = (F.col("r.right") - F.col("r.left") + 1) * (F.col("r.bottom") - F.col("r.top") + 1)
    each = each.select(
        image, "r.*", "base_area", "excluded_before", "talc_before", "x0", "y0", "x1", "y1", upto("talc").alias("talc_inside"), upto("excluded").alias("excluded_after"),
        (area / F.greatest(F.col("base_area"), F.lit(1))).alias("area_ratio"))
    share = F.when(F.col("talc_inside") > 0, F.col("excluded_after") / F.col("talc_inside")).otherwise(F.lit(0.0))
    return each.withColumn("excluded_fraction", share)


def best_crop(candidates: DataFrame, settings: CropSettings, image: str = "image_id") -> DataFrame:
    """Largest crop within the allowed share; else the one that sheds most; else the base box.

    Comparisons ignore differences below 1e-6, and the earlier expansion wins ties.
    """
    wide = F.col("area_ratio") >= settings.min_area_ratio
    valid = wide & (F.col("excluded_fraction") <= settings.excluded_max_fraction)
    reducing = wide & ~valid & (F.col("excluded_before") > 0) & (F.col("excluded_after") < F.col("excluded_before"))
    ratio, share = F.round("area_ratio", 6), F.round("excluded_fraction", 6)
    row = F.struct("left", "top", "right", "bottom", "area_ratio", "excluded_after", "talc_inside", "excluded_fraction")
    picked = candidates.groupBy(image).agg(
        F.min_by(row, F.when(valid, F.struct((-ratio).alias("a"), share.alias("b"), F.col("step").alias("c")))).alias("_v"),
        F.min_by(row, F.when(reducing, F.struct(share.alias("a"), (-ratio).alias("b"), F.col("step").alias("c")))).alias("_r"),
        *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1", "excluded_before", "talc_before")])
    whole_share = F.when(F.col("talc_before") > 0, F.col("excluded_before") / F.col("talc_before")).otherwise(F.lit(0.0))
    base = F.struct(
        F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - 1).alias("right"), (F.col("y1") - 1).alias("bottom"), F.lit(1.0).alias("area_ratio"),
        F.col("excluded_before").alias("excluded_after"), F.col("talc_before").alias("talc_inside"), whole_share.alias("excluded_fraction"))
    chosen = picked.withColumn("_c", F.coalesce("_v", "_r", base))
    fallback = F.col("_v").isNull() & (F.col("_r").isNotNull() | (F.col("excluded_before") > 0))
    enhanced = (F.col("_c.excluded_after") < F.col("excluded_before")) | (F.col("_c.area_ratio") < 0.999)
    return chosen.select(
        image, "_c.left", "_c.top", "_c.right", "_c.bottom", F.round("_c.area_ratio", 4).alias("area_ratio"), "excluded_before", "_c.excluded_after",
        "_c.talc_inside", F.round("_c.excluded_fraction", 4).alias("excluded_fraction"), enhanced.alias("enhanced"), fallback.alias("fallback"))
