"""Sketch-guided correction of class maps, and batch masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import class_name
from tilewright.operators import cluster as cl
from tilewright.operators import crop as cr
from tilewright.operators import raster_classes as rc
from tilewright.operators import segments as sg
from tilewright.operators.components import CHUNK, exterior_split, label_components
from tilewright.operators.raster import Raster, to_chunks
from tilewright.operators.scale import attach, cut_lineage, stored
from tilewright.operators.sketch import region_choice
from tilewright.operators.stats import class_percentages

KEY = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Correction:
    pixels: DataFrame
    crops: DataFrame
    full_stats: DataFrame
    crop_stats: DataFrame
    choices: DataFrame


def interior_regions(pixels: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interior flag per pixel and the region choice per image.

    ``pixels``: h, w, line (boolean); ``sketches``: image_id, lines, open_ends,
    open_ends_on_edge, closed_lines, region_mode.
    """
    free = exterior_split(pixels, F.col("line")).select(*KEY, (~F.col("exterior")).alias("enclosed"))
    rows = cut_lineage(pixels.join(free, KEY, "left").withColumn("enclosed", F.coalesce("enclosed", F.lit(False))))
    regions = label_components(rows.where("enclosed").select(*KEY)).select("image_id", "label").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("regions"))
    images = sketches.join(regions, "image_id", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    choices = cut_lineage(region_choice(images))
    sided = attach(rows, choices.select("image_id", "side"), "image_id")
    interior = F.when(F.col("side") == "outside", ~(F.col("enclosed") | F.col("line"))).otherwise(F.col("enclosed") & (F.col("side") != "none"))
    return sided.withColumn("interior", interior).drop("enclosed"), choices


def correct_with_sketch(
    pixels: DataFrame, sketches: DataFrame, settings: cr.CropSettings, cluster: sg.ClusterFunction = sg.density_labels,
) -> Correction:
    """Keeps dark segments that belong to the sketched region and crops around it.

    ``pixels``: image_id, y, x, h, w, r, g, b, Lab, code, line.  Images whose sketch
    is open keep their class map and their full frame (``applied`` false).
    """
    sided, choices = interior_regions(pixels, sketches)
    some = sided.groupBy("image_id").agg(F.max(F.col("interior").cast("int")).alias("_some"))
    rows = cut_lineage(attach(sided, some, "image_id").withColumn("applied", (F.col("side") != "none") & (F.col("_some") == 1)).drop("_some", "side"))
    active = rows.where("applied").withColumns({"talc": F.col("code") == 3, "boundary": F.col("line")})
    parts = cut_lineage(sg.region_parts(active))
    stats_rows = active.select(*KEY, "lab_l", "lab_a", "lab_b", "r", "g", "b")
    grouped = sg.component_stats(parts.join(stats_rows, KEY), ["image_id", "component", "region", "part"])
    size = active.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    named = {"mean_lab_l": "l", "mean_lab_a": "a", "mean_lab_b": "b"}
    inside = F.col("region").isNotNull()
    segments = attach(grouped.withColumnsRenamed(named), size, "image_id").withColumns({
        "inside": inside, "intersects": inside, "region_id": F.coalesce(F.col("region") + 1, F.lit(0)),
        "segment_id": F.struct("component", F.coalesce("region", F.lit(-1)).alias("region"), "part")})
    segments = cut_lineage(segments)
    mask = active.where("interior").select(*KEY)
    chosen = sg.select_segments(segments, mask, F.col("w"), F.col("h"), cluster).where("kept").select("image_id", "segment_id")
    kept = parts.withColumn("segment_id", F.struct("component", F.coalesce("region", F.lit(-1)).alias("region"), "part")).join(
        chosen, ["image_id", "segment_id"], "left_semi").select(*KEY, F.lit(True).alias("_kept"))
    marked = rows.join(kept, KEY, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    dropped = F.col("applied") & (F.col("code") == 3) & ~F.col("_kept")
    marked = cut_lineage(marked.withColumns({"excluded": dropped.cast("int"), "talc": (F.col("code") == 3).cast("int"), "code": F.when(dropped, 2).otherwise(F.col("code"))}))
    frame = marked.where("applied").where(F.col("interior") | F.col("line")).groupBy("image_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    shapes = marked.where("applied").select(*KEY, "talc", "excluded", F.col("interior").cast("int").alias("interior"))
    crops = cut_lineage(cr.best_crop(cr.crop_candidates(shapes, frame, settings), settings))
    boxed = attach(marked, crops.select("image_id", "left", "top", "right", "bottom"), "image_id", "left")
    in_crop = F.coalesce(F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("top"), F.col("bottom")), F.lit(True))
    final = boxed.withColumn("in_crop", in_crop).drop("_kept", "left", "top", "right", "bottom")
    name = class_name(F.col("code"))
    return Correction(
        final, crops, class_percentages(final, "image_id", name), class_percentages(final, "image_id", name, F.col("in_crop")), choices)


def batch_masks(pixels: DataFrame, settings: cl.TwoStepSettings, unreadable: DataFrame | None = None, chunk: int = CHUNK) -> tuple[Raster, DataFrame]:
    """Class masks (channel ``code``) of all readable images at their own size, and one record per image (ok or error).

    ``pixels``: image_id, y, x, h, w, r, g, b; ``unreadable``: image_id, error.  Images longer than ``max_work_side`` are
    classified at that side and their masks brought back by the nearest position.
    """
    work = rc.at_work_side(to_chunks(pixels, ["r", "g", "b"], chunk=chunk), settings.max_work_side)
    sizes = stored(work.frame.select("image_id", "source_h", "source_w").distinct())
    coded = rc.corrected(rc.with_lab(work.without_facts()), settings).pick("code").with_facts(sizes).settled()
    records = coded.frame.groupBy("image_id").agg(*[F.first(c).alias(n) for c, n in (
        ("h", "height"), ("w", "width"), ("source_h", "source_height"), ("source_w", "source_width"), ("applied", "illumination"))])
    records = records.select("image_id", F.lit("ok").alias("status"), "height", "width", "source_height", "source_width", "illumination", F.lit(None).cast("string").alias("error"))
    if unreadable is not None:
        records = records.unionByName(unreadable.select("image_id", F.lit("error").alias("status"), "error"), allowMissingColumns=True)
    return rc.at_source_size(coded), records
