"""Batch bookkeeping: settings, exclusions, artefact routing and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import color
from tilewright.functions.scalar import class_name, is_artifact_key
from tilewright.functions.settings import with_settings


def with_image_settings(images: DataFrame, saved: DataFrame, key: str, document: str = "doc") -> DataFrame:
    """Every image with its ``settings`` record; no saved row or bad JSON means defaults.

    ``saved`` holds at most one row per key, so the outer join never multiplies rows.
    """
    joined = images.join(saved.select(key, F.col(document).alias("_doc")), key, "left")
    return with_settings(joined, "_doc").drop("_doc")


def preview_pixels(pixels: DataFrame, corrected: bool = False) -> DataFrame:
    """Overlay colours of a class mask (``code`` with r, g, b), clipped to 8 bits."""
    colors = color.CORRECTED_COLORS if corrected else color.OVERLAY_COLORS
    mixed = color.class_overlay((F.col("r"), F.col("g"), F.col("b")), class_name(F.col("code")), colors)
    return pixels.withColumns({n: color.to_byte(v) for n, v in zip("rgb", mixed)})


EXPORT_KINDS = ("color-masks", "color-previews", "corrected-masks", "corrected-previews", "corrected-originals", "all")
_FILES = {
    "color-masks": ("masks", "npy"), "color-previews": ("previews", "png"), "corrected-masks": ("masks", "npy"),
    "corrected-previews": ("previews", "png"), "corrected-originals": ("originals", "png"),
}


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def image_pairs(images: DataFrame, sketches: DataFrame) -> DataFrame:
    """Images with a sketch of the same file name (``name``, ``source_path`` / ``sketch_path``)."""
    allowed = F.lower("name").rlike(r"\.(jpg|jpeg|png|tif|tiff|bmp)$")
    return images.where(allowed).join(sketches.select("name", "sketch_path"), "name")


def segmentation_records(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with a mask of the same stem; images without one drop out."""
    usable = images.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$")).withColumn("stem", stem_of(F.col("name")))
    return usable.join(masks.select(stem_of(F.col("mask_name")).alias("stem"), "mask_name"), "stem")


def mask_records(manifest: DataFrame, mask_files: DataFrame) -> DataFrame:
    """Usable manifest rows (image, mask_file); without any, rows named after the mask files."""
    usable = manifest.where((F.col("status") == "ok") & F.col("mask_file").isNotNull()).select("image", "mask_file")
    derived = mask_files.select(F.concat(stem_of(F.col("mask_file")), F.lit(".JPG")).alias("image"), "mask_file")
    return derived if usable.isEmpty() else usable


def with_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``source_path``, ``status`` and ``error``: a record without its source image is an error row."""
    joined = records.join(sources.select("image", "source_path"), "image", "left")
    missing = F.col("source_path").isNull()
    return joined.withColumns({
        "status": F.when(missing, "error").otherwise("ok"), "error": F.when(missing, F.concat(F.lit("'"), F.col("image"), F.lit("'")))})


def export_records(images: DataFrame, kind: str) -> DataFrame:
    """Status and reason per image: excluded ones and open sketches are skipped, failures are errors.

    ``images``: image, excluded, correction_applied, error.  Exclusion is decided
    first, so place this filter before any heavy step.
    """
    color_only = kind.startswith("color-")
    opened = F.lit(False) if color_only else ~F.col("correction_applied")
    corrected = F.when(F.col("error").isNotNull(), "error").when(opened, "skipped").otherwise("ok")
    merged = F.when(corrected.isin("ok", "skipped"), "ok").otherwise(corrected) if kind == "all" else corrected
    status = F.when(F.col("excluded"), "skipped").otherwise(merged)
    reason = F.when(F.col("excluded"), "excluded").when(F.col("error").isNull() & opened & F.lit(kind != "all"), "open-sketch")
    return images.withColumns({"kind": F.lit(kind), "status": status, "reason": reason})


def export_files(images: DataFrame, kind: str) -> DataFrame:
    """One row per file to write: ``artefact`` and its path.

    Single kinds use the short folder names; ``all`` keeps one folder per kind
    and leaves out corrected files of open sketches.
    """
    kinds = [k for k in EXPORT_KINDS if k != "all"] if kind == "all" else [kind]
    wanted = F.array(*[
        F.struct(F.lit(k).alias("artefact"), F.lit(k if kind == "all" else _FILES[k][0]).alias("folder"), F.lit(_FILES[k][1]).alias("ext")) for k in kinds])
    live = images.where(~F.col("excluded") & F.col("error").isNull()).select("image", "correction_applied", F.explode(wanted).alias("f"))
    usable = F.col("f.artefact").startswith("color-") | F.col("correction_applied")
    return live.where(usable).select(
        "image", "f.artefact", F.concat(F.col("f.folder"), F.lit("/"), stem_of(F.col("image")), F.lit("."), F.col("f.ext")).alias("path"))


def available_artifacts(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Wanted (key, settings_json) that are already stored with equal settings under a valid key."""
    return wanted.where(is_artifact_key(F.col("key"))).join(store.select("key", "settings_json").distinct(), ["key", "settings_json"], "left_semi")


def missing_artifacts(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Only the work that is left: anti join before the heavy step."""
    return wanted.join(store.select("key", "settings_json").distinct(), ["key", "settings_json"], "left_anti")
