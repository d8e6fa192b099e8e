"""Overlapping tile scores to pixel classes, heat maps and image verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import verdict
from tilewright.operators.scale import attach, names, with_mean_in_order

CLASS_COUNT, ORE_INDEX, TALC_INDEX = 4, 0, 2
CLASS_COLUMNS = [f"p{i}" for i in range(CLASS_COUNT)]
ScoreFunction = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def gaussian_weight(dy: Column, dx: Column, tile: int, share: float = 0.125) -> Column:
    centre, spread = (tile - 1) / 2.0, 2 * (tile * share) ** 2
    bell = lambda d: F.exp(-((d - centre) * (d - centre)) / F.lit(spread))
    return F.greatest(bell(dy) * bell(dx), F.lit(1e-3))


def blend(tile_pixels: DataFrame, by, values) -> DataFrame:
    """Weighted mean per pixel; partial sums combine before the shuffle."""
    total = F.greatest(F.sum("weight"), F.lit(1e-6))
    return tile_pixels.groupBy(*names(by)).agg(
        *[(F.sum(F.col(v) * F.col("weight")) / total).alias(v) for v in names(values)], F.sum("weight").alias("weight"))


def top_class(columns=CLASS_COLUMNS) -> Column:
    """Index of the largest value, lowest index on ties."""
    values = [F.col(c) for c in columns]
    return (F.array_position(F.array(*values), F.greatest(*values)) - 1).cast("int")


def tile_ore_ratio(tile_pixels: DataFrame, keys) -> DataFrame:
    """Share of ore among a tile's pixels inside the image (``inside``), 0 if there are none."""
    ore = F.when(F.col("inside"), (top_class() == ORE_INDEX).cast("double"))
    return tile_pixels.groupBy(*names(keys)).agg(F.coalesce(F.avg(ore), F.lit(0.0)).alias("ore_ratio"))


def class_share(pixels: DataFrame, by, condition: Column, name: str) -> DataFrame:
    return pixels.groupBy(*names(by)).agg(F.avg(condition.cast("double")).alias(name))


def ore_shares(tiles: DataFrame, *facts: Column, order="tile_id", image: str = "image_id") -> DataFrame:
    """``ore_share`` per image, the mean of its tiles' ore_ratio added in ``order``, and further aggregates ``facts``."""
    running = with_mean_in_order(tiles, image, "ore_ratio", order, "_share")
    return running.groupBy(image).agg(F.max_by("_share", "_nth").alias("ore_share"), *facts)


def accepted_tiles(tiles: DataFrame, images: DataFrame, factor: float, image: str = "image_id") -> DataFrame:
    """Tiles with ore_ratio >= global ratio / factor; without ore or factor no tile is accepted.

    ``images`` carries one ``ore_share`` per image.
    """
    if factor <= 0:
        return tiles.where(F.lit(False))
    joined = attach(tiles, images.where(F.col("ore_share") > 0).select(image, "ore_share"), image)
    return joined.where(F.col("ore_ratio") >= F.col("ore_share") / F.lit(float(factor))).drop("ore_share")


def image_difficulty(images: DataFrame, accepted: DataFrame, image: str = "image_id") -> DataFrame:
    """Mean probability of accepted tiles whose centre is inside; 0 for images without one."""
    mean = accepted.where("centre_inside").groupBy(image).agg(F.avg("prob").alias("difficulty"))
    return images.join(mean, image, "left").withColumn("difficulty", F.coalesce("difficulty", F.lit(0.0)))


def image_verdicts(images: DataFrame, accepted: DataFrame, image: str = "image_id") -> DataFrame:
    """``images`` (with talc_ratio) plus difficulty, flags and verdict."""
    scored = image_difficulty(images, accepted, image)
    return scored.withColumns({
        "is_talcose": F.col("talc_ratio") > 0.10, "is_difficult": F.col("difficulty") >= 0.50,
        "verdict": verdict(F.col("talc_ratio"), F.col("difficulty"))})


def tile_arrays(tile_pixels: DataFrame, keys, tile: int, value: str) -> DataFrame:
    """One row per tile with its values and their row-major places ``at``; a group never exceeds tile x tile values.

    Places an image has no pixel for are left out.
    """
    cell = F.struct((F.col("dy") * tile + F.col("dx")).alias("at"), F.col(value).alias("v"))
    ordered = F.array_sort(F.collect_list(cell))
    return tile_pixels.groupBy(*names(keys)).agg(ordered.alias("_cells")).select(
        *names(keys), F.transform("_cells", lambda c: c["at"]).alias("at"), F.transform("_cells", lambda c: c["v"]).alias("values"))


def linear_scores(batch: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Default scorer: class logits linear in the pixel and the image mean, difficulty linear in tile mean; absent places are NaN."""
    slope, offset = np.array([1.5, 0.2, -1.0, -0.4]), np.array([0.1, 0.6, 0.2, -0.8])
    logits = batch[..., None] * slope + offset + 0.3 * context[:, None, None, None] * slope[::-1]
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    difficulty = 1.0 / (1.0 + np.exp(-(0.2 + 0.9 * np.nanmean(batch, axis=(1, 2)) - 0.5 * context)))
    return powers / powers.sum(axis=-1, keepdims=True), difficulty


def score_tiles(tiles: DataFrame, tile: int, score: ScoreFunction = linear_scores, keys=("image_id", "ty", "tx")) -> DataFrame:
    """Scores batches of tiles in Python workers.

    ``tiles`` has the keys, ``at`` and ``values`` (see :func:`tile_arrays`) and
    ``context`` (the image's shared number).  The scorer is any callable on numpy
    batches of tile x tile values, NaN at absent places; a model is loaded lazily
    inside it, once per worker.  Scores come back for the places in ``at``.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", prob double, at array<int>, " + ", ".join(
        f"{c} array<double>" for c in CLASS_COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if frame.empty:
                continue
            sizes = np.array([len(a) for a in frame["at"]])
            owner, place = np.repeat(np.arange(len(frame)), sizes), np.concatenate(frame["at"].to_numpy()).astype(np.int64)
            stacked = np.full((len(frame), tile * tile), np.nan)
            stacked[owner, place] = np.concatenate(frame["values"].to_numpy())
            classes, difficulty = score(stacked.reshape(len(frame), tile, tile), frame["context"].to_numpy(dtype=float))
            out = frame[keys].copy()
            out["prob"], out["at"] = difficulty, frame["at"]
            flat, ends = classes.reshape(len(frame), tile * tile, CLASS_COUNT), np.cumsum(sizes)[:-1]
            for i, name in enumerate(CLASS_COLUMNS):
                out[name] = np.split(flat[owner, place, i], ends)
            yield out

    return tiles.mapInPandas(run, schema)


def explode_tiles(scored: DataFrame, tile: int, keys=("image_id", "ty", "tx")) -> DataFrame:
    """Scored tiles to weighted pixels in padded coordinates."""
    zipped = F.arrays_zip("at", *CLASS_COLUMNS)
    rows = scored.select(*keys, "prob", F.explode(zipped).alias("c")).withColumn("at", F.col("c.at"))
    dy, dx = F.floor(F.col("at") / tile).cast("int"), (F.col("at") % tile).cast("int")
    return rows.select(
        *keys, "prob", (F.col("ty") + dy).alias("y"), (F.col("tx") + dx).alias("x"),
        gaussian_weight(dy, dx, tile).alias("weight"), *[F.col(f"c.{c}").alias(c) for c in CLASS_COLUMNS])
