"""Training patches as pixels: rotated extracts of chunked images, and the augmentation plan applied to them.

A patch asks only the chunks its extract touches; they meet in one group per patch, whose size the patch side bounds.
Draws depend on the seed and the patch's keys, never on chunks or partitions.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.raster import Block, Raster
from tilewright.operators.scale import spread_for_python
from tilewright.operators.tiling import PATCH, extract_side

# Sides of a hole, weights of the blur.
HOLE_SIDES = (8, 28)
BLUR = np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2))


def mirrored(place: np.ndarray, size: int) -> np.ndarray:
    """Positions outside 0..size-1 mirrored at the border positions, as often as needed."""
    period = max(1, 2 * (size - 1))
    place = np.abs(place) % period
    return np.where(place >= size, period - place, place)


def _sources(angle: float, scale: float, side: int, patch: int) -> tuple[np.ndarray, np.ndarray]:
    """Source y and x, within the extract, of every position of its central patch after rotation and scaling about the centre."""
    turn, centre, shift = np.deg2rad(angle), side / 2.0, max((side - patch) // 2, 0)
    y, x = np.indices((patch, patch), dtype=float) + shift - centre
    cos, sin = np.cos(turn) / scale, np.sin(turn) / scale
    return sin * x + cos * y + centre, cos * x - sin * y + centre


def warped(extract: np.ndarray, angle: float, scale: float, patch: int, linear: bool) -> np.ndarray:
    """The central patch of a square extract rotated and scaled; borders are mirrored."""
    side = extract.shape[0]
    y, x = _sources(angle, scale, side, patch)
    at = lambda a, b: extract[mirrored(a, side), mirrored(b, side)]
    if not linear:
        return at(np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    return (at(y0, x0) * (1 - fy) + at(y0 + 1, x0) * fy) * (1 - fx) + (at(y0, x0 + 1) * (1 - fy) + at(y0 + 1, x0 + 1) * fy) * fx


def warped_patches(raster: Raster, plan: DataFrame, patch: int = PATCH, nearest=()) -> Raster:
    """One raster of a single chunk for every row of ``plan`` (the raster's ``by``, draw, x0, y0, angle, scale).

    x0 and y0 count from the image padded evenly to the extract's side.  Channels named in ``nearest`` (class masks) take the
    nearest source, the others mix four; 8-bit callers round what comes out.
    """
    side, chunk, by = extract_side(patch), raster.chunk, list(raster.by)
    keys, channels = [*by, "draw"], list(raster.channels)
    sizes = raster.frame.select(*by, "h", "w").distinct()

    def reached(origin: str, size: str):
        """First and last chunk of an axis that the extract reads, mirrored parts included."""
        first = F.col(origin) - F.floor(F.greatest(F.lit(side) - F.col(size), F.lit(0)) / 2)
        low, high = F.greatest(first, F.lit(0)), F.least(first + side - 1, F.col(size) - 1)
        return F.sequence(F.floor(low / chunk).cast("int"), F.floor(high / chunk).cast("int"))

    asked = plan.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("x0", "y0")], *[F.col(c).cast("double").alias(c) for c in ("angle", "scale")])
    asked = asked.join(sizes, by).withColumn("cy", F.explode(reached("y0", "h"))).withColumn("cx", F.explode(reached("x0", "w")))
    met = asked.drop("h", "w").join(raster.frame.select(*raster.keys, *channels), [*by, "cy", "cx"])
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.to_dict("records")[0]
        h, w = int(first["h"]), int(first["w"])
        top, left = int(first["y0"]) - max(side - h, 0) // 2, int(first["x0"]) - max(side - w, 0) // 2
        low_y, low_x = max(top, 0) // chunk * chunk, max(left, 0) // chunk * chunk
        rows, cols = mirrored(np.arange(top, top + side), h) - low_y, mirrored(np.arange(left, left + side), w) - low_x
        out = {**{k: [first[k]] for k in keys}, "h": [patch], "w": [patch], "cy": [0], "cx": [0]}
        for c in channels:
            held = np.full((rows.max() + 1, cols.max() + 1), np.nan)
            for cy, cx, data in zip(frame["cy"], frame["cx"], frame[c]):
                block = np.frombuffer(data, dtype=np.float64).reshape(-1, min(chunk, w - cx * chunk))
                y, x = cy * chunk - low_y, cx * chunk - low_x
                part = held[y:y + block.shape[0], x:x + block.shape[1]]
                part[...] = block[:part.shape[0], :part.shape[1]]
            out[c] = [warped(held[np.ix_(rows, cols)], first["angle"], first["scale"], patch, c not in nearest).tobytes()]
        return pd.DataFrame(out)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", h int, w int, cy int, cx int" + "".join(f", `{c}` binary" for c in channels)
    made = spread_for_python(met, *keys).groupBy(*keys).applyInPandas(cut, schema)
    return Raster(made, tuple(keys), tuple(channels), (), max(patch, 1))


def augmented(raster: Raster, plan: DataFrame, seed: int) -> Raster:
    """8-bit channels after the tone, blur, hole and noise steps of ``plan``, in that order.

    ``plan`` has the raster's ``by`` and columns of ``augmentation_plan`` (NULL: step off).  Limits below 1 are shares as in
    the heavy and light plans, others gray levels and factors as in the simple one.  Flips and turns are done before.
    """
    steps = [c for c in ("brightness", "contrast", "gamma", "blur", "holes", "noise") if c in plan.columns]
    by, channels = list(raster.by), list(raster.channels)
    shares = "gamma" in plan.columns
    facts = plan.select(*by, *[F.col(c).cast("double").alias(f"_{c}") for c in steps], F.xxhash64(F.lit(seed), *[F.col(k) for k in by]).alias("_draw")).distinct()
    rows = raster.with_facts(facts)

    def value(block: Block, step: str) -> float | None:
        found = block.facts.get(f"_{step}")
        return None if found is None or np.isnan(found) else float(found)

    def tone(block: Block) -> dict:
        bright, contrast, gamma = (value(block, s) for s in ("brightness", "contrast", "gamma"))
        out = {}
        for c in channels:
            v = block[c]
            if bright is not None or contrast is not None:
                v = v * (1.0 + contrast) + bright * 255.0 if shares else v * (1.0 if contrast is None else contrast) + (0.0 if bright is None else bright)
                v = np.clip(np.floor(v), 0, 255)
            if gamma is not None:
                v = np.clip(np.floor((v / 255.0) ** (gamma / 100.0) * 255.0), 0, 255)
            out[c] = v
        return out

    def blurred(block: Block) -> dict:
        if value(block, "blur") is None:
            return {c: block[c][block.core] for c in channels}
        weights, out = BLUR / BLUR.sum(), {}
        for c in channels:
            v = block.reflected(c)
            h, w = v.shape
            across = sum(k * v[:, i:w - 4 + i] for i, k in enumerate(weights))
            out[c] = np.clip(np.floor(sum(k * across[i:h - 4 + i] for i, k in enumerate(weights)) + 0.5), 0, 255)
        return out

    def holes(block: Block) -> np.ndarray:
        """Positions of the block inside a hole; every chunk of a patch draws the same holes."""
        draw, inside = np.random.default_rng([seed, block.facts["_draw"] & (1 << 63) - 1]), np.zeros(block[channels[0]].shape, dtype=bool)
        for _ in range(int(value(block, "holes") or 0)):
            tall, wide = (min(int(draw.integers(HOLE_SIDES[0], HOLE_SIDES[1] + 1)), n) for n in (block.h, block.w))
            top, left = int(draw.integers(0, block.h - tall + 1)) - block.top, int(draw.integers(0, block.w - wide + 1)) - block.left
            inside[max(0, top):max(0, top + tall), max(0, left):max(0, left + wide)] = True
        return inside

    def last(block: Block) -> dict:
        inside, spread = holes(block), value(block, "noise")
        out = {c: np.where(inside, 0.0, block[c]) for c in channels}
        if spread is not None:
            deviation = spread * 255.0 if shares else spread
            rows = np.stack([np.random.default_rng([seed + 1, block.facts["_draw"] & (1 << 63) - 1, block.top + y]).standard_normal((len(channels), block.w))[:, block.left:block.left + inside.shape[1]] for y in range(inside.shape[0])], axis=1)
            out = {c: np.clip(np.floor(out[c] + deviation * n + 0.5), 0, 255) for c, n in zip(channels, rows)}
        return out

    rows = rows.map(tone, channels)
    if "blur" in steps:
        rows = rows.stencil(2, channels, blurred, channels)
    done = rows.map(last, channels)
    return replace(done, frame=done.frame.drop(*facts.drop(*by).columns), facts=raster.facts)
