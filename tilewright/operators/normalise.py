"""Contrast normalisation of 8-bit colour rasters: quantised Lab, adaptive equalisation, stretch, and back to RGB or gray.

Histograms are counted chunk by chunk and summed by Spark; the look-up tables of an image are one short row that comes
back as a fact, so no position is copied or shuffled.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilewright.functions.color import RGB_TO_XYZ, WHITE_D65
from tilewright.operators.raster import Block, Raster, percentiles
from tilewright.operators.raster_classes import with_lab

RGB = ("r", "g", "b")
LEVELS = 256


def _byte(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255)


def quantised_lab(raster: Raster) -> Raster:
    """Channels l8, a8, b8 of 8-bit r, g, b: lightness over 0..255, colour shifted by 128."""
    def packed(block: Block) -> dict:
        return {"l8": _byte(block["lab_l"] * 255.0 / 100.0), "a8": _byte(block["lab_a"] + 128.0), "b8": _byte(block["lab_b"] + 128.0)}

    return with_lab(raster).map(packed, ["l8", "a8", "b8"], keep=())


def from_quantised_lab(raster: Raster) -> Raster:
    """8-bit r, g, b of l8, a8, b8."""
    back = np.linalg.inv(np.array(RGB_TO_XYZ))

    def colours(block: Block) -> dict:
        fy = (block["l8"] * 100.0 / 255.0 + 16.0) / 116.0
        bent = (block["a8"] - 128.0) / 500.0 + fy, fy, np.maximum(fy - (block["b8"] - 128.0) / 200.0, 0.0)
        xyz = [np.where(t > 0.2068966, t**3, (t - 16.0 / 116.0) / 7.787) * w for t, w in zip(bent, WHITE_D65)]
        light = [np.maximum(sum(m * v for m, v in zip(row, xyz)), 0.0) for row in back]
        return {c: _byte(np.where(v > 0.0031308, 1.055 * v ** (1 / 2.4) - 0.055, 12.92 * v) * 255.0) for c, v in zip(RGB, light)}

    return raster.map(colours, RGB, keep=())


def _cells(block: Block, grid: int) -> np.ndarray:
    h, w = next(iter(block.channels.values())).shape
    y = np.minimum((np.arange(h) + block.top) * grid // block.h, grid - 1)
    x = np.minimum((np.arange(w) + block.left) * grid // block.w, grid - 1)
    return y[:, None] * grid + x[None, :]


def look_up_row(counts: np.ndarray, clip: float) -> np.ndarray:
    """Look-up of one cell: its histogram clipped, the excess spread evenly, accumulated to 0..255."""
    area = int(counts.sum())
    limit = max(int(area * clip / LEVELS), 1)
    excess = int(np.maximum(counts - limit, 0).sum())
    level = np.minimum(counts, limit) + excess // LEVELS
    rest = excess % LEVELS
    if rest:
        level[::max(LEVELS // rest, 1)][:rest] += 1
    return np.minimum(np.rint(np.cumsum(level) * 255.0 / area), 255.0)


def equalised(raster: Raster, channel: str, grid: int = 8, clip: float = 3.0) -> Raster:
    """Contrast-limited adaptive equalisation of an 8-bit channel; each position mixes the look-ups of its four nearest cells."""
    by = list(raster.by)

    def histogram(block: Block) -> dict:
        held = ~np.isnan(block[channel])
        key, n = np.unique(_cells(block, grid)[held] * LEVELS + block[channel][held].astype(np.int64), return_counts=True)
        return {"cell": (key // LEVELS).astype(np.int32), "v": (key % LEVELS).astype(np.int32), "n": n.astype(np.int64)}

    counted = raster.without_facts().pick(channel).table(histogram, "cell int, v int, n long").groupBy(*by, "cell", "v").agg(F.sum("n").alias("n"))
    packed = counted.groupBy(*by).agg(F.collect_list(F.struct("cell", "v", "n")).alias("h"))  # at most grid * grid * 256 entries an image

    @F.pandas_udf("binary")
    def tables(histograms: pd.Series) -> pd.Series:
        out = []
        for rows in histograms:
            counts = np.zeros((grid * grid, LEVELS), dtype=np.int64)
            for r in rows:
                counts[r["cell"], r["v"]] = r["n"]
            out.append(np.stack([look_up_row(c, clip) if c.any() else np.zeros(LEVELS) for c in counts]).tobytes())
        return pd.Series(out)

    def mixed(block: Block) -> dict:
        tables, values = np.frombuffer(block.facts["_tables"]).reshape(grid, grid, LEVELS), block[channel]
        known = np.nan_to_num(values).astype(np.int64)
        place = [(np.arange(n) + first + 0.5) * grid / size - 0.5 for n, first, size in zip(values.shape, (block.top, block.left), (block.h, block.w))]
        low = [np.floor(p).astype(np.int64) for p in place]
        total = np.zeros(values.shape)
        for dy in (0, 1):
            for dx in (0, 1):
                share = [p - q if d else 1.0 - p + q for p, q, d in zip(place, low, (dy, dx))]
                y, x = (np.clip(q + d, 0, grid - 1) for q, d in zip(low, (dy, dx)))
                total += tables[y[:, None], x[None, :], known] * (share[0][:, None] * share[1][None, :])
        return {channel: np.where(np.isnan(values), np.nan, np.rint(total))}

    done = raster.with_facts(packed.select(*by, tables("h").alias("_tables"))).map(mixed, channel)
    return replace(done, frame=done.frame.drop("_tables"), facts=raster.facts)


def stretched(raster: Raster, channel: str) -> Raster:
    """Linear stretch of the 1st..99th percentile to 0..255, truncated; flat images stay as they are."""
    ends = percentiles(raster, channel, {"_low": 0.01, "_high": 0.99})

    def scaled(block: Block) -> dict:
        low, high = block.facts["_low"], block.facts["_high"]
        return {channel: np.floor(np.clip((block[channel] - low) * 255.0 / (high - low), 0.0, 255.0)) if high > low else block[channel]}

    done = raster.with_facts(ends).map(scaled, channel)
    return replace(done, frame=done.frame.drop("_low", "_high"), facts=raster.facts)


def normalised(raster: Raster) -> Raster:
    """8-bit r, g, b with equalised and stretched lightness, and their 8-bit ``gray``."""
    rows = stretched(equalised(quantised_lab(raster).settled(), "l8").settled(), "l8")

    def gray(block: Block) -> dict:
        return {"gray": np.floor((block["r"] * 4899 + block["g"] * 9617 + block["b"] * 1868 + 8192) / 16384)}

    return from_quantised_lab(rows).map(gray, "gray")
