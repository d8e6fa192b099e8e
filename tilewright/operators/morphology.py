"""Erosion, dilation and what is built from them.

A disk is a stack of horizontal runs.  One window pass per image row takes the
minimum or maximum over each run width, one pass per image column combines the
rows: two shuffles whatever the radius, groups never larger than one image row
or column, and no pixel is copied.  Positions outside the image (or absent from
the table) take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators.components import CHUNK, drop_small
from tilewright.operators.scale import attach, attach_measured, cut_lineage, image_percentiles, in_groups, names


def disk(radius: float) -> dict[int, int]:
    """Half width of the disk's run at each vertical offset."""
    reach = int(math.floor(radius))
    return {dy: int(math.floor(math.sqrt(radius * radius - dy * dy))) for dy in range(-reach, reach + 1)}


SQUARE = {-1: 1, 0: 1, 1: 1}


def sweep(pixels: DataFrame, values: dict[str, tuple[str, str]], footprint: dict[int, int], by="image_id") -> DataFrame:
    """Adds columns ``name -> (source column, "min" | "max")`` over the footprint."""
    keys = names(by)
    widths = sorted(set(footprint.values()))
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    ops = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    across = pixels.withColumns({
        f"_{name}_{w}": ops[how][0](source).over(row.rangeBetween(-w, w)) for name, (source, how) in values.items() for w in widths})
    out = {}
    for name, (_, how) in values.items():
        reduce, combine = ops[how]
        # Offsets with one width that are neighbours share a frame.
        frames: list[tuple[int, int, int]] = []
        for dy in sorted(footprint):
            if frames and frames[-1][2] == footprint[dy] and frames[-1][1] == dy - 1:
                frames[-1] = (frames[-1][0], dy, footprint[dy])
            else:
                frames.append((dy, dy, footprint[dy]))
        parts = [reduce(f"_{name}_{w}").over(column.rangeBetween(lo, hi)) for lo, hi, w in frames]
        out[name] = combine(*parts) if len(parts) > 1 else parts[0]
    return across.withColumns(out).drop(*[f"_{name}_{w}" for name in values for w in widths])


def erode(pixels: DataFrame, value: str, footprint: dict[int, int], name: str | None = None, by="image_id") -> DataFrame:
    return sweep(pixels, {name or value: (value, "min")}, footprint, by)


def dilate(pixels: DataFrame, value: str, footprint: dict[int, int], name: str | None = None, by="image_id") -> DataFrame:
    return sweep(pixels, {name or value: (value, "max")}, footprint, by)


def gradient(pixels: DataFrame, value: str, radius: int, name: str, by="image_id") -> DataFrame:
    """Dilation minus erosion of one channel (both in the same two passes)."""
    both = sweep(pixels, {"_hi": (value, "max"), "_lo": (value, "min")}, disk(max(1, radius)), by)
    return both.withColumn(name, F.col("_hi") - F.col("_lo")).drop("_hi", "_lo")


def lab_gradient(pixels: DataFrame, radius: int, channels=("lab_l", "lab_a", "lab_b"), name: str = "gradient", by="image_id") -> DataFrame:
    """Euclidean norm of the channel gradients."""
    wanted = {}
    for c in channels:
        wanted[f"_{c}_hi"], wanted[f"_{c}_lo"] = (c, "max"), (c, "min")
    both = sweep(pixels, wanted, disk(max(1, radius)), by)
    squares = [(F.col(f"_{c}_hi") - F.col(f"_{c}_lo")) ** 2 for c in channels]
    return both.withColumn(name, F.sqrt(sum(squares[1:], squares[0]))).drop(*wanted)


def robust_normalise(pixels: DataFrame, value: str, name: str, by="image_id") -> DataFrame:
    """Value over the p95 of its entries above 1e-6, clipped to 0..1; all 0 without such entries."""
    keys = names(by)
    scale = cut_lineage(image_percentiles(pixels.where(F.col(value) > 1e-6), keys, value, {"_p95": 0.95}))
    placed = attach_measured(pixels, scale, keys, "left")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_p95")))
    return placed.withColumn(name, F.when(F.col("_p95") > 1e-6, ratio).otherwise(F.lit(0.0))).drop("_p95")


def chain(pixels: DataFrame, value: str, name: str, steps, footprint: dict[int, int], by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Several erosions ("min") and dilations ("max") in a row with a single shuffle.

    Each pixel goes to its chunk and, as a halo as deep as all steps reach, to the
    chunks around it; a bounded block is then swept with numpy.  Other columns
    pass through unchanged.
    """
    keys, steps = names(by), list(steps)
    halo = max(max(map(abs, footprint)), max(footprint.values())) * len(steps)
    shifts = [(dy, dx) for dy, half in footprint.items() for dx in range(-half, half + 1)]
    columns = [c for c in pixels.columns if c != name]
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / chunk), F.floor((F.col(c) + halo) / chunk))
    spread = pixels.select(*columns, F.col(value).cast("double").alias("_v"), F.explode(near("y")).alias("_cy")).select("*", F.explode(near("x")).alias("_cx"))
    own = (F.col("_cy") == F.floor(F.col("y") / chunk)) & (F.col("_cx") == F.floor(F.col("x") / chunk))
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{name}` int"

    def run(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        mine = frame["_own"].to_numpy(dtype=bool)
        y, x = frame["y"].to_numpy(dtype=np.int64), frame["x"].to_numpy(dtype=np.int64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        top, left = np.minimum.reduceat(y, first), np.minimum.reduceat(x, first)
        # Blocks lie one below the other, each between rims as deep as all steps reach.
        heights = np.maximum.reduceat(y, first) - top + 1 + 2 * halo
        y, x = y - top[group] + (np.cumsum(heights) - heights)[group] + halo, x - left[group] + halo
        block = np.full((heights.sum(), x.max() + halo + 1), np.nan)
        block[y, x] = frame["_v"].to_numpy()
        absent = np.isnan(block)
        for step in steps:
            pick, moved = (np.fmin if step == "min" else np.fmax), np.full_like(block, np.nan)
            padded = np.pad(block, halo, constant_values=np.nan)
            for dy, dx in shifts:
                moved = pick(moved, padded[halo + dy:halo + dy + block.shape[0], halo + dx:halo + dx + block.shape[1]])
            moved[absent] = np.nan
            block = moved
        out = frame.loc[mine, columns].copy()
        out[name] = block[y, x][mine].astype("int32")
        return out

    return in_groups(spread.withColumn("_own", own), [*keys, "_cy", "_cx"], run, schema)


def open_close(pixels: DataFrame, value: str, radius: int, name: str, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Opening, then closing of a 0/1 column."""
    if radius <= 0:
        return pixels.withColumn(name, F.col(value).cast("int"))
    return chain(pixels, value, name, ("min", "max", "max", "min"), disk(radius), by, chunk)


def close_square(pixels: DataFrame, value: str, name: str, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """3 x 3 closing used for sketch lines."""
    return chain(pixels, value, name, ("max", "min"), SQUARE, by, chunk)


def postprocess(pixels: DataFrame, code: str, minimum: int, radius: int, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Clean classes in the fixed order ore, talc, damage; what falls out becomes matrix.

    Each class sees the result of the one before, so the order is observable.
    """
    keys = names(by)
    rows = pixels
    for value in (1, 3, 4):
        masked = cut_lineage(open_close(rows.withColumn("_in", (F.col(code) == value).cast("int")), "_in", radius, "_mask", keys, chunk))
        if minimum > 0:
            kept = drop_small(masked.where(F.col("_mask") == 1), minimum, keys, chunk).withColumn("_keep", F.lit(True))
            masked = masked.join(kept, [*keys, "y", "x"], "left")
            on = F.coalesce("_keep", F.lit(False))
        else:
            on = F.col("_mask") == 1
        rows = masked.withColumn(
            code, F.when(on, F.lit(value)).when(F.col(code) == value, F.lit(2)).otherwise(F.col(code))).drop("_in", "_mask", "_keep")
    return rows


def deeper_than(pixels: DataFrame, mask: str, radius: float, name: str, by="image_id") -> DataFrame:
    """0/1 column: set pixels farther than ``radius`` from every unset pixel.

    One plan for every radius, from exact distances.  An image where nothing
    survives keeps its mask.
    """
    keys = names(by)
    if radius <= 0:
        return pixels.withColumn(name, F.col(mask))
    far = squared_distances(pixels, mask, keys)
    deep = (F.col(mask) == 1) & (F.col("_d2").isNull() | (F.col("_d2") > F.lit(float(radius) ** 2)))
    eroded = pixels.join(far.withColumnRenamed("d2", "_d2"), [*keys, "y", "x"], "left").withColumn("_survives", F.coalesce(deep, F.lit(False)).cast("int")).drop("_d2")
    any_left = eroded.groupBy(*keys).agg(F.max("_survives").alias("_any"))
    return attach(eroded, any_left, keys).withColumn(
        name, F.when(F.col("_any") > 0, F.col("_survives")).otherwise(F.col(mask))).drop("_survives", "_any")


def squared_distances(pixels: DataFrame, mask: str, by="image_id") -> DataFrame:
    """Exact squared distance of set pixels to the nearest unset one (``d2``, NULL if there is none).

    Pass one finds the nearest unset pixel in the column with windows; pass two
    takes the lower envelope along each image row, one bounded row per group.
    """
    keys = names(by)
    column = Window.partitionBy(*keys, "x").orderBy("y")
    gap = F.when(F.col(mask) == 0, F.col("y"))
    above = F.last(gap, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(gap, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    reach = pixels.select(*keys, "y", "x", F.least(F.col("y") - above, below - F.col("y")).cast("double").alias("g"))
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", y int, x int, d2 double"

    def along_row(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((frame["x"].to_numpy(), group))
        frame, group = frame.iloc[order], group[order]
        xs = frame["x"].to_numpy(dtype=float)
        base = frame["g"].fillna(np.inf).to_numpy(dtype=float) ** 2
        best = base.copy()
        for shift in range(1, int(np.bincount(group).max())):
            if shift * shift >= best.max():
                break
            gap = np.where(group[shift:] == group[:-shift], (xs[shift:] - xs[:-shift]) ** 2, np.inf)
            best[shift:] = np.minimum(best[shift:], base[:-shift] + gap)
            best[:-shift] = np.minimum(best[:-shift], base[shift:] + gap)
        out = frame[[*keys, "y", "x"]].copy()
        out["d2"] = np.where(np.isfinite(best), best, np.nan)
        return out

    return in_groups(reach, [*keys, "y"], along_row, schema).withColumn("d2", F.nanvl("d2", F.lit(None).cast("double")))


def max_erosion_radius(pixels: DataFrame, mask: str, by="image_id") -> DataFrame:
    """Largest whole radius that leaves something: ceil(largest distance) - 1, at least 0."""
    far = squared_distances(pixels, mask, by).groupBy(*names(by)).agg(F.sqrt(F.max("d2")).alias("_d"))
    return far.select(*names(by), F.greatest(F.ceil(F.coalesce("_d", F.lit(0.0))) - 1, F.lit(0)).cast("int").alias("radius"))


def neighbour_counts(pixels: DataFrame, by="image_id") -> DataFrame:
    """Number of set 8-neighbours of each set pixel (table holds set pixels only)."""
    keys = names(by)
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    one = F.lit(1)
    across = pixels.withColumn("_left", F.count(one).over(row.rangeBetween(-1, -1))).withColumn("_right", F.count(one).over(row.rangeBetween(1, 1)))
    straight = across.withColumn("_v", F.count(one).over(column.rangeBetween(-1, -1)) + F.count(one).over(column.rangeBetween(1, 1)))
    # A diagonal is a row of its own: x - y and x + y are constant along it.
    falling = Window.partitionBy(*keys, "_fall").orderBy("y")
    rising = Window.partitionBy(*keys, "_rise").orderBy("y")
    slanted = straight.withColumns({"_fall": F.col("x") - F.col("y"), "_rise": F.col("x") + F.col("y")})
    slanted = slanted.withColumn("_f", F.count(one).over(falling.rangeBetween(-1, -1)) + F.count(one).over(falling.rangeBetween(1, 1)))
    slanted = slanted.withColumn("_r", F.count(one).over(rising.rangeBetween(-1, -1)) + F.count(one).over(rising.rangeBetween(1, 1)))
    total = F.col("_left") + F.col("_right") + F.col("_v") + F.col("_f") + F.col("_r")
    return slanted.withColumn("neighbours", total.cast("int")).drop("_left", "_right", "_v", "_f", "_r", "_fall", "_rise")


def skeleton_nodes(pixels: DataFrame, by="image_id") -> DataFrame:
    """Skeleton pixels with their degree and role: endpoint (1), junction (> 2), chain or isolated."""
    role = (
        F.when(F.col("neighbours") == 1, "endpoint").when(F.col("neighbours") > 2, "junction")
        .when(F.col("neighbours") == 2, "chain").otherwise("isolated"))
    return neighbour_counts(pixels, by).withColumn("role", role)
