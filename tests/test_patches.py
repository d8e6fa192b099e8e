"""Warped patches and augmentations against loops over positions."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.test_rasters import grid, images
from tilewright.operators import patches as pa
from tilewright.operators import raster as ra
from tilewright.operators import tiling as t


def mirror(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def brute_warp(image, plan, patch, linear):
    side = t.extract_side(patch)
    h, w = image.shape
    pad_y, pad_x = max(side - h, 0) // 2, max(side - w, 0) // 2
    local = lambda y, x: image[mirror(plan["y0"] - pad_y + mirror(y, side), h), mirror(plan["x0"] - pad_x + mirror(x, side), w)]
    alpha, beta = plan["scale"] * math.cos(math.radians(plan["angle"])), plan["scale"] * math.sin(math.radians(plan["angle"]))
    c = side / 2
    forward = np.array([[alpha, beta, (1 - alpha) * c - beta * c], [-beta, alpha, beta * c + (1 - alpha) * c], [0, 0, 1]])
    back, shift = np.linalg.inv(forward), max((side - patch) // 2, 0)
    out = np.empty((patch, patch))
    for ty in range(patch):
        for tx in range(patch):
            x, y, _ = back @ [tx + shift, ty + shift, 1]
            if not linear:
                out[ty, tx] = local(math.floor(y + 0.5), math.floor(x + 0.5))
                continue
            y0, x0 = math.floor(y), math.floor(x)
            fy, fx = y - y0, x - x0
            out[ty, tx] = (local(y0, x0) * (1 - fy) + local(y0 + 1, x0) * fy) * (1 - fx) + (local(y0, x0 + 1) * (1 - fy) + local(y0 + 1, x0 + 1) * fy) * fx
    return out


def test_patches_equal_a_loop_over_targets(spark):
    patch = 10
    side = t.extract_side(patch)
    made, pixels = images(spark, [(side + 13, side + 5), (side + 2, side - 4), (side, side)], 5)
    sizes = pixels.select("image_id", "h", "w").distinct()
    plan = t.random_patches(sizes, 3, seed=9, patch=patch)
    raster = ra.to_chunks(pixels.withColumn("m", F.col("v")), ["v", "m"], chunk=6)
    found = pa.warped_patches(raster, plan, patch, nearest=("m",)).pixels("v", "m").toPandas()
    rows = plan.collect()
    assert len(found) == len(rows) * patch * patch
    for r in rows:
        mine = found[(found["image_id"] == r["image_id"]) & (found["draw"] == r["draw"])]
        for channel, linear in (("v", True), ("m", False)):
            got = mine.pivot(index="y", columns="x", values=channel).to_numpy()
            wanted = brute_warp(made[r["image_id"]], r, patch, linear)
            assert np.allclose(got, wanted, atol=1e-6) if linear else (got != wanted).mean() < 0.01


def steps(spark, **columns):
    names = ("brightness", "contrast", "gamma", "blur", "holes", "noise")
    kept = [n for n in names if n in columns]
    return spark.createDataFrame([(i, *[columns[n][i] for n in kept]) for i in range(2)], "image_id long, " + ", ".join(f"{n} double" for n in kept))


def test_every_step_is_applied_whatever_the_chunks(spark):
    made, pixels = images(spark, [(40, 37), (33, 50)], 6)
    plan = steps(spark, brightness=(0.2, None), contrast=(-0.3, None), gamma=(None, 70.0), blur=(1.0, None), holes=(None, 3.0), noise=(0.05, None))
    small, whole = (pa.augmented(ra.to_chunks(pixels, ["v"], chunk=c), plan, seed=4) for c in (16, 64))
    for i in (0, 1):
        assert np.array_equal(grid(small, "v", i), grid(whole, "v", i))
    a = np.clip(np.floor(made[0] * 0.7 + 0.2 * 255), 0, 255)
    weights = pa.BLUR / pa.BLUR.sum()
    padded = np.pad(a, 2, mode="reflect")
    smooth = np.array([[sum(weights[dy] * weights[dx] * padded[y + dy, x + dx] for dy in range(5) for dx in range(5)) for x in range(37)] for y in range(40)])
    quiet = pa.augmented(ra.to_chunks(pixels, ["v"], chunk=16), plan.withColumn("noise", F.lit(None).cast("double")), seed=4)
    assert np.abs(grid(quiet, "v", 0) - np.floor(smooth + 0.5)).max() <= 1  # sums of another order may round otherwise
    noise = grid(small, "v", 0) - grid(quiet, "v", 0)
    inner = noise[(grid(quiet, "v", 0) > 60) & (grid(quiet, "v", 0) < 195)]
    assert abs(inner.mean()) < 2 and 10 < inner.std() < 16
    dark = np.clip(np.floor((made[1] / 255) ** 0.7 * 255), 0, 255)
    changed = grid(small, "v", 1) != dark
    assert (grid(small, "v", 1)[changed] == 0).all() and 50 < changed.sum() <= 3 * 28 * 28


def test_simple_steps_and_no_steps(spark):
    made, pixels = images(spark, [(12, 9), (9, 12)], 7)
    plan = steps(spark, brightness=(10.0, None), contrast=(1.1, None), blur=(None, None), noise=(None, None))
    found = pa.augmented(ra.to_chunks(pixels, ["v"], chunk=5), plan, seed=4)
    assert np.array_equal(grid(found, "v", 0), np.clip(np.floor(made[0] * 1.1 + 10.0), 0, 255)) and np.array_equal(grid(found, "v", 1), made[1])
