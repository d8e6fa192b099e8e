"""Neighbourhood operators against plain numpy on small rasters, with chunks smaller than the rasters."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import components as co
from tilewright.operators import edges, relax
from tilewright.operators import illumination as il
from tilewright.operators import morphology as mo
from tilewright.operators import tiling as t

SIZE = 13
KEY = ["image_id", "y", "x"]


def raster(seed, classes=4):
    return np.random.default_rng(seed).integers(1, classes + 1, (SIZE, SIZE))


def to_pixels(spark, rasters, name="code"):
    rows = [(i, int(y), int(x), float(v)) for i, r in enumerate(rasters) for (y, x), v in np.ndenumerate(r)]
    return spark.createDataFrame(rows, f"image_id int, y int, x int, {name} double").withColumn(name, F.col(name).cast("int"))


def to_raster(frame, name, image=0, fill=0):
    out = np.full((SIZE, SIZE), fill, dtype=float)
    for row in frame.where(F.col("image_id") == image).collect():
        out[row["y"], row["x"]] = row[name]
    return out


def neighbours(y, x, diagonal):
    for dy, dx in itertools.product((-1, 0, 1), repeat=2):
        if (dy, dx) != (0, 0) and (diagonal or not (dy and dx)) and 0 <= y + dy < SIZE and 0 <= x + dx < SIZE:
            yield y + dy, x + dx


def flood_parts(mask, diagonal):
    label = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask)):
        if label[start] >= 0:
            continue
        stack, number = [start], start[0] * SIZE + start[1]
        label[start] = number
        while stack:
            for spot in neighbours(*stack.pop(), diagonal):
                if mask[spot] and label[spot] < 0:
                    label[spot] = number
                    stack.append(spot)
    return label


def step(values, footprint, how):
    out = np.empty_like(values)
    for y, x in np.ndindex(values.shape):
        seen = [values[y + dy, x + dx] for dy, half in footprint.items() for dx in range(-half, half + 1) if 0 <= y + dy < SIZE and 0 <= x + dx < SIZE]
        out[y, x] = how(seen)
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_disk_sweep_matches_numpy(spark, radius):
    image = raster(1, 60)
    out = mo.sweep(to_pixels(spark, [image], "v"), {"lo": ("v", "min"), "hi": ("v", "max")}, mo.disk(radius))
    assert (to_raster(out, "lo") == step(image, mo.disk(radius), min)).all()
    assert (to_raster(out, "hi") == step(image, mo.disk(radius), max)).all()


def clean(image, minimum, radius):
    out = image.copy()
    for value in (1, 3, 4):
        mask = (out == value).astype(int)
        for how in (min, max, max, min):
            mask = step(mask, mo.disk(radius), how)
        parts = flood_parts(mask == 1, diagonal=False)
        keep = np.isin(parts, [p for p in np.unique(parts) if p >= 0 and (parts == p).sum() >= minimum])
        out[out == value] = 2
        out[keep] = value
    return out


@pytest.mark.parametrize("chunk", [4, 256])
def test_class_cleaning_follows_the_class_order(spark, chunk):
    blocky = np.kron(np.random.default_rng(5).integers(1, 5, (5, 5)), np.ones((3, 3), dtype=int))[:SIZE, :SIZE]
    images = [blocky, np.where(np.random.default_rng(6).random((SIZE, SIZE)) < 0.1, 4, blocky)]
    out = mo.postprocess(to_pixels(spark, images), "code", 4, 1, chunk=chunk)
    for i, image in enumerate(images):
        assert (to_raster(out, "code", i) == clean(image, 4, 1)).all()


@pytest.mark.parametrize("diagonal,chunk", [(True, 3), (True, 64), (False, 3), (False, 5)])
def test_components_do_not_depend_on_chunks(spark, diagonal, chunk):
    masks = [raster(seed) <= 2 for seed in (2, 3)]
    snake = np.zeros((SIZE, SIZE), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks.append(snake)
    pixels = to_pixels(spark, [m.astype(int) for m in masks], "m").where("m = 1").select(*KEY)
    out = co.label_components(pixels, diagonal=diagonal, chunk=chunk)
    out = out.withColumn("l", F.shiftright("label", 32) * SIZE + F.col("label").bitwiseAND(F.lit(0xFFFFFFFF)))
    for i, mask in enumerate(masks):
        assert (to_raster(out, "l", i, -1) == flood_parts(mask, diagonal)).all()


def minimax(grad, seeds, mask):
    cost = np.where(seeds > 0, grad, np.inf)
    label = np.where(seeds > 0, seeds, np.iinfo(np.int64).max)
    free = list(zip(*np.nonzero(mask & (seeds == 0))))
    age = np.where(seeds > 0, 0.0, np.inf)
    for phase in ("cost", "age", "label"):
        moved = True
        while moved:
            moved = False
            for p in free:
                for q in neighbours(*p, False):
                    offer = max(cost[q], grad[p]) if mask[q] else np.inf
                    if phase == "cost" and offer < cost[p]:
                        cost[p], moved = offer, True
                    older = age[q] + 1 if cost[q] == cost[p] else 0.0
                    attained = np.isfinite(offer) and offer == cost[p]
                    if phase == "age" and attained and older < age[p]:
                        age[p], moved = older, True
                    if phase == "label" and attained and older == age[p] and label[q] < label[p]:
                        label[p], moved = label[q], True
    return cost, label


@pytest.mark.parametrize("chunk", [4, 64])
def test_flooding_is_the_minimax_path(spark, chunk):
    rng = np.random.default_rng(11)
    grad, mask = rng.integers(0, 9, (SIZE, SIZE)), rng.random((SIZE, SIZE)) < 0.8
    seeds = np.where(mask & (rng.random((SIZE, SIZE)) < 0.05), np.arange(SIZE * SIZE).reshape(SIZE, SIZE) + 1, 0)
    pixels = to_pixels(spark, [grad], "g").join(to_pixels(spark, [seeds], "s"), KEY).join(to_pixels(spark, [mask.astype(int)], "m"), KEY)
    rows = pixels.where("m = 1").withColumn("seed", F.when(F.col("s") > 0, F.col("s")))
    out = relax.flood(rows, "seed", "g", chunk=chunk)
    cost, label = minimax(grad.astype(float), seeds, mask)
    reached = np.isfinite(cost)
    assert (to_raster(out, "label", 0, -1) == np.where(reached, label, -1)).all()
    assert (to_raster(out, "cost", 0, -1) == np.where(reached, cost, -1)).all()


@pytest.mark.parametrize("chunk", [4, 64])
def test_a_plateau_is_shared_between_its_seeds(spark, chunk):
    rows = spark.createDataFrame([(0, 0, x, 1, {0: 1, 9: 2}.get(x)) for x in range(10)], "image_id int, y int, x int, g int, seed int")
    found = {r["x"]: r["label"] for r in relax.flood(rows, "seed", "g", chunk=chunk).collect()}
    assert found == {x: 1 if x < 5 else 2 for x in range(10)}


def test_patches_of_any_shape_turn_whole(spark):
    from tilewright.operators.tiling import apply_geometry

    for turn in (None, 1.0, 2.0, 3.0):
        rows = [(y, x, 3, 5, 1.0, 1.0, turn, 5 * y + x) for y in range(3) for x in range(5)]
        out = apply_geometry(spark.createDataFrame(rows, "y int, x int, h int, w int, flip_x double, flip_y double, turns double, v int")).collect()
        wanted = np.rot90(np.arange(15).reshape(3, 5)[::-1, ::-1], int(turn or 0))
        assert {(r["h"], r["w"]) for r in out} == {wanted.shape} and all(wanted[r["y"], r["x"]] == r["v"] for r in out) and len(out) == 15


def test_seeds_fall_back_to_the_whole_component(spark):
    mask = np.zeros((SIZE, SIZE), dtype=int)
    mask[1:6, 1:6] = 1
    mask[9, 9:11] = 1
    seeds = edges.seed_labels(to_pixels(spark, [mask], "m"), "m", 1)
    found = to_raster(seeds.withColumn("one", F.lit(1)), "one")
    expected = np.zeros((SIZE, SIZE))
    expected[2:5, 2:5] = 1
    expected[9, 9:11] = 1
    assert (found == expected).all()
    assert seeds.select("seed").distinct().count() == 2


def test_illumination_surface_is_the_least_squares_fit(spark):
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[0:SIZE, 0:SIZE]
    light = 50 + 4 * (xx / 6 - 1) ** 2 - 3 * (yy / 6 - 1) + rng.normal(0, 0.01, (SIZE, SIZE))
    rows = spark.createDataFrame([(0, int(y), int(x), SIZE, SIZE, float(light[y, x])) for y, x in np.ndindex(light.shape)], "image_id int, y int, x int, h int, w int, lab_l double")
    found = il.surface_coefficients(rows, "lab_l").first()["coefficients"]
    u, v = (xx / 6 - 1).ravel(), (yy / 6 - 1).ravel()
    design = np.column_stack([u * u, v * v, u * v, u, v, np.ones_like(u)])
    assert np.allclose(found, np.linalg.lstsq(design, light.ravel(), rcond=None)[0], atol=1e-6)


def test_equalised_values_stay_in_range_and_flat_images_stretch_to_themselves(spark):
    images = [raster(4, 250), np.full((SIZE, SIZE), 77)]
    rows = t.with_size(to_pixels(spark, images, "v"))
    out = il.stretch(il.equalise(rows, "v", "e"), "v", "s")
    assert out.where(~F.col("e").between(0, 255)).count() == 0
    assert (to_raster(out, "s", 1) == 77).all()


def test_enlarging_keeps_a_constant(spark):
    small = spark.createDataFrame([(0, y, x, 4, 5, 3.5) for y in range(4) for x in range(5)], "image_id int, y int, x int, h int, w int, v double")
    sizes = spark.createDataFrame([(0, y, x, 9, 11) for y in range(9) for x in range(11)], "image_id int, y int, x int, h int, w int")
    out = il.enlarge_linear(small, sizes, "v").collect()
    assert len(out) == 99 and all(abs(r["v"] - 3.5) < 1e-9 for r in out)
