"""Chunked rasters against pixel tables and plain arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.q_raster import KEY, lab_pixels
from checks.q_segments import SMALL
from checks.views import Tables
from tilewright.operators import cluster as cl
from tilewright.operators import components, relax
from tilewright.operators import raster as ra
from tilewright.operators import raster_classes as rc
from tilewright.operators import tiling as t

SF = "/root/testdata/sf0.001"
LAB = ["lab_l", "lab_a", "lab_b"]


@pytest.fixture(scope="module")
def mosaics(spark):
    return t.with_size(Tables(spark, SF).rgb().where("image_id < 4").select(*KEY, "code", "r", "g", "b"))


def grid(raster, channel, image):
    rows = raster.pixels(channel).where(F.col("image_id") == image).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = np.nan if r[channel] is None else r[channel]
    return out


def images(spark, sizes, seed=1):
    draw = np.random.default_rng(seed)
    made = [draw.integers(0, 256, size).astype(float) for size in sizes]
    rows = [(i, y, x, *a.shape, float(a[y, x])) for i, a in enumerate(made) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return made, spark.createDataFrame(rows, "image_id long, y int, x int, h int, w int, v double")


def test_pixels_come_back(mosaics):
    raster = ra.to_chunks(mosaics, ["r", "g"], chunk=10)
    back = raster.pixels("r", "g").select(*KEY, F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"))
    wanted = mosaics.select(*KEY, F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"))
    assert wanted.exceptAll(back).isEmpty() and back.count() == wanted.count()


@pytest.mark.parametrize("halo", [1, 5])
def test_halo_brings_what_is_around(spark, halo):
    made, pixels = images(spark, [(13, 7), (5, 21), (6, 6)])
    raster = ra.to_chunks(pixels, ["v"], chunk=5)
    foot = {dy: halo for dy in range(-halo, halo + 1)}
    found = raster.stencil(halo, "v", lambda b: {"low": ra.swept(b["v"], foot, np.fmin)[b.core], "mirror": b.reflected("v")[:b["v"].shape[0] - 2 * halo, b.halo:-b.halo]}, ["low", "mirror"])
    for i, a in enumerate(made):
        low = [[a[max(0, y - halo):y + halo + 1, max(0, x - halo):x + halo + 1].min() for x in range(a.shape[1])] for y in range(a.shape[0])]
        assert np.array_equal(grid(found, "low", i), np.array(low))
        moved = np.pad(a, ((halo, 0), (0, 0)), mode="reflect")[:a.shape[0]]
        assert np.array_equal(grid(found, "mirror", i), moved)


def test_labels_and_small_parts_equal_those_of_pixels(mosaics):
    raster = ra.to_chunks(mosaics.withColumn("m", (F.col("code") == 3).cast("int")), ["m"], chunk=7)
    seen = ra.labelled(raster.map(lambda b: {"v": np.where(b["m"] == 1, 1.0, np.nan)}, "v"), "v", "label").pixels("label").where("label is not null")
    wanted = components.label_components(mosaics.where("code = 3").select(*KEY), chunk=7)
    key = (F.shiftright("label", 32) * 32 + F.col("label").bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")
    assert wanted.select(*KEY, key.alias("l")).exceptAll(seen.select(*KEY, F.col("label").cast("long").alias("l"))).isEmpty()
    left = ra.without_small(raster, "m", 3).pixels("m").where("m = 1").select(*KEY)
    large = components.drop_small(mosaics.where("code = 3").select(*KEY), 3, chunk=7)
    assert left.exceptAll(large).isEmpty() and large.exceptAll(left).isEmpty()


def test_flood_equals_that_of_pixels(spark):
    rows = t.with_size(Tables(spark, SF).mosaic().where("image_id < 3").select(*KEY, F.abs("v").alias("g"), F.when(F.col("v") > 0.22, F.col("y") * 32 + F.col("x")).alias("seed"), (F.col("code") != 3).cast("int").alias("m")))
    wanted = relax.flood(rows.where("m = 1"), "seed", "g").select(*KEY, "label")
    for chunk in (64, 9):
        found = rc.flooded(ra.to_chunks(rows, ["g", "seed", "m"], chunk=chunk), "seed", "g", "m", "basin").pixels("basin").where("basin is not null")
        found = found.select(*KEY, F.col("basin").cast("long").alias("label"))
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


@pytest.mark.parametrize("chunk", [12])
def test_two_step_classes_equal_those_of_pixels(mosaics, spark, chunk):
    lab = t.with_size(lab_pixels(Tables(spark, SF)).where("image_id < 3").select(*KEY, *LAB))
    raw = cl.two_step_raw(lab, SMALL)
    raster = rc.with_lab(ra.to_chunks(mosaics.where("image_id < 3"), ["r", "g", "b"], chunk=chunk)).settled()
    mine = rc.raw_codes(raster, SMALL).settled()
    as_rows = lambda r: r.pixels("code").select(*KEY, F.col("code").cast("int").alias("code"))
    assert raw.select(*KEY, "code").exceptAll(as_rows(mine)).isEmpty()
    from tilewright.operators.edges import refine_edges

    refined = rc.refined(mine, SMALL).settled()
    assert refine_edges(raw, SMALL).select(*KEY, "code").exceptAll(as_rows(refined)).isEmpty()
    from tilewright.operators.morphology import postprocess

    cleaned = rc.cleaned(refined, SMALL.min_component_area, SMALL.morph_radius)
    assert postprocess(refine_edges(raw, SMALL), "code", SMALL.min_component_area, SMALL.morph_radius).select(*KEY, "code").exceptAll(as_rows(cleaned)).isEmpty()


@pytest.mark.parametrize("chunk", [12])
def test_illumination_equals_that_of_pixels(mosaics, spark, chunk):
    from tilewright.operators.illumination import correct_illumination

    lab = t.with_size(lab_pixels(Tables(spark, SF)).where("image_id < 4").select(*KEY, *LAB, F.when(F.col("code") == 2, 1).otherwise(2).alias("code")))
    wanted = {(r["image_id"], r["y"], r["x"]): (r["lab_l"], r["applied"]) for r in correct_illumination(lab, SMALL).collect()}
    found = rc.even_light(ra.to_chunks(lab, [*LAB, "code"], chunk=chunk).settled(), SMALL)
    even = {r["image_id"]: r["even"] for r in found.frame.select("image_id", "even").distinct().collect()}
    for r in found.pixels("lab_l").collect():
        light, applied = wanted[r["image_id"], r["y"], r["x"]]
        assert r["lab_l"] == pytest.approx(light, abs=1e-6) and even[r["image_id"]] == applied


def lanczos(line, n_out):
    """Fixed-point 8-bit resampling of one line, a target at a time."""
    scale = len(line) / n_out
    wide, out = max(scale, 1.0), []
    for target in range(n_out):
        centre = (target + 0.5) * scale
        low, high = max(0, int(centre - 3 * wide + 0.5)), min(len(line), int(centre + 3 * wide + 0.5))
        sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
        weights = [sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((s - centre + 0.5) / wide for s in range(low, high))]
        fixed = [math.floor(k / sum(weights) * 2**22 + 0.5) for k in weights]
        out.append(min(255, max(0, (sum(int(v) * k for v, k in zip(line[low:high], fixed)) + 2**21) >> 22)))
    return out


def test_resampling_equals_plain_arrays(spark):
    sizes = [(23, 17), (9, 31), (40, 12)]
    made, pixels = images(spark, sizes, 2)
    pixels = pixels.withColumns({"h2": (F.col("h") * 0.6).cast("int"), "w2": (F.col("w") * 0.6).cast("int"), "h3": F.col("h") + 9, "w3": F.col("w") * 2})
    facts = pixels.select("image_id", "h2", "w2", "h3", "w3").distinct()
    raster = ra.to_chunks(pixels, ["v"], chunk=8).with_facts(facts).settled()
    small, area = ra.resampled(raster, "h2", "w2", "lanczos"), ra.resampled(raster, "h2", "w2", "area")
    wide, near = ra.resampled(raster, "h3", "w3", "linear"), ra.resampled(raster, "h3", "w3", "nearest")
    for i, a in enumerate(made):
        h, w = a.shape
        h2, w2, h3, w3 = int(h * 0.6), int(w * 0.6), h + 9, w * 2
        across = np.array([lanczos(row, w2) for row in a])
        assert np.array_equal(grid(small, "v", i), np.array([lanczos(col, h2) for col in across.T]).T)
        fine = np.kron(a, np.ones((h2, w2)))
        assert np.allclose(grid(area, "v", i), fine.reshape(h2, h, w2, w).mean(axis=(1, 3)))
        at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        rows = np.array([np.interp(at(w, w3), range(w), row) for row in a])
        assert np.allclose(grid(wide, "v", i), np.array([np.interp(at(h, h3), range(h), col) for col in rows.T]).T)
        pick = lambda n, m: [int((k + 0.5) * n / m) for k in range(m)]
        assert np.array_equal(grid(near, "v", i), a[np.ix_(pick(h, h3), pick(w, w3))])


def test_batch_masks_come_back_at_source_size(spark, mosaics):
    from dataclasses import replace

    from tilewright.plans.segmentation import batch_masks

    large = t.resize_nearest(mosaics.where("image_id < 2").select("image_id", "y", "x", "h", "w", "r", "g", "b"), F.lit(45), F.lit(60)).select("image_id", "y", "x", "r", "g", "b")
    large = t.with_size(large.select((F.col("image_id") + 100).alias("image_id"), "y", "x", "r", "g", "b"))
    both = mosaics.where("image_id < 1").select(*large.columns).unionByName(large)
    bad = spark.createDataFrame([(7, "cannot be read")], "image_id long, error string")
    masks, records = batch_masks(both, replace(SMALL, max_work_side=40), bad, chunk=16)
    records = {r["image_id"]: r for r in records.collect()}
    assert records[7]["status"] == "error" and records[0]["status"] == "ok" and (records[0]["height"], records[0]["width"]) == (32, 32)
    assert (records[100]["height"], records[100]["width"], records[100]["source_height"], records[100]["source_width"]) == (30, 40, 45, 60)
    coded = masks.pixels("code").toPandas()
    assert coded.groupby("image_id").size().to_dict() == {0: 1024, 100: 2700, 101: 2700} and set(coded["code"]) <= {1.0, 2.0, 3.0, 4.0}
    # The way back repeats positions of the work side.
    one = coded[coded["image_id"] == 100].pivot(index="y", columns="x", values="code").to_numpy()
    assert np.array_equal(one[:, 1], one[:, 2]) and np.array_equal(one[1], one[2])


def test_images_of_one_chunk_are_worked_on_without_a_shuffle_or_call_each(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    from tilewright.operators.morphology import disk

    pixels = spark.range(4 * 20 * 18).selectExpr("id div 360 as image_id", "int(id % 360 div 18) as y", "int(id % 18) as x", "20 as h", "18 as w", "double((id * 37) % 101) as g").where("x + y <> 9")
    spread = disk(2)

    def run(chunk):
        raster = ra.to_chunks(pixels, ["g"], chunk=chunk).settled()
        grown = raster.stencil(2, "g", lambda b: {"top": ra.swept(b["g"], spread, np.fmax)[b.core]}, "top")
        beside = raster.halo_table(1, "g", lambda b: {"n": [int(np.isnan(b["g"][1:-1, 2:]).sum())]}, "n long").groupBy("image_id").agg(F.sum("n").alias("n"))
        masked = ra.without_small(raster.map(lambda b: {"m": np.where(np.isnan(b["g"]), np.nan, b["g"] > 60)}, "m"), "m", 4)
        return [sorted(map(tuple, rows.collect())) for rows in (grown.pixels("top"), beside, masked.pixels("m"))]

    cut = run(8)

    def refused(*_):
        raise AssertionError("a shuffle or a call for every image")

    monkeypatch.setattr(GroupedData, "applyInPandas", refused)
    monkeypatch.setattr(ra.Raster, "_with_halo", refused)
    as_text = lambda found: [[tuple(map(str, r)) for r in rows] for rows in found]
    assert as_text(run(64)) == as_text(cut)


def test_edges_are_refined_on_chunks_and_other_columns_pass(mosaics, spark, monkeypatch):
    from tilewright.operators.edges import refine_edges

    def refused(*_, **__):
        raise AssertionError("a step on pixel rows")

    monkeypatch.setattr(relax, "spread_labels", refused)
    monkeypatch.setattr(components, "label_components", refused)
    rows = lab_pixels(Tables(spark, SF)).where("image_id = 1").select(*KEY, *LAB, "code", (F.col("code") == 1).alias("is_ore"), F.concat_ws("/", "y", "x").alias("at"))
    found = refine_edges(rows, SMALL)
    assert found.columns == [*KEY, *LAB, "is_ore", "at", "code"] and found.schema["code"].dataType == rows.schema["code"].dataType
    assert found.where(F.col("at") == F.concat_ws("/", "y", "x")).count() == rows.count() > 0
