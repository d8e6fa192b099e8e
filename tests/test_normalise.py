"""Normalisation of rasters against the pixel-table operators and a scalar round trip."""

import numpy as np
from pyspark.sql import functions as F

from checks.q_raster import KEY
from checks.views import Tables
from tests.test_rasters import SF, grid
from tilewright.operators import illumination as il
from tilewright.operators import normalise as no
from tilewright.operators import raster as ra
from tilewright.operators import tiling as t


def rgb(spark):
    return t.with_size(Tables(spark, SF).rgb().where("image_id < 3").select(*KEY, "r", "g", "b"))


def test_equalise_and_stretch_equal_those_of_pixels(spark):
    rows = rgb(spark)
    wanted = il.stretch(il.equalise(rows.select(*KEY, "h", "w", "r"), "r", "e"), "e", "gray").select(*KEY, "e", "gray")
    even = no.equalised(ra.to_chunks(rows, ["r"], chunk=9), "r").settled()
    found = even.renamed(e="r").pixels("e").join(no.stretched(even, "r").renamed(gray="r").pixels("gray"), KEY)
    found = found.select(*KEY, F.col("e").cast("int").alias("e"), F.col("gray").cast("int").alias("gray"))
    assert wanted.exceptAll(found).count() <= 3  # a half may round either way
    assert found.count() == wanted.count()


def test_chain_keeps_colours_and_ignores_chunks(spark):
    rows = rgb(spark)
    small, whole = (ra.to_chunks(rows, ["r", "g", "b"], chunk=c) for c in (10, 64))
    there = no.from_quantised_lab(no.quantised_lab(whole))
    for c in "rgb":
        off = np.abs(grid(there, c, 0) - grid(whole, c, 0))
        assert off.mean() < 3 and np.quantile(off, 0.99) <= 12
    one, two = no.normalised(small).settled(), no.normalised(whole).settled()
    for c in ("r", "g", "b", "gray"):
        assert np.array_equal(grid(one, c, 1), grid(two, c, 1))
    r, g, b = (grid(two, c, 1) for c in "rgb")
    assert np.array_equal(grid(two, "gray", 1), (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384)
    assert grid(two, "gray", 1).std() > 20
