"""Connected components of pixel masks and of endpoint graphs.

Pixels are labelled inside bounded chunks first; only labels that meet across a
chunk border form a graph, which alternating star contraction reduces in a
logarithmic number of rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.scale import attach, cut_lineage, in_groups, names, sorted_join

CHUNK = 256
FOUR = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*edges.columns)).alias("h")).first()
    return row["n"], row["h"]


def connect(edges: DataFrame, by, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest connected id for every id that has a smaller one: columns by, ``node``, ``root``.

    Large-star and small-star steps alternate until the edge set rests.  Only
    minima are aggregated, so no neighbour list is ever collected, and the
    joins are salted against nodes with very many neighbours.
    """
    keys = names(by)
    current = edges.select(*keys, F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    current = cut_lineage(current)
    seen = _signature(current)
    while seen[0]:
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = attach(both, low, [*keys, "a"], grown=True).where(F.col("b") > F.col("a")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = attach(large, low, [*keys, "a"], grown=True).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = small.unionByName(low.select(*keys, "a", F.col("m").alias("b"))).distinct()
        current = cut_lineage(small)
        found = _signature(current)
        if found == seen:
            break
        seen = found
    return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))


def pixel_key(y: Column, x: Column) -> Column:
    """One sortable number per pixel of an image."""
    return F.shiftleft(y.cast("bigint"), 32) + x.cast("bigint")


def _chunk_labels(keys: np.ndarray, at: np.ndarray, steps) -> np.ndarray:
    """Smallest pixel key of each pixel's component; ``at`` is one place per pixel, in the order of the keys, and ``steps`` lead to neighbours."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    pairs = []
    for step in steps:
        wanted = at + step
        found = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        hit = np.flatnonzero(at[found] == wanted)
        pairs.append(np.stack([hit, found[hit]]))
    left, right = np.concatenate(pairs, axis=1)
    label = np.arange(len(at))
    while True:
        low = np.minimum(label[left], label[right])
        moved = label.copy()
        np.minimum.at(moved, label[left], low)
        np.minimum.at(moved, label[right], low)
        while not np.array_equal(moved, moved[moved]):
            moved = moved[moved]
        if np.array_equal(moved, label):
            break
        label = moved
    out = np.empty(len(at), dtype=np.int64)
    out[order] = keys[order][label]
    return out


def label_components(pixels: DataFrame, by="image_id", diagonal: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Component label per set pixel: the smallest pixel key of its component.

    ``pixels`` holds only set pixels (``by``, y, x); pixels connect only within equal ``by`` values.
    """
    keys = names(by)
    offsets = EIGHT if diagonal else FOUR
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", y int, x int, label bigint"

    side = chunk + 2  # a chunk and an empty rim, so that chunks laid out one below the other do not touch

    def local(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        out = frame[[*keys, "y", "x"]].copy()
        y, x = frame["y"].to_numpy(dtype=np.int64), frame["x"].to_numpy(dtype=np.int64)
        out["label"] = _chunk_labels((y << 32) + x, (group * side + y % chunk + 1) * side + x % chunk + 1, [dy * side + dx for dy, dx in offsets])
        return out

    cells = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).withColumns(
        {"_cy": F.floor(F.col("y") / chunk), "_cx": F.floor(F.col("x") / chunk)})
    labelled = cut_lineage(in_groups(cells, [*keys, "_cy", "_cx"], local, schema))
    edge = lambda c: (F.col(c) % chunk).isin(0, chunk - 1)
    border = labelled.where(edge("y") | edge("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = border.select(*keys, "y", "x", F.col("label").alias("a"), F.explode(steps).alias("s")).withColumns(
        {"ny": F.col("y") + F.col("s.dy"), "nx": F.col("x") + F.col("s.dx")})
    crossing = (F.floor(F.col("ny") / chunk) != F.floor(F.col("y") / chunk)) | (F.floor(F.col("nx") / chunk) != F.floor(F.col("x") / chunk))
    moved = moved.where(crossing).select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x"), "a")
    met = sorted_join(moved, border.select(*keys, "y", "x", F.col("label").alias("b")), [*keys, "y", "x"]).select(*keys, "a", "b").distinct()
    met = cut_lineage(met)
    if met.isEmpty():
        return labelled
    roots = connect(met, keys).select(*keys, F.col("node").alias("label"), F.col("root").alias("_root"))
    joined = attach(labelled, roots, [*keys, "label"], "left", grown=True)
    return joined.select(*keys, "y", "x", F.coalesce("_root", "label").alias("label"))


def drop_small(pixels: DataFrame, minimum: int, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Set pixels of 4-connected components with at least ``minimum`` pixels."""
    keys = names(by)
    if minimum <= 1:
        return pixels.select(*keys, "y", "x")
    labelled = label_components(pixels, keys, diagonal=False, chunk=chunk)
    large = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_area")).where(F.col("_area") >= minimum).drop("_area")
    return attach(labelled, large, [*keys, "label"], grown=True).select(*keys, "y", "x")


def exterior_split(pixels: DataFrame, line: Column, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Free pixels (not ``line``) with ``exterior``: 4-connected to the image border.

    ``pixels`` carries h and w.
    """
    keys = names(by)
    free = pixels.where(~line)
    labelled = label_components(free, keys, diagonal=False, chunk=chunk)
    sizes = free.select(*keys, "y", "x", "h", "w")
    touching = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1)
    outside = sorted_join(labelled, sizes.where(touching), [*keys, "y", "x"]).select(*keys, "label").distinct().withColumn("exterior", F.lit(True))
    return attach(labelled, outside, [*keys, "label"], "left", grown=True).withColumn("exterior", F.coalesce("exterior", F.lit(False)))
