"""Label spreading over pixels: seeded flooding and ring-by-ring region growth.

Growth keeps the smallest (steps, label) per pixel.  Flooding first settles the
cheapest cost of every pixel (the lowest possible largest weight on a path from
a seed), then its age (steps since that cost was entered, so that seeds share a
plateau), then passes labels along the links that attain both; three phases,
because a neighbour that gets cheaper may change to a larger label.  Chunks run to their own rest in one task, then borders exchange one
ring of pixels; rounds end when no border pixel changes, so their number follows
the chunks a path crosses, not its pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import CHUNK
from tilewright.operators.scale import cut_lineage, in_groups, names

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def _settle(keys, own, cost, age, label, weight, steps, phase: str):
    """Relaxes chunks to rest; ring pixels of neighbours only give.  ``keys`` are places, ``steps`` lead from one to its neighbours'.

    Phases: ``cost`` (minimax, labels untouched), ``age`` (costs fixed), ``label`` (both fixed), ``steps`` (cost is steps, with labels).
    """
    order = np.argsort(keys)
    sorted_keys = keys[order]
    links = []
    for step in steps:
        wanted = keys + step
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(keys) - 1)
        hit = (sorted_keys[at] == wanted) & own
        links.append((np.flatnonzero(hit), order[at[hit]]))
    changed = True
    while changed:
        changed = False
        for mine, theirs in links:
            offer = cost[theirs] + 1.0 if phase == "steps" else np.maximum(cost[theirs], weight[mine])
            offered_age = np.where(cost[theirs] == cost[mine], age[theirs] + 1, 0.0)
            lower, same = label[theirs] < label[mine], offer == cost[mine]
            if phase == "cost":
                better = offer < cost[mine]
            elif phase == "age":
                better = same & (offered_age < age[mine])
            elif phase == "label":
                better = same & (offered_age == age[mine]) & lower
            else:
                better = (offer < cost[mine]) | (same & lower)
            better &= np.isfinite(offer)
            if better.any():
                take = mine[better]
                if phase in ("cost", "steps"):
                    cost[take] = offer[better]
                if phase == "age":
                    age[take] = offered_age[better]
                if phase in ("label", "steps"):
                    label[take] = label[theirs[better]]
                changed = True


def spread_labels(pixels: DataFrame, seed: str, weight: str | None, by="image_id", diagonal: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds ``label`` and ``cost`` to every reachable pixel.

    ``seed`` is a label column (NULL where unlabelled).  With ``weight`` the cost
    of a path is its largest weight (flooding); without, its number of steps.
    Equal costs go to the seed that is fewer steps away since that cost was
    entered, then to the smaller label.  Seeds keep their label.
    """
    keys = names(by)
    offsets, minimax = (EIGHT if diagonal else FOUR), weight is not None
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    none = np.iinfo(np.int64).max
    height = F.col(weight).cast("double") if minimax else F.lit(0.0)
    state = pixels.select(
        *keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), height.alias("w"),
        F.col(seed).isNotNull().alias("fixed"), F.coalesce(F.col(seed).cast("bigint"), F.lit(none)).alias("label"),
        F.when(F.col(seed).isNotNull(), height).otherwise(F.lit(float("inf"))).alias("cost"),
        F.when(F.col(seed).isNotNull(), F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("age"))
    schema = key_schema + ", y int, x int, w double, fixed boolean, label bigint, cost double, age double, moved boolean"

    def settle_in(phase: str):
        def settle(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            return settled(frame, group, phase)

        return settle

    side = chunk + 4  # a chunk, its ring and an empty rim, so that chunks laid out one below the other do not touch
    steps = [dy * side + dx for dy, dx in offsets]

    def settled(frame: pd.DataFrame, group: np.ndarray, phase: str) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(dtype=np.int64), frame["x"].to_numpy(dtype=np.int64)
        own = frame["own"].to_numpy(dtype=bool)
        cost, label = frame["cost"].to_numpy(dtype=float).copy(), frame["label"].to_numpy(dtype=np.int64).copy()
        age = frame["age"].to_numpy(dtype=float).copy()
        before = cost.copy(), age.copy(), label.copy()
        free = own & ~frame["fixed"].to_numpy(dtype=bool)
        place = (group * side + y - frame["_cy"].to_numpy() * chunk + 2) * side + x - frame["_cx"].to_numpy() * chunk + 2
        _settle(place, free, cost, age, label, frame["w"].to_numpy(dtype=float), steps, phase)
        ringed = (np.bincount(group, ~own) > 0)[group]  # without a ring no other chunk has a neighbour here
        rim = ((y % chunk) == 0) | ((y % chunk) == chunk - 1) | ((x % chunk) == 0) | ((x % chunk) == chunk - 1)
        out = frame[[*keys, "y", "x", "w", "fixed"]].copy()
        out["label"], out["cost"], out["age"] = label, cost, age
        out["moved"] = rim & ringed & ((cost != before[0]) | (age != before[1]) | (label != before[2]))
        return out[own]

    homes = F.array_distinct(F.array(*[
        F.struct(F.floor((F.col("y") + dy) / chunk).alias("cy"), F.floor((F.col("x") + dx) / chunk).alias("cx"))
        for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    for phase in ("cost", "age", "label") if minimax else ("steps",):
        while True:
            given = state.select(*keys, "y", "x", "w", "fixed", "label", "cost", "age", F.explode(homes).alias("home"))
            own = (F.col("home.cy") == F.floor(F.col("y") / chunk)) & (F.col("home.cx") == F.floor(F.col("x") / chunk))
            given = given.withColumns({"own": own, "_cy": F.col("home.cy"), "_cx": F.col("home.cx")}).drop("home")
            state = cut_lineage(in_groups(given, [*keys, "_cy", "_cx"], settle_in(phase), schema))
            if state.where("moved").isEmpty():
                break
    return state.where(F.col("label") != none).select(*keys, "y", "x", "label", "cost", "fixed")


def flood(pixels: DataFrame, seed: str, gradient: str, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Seeded watershed inside the given pixels: 4-neighbour minimax flooding."""
    return spread_labels(pixels, seed, gradient, by, diagonal=False, chunk=chunk)


def grow_regions(pixels: DataFrame, region: str, assignable: Column, by="image_id", chunk: int = CHUNK) -> DataFrame:
    """Region ids (> 0) spread ring by ring, 8-connected, over assignable pixels; the lower id wins a ring.

    Returns every pixel with a positive region.
    """
    usable = pixels.where((F.col(region) > 0) | assignable)
    seeded = usable.withColumn("_seed", F.when(F.col(region) > 0, F.col(region)))
    grown = spread_labels(seeded, "_seed", None, by, diagonal=True, chunk=chunk)
    return grown.select(*names(by), "y", "x", F.col("label").cast("int").alias(region))
