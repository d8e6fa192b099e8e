"""Two-step class maps on chunked rasters: colour split, illumination and shadow correction, edge refinement, cleaning.

Each function takes a :class:`Raster` with Lab channels and returns one.  Blocks are worked on where they are; image-wide
numbers (centres, percentiles, surface sums, region facts) are grouped by Spark and come back as facts of the image, or as
short lists of labels to the chunks that hold them.  Codes: 1 ore, 2 matrix, 3 talc, 4 damage.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.color import RGB_TO_XYZ, WHITE_D65, is_ore, ore_score
from tilewright.operators.cluster import dark_clusters, weighted_centres
from tilewright.operators.edges import CROSS, DAMAGE_SCORE, DAMAGE_SHARPNESS, EXPAND_SOFTNESS
from tilewright.operators.morphology import disk
from tilewright.operators.raster import Block, Raster, labelled, opened_closed, percentiles, resampled, swept, without_small
from tilewright.operators.scale import attach, stored

LAB = ("lab_l", "lab_a", "lab_b")


def with_lab(raster: Raster) -> Raster:
    """Lab channels of 8-bit r, g, b; the same arithmetic as on columns."""
    def lab(block: Block) -> dict:
        light = [np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92) for c in (block[n] / 255.0 for n in ("r", "g", "b"))]
        xyz = [(light[0] * m[0] + light[1] * m[1] + light[2] * m[2]) / w for m, w in zip(RGB_TO_XYZ, WHITE_D65)]
        x, y, z = (np.where(t > 0.008856, t ** (1.0 / 3.0), t * 7.787 + 16.0 / 116.0) for t in xyz)
        return dict(zip(LAB, (y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0)))

    return raster.map(lab, LAB, keep=())


def centres(raster: Raster, k: int, where: str | None = None, starts: int = 5) -> DataFrame:
    """Cluster centres of each image's colours (positions with ``where`` equal 1); equal colours are merged in the chunk."""
    def colours(block: Block) -> dict:
        held = ~np.isnan(block["lab_l"]) if where is None else block[where] == 1
        found, n = np.unique(np.stack([block[c][held] for c in LAB], axis=1), axis=0, return_counts=True)
        return {"p": list(found), "n": n.astype(np.int64)}

    by = list(raster.by)
    rows = raster.without_facts().table(colours, "p array<double>, n long")
    points = rows.groupBy(*by, "p").agg(F.sum("n").alias("n"))
    if where is not None:
        enough = points.groupBy(*by).agg(F.sum("n").alias("_n")).where(F.col("_n") >= k).select(*by)
        points = attach(points, enough, by)
    return weighted_centres(points, k, starts, image=by[0])


def _apart(block: Block, centre) -> np.ndarray:
    return sum((block[c] - float(v)) ** 2 for c, v in zip(LAB, centre))


def raw_codes(raster: Raster, settings) -> Raster:
    """Adds ``code`` (1, 2, 3) and ``is_ore`` (0/1): ore by two centres and a shifted border, talc by dark sub-clusters of the rest."""
    image = raster.by[0]
    pair = centres(raster, 2, starts=settings.starts)
    first, second = F.col("centres")[0], F.element_at("centres", -1)
    ahead = ore_score(first[0], first[2]) >= ore_score(second[0], second[2])
    pair = pair.select(image, F.when(ahead, first).otherwise(second).alias("_near_ore"), F.when(ahead, second).otherwise(first).alias("_near_rest"))

    def split(block: Block) -> dict:
        ore, rest = _apart(block, block.facts["_near_ore"]), _apart(block, block.facts["_near_rest"])
        score = is_ore(ore, rest, settings.ore_boundary_shift)
        return {"is_ore": np.where(np.isnan(ore), np.nan, score), "_rest": np.where(np.isnan(ore), np.nan, ~score)}

    rows = raster.with_facts(pair).map(split, ["is_ore", "_rest"]).without_facts().settled()
    found = centres(rows, settings.matrix_subclusters, "_rest", settings.starts)
    dark = dark_clusters(found, settings.talc_dark_quantile, image).groupBy(image).agg(F.collect_set("sub").alias("_dark"))
    kept = [f for f in raster.facts]
    if kept:
        rows = replace(rows, frame=rows.frame.join(raster.frame.select(*raster.keys, *kept), raster.keys), facts=tuple(kept))

    def talc(block: Block) -> dict:
        code = np.where(np.isnan(block["is_ore"]), np.nan, np.where(block["is_ore"] == 1, 1.0, 2.0))
        subs, chosen = block.facts["centres"], block.facts["_dark"]
        if subs is not None and chosen is not None:
            nearest = np.argmin(np.stack([_apart(block, c) for c in subs]), axis=0)
            code[(code == 2) & np.isin(nearest, np.asarray(chosen))] = 3.0
        return {"code": code}

    done = rows.with_facts(found.join(dark, image)).map(talc, "code", keep=(*LAB, "is_ore", *[c for c in raster.channels if c not in LAB]))
    return replace(done, frame=done.frame.drop("centres", "_dark"), facts=tuple(kept))


def cleaned(raster: Raster, minimum: int, radius: int, classes=(1, 3, 4)) -> Raster:
    """Classes opened, closed and freed of small parts in their fixed order; each sees the result of the one before."""
    keep = raster.channels
    for value in classes:
        def masked(block: Block, value=value) -> dict:
            mask = np.where(np.isnan(block["code"]), np.nan, block["code"] == value)
            return {"_mask": opened_closed(mask, disk(radius))[block.core] if radius > 0 else mask[block.core]}

        rows = raster.stencil(4 * radius, "code", masked, "_mask") if radius > 0 else raster.map(masked, "_mask")
        rows = without_small(rows, "_mask", minimum)

        def coded(block: Block, value=value) -> dict:
            code = block["code"]
            return {"code": np.where(block["_mask"] == 1, float(value), np.where(code == value, 2.0, code))}

        raster = rows.map(coded, "code", keep=keep)
    return raster.settled()


def _design(block: Block) -> np.ndarray:
    y, x = np.indices(block["lab_l"].shape, dtype=float)
    u = (x + block.left) / max(block.w - 1, 1) * 2.0 - 1.0
    v = (y + block.top) / max(block.h - 1, 1) * 2.0 - 1.0
    return np.stack([u * u, v * v, u * v, u, v, np.ones_like(u)])


def even_light(raster: Raster, settings) -> Raster:
    """Takes a smooth surface of lightness, fitted to trimmed and eroded ore, off ``lab_l``; fact ``even`` says where it was."""
    strength, most = settings.illumination_correction_strength, settings.illumination_max_delta_l
    by, keep = list(raster.by), raster.channels
    if strength <= 0 or most <= 0:
        return raster.with_facts(raster.frame.select(*by).distinct().withColumn("even", F.lit(False)))
    rows = raster.map(lambda b: {"_ore": np.where(np.isnan(b["code"]), np.nan, b["code"] == 1)}, "_ore")
    rows = without_small(rows, "_ore", settings.min_component_area)
    radius = settings.illumination_ore_erosion_radius
    if radius > 0:
        rows = rows.stencil(radius, "_ore", lambda b: {"_ore": swept(b["_ore"], disk(radius), np.fmin)[b.core]}, "_ore")
    rows = rows.map(lambda b: {"_l": np.where(b["_ore"] == 1, b["lab_l"], np.nan)}, "_l").settled()
    trim, least = settings.illumination_outlier_quantile, settings.illumination_min_ore_area
    ends = {"_lo": trim, "_hi": 1.0 - trim}
    sized = rows.without_facts().table(lambda b: {"n": [int((b["_ore"] == 1).sum())]}, "n long").groupBy(*by).agg(F.sum("n").alias("_n"))
    rows = rows.with_facts(percentiles(rows, "_l", ends).join(stored(sized.where(F.col("_n") >= max(least, 1))), by))

    def sums(block: Block) -> dict:
        if block.facts["_n"] is None or np.isnan(block.facts["_n"]):
            return {"i": [], "v": []}
        held = block["_ore"] == 1
        if trim > 0 and block.facts["_n"] >= 20:
            held &= (block["_l"] >= block.facts["_lo"]) & (block["_l"] <= block.facts["_hi"])
        basis, light = _design(block)[:, held], block["_l"][held]
        return {"i": np.arange(43, dtype=np.int32), "v": np.concatenate([(basis @ basis.T).ravel(), basis @ light, [held.sum()]])}

    parts = rows.table(sums, "i int, v double").groupBy(*by, "i").agg(F.sum("v").alias("v"))
    system = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("s"))
    system = system.where(F.col("s")[42] >= max(least, 6))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.asarray(v[:36]).reshape(6, 6), np.asarray(v[36:42]), rcond=None)[0] for v in s])

    rows = rows.with_facts(stored(system.select(*by, solve("s").alias("_surface"))))

    def fit(block: Block) -> np.ndarray:
        return np.tensordot(np.asarray(block.facts["_surface"], dtype=float), _design(block), axes=1)

    def fitted(block: Block) -> dict:
        return {"_fit": np.full(block["_l"].shape, np.nan) if block.facts["_surface"] is None else np.where(block["_ore"] == 1, fit(block), np.nan)}

    rows = rows.with_facts(percentiles(rows.map(fitted, "_fit"), "_fit", {"_median": 0.5}))

    def delta(block: Block) -> np.ndarray | None:
        if block.facts["_surface"] is None or block.facts["_median"] is None or np.isnan(block.facts["_median"]):
            return None
        return np.clip(fit(block) - block.facts["_median"], -most, most)

    def moved(block: Block) -> dict:
        d = delta(block)
        return {"m": [False if d is None else bool((np.abs(d) > 1e-6).any())]}

    def corrected(block: Block) -> dict:
        d = delta(block)
        return {"lab_l": block["lab_l"] if d is None else np.clip(block["lab_l"] - strength * d, 0.0, 100.0)}

    even = rows.table(moved, "m boolean").groupBy(*by).agg(F.max("m").alias("even"))
    done = rows.map(corrected, "lab_l", keep=keep)
    extra = [f for f in done.facts if f not in raster.facts]
    done = replace(done, frame=done.frame.drop(*extra), facts=raster.facts)
    return done.with_facts(stored(even)).settled()


def lifted_shadows(raster: Raster, settings) -> Raster:
    """Lifts ``lab_l`` where it is darker than its edge-aware surroundings, less so near borders; fact ``lifted`` says where."""
    strength, most = settings.local_shadow_correction_strength, settings.local_shadow_max_delta_l
    by, keep = list(raster.by), raster.channels
    if strength <= 0 or most <= 0:
        return raster.with_facts(raster.frame.select(*by).distinct().withColumn("lifted", F.lit(False)))
    radius = max(3, settings.local_shadow_radius)
    scale = min(1.0, 32.0 / radius)
    work = raster.without_facts().pick(*LAB)
    if scale < 1.0:
        side = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int")).alias(f"_{c}2")
        sizes = raster.frame.select(*by, F.col("h").alias("_h"), F.col("w").alias("_w"), side("h"), side("w")).distinct()
        work = resampled(work.with_facts(sizes), "_h2", "_w2", "area")
        work = replace(work, frame=work.frame.drop("_h2", "_w2"), facts=("_h", "_w")).settled()
    reach, rim = max(3, int(round(radius * scale))), max(1, int(round(settings.edge_gradient_radius * scale)))
    colour = max(4.0, most * 1.5)

    def around(block: Block) -> dict:
        light = block.reflected("lab_l")
        core, (h, w) = light[block.core], block["lab_l"][block.core].shape
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        for dy, half in disk(reach).items():
            for dx in range(-half, half + 1):
                moved = light[block.halo + dy:block.halo + dy + h, block.halo + dx:block.halo + dx + w]
                share = np.exp(-(dy * dy + dx * dx) / (2.0 * reach * reach) - (moved - core) ** 2 / (2.0 * colour * colour))
                total += share * moved
                weight += share
        spans = {c: (swept(block[c], disk(rim), np.fmax) - swept(block[c], disk(rim), np.fmin))[block.core] for c in LAB}
        edges = spans["lab_l"], np.sqrt(spans["lab_a"] ** 2 + spans["lab_b"] ** 2)
        return {"_around": total / weight, "_gl": edges[0], "_gc": edges[1]}

    work = work.stencil(max(reach, rim), list(LAB), around, ["_around", "_gl", "_gc"], keep=["lab_l"])
    work = work.map(lambda b: {c: np.where(b[c] > 1e-6, b[c], np.nan) for c in ("_gl", "_gc")}, ["_gl", "_gc"]).settled()
    tops = percentiles(work, "_gl", {"_pl": 0.95}).join(percentiles(work, "_gc", {"_pc": 0.95}), by, "full")

    def share(block: Block, channel: str, top: str) -> np.ndarray:
        scaled = block.facts[top]
        values = np.nan_to_num(block[channel])
        return np.zeros_like(values) if scaled is None or np.isnan(scaled) or scaled <= 1e-6 else np.clip(values / scaled, 0.0, 1.0)

    def barrier(block: Block) -> dict:
        mixed = settings.local_shadow_lightness_barrier * share(block, "_gl", "_pl") + settings.local_shadow_chroma_barrier * share(block, "_gc", "_pc")
        return {"_barrier": np.where(np.isnan(block["lab_l"]), np.nan, np.clip(mixed, 0.0, 1.0))}

    wide = max(1, min(rim + settings.local_shadow_radius // 12, 12))

    def lift(block: Block) -> dict:
        edge = swept(block["_barrier"], disk(wide), np.fmax)
        return {"_lift": np.clip(np.maximum(block["_around"] - block["lab_l"], 0.0) * (1.0 - edge), 0.0, most)[block.core]}

    work = work.with_facts(tops).map(barrier, "_barrier", keep=["lab_l", "_around"])
    work = work.stencil(wide, ["_barrier", "_around", "lab_l"], lift, "_lift", keep=()).settled()
    moved = work.without_facts().table(lambda b: {"m": [bool((np.nan_to_num(b["_lift"]) > 1e-6).any())]}, "m boolean").groupBy(*by).agg(F.max("m").alias("lifted"))
    if scale < 1.0:
        work = resampled(work, "_h", "_w", "linear")
    both = replace(raster, frame=raster.frame.join(work.frame.select(*by, "cy", "cx", "_lift"), [*by, "cy", "cx"]), channels=(*keep, "_lift")).with_facts(stored(moved))

    def raised(block: Block) -> dict:
        return {"lab_l": np.clip(block["lab_l"] + strength * block["_lift"], 0.0, 100.0) if block.facts["lifted"] else block["lab_l"]}

    return both.map(raised, "lab_l", keep=keep).settled()


def _told(raster: Raster, labels: str, verdicts: DataFrame, name: str) -> Raster:
    """Fact ``name`` per chunk: label and value of those of ``verdicts`` (by, label, value) that the chunk's channel holds."""
    by = list(raster.by)
    held = raster.without_facts().pick(labels).table(lambda b: {"label": np.unique(b[labels][~np.isnan(b[labels])]).astype(np.int64)}, "label long", place=True)
    told = attach(held, verdicts, [*by, "label"]).groupBy(*by, "cy", "cx").agg(F.array_sort(F.collect_list(F.struct("label", "value"))).alias(name))
    return replace(raster, frame=raster.frame.join(told, [*by, "cy", "cx"], "left"), facts=(*raster.facts, name))


def _having(told, labels: np.ndarray, value) -> np.ndarray:
    return np.isin(labels, np.array([] if told is None else [r["label"] for r in told if r["value"] == value], dtype=float))


def seeds(raster: Raster, mask: str, radius: int, name: str) -> Raster:
    """Adds ``name``: labels of the 8-connected parts of each eroded part of ``mask``, or of the whole part if erosion empties it."""
    by, keep = list(raster.by), raster.channels
    rows = labelled(raster.map(lambda b: {"_in": np.where(b[mask] == 1, 1.0, np.nan)}, "_in"), "_in", "_part")
    if radius > 0:
        def core(block: Block) -> dict:
            inside, absent = block["_part"], np.isnan(block[mask])
            part = np.where(absent, np.nan, np.nan_to_num(inside, nan=-1.0))
            same = (swept(part, disk(radius), np.fmin) == part) & (swept(part, disk(radius), np.fmax) == part)
            return {"_core": np.where(np.isnan(inside), np.nan, same)[block.core]}

        rows = rows.stencil(radius, [mask, "_part"], core, "_core").settled()

        def alive(block: Block) -> dict:
            label, core = block["_part"], block["_core"]
            found = np.unique(label[~np.isnan(label)])
            return {"label": found.astype(np.int64), "alive": np.isin(found, label[core == 1])}

        empty = rows.without_facts().table(alive, "label long, alive boolean").groupBy(*by, "label").agg(F.max("alive").alias("value")).where(~F.col("value"))
        rows = _told(rows, "_part", empty, "_empty")
        rows = rows.map(lambda b: {"_in": np.where((b["_core"] == 1) | _having(b.facts["_empty"], b["_part"], False), b["_part"], np.nan)}, "_in", keep=keep)
        rows = replace(rows, frame=rows.frame.drop("_empty"), facts=raster.facts)
    else:
        rows = rows.map(lambda b: {"_in": b["_part"]}, "_in", keep=keep)
    done = labelled(rows, "_in", name)
    return done.pick(*keep, name)


def _relax(weight, cost, age, label, free, phase: str) -> bool:
    """One phase of flooding inside a padded block, to rest; borders of the block only give.  True if anything changed."""
    ever, changed = False, True
    inner = slice(1, -1)
    while changed:
        changed = False
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            there = (slice(1 + dy, cost.shape[0] - 1 + dy), slice(1 + dx, cost.shape[1] - 1 + dx))
            here = (inner, inner)
            offer = np.maximum(cost[there], weight[here])
            if phase == "cost":
                better = offer < cost[here]
            else:
                offered = np.where(cost[there] == cost[here], age[there] + 1, 0.0)
                same = offer == cost[here]
                better = same & (offered < age[here]) if phase == "age" else same & (offered == age[here]) & (label[there] < label[here])
            better &= free[here] & np.isfinite(offer)
            if better.any():
                target, value = {"cost": (cost, offer), "age": (age, None), "label": (label, label[there])}[phase]
                value = offered if phase == "age" else value
                target[here][better] = value[better]
                ever = changed = True
    return ever


def flooded(raster: Raster, seed: str, weight: str, mask: str, name: str) -> Raster:
    """Adds ``name``: the seed whose flood reaches each position of ``mask`` (1) at the lowest largest weight, 4-connected.

    Ties go to the seed fewer steps away since that cost was entered, then to the smaller label.  Images of one chunk are
    settled at once; for others chunks settle and exchange borders until none changes, phase by phase.
    """
    keep, none = raster.channels, float(1 << 62)
    channels = ["_w", "_cost", "_age", "_label", "_free"]

    def start(block: Block) -> dict:
        inside = block[mask] == 1
        given = inside & ~np.isnan(block[seed])
        height = np.where(inside, block[weight], np.inf)
        return {"_w": height, "_cost": np.where(given, height, np.inf), "_age": np.where(given, 0.0, np.inf), "_label": np.where(given, block[seed], none), "_free": inside & ~given}

    def settle(block: Block, phases) -> dict:
        weight, cost, age, label = (np.nan_to_num(block[c], nan=n, posinf=np.inf) for c, n in zip(channels[:4], (np.inf, np.inf, np.inf, none)))
        core = np.zeros(cost.shape, dtype=bool)
        core[block.core] = True
        free = (block["_free"] == 1) & core
        before = {"_cost": cost.copy(), "_age": age.copy(), "_label": label.copy()}
        for phase in phases:
            _relax(weight, cost, age, label, free, phase)
        found = {"_cost": cost, "_age": age, "_label": label}
        rim = np.ones(cost[block.core].shape, dtype=bool)
        rim[1:-1, 1:-1] = False
        moved = any((found[c] != before[c])[block.core][rim].any() for c in found)
        return {**{c: v[block.core] for c, v in found.items()}, "_moved": np.full(rim.shape, float(moved))}

    def alone(block: Block) -> dict:
        padded = replace(block, halo=1, channels={c: np.pad(block[c], 1, constant_values=np.nan) for c in channels})
        return {c: v for c, v in settle(padded, ("cost", "age", "label")).items() if c != "_moved"}

    rows = raster.map(start, channels)
    single = (F.col("h") <= raster.chunk) & (F.col("w") <= raster.chunk)
    small = (rows if raster.lone else replace(rows, frame=rows.frame.where(single))).map(alone, ["_cost", "_age", "_label"])
    state = rows if raster.lone else replace(rows, frame=rows.frame.where(~single)).settled()
    if not (raster.lone or state.frame.isEmpty()):
        for phase in ("cost", "age", "label"):
            while True:
                state = state.stencil(1, channels, lambda b, phase=phase: settle(b, (phase,)), ["_cost", "_age", "_label", "_moved"])
                moved = replace(state, frame=stored(state.frame))
                state = moved.pick(*keep, *channels)
                changes = moved.pick("_moved").without_facts().table(lambda b: {"m": [bool(b["_moved"].any())]}, "m boolean")
                if changes.where("m").isEmpty():
                    break
        small = replace(small, frame=small.pick(*keep, *channels).frame.unionByName(state.frame), channels=state.channels)
    return small.map(lambda b: {name: np.where(b["_label"] < none, b["_label"], np.nan)}, name, keep=keep)


def region_facts(raster: Raster, settings) -> DataFrame:
    """Contrast, sharpness and decision (damage, expand, keep) of each region: ``by``, label and those.

    Channels: raw (label of a region's own dark positions), matrix, watershed, gradient_norm, Lab.  Sums and edge values are
    made where the positions are; a region that spans chunks is put together by its label.
    """
    by, wide = list(raster.by), disk(max(1, settings.edge_transition_radius))
    halo = max(max(1, settings.edge_transition_radius), 1)
    inputs = ["raw", "matrix", "watershed", "gradient_norm", *LAB]

    def touching(block: Block, shape: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Flat core position and label of another region within the footprint, each pair once."""
        raw = block["raw"]
        h, w = raw[block.core].shape
        mine, found = raw[block.core], []
        for dy, half in shape.items():
            for dx in range(-half, half + 1):
                theirs = raw[block.halo + dy:block.halo + dy + h, block.halo + dx:block.halo + dx + w]
                at = np.flatnonzero(~np.isnan(theirs) & (theirs != mine))
                found.append(np.stack([at, theirs.ravel()[at]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0].astype(np.int64), pairs[1]

    def parts(block: Block) -> dict:
        core = {c: block[c][block.core].ravel() for c in inputs}
        raw = core["raw"]
        own = np.flatnonzero(~np.isnan(raw))
        filled = np.where(np.isnan(block["matrix"]), np.nan, np.nan_to_num(block["raw"], nan=-1.0))
        rim = ((swept(filled, CROSS, np.fmin) != filled) | (swept(filled, CROSS, np.fmax) != filled))[block.core].ravel()
        at, label = touching(block, wide)
        near, beside = touching(block, CROSS)
        watershed = core["watershed"] == 1
        sharp, outer = own[rim[own] & watershed[own]], core["matrix"][at] == 1
        edge = np.concatenate([sharp, near[watershed[near]]]), np.concatenate([raw[sharp], beside[watershed[near]]])
        groups = [("all", own, raw[own]), ("rim", own[rim[own]], raw[own[rim[own]]]), ("outer", at[outer], label[outer]), ("edge", *edge), ("inside", own, raw[own])]
        rows = {c: [] for c in ("label", "kind", "n", "l", "a", "b", "g")}
        for kind, where, of in groups:
            if kind in ("edge", "inside"):
                pairs, n = np.unique(np.stack([of, core["gradient_norm"][where]]), axis=1, return_counts=True)
                made = {"label": pairs[0], "n": n, "g": pairs[1], **{c: np.zeros(len(n)) for c in "lab"}}
            else:
                labels, to = np.unique(of, return_inverse=True)
                made = {"label": labels, "n": np.bincount(to, minlength=len(labels)), "g": np.full(len(labels), np.nan),
                        **{c: np.bincount(to, core[f"lab_{c}"][where], minlength=len(labels)) for c in "lab"}}
            for c in rows:
                rows[c].append(np.full(len(made["n"]), kind, dtype=object) if c == "kind" else made[c])
        joined = {c: np.concatenate(v) for c, v in rows.items()}
        return {**joined, "label": joined["label"].astype(np.int64), "n": joined["n"].astype(np.int64)}

    found = raster.without_facts().halo_table(halo, inputs, parts, "label long, kind string, n long, l double, a double, b double, g double")
    of = lambda kind, value="n": F.sum(F.when(F.col("kind") == kind, F.col(value)))
    summed = found.groupBy(*by, "label").agg(
        *[of(k).alias(f"n_{k}") for k in ("all", "rim", "outer")], *[of(k, c).alias(f"{c}_{k}") for k in ("all", "rim", "outer") for c in "lab"],
        F.percentile(F.when(F.col("kind") == "edge", F.col("g")), 0.5, F.col("n")).alias("edge"), F.percentile(F.when(F.col("kind") == "inside", F.col("g")), 0.5, F.col("n")).alias("inside"))
    mean = lambda c: F.coalesce(F.col(f"{c}_rim") / F.col("n_rim"), F.col(f"{c}_all") / F.col("n_all")) - F.col(f"{c}_outer") / F.col("n_outer")
    soft = F.lit(max(settings.edge_soft_delta_e, 1e-6))
    summed = summed.where((F.col("n_all") >= settings.edge_min_region_area) & (F.col("n_outer") > 0)).select(
        *by, "label", F.col("n_all").alias("area"), F.sqrt(mean("l") ** 2 + mean("a") ** 2 + mean("b") ** 2).alias("delta_e"), F.coalesce("edge", "inside").alias("sharpness"))
    damage = F.lit(float(settings.edge_refinement_strength)) * F.col("sharpness") * F.least(F.lit(2.0), F.col("delta_e") / soft) / 2.0
    softness = F.lit(1.0) - F.least(F.lit(1.0), F.col("delta_e") / soft)
    decision = F.when((damage >= DAMAGE_SCORE) & (F.col("sharpness") >= DAMAGE_SHARPNESS) & (F.col("delta_e") >= settings.edge_soft_delta_e), "damage").when(softness >= EXPAND_SOFTNESS, "expand").otherwise("keep")
    return summed.select(*by, "label", "area", "delta_e", "sharpness", decision.alias("decision"))


def refined(raster: Raster, settings) -> Raster:
    """Sharp, high-contrast dark regions become damage, soft ones grow to their flood basin; images without gradient keep their codes."""
    keep = raster.channels
    rows = raster.map(lambda b: {"_large": np.where(np.isnan(b["code"]), np.nan, b["code"] == 3), "matrix": 1.0 - b["is_ore"]}, ["_large", "matrix"])
    rows = without_small(rows, "_large", settings.edge_min_region_area)
    step, wide = max(1, settings.edge_gradient_radius), settings.edge_transition_radius

    def edges(block: Block) -> dict:
        spans = [swept(block[c], disk(step), np.fmax) - swept(block[c], disk(step), np.fmin) for c in LAB]
        grown = swept(block["_large"], disk(wide), np.fmax) if wide > 0 else block["_large"]
        gradient = np.sqrt(sum(s ** 2 for s in spans))
        return {"gradient": gradient[block.core], "_sloped": np.where(gradient > 1e-6, gradient, np.nan)[block.core], "watershed": (grown * block["matrix"])[block.core]}

    rows = rows.stencil(max(step, wide), [*LAB, "_large", "matrix"], edges, ["gradient", "_sloped", "watershed"]).settled()
    rows = rows.with_facts(percentiles(rows, "_sloped", {"_p95": 0.95}))

    def normal(block: Block) -> dict:
        top = block.facts["_p95"]
        flat = top is None or np.isnan(top) or top <= 1e-6
        return {"gradient_norm": block["gradient"] * 0.0 if flat else np.clip(block["gradient"] / top, 0.0, 1.0)}

    rows = rows.map(normal, "gradient_norm", keep=(*keep, "_large", "matrix", "watershed"))
    rows = seeds(rows, "_large", settings.edge_seed_erosion_radius, "_seed")
    rows = flooded(rows, "_seed", "gradient_norm", "watershed", "_basin")
    rows = rows.map(lambda b: {"raw": np.where(b["_large"] == 1, b["_basin"], np.nan)}, "raw").settled()
    verdicts = region_facts(rows, settings).select(*rows.by, "label", F.col("decision").alias("value")).where("value <> 'keep'")
    rows = _told(rows, "_basin", verdicts, "_verdicts")

    def judged(block: Block) -> dict:
        top = block.facts["_p95"]
        code = block["code"]
        if top is None or np.isnan(top) or top <= 1e-6:
            return {"code": code}
        told = block.facts["_verdicts"]
        grown = _having(told, block["_basin"], "expand") & (block["matrix"] == 1)
        broken = _having(told, block["_basin"], "damage") & ~np.isnan(block["raw"])
        return {"code": np.where(broken, 4.0, np.where(grown, 3.0, code))}

    done = rows.map(judged, "code", keep=keep)
    return replace(done, frame=done.frame.drop("_p95", "_verdicts"), facts=raster.facts)


def two_step(raster: Raster, settings, refine: bool = True) -> Raster:
    """Adds ``code`` and ``is_ore`` to a raster of Lab channels."""
    rows = raw_codes(raster, settings)
    if refine and settings.edge_refinement_strength > 0:
        rows = refined(rows.settled(), settings)
    # Before refinement no position is damage, so its cleaning would change nothing.
    return cleaned(rows.settled(), settings.min_component_area, settings.morph_radius, (1, 3, 4) if refine else (1, 3))


def corrected(raster: Raster, settings) -> Raster:
    """:func:`two_step` after illumination and shadow correction; fact ``applied`` says whether either changed an image."""
    if settings.illumination_correction_strength <= 0 and settings.local_shadow_correction_strength <= 0:
        none = raster.frame.select(*raster.by).distinct().withColumn("applied", F.lit(False))
        return two_step(raster.settled(), settings).with_facts(none)
    first = two_step(raster.settled(), settings, refine=False)
    lit = lifted_shadows(even_light(first, settings), settings)
    applied = lit.frame.select(*lit.by, (F.col("even") | F.col("lifted")).alias("applied")).distinct()
    return two_step(lit.without_facts().pick(*LAB), settings).with_facts(stored(applied))


def at_work_side(raster: Raster, most: int) -> Raster:
    """8-bit channels of images with a longer side than ``most`` shrunk to it; facts source_h and source_w keep the size."""
    side = lambda c: F.greatest(F.lit(1), (F.col(c) * (F.lit(float(most)) / F.greatest("h", "w"))).cast("int"))
    raster = raster.settled()
    sizes = raster.frame.select(*raster.by, F.col("h").alias("source_h"), F.col("w").alias("source_w"), side("h").alias("_h"), side("w").alias("_w")).distinct()
    rows = raster.with_facts(sizes)
    large = F.greatest("h", "w") > most
    if not rows.frame.where(large).isEmpty():
        shrunk = resampled(replace(rows, frame=rows.frame.where(large)), "_h", "_w", "lanczos")
        rows = replace(rows, frame=rows.frame.where(~large).unionByName(shrunk.frame)).settled()
    return replace(rows, frame=rows.frame.drop("_h", "_w"), facts=tuple(f for f in rows.facts if f not in ("_h", "_w")))


def at_source_size(raster: Raster) -> Raster:
    """Channels back at the size of facts source_h and source_w, by the nearest position."""
    same = (F.col("h") == F.col("source_h")) & (F.col("w") == F.col("source_w"))
    if raster.frame.where(~same).isEmpty():
        return raster
    back = resampled(replace(raster, frame=raster.frame.where(~same)), "source_h", "source_w", "nearest")
    return replace(raster, frame=raster.frame.where(same).unionByName(back.frame), lone=False)
