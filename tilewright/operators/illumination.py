"""Illumination surface, local shadows and contrast normalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import CHUNK, drop_small
from tilewright.operators.morphology import dilate, disk, erode, robust_normalise, sweep
from tilewright.operators.scale import attach, attach_measured, cut_lineage, image_percentiles, in_groups, names, sorted_join


def _design(y: Column, x: Column, h: Column, w: Column) -> list[Column]:
    u = x / F.greatest(w - 1, F.lit(1)) * 2.0 - 1.0
    v = y / F.greatest(h - 1, F.lit(1)) * 2.0 - 1.0
    return [u * u, v * v, u * v, u, v, F.lit(1.0)]


def surface_coefficients(rows: DataFrame, value: str, image: str = "image_id") -> DataFrame:
    """Least-squares quadratic surface per image.

    The normal equations are plain sums, combined before the shuffle; only a 6 x 6
    system per image reaches Python.
    """
    basis = _design(F.col("y"), F.col("x"), F.col("h"), F.col("w"))
    count = len(basis)
    sums = rows.groupBy(image).agg(
        F.array(*[F.sum(basis[i] * basis[j]) for i in range(count) for j in range(count)]).alias("gram"),
        F.array(*[F.sum(basis[i] * F.col(value)) for i in range(count)]).alias("moment"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, moment: pd.Series) -> pd.Series:
        return pd.Series([
            np.linalg.lstsq(np.asarray(g, dtype=float).reshape(count, count), np.asarray(m, dtype=float), rcond=None)[0]
            for g, m in zip(gram, moment)])

    return sums.select(image, solve("gram", "moment").alias("coefficients"))


def correct_illumination(pixels: DataFrame, settings, image: str = "image_id") -> DataFrame:
    """Removes a smooth brightness surface fitted to trimmed, eroded ore; ``applied`` says where.

    ``pixels``: h, w, Lab and ``code``.  Images without enough ore stay as they are.
    """
    strength, most = settings.illumination_correction_strength, settings.illumination_max_delta_l
    if strength <= 0 or most <= 0:
        return pixels.withColumn("applied", F.lit(False))
    ore = drop_small(pixels.where(F.col("code") == 1).select(image, "y", "x"), settings.min_component_area, image).withColumn("_ore", F.lit(1))
    rows = pixels.join(ore, [image, "y", "x"], "left").withColumn("_ore", F.coalesce("_ore", F.lit(0)))
    if settings.illumination_ore_erosion_radius > 0:
        rows = erode(rows, "_ore", disk(settings.illumination_ore_erosion_radius), by=image)
    rows = cut_lineage(rows)
    core = rows.where(F.col("_ore") == 1).select(image, "y", "x", "h", "w", "lab_l")
    trim = settings.illumination_outlier_quantile
    sizes = core.groupBy(image).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= settings.illumination_min_ore_area)
    core = attach(core, sizes, image)
    if trim > 0:
        limits = cut_lineage(image_percentiles(core, image, "lab_l", {"_lo": trim, "_hi": 1.0 - trim}))
        core = attach_measured(core, limits, image).where((F.col("_n") < 20) | F.col("lab_l").between(F.col("_lo"), F.col("_hi")))
    left = core.groupBy(image).agg(F.count(F.lit(1)).alias("_kept")).where(F.col("_kept") >= max(settings.illumination_min_ore_area, 6)).select(image)
    fitted = surface_coefficients(attach(core, left, image), "lab_l", image)
    placed = attach(rows, fitted, image, "left")
    basis = _design(F.col("y"), F.col("x"), F.col("h"), F.col("w"))
    value = sum((basis[i] * F.col("coefficients")[i] for i in range(1, 6)), basis[0] * F.col("coefficients")[0])
    placed = cut_lineage(placed.withColumn("_fit", value).drop("coefficients"))
    centre = cut_lineage(image_percentiles(placed.where(F.col("_ore") == 1), image, "_fit", {"_median": 0.5}))
    placed = attach_measured(placed, centre, image, "left")
    delta = F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.col("_fit") - F.col("_median")))
    placed = placed.withColumn("_delta", F.coalesce(delta, F.lit(0.0)))
    moved = placed.groupBy(image).agg((F.max(F.abs("_delta")) > 1e-6).alias("applied"))
    lightness = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("lab_l") - F.lit(float(strength)) * F.col("_delta")))
    return attach_measured(placed, cut_lineage(moved), image).withColumn(
        "lab_l", F.when(F.col("_median").isNull(), F.col("lab_l")).otherwise(lightness)).drop("_ore", "_fit", "_median", "_delta")


def bilateral(pixels: DataFrame, value: str, radius: int, sigma_color: float, sigma_space: float, name: str, image: str = "image_id", chunk: int = CHUNK) -> DataFrame:
    """Edge-aware mean over a disk with reflected borders.

    Pixels go to their own chunk and, as a halo of ``radius``, to its neighbours;
    borders are reflected inside the block, and blocks of one shape are filtered together.
    """
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def homes(position: str, size: str) -> Column:
        """Chunks of the image whose halo holds the pixel; what a border reflects lies inside it too."""
        first = F.greatest(F.floor((F.col(position) - radius) / chunk), F.lit(0))
        last = F.least(F.floor((F.col(position) + radius) / chunk), F.floor((F.col(size) - 1) / chunk))
        return F.when(first <= last, F.sequence(first, last))

    spread = pixels.select(image, "y", "x", "h", "w", F.col(value).cast("double").alias("v"), F.explode(homes("y", "h")).alias("_cy")).select(
        image, "y", "x", "h", "w", "v", "_cy", F.explode(homes("x", "w")).alias("_cx"))
    offsets = [(dy, dx) for dy, half in disk(radius).items() for dx in range(-half, half + 1)]

    def mirrored(start: int, side: int, size: int) -> np.ndarray:
        """Place inside the block that each of its positions is read from."""
        turn = max(2 * (size - 1), 1)
        at = np.arange(start - radius, start + side + radius) % turn
        return np.minimum(at, turn - at if size > 1 else 0) - (start - radius)

    def filtered(block: np.ndarray) -> np.ndarray:
        """The mean at every position inside the rims; NaN where nothing is."""
        there = np.isfinite(block)
        whole, held = there.all(), np.where(there, block, 0.0)
        high, wide = block.shape[1] - 2 * radius, block.shape[2] - 2 * radius
        core = np.ascontiguousarray(held[:, radius:radius + high, radius:radius + wide])
        total, weight, w = np.zeros_like(core), np.zeros_like(core), np.empty_like(core)
        for dy, dx in offsets:
            part = np.s_[:, radius + dy:radius + dy + high, radius + dx:radius + dx + wide]
            moved = held[part]
            np.subtract(moved, core, out=w)
            w *= w
            w /= 2 * sigma_color**2
            np.exp(np.subtract(-(dy * dy + dx * dx) / (2 * sigma_space**2), w, out=w), out=w)
            if not whole:
                w *= there[part]
            weight += w
            w *= moved
            total += w
        usable = there[:, radius:radius + high, radius:radius + wide] & (weight > 0)
        return np.where(usable, total / np.where(usable, weight, 1.0), np.nan)

    def smooth(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        _, firsts = np.unique(group, return_index=True)
        kinds, kind = np.unique(frame[["h", "w", "_cy", "_cx"]].to_numpy(dtype=np.int64)[firsts], axis=0, return_inverse=True)
        kind, ids, out = kind.reshape(-1), frame[image].to_numpy()[firsts], []
        y, x, v = (frame[c].to_numpy() for c in ("y", "x", "v"))
        for number, (h, w, cy, cx) in enumerate(kinds.tolist()):
            top, left = cy * chunk, cx * chunk
            high, wide = min(chunk, h - top), min(chunk, w - left)
            members, most = np.flatnonzero(kind == number), max(1, 32768 // (high * wide))
            for some in np.split(members, range(most, len(members), most)):
                place = np.full(len(kind), -1)
                place[some] = np.arange(len(some))
                mine = np.flatnonzero(place[group] >= 0)
                block = np.full((len(some), high + 2 * radius, wide + 2 * radius), np.nan)
                block[place[group[mine]], y[mine] - top + radius, x[mine] - left + radius] = v[mine]
                mean = filtered(block[:, mirrored(top, high, h)][:, :, mirrored(left, wide, w)])
                at, ys, xs = np.nonzero(np.isfinite(mean))
                out.append(pd.DataFrame({image: ids[some][at], "y": (ys + top).astype("int32"), "x": (xs + left).astype("int32"), name: mean[at, ys, xs]}))
        return pd.concat(out, ignore_index=True)

    smoothed = in_groups(spread, [image, "_cy", "_cx"], smooth, f"`{image}` {types[image]}, y int, x int, `{name}` double")
    return sorted_join(pixels, smoothed, [image, "y", "x"])


def shrink_lab(pixels: DataFrame, scale: float, image: str = "image_id") -> DataFrame:
    """Area average of Lab at a smaller scale (sizes rounded half to even)."""
    h = F.greatest(F.lit(1), F.rint(F.col("h") * scale).cast("int"))
    w = F.greatest(F.lit(1), F.rint(F.col("w") * scale).cast("int"))
    placed = pixels.withColumns({"_h": h, "_w": w}).withColumns({
        "y": F.floor(F.col("y") * F.col("_h") / F.col("h")).cast("int"), "x": F.floor(F.col("x") * F.col("_w") / F.col("w")).cast("int")})
    return placed.groupBy(image, "y", "x", F.col("_h").alias("h"), F.col("_w").alias("w")).agg(*[F.avg(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


def enlarge_linear(small: DataFrame, sizes: DataFrame, value: str, image: str = "image_id") -> DataFrame:
    """Bilinear enlargement: every target pixel asks for its four sources and sums their shares."""
    target = sizes.select(image, "y", "x", "h", "w")
    scaled = attach(target, small.groupBy(image).agg(F.first("h").alias("_h"), F.first("w").alias("_w")), image)
    source = lambda p, n, m: (F.col(p) + 0.5) * F.col(m) / F.col(n) - 0.5
    sy, sx = source("y", "h", "_h"), source("x", "w", "_w")
    corners = F.array(*[
        F.struct((F.floor(sy) + dy).alias("sy"), (F.floor(sx) + dx).alias("sx"),
                 ((sy - F.floor(sy) if dy else F.lit(1.0) - sy + F.floor(sy)) * (sx - F.floor(sx) if dx else F.lit(1.0) - sx + F.floor(sx))).alias("share"))
        for dy in (0, 1) for dx in (0, 1)])
    asked = scaled.select(image, "y", "x", "_h", "_w", F.explode(corners).alias("c")).select(
        image, "y", "x", F.greatest(F.lit(0), F.least(F.col("_h") - 1, F.col("c.sy"))).cast("int").alias("sy"),
        F.greatest(F.lit(0), F.least(F.col("_w") - 1, F.col("c.sx"))).cast("int").alias("sx"), F.col("c.share").alias("share"))
    given = small.select(image, F.col("y").alias("sy"), F.col("x").alias("sx"), value)
    return asked.join(given, [image, "sy", "sx"]).groupBy(image, "y", "x").agg(F.sum(F.col(value) * F.col("share")).alias(value))


def boundary_barrier(pixels: DataFrame, settings, radius: int, image: str = "image_id") -> DataFrame:
    """Adds ``barrier`` 0..1: weighted, dilated edge strength of lightness and colour."""
    wanted = {}
    for c in ("l", "a", "b"):
        wanted[f"_{c}_hi"], wanted[f"_{c}_lo"] = (f"lab_{c}", "max"), (f"lab_{c}", "min")
    rows = sweep(pixels, wanted, disk(max(1, radius)), image)
    span = lambda c: F.col(f"_{c}_hi") - F.col(f"_{c}_lo")
    rows = cut_lineage(rows.withColumns({"_gl": span("l"), "_gc": F.sqrt(span("a") ** 2 + span("b") ** 2)}).drop(*wanted))
    rows = robust_normalise(robust_normalise(rows, "_gl", "_nl", image), "_gc", "_nc", image)
    mixed = F.col("_nl") * settings.local_shadow_lightness_barrier + F.col("_nc") * settings.local_shadow_chroma_barrier
    rows = rows.withColumn("barrier", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))).drop("_gl", "_gc", "_nl", "_nc")
    return dilate(rows, "barrier", disk(max(1, min(radius + settings.local_shadow_radius // 12, 12))), by=image)


def correct_shadows(pixels: DataFrame, settings, image: str = "image_id") -> DataFrame:
    """Lifts pixels darker than their edge-aware surroundings, less so near boundaries; adds ``applied``."""
    strength, most = settings.local_shadow_correction_strength, settings.local_shadow_max_delta_l
    if strength <= 0 or most <= 0:
        return pixels.withColumn("applied", F.lit(False))
    radius = max(3, settings.local_shadow_radius)
    scale = min(1.0, 32.0 / radius)
    work = pixels.select(image, "y", "x", "h", "w", "lab_l", "lab_a", "lab_b") if scale >= 1.0 else shrink_lab(pixels, scale, image)
    reach = max(3, int(round(radius * scale)))
    smooth = bilateral(cut_lineage(work), "lab_l", reach, max(4.0, most * 1.5), float(reach), "_around", image)
    edged = boundary_barrier(smooth, settings, max(1, int(round(settings.edge_gradient_radius * scale))), image)
    lift = F.greatest(F.col("_around") - F.col("lab_l"), F.lit(0.0)) * (F.lit(1.0) - F.col("barrier"))
    lifted = cut_lineage(edged.withColumn("_lift", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), lift))).select(image, "y", "x", "h", "w", "_lift"))
    moved = lifted.groupBy(image).agg((F.max("_lift") > 1e-6).alias("applied"))
    full = lifted.drop("h", "w") if scale >= 1.0 else enlarge_linear(lifted, pixels, "_lift", image)
    joined = attach(pixels.join(full, [image, "y", "x"]), moved, image)
    raised = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("lab_l") + F.lit(float(strength)) * F.col("_lift")))
    return joined.withColumn("lab_l", F.when(F.col("applied"), raised).otherwise(F.col("lab_l"))).drop("_lift")


def equalise(pixels: DataFrame, value: str, name: str, grid: int = 8, clip: float = 3.0, image: str = "image_id") -> DataFrame:
    """Contrast-limited adaptive equalisation of an 8-bit channel.

    Per grid cell a 256-bin histogram is clipped, its excess spread evenly and
    accumulated to a lookup row (an array of 256, built without a window); each
    pixel then mixes the lookups of its four nearest cells.  ``pixels`` carries
    h and w.
    """
    cell = lambda p, n: F.least(F.floor(F.col(p) * grid / F.col(n)), F.lit(grid - 1)).cast("int")
    rows = pixels.withColumns({"_cy": cell("y", "h"), "_cx": cell("x", "w")})
    counted = rows.groupBy(image, "_cy", "_cx", F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(image, "_cy", "_cx").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"), F.sum("n").alias("area"))
    limit = F.greatest(F.floor(F.col("area") * clip / 256), F.lit(1))
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.element_at("m", v), F.lit(0)))
    clipped = packed.withColumn("_limit", limit).withColumn("bins", bins)
    excess = F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, n: s + F.greatest(n - F.col("_limit"), F.lit(0)).cast("bigint"))
    clipped = clipped.withColumn("_excess", excess)
    each, rest = F.floor(F.col("_excess") / 256), F.col("_excess") % 256
    stepping = F.greatest(F.floor(F.lit(256) / F.greatest(rest, F.lit(1))), F.lit(1))
    level = F.transform("bins", lambda n, i: (
        F.least(n, F.col("_limit")) + each
        + F.when((rest > 0) & (i % stepping == 0) & (F.floor(i / stepping) < rest), 1).otherwise(0)).cast("bigint"))

    @F.pandas_udf("array<bigint>")
    def cumulative(levels: pd.Series) -> pd.Series:
        return pd.Series(list(np.cumsum(np.stack(levels.to_list()), axis=1))) if len(levels) else pd.Series([], dtype=object)

    tables = clipped.withColumn("level", level).withColumn("cum", cumulative("level")).select(
        image, F.col("_cy").alias("ty"), F.col("_cx").alias("tx"),
        F.transform("cum", lambda c: F.least(F.lit(255.0), F.rint(c * 255.0 / F.col("area")))).alias("lut"))
    place = lambda p, n: (F.col(p) + 0.5) * grid / F.col(n) - 0.5
    fy, fx = place("y", "h"), place("x", "w")
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid - 1), c)).cast("int")
    corners = F.array(*[
        F.struct(hold(F.floor(fy) + dy).alias("ty"), hold(F.floor(fx) + dx).alias("tx"),
                 ((fy - F.floor(fy) if dy else F.lit(1.0) - fy + F.floor(fy)) * (fx - F.floor(fx) if dx else F.lit(1.0) - fx + F.floor(fx))).alias("share"))
        for dy in (0, 1) for dx in (0, 1)])
    asked = pixels.select(image, "y", "x", F.col(value).cast("int").alias("v"), F.explode(corners).alias("c"))
    asked = asked.select(image, "y", "x", "v", "c.ty", "c.tx", "c.share")
    mixed = attach(asked, tables, [image, "ty", "tx"]).groupBy(image, "y", "x").agg(
        F.rint(F.sum(F.get(F.col("lut"), F.col("v")) * F.col("share"))).cast("int").alias(name))
    return pixels.join(mixed, [image, "y", "x"])


def stretch(pixels: DataFrame, value: str, name: str, image: str = "image_id") -> DataFrame:
    """Linear stretch of the 1st..99th percentile to 0..255, truncated; flat images stay as they are.

    An 8-bit channel has at most 256 distinct values per image, so the built-in
    exact percentile keeps a bounded state.
    """
    ends = pixels.groupBy(*names(image)).agg(F.percentile(value, 0.01).alias("_lo"), F.percentile(value, 0.99).alias("_hi"))
    placed = attach(pixels, ends, image)
    scaled = (F.col(value) - F.col("_lo")) * 255.0 / (F.col("_hi") - F.col("_lo"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("int")
    return placed.withColumn(name, F.when(F.col("_hi") > F.col("_lo"), clipped).otherwise(F.col(value).cast("int"))).drop("_lo", "_hi")
