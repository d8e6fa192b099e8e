"""Dark segments of an image: parts, features, density clusters and their selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import CHUNK, label_components
from tilewright.operators.relax import spread_labels
from tilewright.operators.scale import attach, cut_lineage, sorted_join, spread_for_python
from tilewright.operators.stats import component_stats, zscores

# Feature weightings and sweep sizes.
VARIANTS = (
    ("color_spatial", (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)),
    ("spatial", (1.0, 1.0, 0.0, 0.0, 0.0, 0.0)),
    ("spatial_x2", (2.0, 2.0, 0.5, 0.5, 0.5, 0.25)),
    ("spatial_x4", (4.0, 4.0, 0.5, 0.5, 0.5, 0.25)),
    ("spatial_x8", (8.0, 8.0, 0.5, 0.5, 0.5, 0.25)),
    ("spatial_x16", (16.0, 16.0, 0.5, 0.5, 0.5, 0.25)),
)
# The sample counts tried with each smallest cluster size.
SAMPLES = {2: (1, 2), 3: (1, 2, 3), 4: (1, 2, 4), 5: (1, 2, 5), 8: (1, 2, 4, 8), 13: (1, 2, 6, 13), 21: (1, 2, 10, 21), 34: (1, 2, 17, 34), 55: (1, 2, 27, 55), 89: (1, 2, 44, 89)}
CLUSTER_SIZES = tuple(SAMPLES)
CELL = 64
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5")
ClusterFunction = Callable[[np.ndarray, int, int], np.ndarray]


def region_parts(pixels: DataFrame, image: str = "image_id", chunk: int = CHUNK) -> DataFrame:
    """Labels of dark parts: components cut by region, each cut part connected again.

    ``pixels``: talc, interior, boundary (booleans).  Interior regions first grow
    over dark boundary pixels.  Result: image, y, x, component, region, part.
    """
    key = [image, "y", "x"]
    talc = label_components(pixels.where("talc").select(*key), image, chunk=chunk).withColumnRenamed("label", "component")
    inside = label_components(pixels.where("interior").select(*key), image, chunk=chunk)
    firsts = inside.select(image, "label").distinct()
    # Region ids follow the scan order of first pixels: the label is that pixel's key.
    ids = firsts.withColumnRenamed("label", "region_label")
    marked = pixels.join(inside, key, "left").withColumn("_region", F.coalesce(F.col("label") + 1, F.lit(0))).drop("label")
    grown = spread_regions(marked, image, chunk)
    joined = talc.join(grown, key, "left").withColumn("region_label", F.coalesce("_region", F.lit(0)) - 1).drop("_region")
    parts = label_components(joined.select(image, "component", "region_label", "y", "x"), [image, "component", "region_label"], chunk=chunk)
    return parts.join(ids.withColumn("_known", F.lit(True)), [image, "region_label"], "left").select(
        image, "y", "x", "component", F.when(F.col("_known"), F.col("region_label")).alias("region"), F.col("label").alias("part"))


def spread_regions(marked: DataFrame, image: str, chunk: int = CHUNK) -> DataFrame:
    usable = marked.where((F.col("_region") > 0) | (F.col("talc") & F.col("boundary")))
    seeded = usable.withColumn("_seed", F.when(F.col("_region") > 0, F.col("_region")))
    return spread_labels(seeded, "_seed", None, image, diagonal=True, chunk=chunk).select(image, "y", "x", F.col("label").alias("_region"))


def talc_segments(pixels: DataFrame, image: str = "image_id", chunk: int = CHUNK) -> DataFrame:
    """One row per dark part with area, centroid, mean colours and region flags.

    ``pixels`` adds Lab and r, g, b to the columns of :func:`region_parts`.
    """
    parts = cut_lineage(region_parts(pixels, image, chunk))
    colours = pixels.select(image, "y", "x", "lab_l", "lab_a", "lab_b", "r", "g", "b")
    stats = component_stats(parts.join(colours, [image, "y", "x"]), [image, "component", "region", "part"])
    inside = F.col("region").isNotNull()
    return stats.withColumns({"inside": inside, "intersects": inside, "interior_area": F.when(inside, F.col("area")).otherwise(F.lit(0))})


def segment_features(segments: DataFrame, width: Column, height: Column, image: str = "image_id") -> DataFrame:
    """Standardised features f0..f5: place, colour and size (columns cx, cy, l, a, b, area)."""
    raw = segments.withColumns({
        "f0": F.col("cx") / F.greatest(F.lit(1.0), width), "f1": F.col("cy") / F.greatest(F.lit(1.0), height), "f2": F.col("l") / 100.0,
        "f3": F.col("a") / 128.0, "f4": F.col("b") / 128.0, "f5": F.log1p(F.col("area").cast("double")) / 12.0})
    return zscores(raw, image, FEATURES)


def feature_variants(segments: DataFrame) -> DataFrame:
    """Each segment once per weighting: ``variant``, ``variant_order``, ``features``."""
    table = F.array(*[
        F.struct(F.lit(i).alias("o"), F.lit(name).alias("n"), F.array(*[F.lit(w) for w in weights]).alias("w"))
        for i, (name, weights) in enumerate(VARIANTS)])
    point = F.array(*[F.col(f) for f in FEATURES])
    return segments.select("*", F.explode(table).alias("_v")).select(
        "*", F.col("_v.o").alias("variant_order"), F.col("_v.n").alias("variant"), F.zip_with(point, F.col("_v.w"), lambda a, w: a * w).alias("features")).drop("_v")


def density_labels(points: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Hierarchical density clusters (excess of mass, a single cluster allowed); -1 is noise.

    Mutual-reachability spanning tree, condensed by ``min_size``; one image's
    segments at a time, n^2 work and n memory.
    """
    return density_label_sets(points, [(min_size, min_samples)])[0]


def density_label_sets(points: np.ndarray, sets: list[tuple[int, int]]) -> list[np.ndarray]:
    """:func:`density_labels` of several (min_size, min_samples): one tree a sample count, all grown together."""
    samples = sorted({s for _, s in sets})
    trees = dict(zip(samples, _density_trees(points, samples)))
    return [_condensed_labels(len(points), min_size, *trees[s]) for min_size, s in sets]


def _density_trees(points: np.ndarray, samples: list[int]) -> list[tuple[list, list, list]]:
    """Dendrogram (children, height and size of every node) of each sample count."""
    n, every = len(points), np.arange(len(samples))
    gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)) if n <= 2048 else None
    row = (lambda i: gaps[i]) if gaps is not None else (lambda i: np.sqrt(((points - points[i]) ** 2).sum(-1)))
    rows = (lambda at: gaps[at]) if gaps is not None else (lambda at: np.stack([row(i) for i in at]))
    ranks = [s - 1 for s in samples]
    core = np.array([np.partition(row(i), ranks)[ranks] for i in range(n)]).T
    shape = len(samples), n
    reach, origin, rest = np.full(shape, np.inf), np.zeros(shape, dtype=int), np.ones(shape, dtype=bool)
    here = np.zeros(len(samples), dtype=int)
    weight, ends = np.empty((len(samples), n - 1)), np.empty((len(samples), n - 1, 2), dtype=int)
    rest[:, 0] = False
    for step in range(n - 1):
        d = np.maximum(np.maximum(rows(here), core), core[every, here][:, None])
        closer = rest & (d < reach)
        reach = np.where(closer, d, reach)
        origin = np.where(closer, here[:, None], origin)
        here = np.argmin(np.where(rest, reach, np.inf), axis=1)
        weight[:, step], ends[:, step, 0], ends[:, step, 1] = reach[every, here], origin[every, here], here
        rest[every, here] = False
    out = []
    for w, e in zip(weight, ends):
        order = np.argsort(w, kind="stable")
        out.append(_dendrogram(n, w[order].tolist(), e[order].tolist()))
    return out


def _dendrogram(n: int, heights: list[float], ends: list[list[int]]) -> tuple[list, list, list]:
    """Node n + i joins the two subtrees at edge i."""
    top, size, kids, height = list(range(n)), [1] * n, [None] * n, [0.0] * n

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for d, (a, b) in zip(heights, ends):
        left, right, node = find(a), find(b), len(top)
        top.append(node)
        top[left] = top[right] = node
        kids.append((left, right))
        height.append(d)
        size.append(size[left] + size[right])
    return kids, height, size


def _condensed_labels(n: int, min_size: int, kids: list, height: list, size: list) -> np.ndarray:
    leaves = lambda node: _leaves(node, kids, n)
    # Condensed tree: cluster -> members leaving at a density, and child clusters.
    birth, parent, leaving, children = {0: 0.0}, {0: None}, {0: []}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        density = 1.0 / height[node] if height[node] > 1e-12 else 1e12
        big = [k for k in kids[node] if size[k] >= min_size]
        for kid in kids[node]:
            if len(big) == 2:
                new = len(birth)
                birth[new], parent[new], leaving[new], children[new] = density, cluster, [], []
                children[cluster].append((new, size[kid], density))
                stack.append((kid, new))
            elif kid in big:
                stack.append((kid, cluster))
            else:
                leaving[cluster] += [(p, density) for p in leaves(kid)]
    stability = {
        c: sum(d - birth[c] for _, d in leaving[c]) + sum((d - birth[c]) * s for _, s, d in children[c]) for c in birth}
    chosen, worth = {}, {}
    for c in sorted(birth, reverse=True):
        below = sum(worth[k] for k, _, _ in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        worth[c] = max(stability[c], below) if children[c] else stability[c]
    labels, queue, selected = np.full(n, -1), [0], []
    while queue:
        c = queue.pop(0)
        if chosen[c]:
            selected.append(c)
        else:
            queue += [k for k, _, _ in children[c]]
    for number, c in enumerate(sorted(selected)):
        inner, members = [c], []
        while inner:
            k = inner.pop()
            members += leaving[k]
            inner += [j for j, _, _ in children[k]]
        if c == 0:
            # The whole tree as one cluster keeps only the densest level of its own members.
            limit = max([d for _, d in leaving[0]] + [d for _, _, d in children[0]])
            members = [(p, d) for p, d in leaving[0] if d >= limit] + [
                m for k, _, _ in children[0] for m in _members(k, leaving, children)]
        for point, _ in members:
            labels[point] = number
    return labels


def _leaves(node: int, kids: list, n: int) -> list[int]:
    out, stack = [], [node]
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            stack += kids[k]
    return out


def _members(cluster: int, leaving: dict, children: dict) -> list:
    out, stack = [], [cluster]
    while stack:
        k = stack.pop()
        out += leaving[k]
        stack += [j for j, _, _ in children[k]]
    return out


def density_sweep(variants: DataFrame, cluster: ClusterFunction = density_labels, image: str = "image_id", segment: str = "segment_id") -> DataFrame:
    """Cluster label of every segment under every parameter set.

    Result: image, segment, variant, sweep_order, min_cluster_size, min_samples, label.
    """
    kept = [image, "variant", "sweep_order", "min_cluster_size", "min_samples"]
    return swept_sets(variants, cluster, image, segment).select(*kept, F.explode(F.arrays_zip("ids", "labels")).alias("_z")).select(
        *kept, F.col("_z.ids").alias(segment), F.col("_z.labels").alias("label"))


def swept_sets(variants: DataFrame, cluster: ClusterFunction = density_labels, image: str = "image_id", segment: str = "segment_id") -> DataFrame:
    """As :func:`density_sweep`, one row a parameter set: ``ids`` in ascending order and their ``labels``.

    One task row per (image, variant); an image's segments are bounded by the
    working size images are shrunk to (tens of pixels per segment at least).
    """
    types = {f.name: f.dataType.simpleString() for f in variants.schema.fields}
    gathered = variants.groupBy(image, "variant", "variant_order").agg(
        F.array_sort(F.collect_list(F.struct(F.col(segment).alias("s"), F.col("features").alias("f")))).alias("rows"))
    packed = gathered.where(F.size("rows") >= 2).select(
        image, "variant", "variant_order", F.transform("rows", lambda r: r["s"]).alias("ids"),
        F.flatten(F.transform("rows", lambda r: r["f"])).alias("flat"))
    schema = (f"`{image}` {types[image]}, variant string, variant_order int, ids array<{types[segment]}>, "
              "labels array<int>, set_order int, min_cluster_size int, min_samples int")

    def each(points: np.ndarray, sets: list[tuple[int, int]]) -> list[np.ndarray]:
        return [cluster(points, size, samples) for size, samples in sets]

    sweep = density_label_sets if cluster is density_labels else each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for record in frame.itertuples(index=False):
                ids = list(record.ids)
                points = np.asarray(record.flat, dtype=float).reshape(len(ids), -1)
                sets = [(size, samples) for size in CLUSTER_SIZES if size <= len(ids) for samples in SAMPLES[size]]
                for order, ((size, samples), labels) in enumerate(zip(sets, sweep(points, sets))):
                    out.append((getattr(record, image), record.variant, record.variant_order, ids, labels.tolist(), order, size, samples))
            yield pd.DataFrame(out, columns=[image, "variant", "variant_order", "ids", "labels", "set_order", "min_cluster_size", "min_samples"])

    swept = spread_for_python(packed, image, "variant").mapInPandas(run, schema)
    return swept.withColumn("sweep_order", F.col("variant_order") * 1000 + F.col("set_order")).drop("variant_order", "set_order")


def cluster_centres(assigned: DataFrame, by) -> DataFrame:
    """Area-weighted centre of each cluster."""
    weight = F.sum(F.col("area").cast("double"))
    return assigned.groupBy(*by).agg(
        (F.sum(F.col("cx") * F.col("area")) / weight).alias("cx"), (F.sum(F.col("cy") * F.col("area")) / weight).alias("cy"))


def centres_in_mask(centres: DataFrame, mask: DataFrame, width: Column, height: Column, image: str = "image_id") -> DataFrame:
    """Centres whose rounded, clipped pixel is set.

    ``mask``: image, y, x of set pixels, or half-open boxes (image, x0, y0, x1, y1)
    of set pixels, which may overlap.  A box is listed in the cells it touches and a
    centre asks its own cell, so boxes are never spread into pixels.
    """
    held = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, F.rint(v))).cast("int")
    placed = centres.withColumns({"_x": held(F.col("cx"), width), "_y": held(F.col("cy"), height)})
    if "x0" not in mask.columns:
        pixels = mask.select(image, F.col("y").alias("_y"), F.col("x").alias("_x")).distinct()
        return sorted_join(placed, pixels, [image, "_y", "_x"], "left_semi").drop("_y", "_x")
    cell = lambda c: F.floor(c / CELL)
    boxes = mask.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).select(
        F.col(image).alias("_image"), "x0", "y0", "x1", "y1", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1") - 1))).alias("_by")).select(
        "*", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1") - 1))).alias("_bx"))
    asked = placed.withColumns({"_cy": cell(F.col("_y")), "_cx": cell(F.col("_x"))})
    holds = (F.col("_x") >= F.col("x0")) & (F.col("_x") < F.col("x1")) & (F.col("_y") >= F.col("y0")) & (F.col("_y") < F.col("y1"))
    same = (F.col(image) == F.col("_image")) & (F.col("_cy") == F.col("_by")) & (F.col("_cx") == F.col("_bx"))
    return sorted_join(asked, boxes, same & holds, "left_semi").drop("_y", "_x", "_cy", "_cx")


def score_candidates(
    labels: DataFrame, segments: DataFrame, mask: DataFrame, width: Column, height: Column, by=("sweep_order",), image: str = "image_id",
    segment: str = "segment_id",
) -> DataFrame:
    """Selection of every parameter set: one row per (set, segment) with ``selected`` and ``supplemental``.

    Clusters whose centre lies inside are taken; required segments (``inside``)
    they miss are added.  Sets that take no cluster give no rows.
    """
    keys = [image, *by]
    sized = segments.select(image, segment, "area", "cx", "cy", "inside", "intersects", width.alias("_w"), height.alias("_h"))
    joined = sorted_join(labels, sized, [image, segment])
    clustered = joined.where(F.col("label") >= 0)
    centres = cluster_centres(clustered, [*keys, "label", "_w", "_h"])
    taken = centres_in_mask(centres, mask, F.col("_w"), F.col("_h"), image).select(*keys, "label")
    sizes = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"))
    flagged = sorted_join(sorted_join(joined, taken.withColumn("_in", F.lit(True)), [*keys, "label"], "left"), sizes, keys)
    hit = F.coalesce("_in", F.lit(False))
    return flagged.select(
        *keys, segment, "n_clusters", "intersects", "inside", (hit | F.col("inside")).alias("selected"), (~hit & F.col("inside")).alias("supplemental"))


def candidate_counts(selection: DataFrame, by=("sweep_order",), image: str = "image_id") -> DataFrame:
    keys = [image, *by]
    return selection.groupBy(*keys).agg(
        F.count_if("selected").alias("selected_count"), F.count_if("supplemental").alias("supplemental_count"),
        F.count_if(F.col("selected") & ~F.col("intersects")).alias("outside_selected"), F.count_if("inside").alias("required"),
        (F.first("n_clusters") + F.count_if("supplemental")).alias("selected_clusters"))


def taken_clusters(
    sets: DataFrame, segments: DataFrame, mask: DataFrame, width: Column, height: Column, image: str = "image_id", segment: str = "segment_id",
) -> DataFrame:
    """Clusters of :func:`swept_sets` whose centre lies inside the mask, with the numbers of segments that scoring asks for.

    Labels meet their segments as arrays of one image and are merged to clusters in
    the same task, so no table of all sets times all segments is shuffled or stored.
    """
    facts = F.struct(segment, "area", "cx", "cy", "inside", "intersects", width.alias("_w"), height.alias("_h"))
    rows = segments.groupBy(image).agg(F.array_sort(F.collect_list(facts)).alias("rows"))
    met = sorted_join(sets.select(image, "sweep_order", "labels"), rows, image)
    single = met.select(image, "sweep_order", F.explode(F.arrays_zip("labels", "rows")).alias("_z")).select(
        image, "sweep_order", F.col("_z.labels").alias("label"), "_z.rows.*").where(F.col("label") >= 0)
    weight = F.sum(F.col("area").cast("double"))
    clusters = single.groupBy(image, "sweep_order", "label", "_w", "_h").agg(
        (F.sum(F.col("cx") * F.col("area")) / weight).alias("cx"), (F.sum(F.col("cy") * F.col("area")) / weight).alias("cy"), F.count(F.lit(1)).alias("n"),
        F.count_if("inside").alias("n_inside"), F.count_if(~F.col("intersects")).alias("n_outside"),
        F.count_if(F.col("inside") & ~F.col("intersects")).alias("n_inside_outside"))
    return centres_in_mask(clusters, mask, F.col("_w"), F.col("_h"), image).drop("_w", "_h", "cx", "cy")


def taken_counts(taken: DataFrame, segments: DataFrame, image: str = "image_id") -> DataFrame:
    """The table of :func:`candidate_counts`, from the taken clusters and the required segments of an image."""
    sums = taken.groupBy(image, "sweep_order").agg(
        F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(f"_{c}") for c in ("n", "n_inside", "n_outside", "n_inside_outside")])
    required = segments.groupBy(image).agg(
        F.count_if("inside").alias("required"), F.count_if(F.col("inside") & ~F.col("intersects")).alias("_required_outside"))
    missed = F.col("required") - F.col("_n_inside")
    return sorted_join(sums, required, image).select(
        image, "sweep_order", (F.col("_n") + missed).alias("selected_count"), missed.alias("supplemental_count"),
        (F.col("_n_outside") + F.col("_required_outside") - F.col("_n_inside_outside")).alias("outside_selected"), "required",
        (F.col("_k") + missed).alias("selected_clusters"))


def best_parameters(counts: DataFrame, image: str = "image_id") -> DataFrame:
    """Winning parameter set: fewest supplemental, then outside, then selected, most clusters, first.

    A perfect set (nothing supplemental or outside, exactly the required ones)
    ends the search, so among perfect sets only the order counts.
    """
    perfect = (F.col("supplemental_count") == 0) & (F.col("outside_selected") == 0) & (F.col("selected_count") == F.col("required"))
    rank = F.struct(
        "supplemental_count", "outside_selected", "selected_count", F.when(perfect, F.lit(0)).otherwise(-F.col("selected_clusters")), "sweep_order")
    return counts.groupBy(image).agg(F.min_by(F.struct(*[c for c in counts.columns if c != image]), rank).alias("_b")).select(image, "_b.*")


def drop_large_outside(selected: DataFrame, image: str = "image_id", area: str = "area", region: str = "region_id") -> DataFrame:
    """Adds ``kept``: outside segments (region 0) larger than the smallest region's selected area go.

    Also carries the ``threshold`` (0 when no region has selected area, then nothing goes).
    """
    per_region = selected.where(F.col(region) > 0).groupBy(image, region).agg(F.sum(area).alias("_a"))
    limits = per_region.groupBy(image).agg(F.min("_a").alias("threshold"))
    joined = attach(selected, limits, image, "left")
    too_large = (F.col(region) == 0) & (F.col(area) > F.col("threshold"))
    return joined.withColumn("kept", ~F.coalesce(too_large, F.lit(False))).withColumn("threshold", F.coalesce("threshold", F.lit(0)))


def outside_filter_counters(filtered: DataFrame, image: str = "image_id", area: str = "area") -> DataFrame:
    gone = ~F.col("kept")
    return filtered.groupBy(image).agg(
        F.max("threshold").alias("threshold"), F.count_if(gone).alias("filtered_segments"),
        F.coalesce(F.sum(F.when(gone, F.col(area))), F.lit(0)).alias("filtered_pixels"), F.count_if("kept").alias("selected_segments"))


def select_segments(
    segments: DataFrame, mask: DataFrame, width: Column, height: Column, cluster: ClusterFunction = density_labels, image: str = "image_id",
    segment: str = "segment_id",
) -> DataFrame:
    """Final selection per segment: best density clustering, else the required ones; large outside parts removed.

    ``segments``: segment, area, cx, cy, l, a, b, inside, intersects, region_id.
    Images without a required segment select nothing.
    """
    needed = segments.where("inside").select(image).distinct()
    active = attach(segments, needed, image)
    features = feature_variants(segment_features(active, width, height, image))
    sets = cut_lineage(swept_sets(features, cluster, image, segment))
    taken = cut_lineage(taken_clusters(sets, active, mask, width, height, image, segment))
    best = cut_lineage(best_parameters(taken_counts(taken, active, image), image).select(image, "sweep_order"))
    won_labels = sorted_join(sets, best, [image, "sweep_order"]).select(image, "sweep_order", F.explode(F.arrays_zip("ids", "labels")).alias("_z")).select(
        image, "sweep_order", F.col("_z.ids").alias(segment), F.col("_z.labels").alias("label"))
    hits = taken.select(image, "sweep_order", "label", F.lit(True).alias("_in"))
    flagged = sorted_join(sorted_join(won_labels, hits, [image, "sweep_order", "label"], "left"), active.select(image, segment, "inside"), [image, segment])
    won = flagged.where(F.coalesce("_in", F.lit(False)) | F.col("inside")).select(image, segment, F.lit(False).alias("fallback"))
    lost = sorted_join(active.where("inside"), best.select(image), image, "left_anti").select(image, segment, F.lit(True).alias("fallback"))
    chosen = sorted_join(active, won.unionByName(lost), [image, segment])
    return drop_large_outside(chosen, image)

