"""Sketch lines: spurs, polylines, closed groups, region choice and edit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.operators.components import connect, label_components, pixel_key
from tilewright.operators.morphology import skeleton_nodes
from tilewright.operators.neighbours import connection_candidates, pair_key, valid_connections
from tilewright.operators.scale import attach, cut_lineage, sorted_join
from tilewright.operators.stats import segment_width, stroke_width

_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def pixel_links(left: DataFrame, right: DataFrame, image: str, give: str, take: str) -> DataFrame:
    """8-neighbour pairs of two pixel sets: image, y, x, ``give`` of left, and ``take`` of the neighbour."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _AROUND])
    asked = left.select(image, "y", "x", give, F.explode(offsets).alias("o")).select(
        image, "y", "x", give, (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    given = right.select(image, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(take))
    return sorted_join(asked, given, [image, "ny", "nx"])


def chains(skeleton: DataFrame, image: str = "image_id") -> DataFrame:
    """Pixels of degree at most 2 with the label of the run they form once junctions are taken out."""
    nodes = cut_lineage(skeleton_nodes(skeleton, image))
    simple = nodes.where(F.col("neighbours") <= 2)
    labelled = label_components(simple.select(image, "y", "x"), image).withColumnRenamed("label", "chain")
    return sorted_join(labelled, simple, [image, "y", "x"])


def spur_chains(skeleton: DataFrame, protected: DataFrame | None = None, image: str = "image_id", runs: DataFrame | None = None) -> DataFrame:
    """Length and ends of each chain: endpoints it holds, whether it meets a junction, protection."""
    nodes = cut_lineage(skeleton_nodes(skeleton, image))
    runs = cut_lineage(chains(skeleton, image)) if runs is None else runs
    junctions = nodes.where(F.col("role") == "junction").select(image, "y", "x", F.lit(True).alias("meets"))
    touching = pixel_links(runs, junctions, image, "chain", "meets").select(image, "chain").distinct().withColumn("meets", F.lit(True))
    stats = runs.groupBy(image, "chain").agg(
        F.count(F.lit(1)).alias("length"), F.count_if(F.col("role") == "endpoint").alias("ends"))
    out = attach(stats, touching, [image, "chain"], "left", grown=True).withColumn("meets", F.coalesce("meets", F.lit(False)))
    if protected is None:
        return out.withColumn("protected", F.lit(False))
    guarded = sorted_join(runs.where(F.col("role") == "endpoint"), protected.select(image, "y", "x").distinct(), [image, "y", "x"], "left_semi")
    guarded = guarded.select(image, "chain").distinct().withColumn("protected", F.lit(True))
    return attach(out, guarded, [image, "chain"], "left", grown=True).withColumn("protected", F.coalesce("protected", F.lit(False)))


def prune_spurs(skeleton: DataFrame, minimum: int, protected: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """Skeleton without short spurs: chains from an endpoint to a junction shorter than ``minimum``.

    An image that would lose every pixel keeps its skeleton.
    """
    pixels = skeleton.select(image, "y", "x")
    if minimum <= 0:
        return pixels
    runs = cut_lineage(chains(skeleton, image))
    short = spur_chains(skeleton, protected, image, runs).where(
        (F.col("ends") >= 1) & F.col("meets") & (F.col("length") < minimum) & ~F.col("protected")).select(image, "chain")
    doomed = attach(runs.select(image, "y", "x", "chain"), short, [image, "chain"], grown=True).select(image, "y", "x")
    left = cut_lineage(sorted_join(pixels, doomed, [image, "y", "x"], "left_anti"))
    emptied = pixels.select(image).distinct().join(left.select(image).distinct(), image, "left_anti")
    return left.unionByName(attach(pixels, emptied, image))


def branch_lengths(skeleton: DataFrame, limit: int, image: str = "image_id") -> DataFrame:
    """Pixels from each endpoint along its chain, at most ``limit``."""
    runs = chains(skeleton, image)
    # A chain that ends in another endpoint stops before that endpoint's own pixel.
    sizes = runs.groupBy(image, "chain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "endpoint").alias("ends"))
    ends = runs.where(F.col("role") == "endpoint").select(image, "y", "x", "chain")
    reach = F.col("n") - F.when(F.col("ends") == 2, 1).otherwise(0)
    return attach(ends, sizes, [image, "chain"], grown=True).select(image, "y", "x", F.least(reach, F.lit(limit)).alias("length"))


def component_endpoints(skeleton: DataFrame, minimum: int, protected: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """Endpoints whose branch is long enough, or which are protected."""
    lengths = branch_lengths(skeleton, minimum, image)
    if protected is not None:
        marked = protected.select(image, "y", "x").distinct().withColumn("_p", F.lit(True))
        lengths = sorted_join(lengths, marked, [image, "y", "x"], "left")
        return lengths.where((F.col("length") >= minimum) | F.col("_p")).select(image, "y", "x")
    return lengths.where(F.col("length") >= minimum).select(image, "y", "x")


def chain_order(skeleton: DataFrame, image: str = "image_id") -> DataFrame:
    """Place of every chain pixel along its chain, by pointer doubling over the pixels.

    Each chain is walked from its smaller end pixel (its smallest pixel for a
    loop).  Every directed step (from, to) of a chain knows its predecessor, so
    distances to the start double each round: log2(longest chain) rounds, keyed
    by pixel pairs, nothing gathered per line.
    """
    runs = cut_lineage(chains(skeleton, image).select(image, "chain", "y", "x", pixel_key(F.col("y"), F.col("x")).alias("px")))
    links = pixel_links(runs.withColumnRenamed("px", "here"), runs.withColumnRenamed("px", "there"), image, "here", "there").select(image, "here", "there")
    links = cut_lineage(links)
    degree = links.groupBy(image, F.col("here").alias("px")).agg(F.count(F.lit(1)).alias("deg"))
    placed = sorted_join(runs, degree, [image, "px"], "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    starts = placed.groupBy(image, "chain").agg(F.coalesce(F.min(F.when(F.col("deg") <= 1, F.col("px"))), F.min("px")).alias("start"), F.max(F.col("deg") <= 1).alias("open"))
    starts = cut_lineage(starts)
    # Directed steps; the step before (a, b) is (z, a) with z the other neighbour of a.
    steps = links.select(image, F.col("here").alias("a"), F.col("there").alias("b"))
    before = links.select(image, F.col("here").alias("a"), F.col("there").alias("z"))
    owner = runs.select(image, F.col("px").alias("a"), "chain")
    steps = attach(sorted_join(steps, owner, [image, "a"]), starts, [image, "chain"], grown=True)
    first_hop = steps.where(F.col("a") == F.col("start")).groupBy(image, "chain").agg(F.min("b").alias("hop"))
    steps = attach(steps, first_hop, [image, "chain"], grown=True)
    at_start = F.col("a") == F.col("start")
    linked = sorted_join(steps, before, [image, "a"], "left").where(F.col("z").isNull() | (F.col("z") != F.col("b")) | at_start)
    linked = linked.groupBy(image, "chain", "a", "b", "start", "hop").agg(F.max(F.when(F.col("z") != F.col("b"), F.col("z"))).alias("z"))
    good_start = at_start & (F.col("b") == F.col("hop"))
    state = linked.select(
        image, "chain", "a", "b", F.when(at_start, F.lit(None).cast("bigint")).otherwise(F.col("z")).alias("pa"),
        F.when(at_start, F.lit(None).cast("bigint")).otherwise(F.col("a")).alias("pb"), F.lit(1).alias("hops"),
        F.when(at_start, good_start).alias("ok"))
    state = cut_lineage(state)
    while not state.where(F.col("ok").isNull() & F.col("pa").isNotNull()).isEmpty():
        far = state.select(image, F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("hops").alias("more"), F.col("ok").alias("pok"))
        jumped = sorted_join(state, far, [image, "pa", "pb"], "left")
        open_ = F.col("ok").isNull() & F.col("more").isNotNull()
        state = cut_lineage(jumped.select(
            image, "chain", "a", "b", F.when(open_, F.col("qa")).otherwise(F.lit(None)).alias("pa"), F.when(open_, F.col("qb")).otherwise(F.lit(None)).alias("pb"),
            F.when(open_, F.col("hops") + F.col("more")).otherwise(F.col("hops")).alias("hops"),
            F.when(open_, F.col("pok")).otherwise(F.col("ok")).alias("ok")))
    reached = state.where("ok").groupBy(image, F.col("b").alias("px")).agg(F.min("hops").alias("place"))
    joined = sorted_join(attach(runs, starts, [image, "chain"], grown=True), reached, [image, "px"], "left")
    return joined.select(image, "chain", "y", "x", F.when(F.col("px") == F.col("start"), F.lit(0)).otherwise(F.col("place")).alias("place"), "open")


def polylines(skeleton: DataFrame, image: str = "image_id") -> DataFrame:
    """SVG path per chain, its points in walking order (a path is bounded by one line of one sketch).

    Chains touching junctions are extended by them at the proper end; loops close on their start.
    """
    placed = cut_lineage(chain_order(skeleton, image))
    last = placed.groupBy(image, "chain").agg(F.max("place").alias("last"), F.first("open").alias("open"))
    nodes = skeleton_nodes(skeleton, image).where(F.col("role") == "junction")
    junctions = nodes.select(image, "y", "x", F.struct("x", "y").alias("node"))
    ends = attach(placed.select(image, "chain", "y", "x", "place"), last, [image, "chain"], grown=True).where(
        F.col("open") & ((F.col("place") == 0) | (F.col("place") == F.col("last"))))
    met = pixel_links(ends.withColumn("end", F.struct("chain", "place", "last")), junctions, image, "end", "node")
    caps = met.groupBy(image, F.col("end.chain").alias("chain"), F.col("end.place").alias("place"), F.col("end.last").alias("last")).agg(
        F.array_sort(F.collect_set("node")).alias("found"))
    lone = F.col("last") == 0
    head = F.when(F.col("place") == 0, F.col("found")[0])
    tail = F.when(lone & (F.size("found") > 1), F.element_at("found", -1)).when(~lone & (F.col("place") == F.col("last")), F.col("found")[0])
    caps = caps.groupBy(image, "chain").agg(F.max(head).alias("head"), F.max(tail).alias("tail"))
    lines = placed.groupBy(image, "chain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("body"),
        F.first("open").alias("open"))
    joined = sorted_join(lines, caps, [image, "chain"], "left")
    wrap = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    closing = F.when(~F.col("open") & (F.size("body") > 2), F.col("body")[0])
    points = F.concat(wrap(F.col("head")), F.col("body"), wrap(F.col("tail")), wrap(closing))
    return joined.select(image, "chain", points.alias("points"), g.svg_path(points).alias("path")).where(F.size("points") > 1)


def closed_groups(endpoints: DataFrame, connections: DataFrame, image: str = "image_id") -> DataFrame:
    """``closed`` per endpoint: every endpoint of its group takes part in a connection.

    Groups join endpoints of one line (``line_id``) and of one connection (a, b).
    """
    first = endpoints.groupBy(image, "line_id").agg(F.min("endpoint_id").alias("b"))
    by_line = attach(endpoints.select(image, "line_id", F.col("endpoint_id").alias("a")), first, [image, "line_id"]).select(image, "a", "b")
    known = endpoints.select(image, "endpoint_id").distinct()
    both = sorted_join(connections.select(image, "a", "b"), known.withColumnRenamed("endpoint_id", "a"), [image, "a"])
    both = sorted_join(both, known.withColumnRenamed("endpoint_id", "b"), [image, "b"]).select(image, "a", "b")
    roots = connect(by_line.unionByName(both), image).select(image, F.col("node").alias("endpoint_id"), "root")
    used = connections.select(image, F.explode(F.array("a", "b")).alias("endpoint_id")).distinct().withColumn("used", F.lit(True))
    rows = sorted_join(sorted_join(endpoints, roots, [image, "endpoint_id"], "left"), used, [image, "endpoint_id"], "left").withColumns(
        {"root": F.coalesce("root", "endpoint_id"), "used": F.coalesce("used", F.lit(False))})
    groups = rows.groupBy(image, "root").agg(F.bool_and("used").alias("closed"))
    return attach(rows, groups, [image, "root"], grown=True)


def allows_region_choice(images: DataFrame) -> Column:
    """Rule over per-image counts: lines, open_ends, open_ends_on_edge, regions, closed_lines."""
    edge_case = (F.col("lines") == 1) & (F.col("open_ends") == F.col("open_ends_on_edge"))
    ready = (F.col("open_ends") == 0) | edge_case
    single_closed = (F.col("lines") == 1) & (F.col("open_ends") == 0) & (F.col("closed_lines") == 1)
    return (F.col("lines") > 0) & ready & (F.col("regions") > 0) & ((F.col("regions") == 1) | single_closed)


def region_choice(images: DataFrame) -> DataFrame:
    """Adds ``has_choice``, ``usable`` (a closed region exists) and ``side`` (inside / outside / none)."""
    ready = (F.col("open_ends") == 0) | ((F.col("lines") == 1) & (F.col("open_ends") == F.col("open_ends_on_edge")))
    opened = (F.col("open_ends") > 0) | (F.col("closed_lines") < F.col("lines"))
    usable = (F.col("lines") > 0) & (F.col("regions") > 0) & ~(opened & ((F.col("regions") != 1) | ~ready))
    choice = allows_region_choice(images)
    side = F.when(~usable, "none").when((F.col("region_mode") == "outside") & choice, "outside").otherwise("inside")
    return images.withColumns({"has_choice": choice, "usable": usable, "side": side})


def fold_edits(log: DataFrame, image: str = "image_id") -> DataFrame:
    """Live segments of an edit log (op add / delete / mode): the last word per segment id counts."""
    edits = log.where(F.col("op").isin("add", "delete"))
    last = edits.groupBy(image, "segment_id").agg(F.max_by(F.struct("op", "payload", "seq"), "seq").alias("e"))
    return last.where(F.col("e.op") == "add").select(image, "segment_id", F.col("e.payload").alias("payload"), F.col("e.seq").alias("seq"))


def edit_modes(log: DataFrame, image: str = "image_id") -> DataFrame:
    """Region mode per image: the last valid one, ``inside`` by default."""
    good = (F.col("op") == "mode") & F.col("payload").isin("inside", "outside")
    return log.groupBy(image).agg(F.coalesce(F.max_by("payload", F.when(good, F.col("seq"))), F.lit("inside")).alias("region_mode"))


def check_connections(requests: DataFrame, points: DataFrame, candidates: DataFrame, image: str = "image_id") -> DataFrame:
    """Adds ``reason`` (NULL = accepted) to requested connections.

    ``requests``: a, b, control, tangent (structs); ``candidates``: id, bounds (point array).
    """
    ends = points.select(image, F.col("endpoint_id"))
    known = lambda s: ends.select(image, F.col("endpoint_id").alias(s)).distinct().withColumn(f"_{s}", F.lit(True))
    rows = requests.join(known("a"), [image, "a"], "left").join(known("b"), [image, "b"], "left").withColumn("id", pair_key(F.col("a"), F.col("b")))
    rows = rows.join(candidates.select(image, "id", "bounds"), [image, "id"], "left")
    held = F.col("bounds").isNotNull() & g.control_in_bounds(F.col("control.x"), F.col("control.y"), F.col("bounds"))
    # The texts of the five rejections.
    reason = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "Unknown endpoint id")
        .when(F.col("a") == F.col("b"), "Segment endpoints must be different")
        .when(F.col("control").isNull(), "Missing segment control point")
        .when(~F.coalesce(held, F.lit(False)), "Control point is outside the segment bounds")
        .when(F.col("tangent").isNull(), "Missing segment tangent"))
    return rows.withColumn("reason", reason).drop("_a", "_b", "bounds")


def sketch_tables(
    lines: DataFrame, skeleton: DataFrame, saved: DataFrame, minimum: int, k: int, limit: float, reach: int, width: Column, height: Column,
    image: str = "image_id", smallest: int = 40,
) -> dict[str, DataFrame]:
    """Lines, endpoints, connections and candidates of every sketch.

    ``lines``: set pixels of the drawn lines; ``skeleton``: their skeleton pixels.
    Endpoints of saved connections are protected: their branch stays, however short.
    """
    kept = saved.select(image, F.explode(F.array("a", "b")).alias("id")).select(image, g.endpoint_point(F.col("id")).alias("p"))
    protected = cut_lineage(kept.where(F.col("p").isNotNull()).select(image, F.col("p.y").alias("y"), F.col("p.x").alias("x")).distinct())
    labelled = label_components(lines.select(image, "y", "x"), image).withColumnRenamed("label", "line_id")
    areas = labelled.groupBy(image, "line_id").agg(F.count(F.lit(1)).alias("_area")).where(F.col("_area") >= smallest).drop("_area")
    labelled = cut_lineage(attach(labelled, areas, [image, "line_id"], grown=True))
    thin = sorted_join(skeleton.select(image, "y", "x"), labelled, [image, "y", "x"])
    visible = cut_lineage(prune_spurs(thin, minimum, protected, image))
    widths = stroke_width(labelled, thin, [image, "line_id"]).withColumn("stroke_width", F.greatest(F.lit(2.0), F.bround("width", 2))).drop("width")
    ends = sorted_join(component_endpoints(visible, minimum, protected, image), labelled, [image, "y", "x"])
    endpoints = cut_lineage(ends.select(
        image, "line_id", g.endpoint_id(F.col("x").cast("double"), F.col("y").cast("double")).alias("endpoint_id"), F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"), F.row_number().over(Window.partitionBy(image).orderBy("line_id", pixel_key(F.col("y"), F.col("x")))).alias("seq")))
    joined = valid_connections(saved, endpoints)
    groups = cut_lineage(closed_groups(endpoints, joined, image))
    per_line = groups.groupBy(image, "line_id").agg(F.count(F.lit(1)).alias("ends"), F.bool_and("closed").alias("closed"))
    table = sorted_join(widths, per_line, [image, "line_id"], "left").withColumns({
        "ends": F.coalesce("ends", F.lit(0)), "closed": F.coalesce("closed", F.lit(True))})
    active = groups.where(~F.col("used")).select(image, "endpoint_id", "x", "y", "seq")
    return {
        "lines": table.withColumn("color", F.when(F.col("closed"), "red").otherwise("blue")),
        "endpoints": groups, "active": active, "connections": joined,
        "candidates": connection_candidates(active, joined, k, limit, reach, width, height), "widths": segment_width(table, image),
        "visible": visible}
