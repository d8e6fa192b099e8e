"""Boxes, grids and sketch geometry as expressions on scalars and point arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL_SIDE = 512  # fixed value: side of the global view


def round2(value: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(value * 100.0) / 100.0


def window_starts(length: Column, window: int, stride: int) -> Column:
    """Starts of sliding windows; the last one is flush with the end, short inputs give one window."""
    last = length - window
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"), F.lit(stride))
    return F.when(length <= window, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(regular, F.array(last.cast("int")))))


def mirrored_targets(index: Column, before: Column, after: Column, size: Column) -> Column:
    """All positions of a reflect-padded axis (edge not repeated) that show source ``index``.

    Reflection has period ``2 * (size - 1)``, so each pixel emits its own copies
    and padding needs no join.
    """
    total = (size + before + after).cast("int")
    period = F.greatest((size - 1) * 2, F.lit(1)).cast("int")
    turns = F.sequence(F.lit(0), F.floor((total - 1) / period + 1).cast("int"))
    direct = (before + index) % period
    mirror = F.pmod(before - index, period)
    both = F.array_distinct(F.concat(
        F.transform(turns, lambda t: (direct + t * period).cast("int")),
        F.transform(turns, lambda t: (mirror + t * period).cast("int")),
    ))
    whole = F.sequence(F.lit(0), total - 1)
    return F.when(size == 1, whole).otherwise(F.filter(both, lambda p: p < total))


def scaled_targets(index: Column, source: Column, target: Column) -> Column:
    """Target positions whose nearest source position is ``index`` (narrow resize, no join)."""
    first = F.ceil(index * target / source).cast("int")
    stop = F.ceil((index + 1) * target / source).cast("int")
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))


def global_roi(x0: Column, y0: Column, patch_w, patch_h, width: Column, height: Column) -> tuple[Column, ...]:
    """Patch box in unit coordinates of the letterboxed global view."""
    side = F.lit(float(GLOBAL_SIDE))
    scale = side / F.greatest(width, height)
    shift_x, shift_y = (side - width * scale) / 2.0, (side - height * scale) / 2.0
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return (
        unit((shift_x + x0 * scale) / side), unit((shift_y + y0 * scale) / side),
        unit((shift_x + (x0 + patch_w) * scale) / side), unit((shift_y + (y0 + patch_h) * scale) / side),
    )


def letterbox(width: Column, height: Column, side: int = GLOBAL_SIDE) -> tuple[Column, Column, Column, Column]:
    """Resized width and height and the offsets that centre them on a square canvas."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w = F.greatest(F.lit(1), F.rint(width * scale).cast("int"))
    h = F.greatest(F.lit(1), F.rint(height * scale).cast("int"))
    return w, h, F.floor((F.lit(side) - w) / 2).cast("int"), F.floor((F.lit(side) - h) / 2).cast("int")


def scaled_box(left, top, right, bottom, source_w, source_h, target_w, target_h) -> tuple[Column, ...]:
    """Half-open box at another scale: floor/ceil outwards, at least one pixel, inside the target."""
    sx, sy = target_w / source_w.cast("double"), target_h / source_h.cast("double")
    x0 = F.greatest(F.lit(0), F.least(target_w - 1, F.floor(left * sx).cast("int")))
    y0 = F.greatest(F.lit(0), F.least(target_h - 1, F.floor(top * sy).cast("int")))
    x1 = F.greatest(x0 + 1, F.least(target_w, F.ceil(right * sx).cast("int")))
    y1 = F.greatest(y0 + 1, F.least(target_h, F.ceil(bottom * sy).cast("int")))
    return x0, y0, x1, y1


def roi_cells(u0: Column, u1: Column, cells: Column) -> tuple[Column, Column]:
    """Half-open cell range of a unit interval, at least one cell."""
    start = F.greatest(F.lit(0), F.least(cells - 1, F.floor(u0 * cells).cast("int")))
    return start, F.greatest(start + 1, F.least(cells, F.ceil(u1 * cells).cast("int")))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def endpoint_id(x: Column, y: Column) -> Column:
    return F.concat(F.lit("e_"), F.rint(x).cast("bigint").cast("string"), F.lit("_"), F.rint(y).cast("bigint").cast("string"))


def endpoint_point(identifier: Column) -> Column:
    """Inverse of :func:`endpoint_id`; NULL for anything that is not an endpoint id."""
    parts = F.split(identifier, "_")
    x, y = parts[1].try_cast("int"), parts[2].try_cast("int")
    good = (F.size(parts) == 3) & (parts[0] == "e") & x.isNotNull() & y.isNotNull()
    return F.when(good, F.struct(x.alias("x"), y.alias("y")))


def svg_path(points: Column) -> Column:
    """``M x y L x y ...`` for an array of struct(x, y)."""
    pieces = F.transform(points, lambda p, i: F.concat(
        F.when(i == 0, "M ").otherwise("L "), p["x"].cast("string"), F.lit(" "), p["y"].cast("string")))
    return F.array_join(pieces, " ")


def svg_points(path: Column) -> Column:
    numbers = F.regexp_extract_all(path, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    pairs = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    return F.when(F.size(numbers) < 2, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.transform(pairs, lambda i: F.struct(
            F.get(numbers, i * 2).cast("double").alias("x"), F.get(numbers, i * 2 + 1).cast("double").alias("y"))))


def _next(points: Column) -> Column:
    return F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))


def _segments(points: Column) -> Column:
    """Array of (start, end, length) for consecutive points."""
    return F.transform(
        F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), _next(points).alias("b")),
        lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"),
                           hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("d")))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used: inside lambdas Spark shares no expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def polyline_length(points: Column) -> Column:
    return F.aggregate(_segments(points), F.lit(0.0), lambda total, s: total + s["d"])


def polyline_midpoint(points: Column) -> Column:
    """Point at half of the travelled length, two decimals."""
    def along(points: Column, segments: Column, half: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

        def step(state, s):
            reached = state["x"].isNull() & (state["done"] + s["d"] >= half) & (s["d"] > 1e-9)
            part = (half - state["done"]) / s["d"]
            return F.struct(
                (state["done"] + s["d"]).alias("done"),
                F.when(reached, round2(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * part)).otherwise(state["x"]).alias("x"),
                F.when(reached, round2(s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * part)).otherwise(state["y"]).alias("y"))

        first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
        return _once(F.aggregate(segments, start, step), lambda found: F.when(half * 2 <= 1e-9, first).when(found["x"].isNull(), last).otherwise(
            F.struct(found["x"].alias("x"), found["y"].alias("y"))))

    def placed(points: Column) -> Column:
        return _once(_segments(points), lambda segments: _once(
            F.aggregate(segments, F.lit(0.0), lambda total, s: total + s["d"]) / 2.0, lambda half: along(points, segments, half)))

    empty = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.when(F.size(points) == 0, empty).otherwise(_once(points, placed))


def without_repeats(points: Column) -> Column:
    """Points at two decimals with consecutive repeats removed."""
    rounded = F.transform(points, lambda p: F.struct(round2(p["x"]).alias("x"), round2(p["y"]).alias("y")))
    return F.filter(rounded, lambda p, i: (i == 0) | (
        (F.abs(p["x"] - F.get(rounded, i - 1)["x"]) > 1e-6) | (F.abs(p["y"] - F.get(rounded, i - 1)["y"]) > 1e-6)))


def _edges(points: Column) -> Column:
    """Closed polygon edges as (previous, current)."""
    rotated = F.concat(F.slice(points, F.lit(-1), F.lit(1)), F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))))
    return F.arrays_zip(rotated.alias("p"), points.alias("c"))


def polygon_area(points: Column) -> Column:
    """Signed shoelace area; fewer than three points have none."""
    doubled = F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["c"]["y"] - e["c"]["x"] * e["p"]["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(doubled / 2.0)


def bounds_degenerate(points: Column) -> Column:
    return (F.size(points) < 3) | (F.abs(polygon_area(points)) <= 1e-6)


def on_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    cross = (px - a["x"]) * dy - (py - a["y"]) * dx
    along = (px - a["x"]) * dx + (py - a["y"]) * dy
    return (F.abs(cross) <= 1e-6) & (along >= -1e-6) & (along <= dx * dx + dy * dy + 1e-6)


def in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Inside by crossing parity, or on an edge."""
    edges = _edges(points)

    def crosses(e):
        cur, prev = e["c"], e["p"]
        at = (prev["x"] - cur["x"]) * (py - cur["y"]) / (prev["y"] - cur["y"] + 1e-12) + cur["x"]
        return ((cur["y"] > py) != (prev["y"] > py)) & (px <= at + 1e-9)

    parity = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
    touching = F.exists(edges, lambda e: on_segment(px, py, e["p"], e["c"]))
    return (F.size(points) >= 3) & (touching | parity)


def control_in_bounds(px: Column, py: Column, bounds: Column) -> Column:
    first, second = F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))
    return (
        F.when(F.size(bounds) == 1, hypot(px - first["x"], py - first["y"]) <= 1e-6)
        .when(F.size(bounds) == 2, on_segment(px, py, first, second)).otherwise(in_polygon(px, py, bounds))
    )


def midpoint_curve(a: Column, middle: Column, tangent: Column, b: Column, steps: int = 64) -> Column:
    """Cubic through ``middle`` at t = 1/2 with the given tangent, sampled at ``steps + 1`` points."""
    def controls(axis: str):
        total = (middle[axis] * 8.0 - a[axis] - b[axis]) / 3.0
        delta = tangent[axis] * (4.0 / 3.0) - (b[axis] - a[axis])
        return F.struct(a[axis].alias("a"), ((total - delta) / 2.0).alias("first"), ((total + delta) / 2.0).alias("second"), b[axis].alias("b"))

    def at(t: Column, own: Column) -> Column:
        u = F.lit(1.0) - t
        return round2(u * u * u * own["a"] + u * u * t * 3.0 * own["first"] + u * t * t * 3.0 * own["second"] + t * t * t * own["b"])

    return _once(F.struct(controls("x").alias("x"), controls("y").alias("y")), lambda own: F.transform(
        F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(at(i / float(steps), own["x"]).alias("x"), at(i / float(steps), own["y"]).alias("y"))))


def edge_tolerance(width: Column, height: Column, share: float = 0.015) -> Column:
    return F.greatest(F.lit(2.0), F.least(width, height) * share)


def on_image_edge(x: Column, y: Column, width: Column, height: Column, share: float = 0.015) -> Column:
    tol = edge_tolerance(width, height, share)
    near = (F.abs(x) <= tol) | (F.abs(x - width) <= tol) | (F.abs(y) <= tol) | (F.abs(y - height) <= tol)
    return x.between(-tol, width + tol) & y.between(-tol, height + tol) & near


def on_or_outside_edge(x: Column, y: Column, width: Column, height: Column) -> Column:
    tol = edge_tolerance(width, height)
    return (x <= tol) | (x >= width - tol) | (y <= tol) | (y >= height - tol)


def endpoint_on_edge(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Nearest image side within one percent of the shorter side (two pixels at least)."""
    nearest = F.least(F.abs(x), F.abs(x - width), F.abs(y), F.abs(y - height))
    return nearest <= edge_tolerance(width, height, 0.01)


def uses_perimeter(cx: Column, cy: Column, tx: Column, ty: Column, width: Column, height: Column) -> Column:
    """A control on the image edge whose handle leaves the image follows the perimeter."""
    leaves = on_or_outside_edge(cx + tx / 4.0, cy + ty / 4.0, width, height) | on_or_outside_edge(
        cx - tx / 4.0, cy - ty / 4.0, width, height)
    return on_image_edge(cx, cy, width, height) & leaves
