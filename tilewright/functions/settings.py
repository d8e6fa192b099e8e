"""Settings records: one table of bounds drives every parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import clamp_float, clamp_int, flag_value, parse_number

# Fixed values: (key, kind, default, low, high) per settings section.
CLUSTER_BOUNDS = (
    ("k", "int", 7, 3, 12),
    ("ore_l_min", "float", 56.0, 0, 100),
    ("ore_b_min", "float", 8.0, -30, 60),
    ("talc_l_max", "float", 30.0, 0, 80),
    ("min_component_area", "int", 70, 0, 5000),
    ("morph_radius", "int", 2, 0, 8),
    ("max_work_side", "int", 1300, 500, 2200),
    ("sample_pixels", "int", 90000, 10000, 300000),
)
TWO_STEP_BOUNDS = (
    ("matrix_subclusters", "int", 5, 2, 5),
    ("ore_boundary_shift", "float", 0.72, -1.0, 1.0),
    ("talc_dark_quantile", "float", 0.1, 0.05, 0.8),
    ("min_component_area", "int", 10, 0, 5000),
    ("morph_radius", "int", 1, 0, 8),
    ("edge_refinement_strength", "float", 1.0, 0.0, 1.0),
    ("edge_gradient_radius", "int", 1, 1, 8),
    ("edge_seed_erosion_radius", "int", 2, 0, 8),
    ("edge_transition_radius", "int", 3, 0, 12),
    ("edge_soft_delta_e", "float", 6.5, 1.0, 40.0),
    ("edge_min_region_area", "int", 100, 0, 5000),
    ("illumination_correction_strength", "float", 0.8, 0.0, 1.0),
    ("illumination_ore_erosion_radius", "int", 12, 0, 12),
    ("illumination_min_ore_area", "int", 5000, 0, 100000),
    ("illumination_outlier_quantile", "float", 0.1, 0.0, 0.35),
    ("illumination_max_delta_l", "float", 20.0, 0.0, 50.0),
    ("local_shadow_correction_strength", "float", 1.0, 0.0, 1.0),
    ("local_shadow_radius", "int", 66, 3, 120),
    ("local_shadow_max_delta_l", "float", 20.0, 0.0, 40.0),
    ("local_shadow_chroma_barrier", "float", 1.0, 0.0, 3.0),
    ("local_shadow_lightness_barrier", "float", 0.2, 0.0, 2.0),
    ("max_work_side", "int", 1300, 500, 2200),
    ("sample_pixels", "int", 90000, 10000, 300000),
)
SKETCH_BOUNDS = (
    ("endpoint_min_branch_length", "int", 40, 0, 200),
    ("connection_max_distance", "float", 300.0, 0, 3000),
    ("connection_neighbors_per_endpoint", "int", 4, 1, 12),
    ("angular_neighbors_per_endpoint", "int", 2, 0, 4),
)
CORRECTION_BOUNDS = (
    ("crop_excluded_talc_max_fraction", "float", 0.125, 0.0, 1.0),
    ("crop_min_area_ratio", "float", 0.50, 0.1, 1.0),
    ("crop_max_rotation_degrees", "int", 0, 0, 0),
    ("crop_sketch_erosion_radius", "int", 42, 0, 5000),
)
SECTIONS = {"clusters": CLUSTER_BOUNDS, "a2": TWO_STEP_BOUNDS, "sketch": SKETCH_BOUNDS, "correction": CORRECTION_BOUNDS}


def defaults(section: str) -> dict[str, float]:
    return {key: default for key, _, default, _, _ in SECTIONS[section]}


def numbers(params: Column) -> Column:
    """``map<string,string>`` to ``map<string,double>``; parse once, clamp per key afterwards."""
    return F.transform_values(params, lambda _, text: parse_number(text))


def parsed_fields(values: Column, section: str, prefix: str = "") -> list[Column]:
    """One bounded column per key of a number map (see :func:`numbers`)."""
    fields = []
    for key, kind, default, low, high in SECTIONS[section]:
        clamp = clamp_int if kind == "int" else clamp_float
        fields.append(clamp(values[key], default, low, high).alias(f"{prefix}{key}"))
    return fields


def parsed_settings(values: Column, section: str) -> Column:
    return F.struct(*parsed_fields(values, section))


def _object_at(document: Column, path: str) -> Column:
    """Raw text of a non-empty JSON object at ``path``, else NULL (an empty object counts as absent)."""
    raw = F.get_json_object(document, path)
    return F.when(F.trim(raw).rlike(r"^\{\s*\S") & ~F.trim(raw).rlike(r"^\{\s*\}$"), raw)


def section_text(document: Column, aliases: tuple[str, ...], target: str) -> Column:
    """First present alias, else ``settings`` when ``target`` names this section."""
    direct = [_object_at(document, f"$.{name}") for name in aliases]
    routed = F.when(F.get_json_object(document, "$.target") == target, _object_at(document, "$.settings"))
    return F.coalesce(*direct, routed)


def with_settings(rows: DataFrame, document: str, name: str = "settings") -> DataFrame:
    """Adds the full settings record parsed from saved JSON; invalid JSON gives the defaults.

    The JSON is parsed into number maps in a projection of its own, so the 31
    clamped fields read those maps instead of repeating the parse.
    """
    doc = F.col(document)
    valid = F.coalesce(F.trim(doc).rlike(r"(?s)^\{.*\}$") & F.get_json_object(doc, "$").isNotNull(), F.lit(False))
    as_map = lambda c: F.coalesce(
        numbers(F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,double>"))
    checked = rows.withColumn("_valid", valid).withColumn("_text", F.when(F.col("_valid"), doc))
    text = F.col("_text")
    maps = checked.withColumns({
        "_a2": as_map(section_text(text, ("a2", "approach"), "approach")),
        "_sketch": as_map(section_text(text, ("sketch",), "sketch")),
        "_correction": as_map(section_text(text, ("correction", "corrected"), "corrected")),
    })
    record = F.struct(
        *[parsed_settings(F.col(f"_{s}"), s).alias(s) for s in ("a2", "sketch", "correction")],
        flag_value(F.get_json_object(text, "$.excluded_from_exports")).alias("excluded_from_exports"),
        F.col("_valid").alias("customized"),
    )
    return maps.withColumn(name, record).drop("_valid", "_text", "_a2", "_sketch", "_correction")
