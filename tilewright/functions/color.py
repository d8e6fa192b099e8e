"""Colour conversions, palettes and overlays as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Palettes, overlay strengths and colour constants.
MASK_PALETTE = ((237, 28, 36), (255, 242, 0), (63, 72, 204), (136, 0, 21))
OVERLAY_COLORS = {"ore": (0, 245, 85), "matrix": (118, 126, 128), "talc": (0, 170, 255), "damage": (185, 0, 70)}
CORRECTED_COLORS = {"ore": (255, 40, 40), "matrix": (118, 126, 128), "talc": (0, 170, 255), "damage": (185, 0, 70)}
OVERLAY_ALPHA = {"ore": 0.65, "matrix": 0.12, "talc": 0.62, "damage": 0.68}
HEAT_STOPS = ((16, 185, 129), (250, 204, 21), (220, 38, 38))
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE_D65 = (0.95047, 1.0, 1.08883)


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray by the BT.601 weights in 14-bit fixed point."""
    return F.shiftright((r * 4899 + g * 9617 + b * 1868 + 8192).cast("int"), 14)


def with_lab(pixels: DataFrame, channels=("r", "g", "b"), names=("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Adds CIELab (D65) of 8-bit sRGB.

    Each stage is a projection of its own: values used several times are computed
    once, and the generated code stays small.
    """
    def linear(channel: Column) -> Column:
        c = channel / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)

    light = pixels.withColumns({f"_lin{i}": linear(F.col(c)) for i, c in enumerate(channels)})
    xyz = light.withColumns({
        f"_xyz{i}": (F.col("_lin0") * m[0] + F.col("_lin1") * m[1] + F.col("_lin2") * m[2]) / w
        for i, (m, w) in enumerate(zip(RGB_TO_XYZ, WHITE_D65))})
    curved = xyz.withColumns({f"_f{i}": bent(F.col(f"_xyz{i}")) for i in range(3)})
    x, y, z = (F.col(f"_f{i}") for i in range(3))
    lab = dict(zip(names, (y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0)))
    return curved.withColumns(lab).drop(*[f"{s}{i}" for s in ("_lin", "_xyz", "_f") for i in range(3)])


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB of CIELab, clipped and truncated."""
    fy = (lightness + 16.0) / 116.0
    fx = a / 500.0 + fy
    fz = F.greatest(fy - b / 200.0, F.lit(0.0))

    def unbent(t: Column) -> Column:
        return F.when(t > 0.2068966, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)

    x, y, z = (unbent(t) * w for t, w in zip((fx, fy, fz), WHITE_D65))
    # Inverse of RGB_TO_XYZ, rounded to six digits.
    rows = ((3.240481, -1.537152, -0.498536), (-0.969255, 1.875990, 0.041556), (0.055647, -0.204041, 1.057311))

    def encode(c: Column) -> Column:
        curved = F.when(c > 0.0031308, F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(c * 12.92)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), curved * 255.0)).cast("int")

    return tuple(encode(F.greatest(x * m[0] + y * m[1] + z * m[2], F.lit(0.0))) for m in rows)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179, saturation and value 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    degrees = (
        F.when(spread == 0, F.lit(0.0))
        .when(top == r, (g - b) / spread * 60.0)
        .when(top == g, (b - r) / spread * 60.0 + 120.0)
        .otherwise((r - g) / spread * 60.0 + 240.0)
    )
    degrees = F.when(degrees < 0, degrees + 360.0).otherwise(degrees)
    hue = F.floor(degrees / 2.0 + 0.5).cast("int") % 180
    saturation = F.when(top == 0, F.lit(0)).otherwise(F.floor(spread * 255.0 / top + 0.5).cast("int"))
    return hue, saturation, top


def is_sketch_blue(r: Column, g: Column, b: Column) -> Column:
    hue, saturation, value = rgb_to_hsv(r, g, b)
    return hue.between(95, 135) & (saturation > 70) & (value > 45)


def pick(key: Column, table: dict, default=None) -> Column:
    """Lookup in a fixed, tiny table as a CASE expression (no join, no shuffle)."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def mask_color(index: Column) -> tuple[Column, Column, Column]:
    bounded = F.greatest(F.lit(0), F.least(F.lit(len(MASK_PALETTE) - 1), index))
    return tuple(pick(bounded, {i: rgb[c] for i, rgb in enumerate(MASK_PALETTE)}) for c in range(3))


def class_overlay(rgb: tuple[Column, Column, Column], name: Column, colors=None) -> tuple[Column, ...]:
    """Image channel mixed with the class colour (floating point, not rounded)."""
    colors = colors or OVERLAY_COLORS
    alpha = pick(name, OVERLAY_ALPHA, 0.0)
    return tuple(
        channel * (F.lit(1.0) - alpha) + pick(name, {k: float(v[c]) for k, v in colors.items()}, 0.0) * alpha
        for c, channel in enumerate(rgb)
    )


def to_byte(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)).cast("int")


def corrected_overlay(rgb, name: Column, in_crop: Column) -> tuple[Column, ...]:
    inside = class_overlay(rgb, name, CORRECTED_COLORS)
    return tuple(to_byte(F.when(in_crop, mixed).otherwise(channel * 0.3)) for channel, mixed in zip(rgb, inside))


def heat_color(probability: Column) -> tuple[Column, ...]:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))
    low, mid, high = HEAT_STOPS
    return tuple(
        F.when(p <= 0.5, F.lit(float(low[c])) + F.lit(float(mid[c] - low[c])) * (p / 0.5))
        .otherwise(F.lit(float(mid[c])) + F.lit(float(high[c] - mid[c])) * ((p - 0.5) / 0.5)).cast("int")
        for c in range(3)
    )


def heat_blend(rgb, probability: Column, covered: Column) -> tuple[Column, ...]:
    """Heat colour over the image where at least one accepted tile covers the pixel."""
    return tuple(
        F.when(covered, (channel * 0.45 + heat * 0.55).cast("int")).otherwise(channel)
        for channel, heat in zip(rgb, heat_color(probability))
    )


def ore_score(lightness: Column, b: Column) -> Column:
    return lightness + b * 0.55


def boundary_score(to_ore: Column, to_matrix: Column) -> Column:
    return (to_matrix - to_ore) / (to_matrix + to_ore + 1e-6)


def is_ore(to_ore: Column, to_matrix: Column, shift: float = 0.72) -> Column:
    return boundary_score(to_ore, to_matrix) >= -shift
