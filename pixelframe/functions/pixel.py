"""Scalar functions on pixel columns: color conversion, thresholds, depth, distances, narrowing to eight bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer luma weights out of 256.
LUMA = (77, 150, 29)


def gray(r: Column, g: Column, b: Column, weights: tuple[int, int, int] = LUMA) -> Column:
    """Integer luma, (77 r + 150 g + 29 b) >> 8 unless other weights (out of 256) are given."""
    return F.shiftright(weights[0] * r + weights[1] * g + weights[2] * b, 8).cast("int")


def gray_float(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> Column:
    """Rounded luma with fractional weights, as computer-vision libraries define it."""
    return F.floor(weights[0] * r + weights[1] * g + weights[2] * b + 0.5).cast("int")


def threshold(v: Column, t: Column | int, above: int = 255, below: int = 0) -> Column:
    """`above` where v is strictly greater than t, else `below`."""
    return F.when(v > t, above).otherwise(below)


def to_8_bit(v: Column) -> Column:
    """16-bit depth to 8: the high byte."""
    return F.shiftright(v, 8).cast("int")


def to_16_bit(v: Column) -> Column:
    """8-bit depth to 16: the byte twice."""
    return (v * 257).cast("int")


def narrow(v: Column, overflow: str = "wrap") -> Column:
    """A magnitude as eight bits: its low byte ("wrap") or its value up to 255 ("saturate"). Fractions are cut off."""
    whole = F.floor(F.abs(v)).cast("int")
    if overflow == "wrap":
        return whole.bitwiseAND(F.lit(255))
    if overflow == "saturate":
        return F.least(whole, F.lit(255))
    raise ValueError(f"overflow is 'wrap' or 'saturate', not {overflow!r}")


def _minus(v: Column, to: Column | float) -> Column:
    """The difference, BIGINT for whole numbers of any size, so that its square fits; fractions stay doubles."""
    return v - (F.lit(to) + F.lit(0).cast("bigint"))


def color_distance(r: Column, g: Column, b: Column, to: tuple) -> Column:
    """Squared distance of colors, summed in the order r, b, g so that doubles are the same each time."""
    dr, dg, db = _minus(r, to[0]), _minus(g, to[1]), _minus(b, to[2])
    return dr * dr + db * db + dg * dg


def spatial_distance(x: Column, y: Column, to: tuple) -> Column:
    """Squared distance of places."""
    dx, dy = _minus(x, to[0]), _minus(y, to[1])
    return dx * dx + dy * dy


def channels(source: int, target: int, columns: list[Column]) -> list[Column]:
    """Convert between 1 (gray), 2 (gray, alpha), 3 (RGB) and 4 (RGBA) channels: gray is repeated, colors are weighed,
    alpha is dropped or set to 255."""
    if len(columns) != source or not (1 <= source <= 4 and 1 <= target <= 4):
        raise ValueError("channels are 1 to 4, and there is one column for each source channel")
    alpha = columns[source - 1] if source in (2, 4) else F.lit(255)
    color = [columns[0]] * 3 if source < 3 else columns[:3]
    light = columns[0] if source < 3 else gray(*columns[:3])
    return {1: [light], 2: [light, alpha], 3: color, 4: [*color, alpha]}[target]
