"""Colours, presentation numbers and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(t: Column, stops: list[tuple[float, tuple[float, float, float]]]) -> Column:
    """Linear between colour stops (position, rgb), clamped at both ends: an array of three doubles."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    out = F.array(*[F.lit(c) for c in stops[-1][1]])
    for (a, low), (b, high) in reversed(list(zip(stops, stops[1:], strict=False))):
        k = (t - a) / (b - a)
        out = F.when(t <= b, F.array(*[F.lit(x) + k * (y - x) for x, y in zip(low, high, strict=True)])).otherwise(out)
    return out


HEAT = [(0.0, (0.0, 0.0, 1.0)), (0.25, (0.0, 1.0, 1.0)), (0.5, (0.0, 1.0, 0.0)), (0.75, (1.0, 1.0, 0.0)), (1.0, (1.0, 0.0, 0.0))]
TRAFFIC = [(0.0, (0.0, 1.0, 0.0)), (0.5, (1.0, 1.0, 0.0)), (1.0, (1.0, 0.0, 0.0))]


def heat(t: Column) -> Column:
    """Blue, cyan, green, yellow, red."""
    return ramp(t, HEAT)


def traffic_light(t: Column) -> Column:
    return ramp(t, TRAFFIC)


def hue(h: Column, s: float = 0.6, v: float = 0.95) -> Column:
    """The colour of a hue in turns, by saturation and value."""
    channel = lambda n: F.lit(v) - v * s * F.greatest(F.lit(0.0), F.least(F.pmod(n + h * 6, F.lit(6.0)), 4 - F.pmod(n + h * 6, F.lit(6.0)), F.lit(1.0)))
    return F.array(*[channel(F.lit(float(n))) for n in (5, 3, 1)])


def group_color(group_id: Column) -> Column:
    """Hues a golden section of a turn apart."""
    return hue(F.pmod(group_id * 0.618033988749895, F.lit(1.0)))


def mixed(base: Column, over: Column, share: float) -> Column:
    """base, tinted by a colour that may be null."""
    return F.when(over.isNull(), base).otherwise(F.zip_with(base, over, lambda a, b: a * (1 - share) + b * share))


def vertex_color(base: Column, group: Column, heated: Column, hovered: Column, selected: Column) -> Column:
    """What lies uppermost: heat over group over base, then tints for hover and selection. Null layers are passed over."""
    return mixed(mixed(F.coalesce(heated, group, base), hovered, 0.35), selected, 0.6)


def world_per_pixel(distance: Column, field_of_view: Column, height: Column) -> Column:
    """Length of a pixel at a distance from a camera whose vertical field of view is given in radians."""
    return 2 * distance * F.tan(field_of_view / 2) / height


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * srgb_to_linear(r) + 0.7152 * srgb_to_linear(g) + 0.0722 * srgb_to_linear(b)


def contrast(a: Column, b: Column) -> Column:
    """Ratio of two luminances, from 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def nice_step(x: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is no smaller than x."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    m = x / power
    return power * F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0)


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def safe_name(name: Column) -> Column:
    """Letters, digits, - and _ of any script; all else becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
